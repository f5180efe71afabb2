"""Suffix arrays by linear grouping.

Suffixes are kept in groups that share a prefix, at first their first character. Groups
are taken in descending order. For the suffixes of a group, the pointer to the previous
smaller suffix (the nearest position before it in a lower group) says whose prefix the
group's prefix continues; suffixes that are pointed at rise above the others of their group,
those pointed at more often higher. Each ends in the group of its longest Lyndon prefix.
A second pass then emits every group's suffixes in order: when a suffix is placed, the
suffixes whose next smaller suffix it is take the next places of their groups. No ranks are
recomputed and no smaller string is solved.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of an array of non-negative integers."""
    n = len(text) + 1  # the end mark is the least suffix, at position n - 1
    t = np.zeros(n, np.int64)
    t[:-1] = np.asarray(text, np.int64) + 1
    order = np.argsort(t, kind="stable")
    ordered = t[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    start_of = np.repeat(first, np.diff([*first, n]))
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    group_at = np.empty(n, np.int64)
    group_at[order] = start_of
    room = np.zeros(n, np.int64)
    room[first] = np.diff([*first, n])

    sa, place, group, size = order.tolist(), at.tolist(), group_at.tolist(), room.tolist()
    prev = [-1] * n
    end = n - 1
    while end > 0:
        start = group[sa[end]]
        if start == end:  # a group of one
            i = sa[end]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                k = size[g] - 1
                if k:
                    size[g] = k
                    k += g
                    q = sa[k]
                    p = place[j]
                    sa[p] = q
                    place[q] = p
                    sa[k] = j
                    place[j] = k
                    group[j] = k
                    size[k] = 1
            end = start - 1
            continue
        counts: dict[int, int] = {}
        for i in sorted(sa[start : end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        end = start - 1
        if not counts:
            continue
        most = max(counts.values())
        if most == 1:
            levels = [list(counts)]
        else:
            by: dict[int, list[int]] = {}
            for j, c in counts.items():
                by.setdefault(c, []).append(j)
            levels = [by[c] for c in sorted(by, reverse=True)]
        for level in levels:
            # those pointed at equally often move together to the end of their group
            for j in level:
                g = group[j]
                k = size[g] - 1
                size[g] = k
                k += g
                q = sa[k]
                p = place[j]
                sa[p] = q
                place[q] = p
                sa[k] = j
                place[j] = k
            starts = [group[j] + size[group[j]] for j in level]
            for j, k in zip(level, starts):
                group[j] = k
                size[k] += 1

    # emit: the end mark first; a placed suffix calls those whose next smaller suffix it is
    out = [0] * n
    filled = [0] * n
    out[0] = n - 1
    prev[n - 1] = -1
    for r in range(n):
        j = out[r]
        stop = prev[j]
        i = j - 1
        while i != stop and i >= 0:
            g = group[i]
            out[g + filled[g]] = i
            filled[g] += 1
            i = prev[i]
    return np.array(out[1:], np.int64)
