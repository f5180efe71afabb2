"""Repeated passages: bytes covered by a 50-byte string that a smaller document also holds.

Documents go into frames (batches of texts). In every text, anchors are chosen by its
content: of every 50-byte string at least one 20-byte string within it, the one of least
hash, so equal strings have equal anchors wherever they stand. Then, in buckets by the
anchor's hash:

1. Frames send their different anchors; anchors that only one document holds are told off.
   This settles which parts of a text can repeat at all.
2. Of the others frames send the anchor's surroundings, 80 bytes that hold every 50-byte
   string of that anchor; equal ones of a frame go once, with the smallest document. A
   bucket folds equal surroundings, trims each to what it has in common with another one
   and builds a suffix array by linear grouping (:mod:`suffix_array`) over the different
   ones left. Runs of suffixes that agree in 50 bytes have the same smallest document, and
   the strings of a larger document are repeats.

Where an anchor has very many different surroundings (at the edge of a passage that a third
of all documents hold, say), one array over them would grow with the corpus. Groups of more
than ``LARGE`` are cut: the strings that start in the first half of the places around the
anchor, and those of the second half, go apart, each grouped by the bytes that all strings of
the half hold, and halves of halves where a group is still large. Equal strings still meet;
at one start, all strings of a group are equal. From about ``WIDE`` entries on, which frames
count in step 1, the strings of the anchor are sent one by one and dealt by themselves.

What a bucket returns is one bit a string, by frame; frames cut the bytes out. Texts move
three times, anchors as four bytes each, and no pairs are listed. Equal surroundings are
folded before the shuffle, so a group of copies sends one a frame.

Defined cases: null and empty texts have nothing to remove; texts under 50 bytes match
nothing; documents that repeat an id are not smaller than each other; a null id is above
all others; strings are judged on the input; texts may hold any characters; an empty table
gives no rows; a very long text is a frame of its own, held whole in one task, about 30 bytes
of memory a byte; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, partitions, written
from .minhash import mixed
from .suffix_array import suffix_array

LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR
AROUND = 2 * LENGTH - ANCHOR
STARTS = SIDE + 1
FRAME = 1 << 21
BUCKET = 1 << 25  # bytes of text whose anchors one bucket holds, about
SLICE = 1 << 15  # entries of a bucket that are judged at once, about
LARGE = 1 << 11  # different surroundings of an anchor in one suffix array, at most
WIDE = 1 << 19
FEW = 8  # a frame with fewer different surroundings of an anchor counts one
SA_BATCH = 1 << 18
NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(10)
_BYTE = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_R = 0x9E3779B1
_W = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
#: One entry: what is sent of an anchor's surroundings.
ENTRY = np.dtype([("h", "<u8"), ("x", "<u8"), ("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("raw", "u1", AROUND)])


def _frames(batches):
    """Texts in frames of about FRAME bytes, compressed."""
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    z, task, k = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0

    def frame(docs, texts):
        nonlocal k
        k += 1
        row = [(task << 32) | k, docs, [len(t) for t in texts], z.compress(np.concatenate([*texts, np.zeros(0, np.uint8)]).tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["frame", "docs", "sizes", "data"])

    docs, texts, held = [], [], 0
    for b in batches:
        for doc, raw in zip(b.column("doc_id").to_pylist(), byte_rows(b.column("text"))):
            docs.append(NO_ID if doc is None else doc)
            texts.append(np.array(raw) if raw is not None else np.zeros(0, np.uint8))
            held += len(texts[-1])
            if held >= FRAME:
                yield frame(docs, texts)
                docs, texts, held = [], [], 0
    if docs:
        yield frame(docs, texts)


class Frame:
    """The texts of a frame in one buffer, LENGTH zero bytes apart, and their anchors."""

    def __init__(self, docs, sizes, data: bytes):
        import zstandard

        self.docs, self.sizes = np.array(docs, np.int64), np.array(sizes, np.int64)
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if self.sizes.sum() else np.zeros(0, np.uint8)
        ends = np.cumsum(self.sizes)
        self.starts = LENGTH + ends - self.sizes + LENGTH * np.arange(len(self.sizes))
        self.buf = np.zeros(int(self.sizes.sum()) + LENGTH * (len(self.sizes) + 1) + 16, np.uint8)
        for a, n, e in zip(self.starts.tolist(), self.sizes.tolist(), ends.tolist()):
            self.buf[a : a + n] = flat[e - n : e]
        places = [np.zeros(0, np.int64)]
        at = 0
        while at < len(self.sizes):  # by parts that stay in the processor's cache
            end, size = at, 0
            while end < len(self.sizes) and (end == at or size < 1 << 17):
                size += int(self.sizes[end])
                end += 1
            places.append(self._anchors(at, end))
            at = end
        self.places = np.concatenate(places)
        self.doc = np.searchsorted(self.starts, self.places, side="right") - 1
        words = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))
        p = self.places
        self.hash = mixed(words[p] * _W[0] ^ mixed(words[p + 8] * _W[1] ^ mixed(words[p + ANCHOR - 8] * _W[2])))
        self.words = words

    def _anchors(self, first: int, end: int) -> np.ndarray:
        base = int(self.starts[first]) - LENGTH
        b = self.buf[base : int(self.starts[end - 1] + self.sizes[end - 1]) + LENGTH]
        power = lambda n: np.uint32(pow(_R, n, 1 << 32))
        h = _BYTE[b]
        sums = {1: h}
        for n in (1, 2, 4, 8):
            h = h[:-n] + h[n:] * power(n)
            sums[2 * n] = h
        v = h[: len(b) - ANCHOR + 1] + sums[4][16 : 16 + len(b) - ANCHOR + 1] * power(16)
        v = (v ^ (v >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v |= np.uint32(1)
        least = _slide(v, STARTS, np.minimum)  # of every 50-byte string
        for a, n in zip((self.starts[first:end] - base).tolist(), self.sizes[first:end].tolist()):
            least[max(0, a - LENGTH) : a] = 0  # strings that begin before a text
            least[max(a, a + n - LENGTH + 1) : a + n] = 0  # and those that end after it
        least[max(0, len(b) - LENGTH - LENGTH + 1) :] = 0
        most = _slide(np.concatenate([np.zeros(SIDE, np.uint32), least, np.zeros(len(v) - len(least), np.uint32)]), STARTS, np.maximum)
        return np.flatnonzero(most[: len(v)] == v) + base

    def own_bucket(self, buckets: int) -> np.ndarray:
        return _bucket(self.hash, buckets)

    def short(self) -> np.ndarray:
        return (self.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def left(self, k) -> np.ndarray:
        return np.minimum(SIDE, self.places[k] - self.starts[self.doc[k]])

    def right(self, k) -> np.ndarray:
        d = self.doc[k]
        return np.minimum(SIDE, self.starts[d] + self.sizes[d] - self.places[k] - ANCHOR)

    def whole(self, k) -> dict:
        """Anchors as items: what is sent of an anchor, dealt by the anchor."""
        return {"k": k, "h": self.hash[k], "left": self.left(k), "right": self.right(k), "cut": np.zeros(len(k), bool)}

    def _raw(self, k) -> np.ndarray:
        return self.buf[(self.places[k] - SIDE)[:, None] + np.arange(AROUND)]

    def strings(self, k) -> dict:
        """Every string around anchors as an item, dealt by itself."""
        k, start = np.repeat(k, STARTS), np.tile(np.arange(STARTS), len(k))
        ok = (start >= SIDE - self.left(k)) & (start <= self.right(k))
        k, start = k[ok], start[ok]
        return {"k": k, "h": _mix(_only(self._raw(k), start, start + LENGTH), start.astype(np.uint64) * _W[12]), "left": SIDE - start, "right": start, "cut": np.ones(len(k), bool)}

    def entries(self, items: dict) -> tuple[np.ndarray, np.ndarray]:
        """The different surroundings of some items, and of each item its surroundings' number."""
        k, cut = items["k"], items["cut"]
        e = np.zeros(len(k), ENTRY)
        e["h"], e["left"], e["right"], e["doc"] = items["h"], items["left"], items["right"], self.docs[self.doc[k]]
        p = self.places[k] - SIDE
        raw = lambda at: _only(self._raw(k[at]), SIDE - e["left"][at].astype(np.int64), LENGTH + e["right"][at].astype(np.int64))
        words = raw(cut).view("<u8")
        x = e["left"].astype(np.uint64) * _W[10] + e["right"].astype(np.uint64) * _W[11]
        for j in range(AROUND // 8):
            w = self.words[p + 8 * j]
            w[cut] = words[:, j]
            x = mixed(x + w * _W[j])
        e["x"] = x
        order = np.lexsort((e["doc"], x, e["h"]))
        new = np.ones(len(k), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (e["h"][order][1:] != e["h"][order][:-1])
        number = np.empty(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        kept = order[new]
        out = e[kept]
        out["raw"] = raw(kept)
        return out, number


def _slide(v: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n neighbours; shorter by n - 1."""
    m, w = v, 1
    while 2 * w <= n:
        m = f(m[:-w], m[w:])
        w *= 2
    return f(m[: len(m) - (n - w)], m[n - w :]) if n > w else m


def _only(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of bytes with all but columns ``first`` to ``last`` - 1 set to zero, in place."""
    column = np.arange(raw.shape[1])
    raw[(column < first[:, None]) | (column >= last[:, None])] = 0
    return raw


def _mix(raw: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes of rows of bytes."""
    words = np.ascontiguousarray(raw).view("<u8")
    for j in range(words.shape[1]):
        x = mixed(x + words[:, j] * _W[j])
    return x


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _send_anchors(buckets: int):
    def run(frames):
        import pandas as pd
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                f = Frame(r.docs, r.sizes, r.data)
                bucket, short = f.own_bucket(buckets), f.short()
                own = f.docs[f.doc]
                order = np.lexsort((own, short, bucket))
                b, s, d = bucket[order], short[order], own[order]
                new = np.ones(len(order), bool)
                new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
                heads = np.flatnonzero(new)
                last = np.append(heads[1:], len(order)) - 1
                several = d[heads] != d[last]
                # of anchors that occur often, how many surroundings differ
                group = np.cumsum(new) - 1
                often = np.flatnonzero((last - heads + 1 >= FEW)[group])
                _, number = f.entries(f.whole(order[often]))
                _, at = np.unique(number, return_index=True)
                differ = np.bincount(group[often][at], minlength=len(heads))
                cuts = np.searchsorted(b[heads], np.arange(buckets + 1))
                rows = []
                for k, (a, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    if e > a:
                        many = np.flatnonzero(differ[a:e] >= FEW)
                        counts = np.stack([many, differ[a:e][many]], 1).astype("<u4").tobytes()
                        rows.append((r.frame, k, z.compress(s[heads[a:e]].tobytes()), _bits(several[a:e]), counts))
                yield pd.DataFrame(rows, columns=["frame", "bucket", "anchors", "several", "counts"])

    return run


def _repeated(pdf):
    """Of every frame's anchors in a bucket, whether two documents hold them, and which are wide (empty: none). Ids that repeat across frames count as two."""
    import pandas as pd
    import zstandard

    unz = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unz.decompress(x), np.uint32) for x in pdf["anchors"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(pdf["several"], parts)])
    _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    many = n > 1
    many[back[several > 0]] = True
    cuts = np.cumsum([0, *map(len, parts)])
    for a, raw in zip(cuts.tolist(), pdf["counts"]):
        at, differ = np.frombuffer(raw, "<u4").reshape(-1, 2).T.astype(np.int64)
        np.add.at(n, back[a + at], differ - 1)
    wide = n >= WIDE
    own = [back[a:e] for a, e in zip(cuts, cuts[1:])]
    return pd.DataFrame({"frame": pdf["frame"], "bucket": pdf["bucket"], "bits": [_bits(many[x]) for x in own], "wide": [_bits(wide[x]) if wide[x].any() else b"" for x in own]})


def _kept(f: Frame, masks, buckets: int) -> tuple[dict, np.ndarray]:
    """What is sent of the frame's anchors that can repeat, in the order of buckets, and where each bucket begins."""
    bucket, short = f.own_bucket(buckets), f.short()
    kept = np.zeros(len(bucket), np.int8)  # 1: by the anchor, 2: string by string
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for m in masks:
        at = order[cuts[m["bucket"]] : cuts[m["bucket"] + 1]]
        known, back = np.unique(short[at], return_inverse=True)
        bits = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8), count=len(known))
        how = bits(m["bits"])
        if m["wide"]:
            how <<= bits(m["wide"])
        kept[at] = how[back]
    items = f.whole(np.flatnonzero(kept == 1))
    if (kept == 2).any():
        more = f.strings(np.flatnonzero(kept == 2))
        items = {c: np.concatenate([x, more[c]]) for c, x in items.items()}
    bucket = _bucket(items["h"], buckets)
    order = np.argsort(bucket, kind="stable")
    return {c: x[order] for c, x in items.items()}, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _of_bucket(items: dict, cuts: np.ndarray, b: int) -> dict:
    return {c: x[cuts[b] : cuts[b + 1]] for c, x in items.items()}


def _send_entries(buckets: int):
    def run(frames):
        import pandas as pd
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                f = Frame(r.docs, r.sizes, r.data)
                items, cuts = _kept(f, r.masks, buckets)
                rows = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    e, _ = f.entries(_of_bucket(items, cuts, b))
                    rows.append((r.frame, b, z.compress(b"".join(np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names))))
                yield pd.DataFrame(rows, columns=["frame", "bucket", "entries"])

    return run


def _load(raw: bytes) -> np.ndarray:
    n = len(raw) // ENTRY.itemsize
    e, at = np.empty(n, ENTRY), 0
    for c in ENTRY.names:
        size = n * ENTRY[c].itemsize
        e[c] = np.frombuffer(raw[at : at + size], ENTRY[c].base).reshape(e[c].shape)
        at += size
    return e


def _common(keys: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of rows of bytes in groups: how many bytes each has in common, at most, with another of its group."""
    wide = np.zeros((len(keys), -(-keys.shape[1] // 8) * 8), np.uint8)
    wide[:, : keys.shape[1]] = keys
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), group])
    a, b = order[:-1], order[1:]
    same = keys[a] == keys[b]
    n = np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1))
    n = np.where(group[a] == group[b], np.minimum(n, np.minimum(lengths[a], lengths[b])), 0)
    out = np.zeros(len(keys), np.int64)
    out[b] = n
    out[a] = np.maximum(out[a], n)
    return out


def least_documents(strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """Of each string, for every LENGTH bytes in it, the smallest document of those bytes.

    One suffix array by linear grouping over all strings finds the equal ones.
    """
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = flat.astype(np.int64) + 1
    sa = suffix_array(text)
    of = np.repeat(np.arange(len(strings)), sizes + 1)
    sa = sa[sa + LENGTH <= (starts + sizes)[of[sa]]]
    least = np.full(len(text), NO_ID)
    if len(sa):
        grams = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), LENGTH)
        new = np.ones(len(sa), bool)
        for at in range(1, len(sa), 1 << 16):
            to = min(len(sa), at + (1 << 16))
            new[at:to] = (grams[sa[at:to]] != grams[sa[at - 1 : to - 1]]).any(axis=1)
        heads = np.flatnonzero(new)
        least[sa] = np.repeat(np.minimum.reduceat(docs[of[sa]], heads), np.diff([*heads, len(sa)]))
    return [least[a : a + max(0, n - LENGTH + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]


def _part(u: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries cut to the strings of some starts, grouped by what all these strings hold, and
    the numbers of those that have such strings."""
    at = np.flatnonzero(np.maximum(first, SIDE - u["left"].astype(np.int64)) <= np.minimum(last, u["right"]))
    out = u[at]
    out["left"], out["right"] = np.minimum(out["left"], SIDE - first), np.minimum(out["right"], last)
    left, right = out["left"].astype(np.int64), out["right"].astype(np.int64)
    out["raw"] = _only(out["raw"], SIDE - left, LENGTH + right)
    core = out["raw"].copy()
    core[:, :last] = core[:, first + LENGTH :] = 0
    out["h"] = _mix(core, np.zeros(len(out), np.uint64))
    out["x"] = _mix(out["raw"], out["left"].astype(np.uint64) * _W[10] + out["right"].astype(np.uint64) * _W[11])
    return out, at


def _least(e: np.ndarray, start: int = 0, stop: int = STARTS - 1) -> tuple[np.ndarray, np.ndarray]:
    """Of different entries, for each of the starts, the smallest document of the string there
    (NO_ID: there is none), and of each entry its row."""
    order = np.lexsort((e["doc"], e["x"], e["h"]))
    h, x = e["h"][order], e["x"][order]
    new = np.ones(len(e), bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    heads = np.flatnonzero(new)
    number = np.empty(len(e), np.int64)
    number[order] = np.cumsum(new) - 1
    u = e[order[heads]]  # the different surroundings, each with its smallest document
    least = np.where(_valid(u)[:, start : stop + 1], u["doc"][:, None], NO_ID)

    group = np.cumsum(np.append(True, u["h"][1:] != u["h"][:-1])) - 1
    size = np.bincount(group)[group]
    large = np.flatnonzero(size > LARGE)
    if len(large):
        half = (start + stop) // 2
        for a, b in ((start, half), (half + 1, stop)):
            part, at = _part(u[large], a, b)
            found, row = _least(part, a, b)
            least[large[at], a - start : b - start + 1] = found[row]
    many = np.flatnonzero((size > 1) & (size <= LARGE))
    if len(many):
        m = u[many]
        left, right = m["left"].astype(np.int64), m["right"].astype(np.int64)
        a = np.minimum(left, _common(np.ascontiguousarray(m["raw"][:, :SIDE][:, ::-1]), left, group[many]))
        b = np.minimum(right, _common(np.ascontiguousarray(m["raw"][:, LENGTH:]), right, group[many]))
        held: dict[bytes, int] = {}
        use = []
        for k in np.flatnonzero(a + b + ANCHOR >= LENGTH).tolist():
            s = m["raw"][k, SIDE - a[k] : LENGTH + b[k]].tobytes()
            d = int(m["doc"][k])
            use.append((k, s))
            held[s] = min(held.get(s, d), d)
        strings = sorted(held)
        found: dict[bytes, np.ndarray] = {}
        # strings of the same anchors must meet in one array, so batches are cut by anchor
        by: dict[int, set] = {}
        for k, s in use:
            by.setdefault(int(group[many[k]]), set()).add(s)
        batch: dict[bytes, None] = {}
        size = 0

        def solve():
            own = list(batch)
            for s, l in zip(own, least_documents(own, np.array([held[s] for s in own]))):
                found[s] = np.minimum(found[s], l) if s in found else l

        for g in sorted(by, key=lambda g: min(by[g])):
            if len(by[g]) > 1:
                for s in sorted(by[g]):
                    size += 0 if s in batch else len(s) + 1
                    batch[s] = None
                if size > SA_BATCH:
                    solve()
                    batch, size = {}, 0
        if batch:
            solve()
        del strings
        for k, s in use:
            first = SIDE - a[k] - start
            n = len(s) - LENGTH + 1
            row = least[many[k]]
            row[first : first + n] = np.minimum(row[first : first + n], found[s] if s in found else held[s])
    return least, number


def _valid(e: np.ndarray) -> np.ndarray:
    """Of entries, the strings around the anchor that lie in the text."""
    starts = np.arange(STARTS)
    return (starts >= SIDE - e["left"][:, None].astype(np.int64)) & (starts <= e["right"][:, None])


def removable(e: np.ndarray) -> np.ndarray:
    """Of the entries of one bucket: a bit for each of the STARTS strings around the anchor,
    whether a document smaller than the entry's holds it."""
    least, number = _least(e)
    out = np.empty((len(e), STARTS), bool)
    for a in range(0, len(e), SLICE):
        own = e[a : a + SLICE]
        out[a : a + SLICE] = _valid(own) & (least[number[a : a + SLICE]] < own["doc"][:, None])
    return out


def _judge(pdf):
    import pandas as pd
    import zstandard

    unz = zstandard.ZstdDecompressor()
    sizes = [zstandard.frame_content_size(x) // ENTRY.itemsize for x in pdf["entries"]]
    cuts = np.cumsum([0, *sizes])
    e = np.empty(cuts[-1], ENTRY)
    for a, b, x in zip(cuts, cuts[1:], pdf["entries"]):
        e[a:b] = _load(unz.decompress(x))
    # anchors do not meet each other, so memory is that of some of them, or of the largest
    order = np.argsort(e["h"], kind="stable")
    h = e["h"][order]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    bits = np.zeros((len(e), STARTS), bool)
    at = 0
    while at < len(e):
        nearest = np.searchsorted(heads, at + SLICE)
        end = int(heads[nearest]) if nearest < len(heads) else len(e)
        bits[order[at:end]] = removable(e[order[at:end]])
        at = end
    return pd.DataFrame({"frame": pdf["frame"], "bucket": pdf["bucket"], "bits": [_bits(bits[a:b].ravel()) for a, b in zip(cuts, cuts[1:])]})


def _cut(buckets: int):
    def run(frames):
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                f = Frame(r.docs, r.sizes, r.data)
                repeat = np.zeros(len(f.buf), bool)
                items, cuts = _kept(f, r.masks if r.masks is not None else [], buckets)
                for j in r.judged if r.judged is not None else []:
                    own = _of_bucket(items, cuts, j["bucket"])
                    e, number = f.entries(own)
                    bits = np.unpackbits(np.frombuffer(j["bits"], np.uint8), count=len(e) * STARTS).reshape(-1, STARTS).astype(bool)[number]
                    left, right, own = own["left"], own["right"], own["k"]
                    starts = np.arange(STARTS)
                    # a copy within the frame, of a larger document than the entry's
                    later = f.docs[f.doc[own]] > e["doc"][number]
                    bits |= later[:, None] & (starts >= SIDE - left[:, None]) & (starts <= right[:, None])
                    i, o = np.nonzero(bits)
                    repeat[f.places[own][i] - SIDE + o] = True
                last = np.where(repeat, np.arange(len(repeat)), -LENGTH)
                covered = np.arange(len(repeat)) - np.maximum.accumulate(last) < LENGTH
                rows = []
                for d, a, n in zip(f.docs.tolist(), f.starts.tolist(), f.sizes.tolist()):
                    c, raw = covered[a : a + n], f.buf[a : a + n]
                    rows.append((None if d == NO_ID else d, n, int(c.sum()), int(np.count_nonzero(np.diff(c.view(np.int8), prepend=0) == 1)), sha256(raw[~c].tobytes()).hexdigest(), raw[~c].tobytes()))
                out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                yield out.astype({"doc_id": "Int64"})

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frames = written(docs.mapInArrow(_frames, "frame long, docs array<long>, sizes array<long>, data binary"), "frames")
    size = frames.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET))
    dealt = lambda d: d.repartition(buckets, "bucket").groupBy("bucket")  # noqa: E731  a bucket's memory does not grow with the corpus
    mask = "frame long, bucket int, bits binary"
    gathered = lambda d, name: d.groupBy("frame").agg(F.collect_list(F.struct(*(c for c in d.columns if c != "frame"))).alias(name))  # noqa: E731  a frame's own bits
    sent = frames.mapInPandas(_send_anchors(buckets), "frame long, bucket int, anchors binary, several binary, counts binary")
    repeated = written(gathered(dealt(sent).applyInPandas(_repeated, mask + ", wide binary"), "masks"), "anchors")
    entries = frames.join(repeated, "frame").mapInPandas(_send_entries(buckets), "frame long, bucket int, entries binary")
    judged = written(gathered(dealt(entries).applyInPandas(_judge, mask), "judged"), "judged")
    full = frames.join(repeated, "frame", "left").join(judged, "frame", "left")
    return full.mapInPandas(_cut(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
