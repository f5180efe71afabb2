"""Near-duplicate documents: MinHash banding, signature check, exact check, components.

A document is the set of its distinct five-word shingles (64-bit hashes). Documents with
equal sets fold into their smallest id first, so copies never meet in pairs. ``PERMS``
universal hash minima, in ``BANDS`` bands, give the candidates: two sets that share three
quarters of their union miss each other in all bands with a chance of 5 in a million.

Within a bucket no pairs are listed. Every member is first held against one hub, the
smallest id of the bucket. Links that hold on the full sets give components by
alternating large-star and small-star. Only buckets where members are still in different
components go on: members outside the bucket's most common component meet the rest in
blocks of bounded size, first by signature, then, those with a likely partner, on their
full sets. Members of one component never meet. Pairs stay within a block's task; what
leaves it is one link for each member and component.

What later steps no longer read is deleted from the shared folder as soon as the next
table stands. Hot buckets are told by their counts and not gathered: a hub's text goes to
as many tasks as its bucket needs.

Defined cases: a null or blank text has an empty set and is linked with nothing; texts of
fewer than five words are one shingle; rows without an id are linked with nothing; rows
that repeat an id count as one document, linked if any of them is; an empty table gives
no rows; texts are read whole, about 40 bytes of memory a word; columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, drop_written, join_skewed, partitions, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
PERMS = BANDS * ROWS
#: Least equal minima of a pair that is checked on its full sets: five standard deviations under 0.75.
LEAST_EQUAL = 71
BLOCK = 512
#: Members of a bucket that meet its hub in one task.
HUB = 1024
PIECE = 1 << 22

_rng = np.random.default_rng(6)
_A = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)
_C = _rng.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_edges(buf: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start and end; ``apart`` marks bytes between words."""
    word = np.zeros(len(buf) + 2, bool)
    np.logical_not(apart[buf], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def eights(buf: np.ndarray) -> np.ndarray:
    """Of every byte, A-Z lower-cased, the eight from it on as one number; zeros follow the end."""
    low = np.zeros(len(buf) + 8, np.uint8)
    low[: len(buf)] = _LOWER[buf]
    return np.ndarray((len(buf) + 1,), "<u8", low, strides=(1,))


def word_hashes(buf: np.ndarray, apart: np.ndarray = _SPACE, edges: tuple | None = None, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of the bytes, A-Z lower-cased: its bytes, eight at a time, and its length."""
    starts, ends = edges or word_edges(buf, apart)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    wide = eights(buf) if wide is None else wide
    left = ends - starts
    h = mixed((wide[starts] & _MASK[np.minimum(left, 8)]) * _C[0] + left.astype(np.uint64) * _C[5])
    at = np.flatnonzero(left > 8)
    while len(at):  # a word of n bytes takes n / 8 rounds, those of all words at once
        left = left - 8
        if len(at) <= 4 and (left[at] > 1 << 12).all():  # a few words longer than many
            import hashlib

            for k in at.tolist():
                tail = hashlib.blake2b(_LOWER[buf[ends[k] - left[k] : ends[k]]].tobytes(), digest_size=8).digest()
                h[k] = mixed(h[k : k + 1] ^ np.frombuffer(tail, "<u8"))[0]
            break
        n = left[at]
        h[at] = mixed(h[at] ^ (wide[ends[at] - n] & _MASK[np.minimum(n, 8)]) * _C[1])
        at = at[n > 8]
    return h, starts


def shingle_sets(rows: list) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, given as bytes or None."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size < PIECE):
            size += len(rows[end]) + 1 if rows[end] is not None else 1
            end += 1
        space = np.full(1, 32, np.uint8)
        parts = [p for r in rows[at:end] for p in ((r, space) if r is not None else (space,))]
        sizes = np.array([(len(r) if r is not None else 0) + 1 for r in rows[at:end]])
        w, starts = word_hashes(np.concatenate(parts))
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        whole = mixed(sum(w[i : len(w) - SHINGLE + 1 + i] * _C[i] for i in range(SHINGLE))) if len(w) >= SHINGLE else w[:0]
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(whole[a : b - SHINGLE + 1]))
            elif b > a:
                short = sum((int(x) * int(c) for x, c in zip(w[a:b], _C)), (b - a) * int(_C[6])) & (2**64 - 1)
                out.append(mixed(np.array([short], np.uint64)))
            else:
                out.append(w[:0])
        at = end
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of the PERMS hash functions over a set that is not empty."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    m = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        m = np.minimum(m, (x[at : at + 1024, None] * _A + _B).min(axis=0))
    return m


def _sign(batches):
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            sets = shingle_sets(byte_rows(part.column("text")))
            sigs = [signature(s) if len(s) else None for s in sets]
            some = np.array([s for s in sigs if s is not None], np.uint64).reshape(-1, BANDS, ROWS)
            keys = mixed((some * _C[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _C[7]).view(np.int64)
            it = iter(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(np.add.reduce(s).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(mixed(s * _C[3])).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([s.tobytes() if s is not None else None for s in sigs], pa.binary()),
                    pa.array([s.astype(np.uint8).tobytes() if s is not None else None for s in sigs], pa.binary()),
                    pa.array([next(it) if s is not None else None for s in sigs], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "sig", "low", "keys"],
            )


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, low binary, keys array<long>"


def _likely(batches):
    """Pairs whose signatures, by the last byte of each minimum, agree enough to be worth the exact check."""
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, PERMS) for c in ("low", "low_b"))
            yield b.select(["a", "b", "n"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL))


def _exact(least: float):
    def run(batches):
        import pyarrow as pa

        last: tuple = (None, None)
        for b in batches:
            keep = []
            x, y, ids = byte_rows(b.column("text")), byte_rows(b.column("text_b")), b.column("b").to_pylist()
            for at in range(0, len(x), 256):
                left = shingle_sets(x[at : at + 256])
                for s, other, i in zip(left, y[at : at + 256], ids[at : at + 256]):
                    if last[0] != (i, len(other)):
                        last = ((i, len(other)), shingle_sets([other])[0])
                    both = len(np.intersect1d(s, last[1], assume_unique=True))
                    keep.append(100 * both >= least * 100 * (len(s) + len(last[1]) - both) and both > 0)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_hubs(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b, n) with the columns of ``rows`` for a, and those for b as c_b.

    Every member of a bucket has the bucket's hub for b, so a hub's row goes to as many
    tasks as its largest bucket, of n members, needs: ``HUB`` members a task.
    """
    salts = F.ceil(F.col("n") / HUB).cast("int")
    hubs = pairs.groupBy("b").agg(F.max("n").alias("n")).select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    # merge joins at every size: all sides grow with the corpus
    hubs = hubs.hint("merge").join(rows.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns)), "b")
    own = pairs.hint("merge").join(rows.select(F.col("doc_id").alias("a"), *columns), "a").withColumn("s", F.pmod(F.xxhash64("a"), salts).cast("int"))
    return own.join(hubs.hint("merge"), ["b", "s"])


def _confirmed(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, n) that are links on their full sets; texts of the pairs' documents only."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().hint("merge")
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")
    return _with_hubs(pairs, texts, ["text"]).select("a", "b", "text", "text_b").mapInArrow(_exact(least), "a long, b long")


GROUP = ["key", "band", "o", "kind", "i"]
MET = "key long, band int, o int, kind int, i int, node long, label long, outer boolean, inner boolean"


def _near(key, pdf):
    """The members of one block of a bucket with a likely partner in another component.

    Partners count in the first band that they share, so in one bucket only.
    """
    band = int(key[1])
    left, right = (np.flatnonzero(pdf[c].to_numpy(bool)) for c in ("outer", "inner"))
    sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, PERMS)
    label = pdf["label"].to_numpy()
    hit = np.zeros(len(pdf), bool)
    for k in left:
        same = sigs[right] == sigs[k]
        ok = (same.sum(axis=1) >= LEAST_EQUAL) & (label[right] != label[k])
        ok[ok] = same[ok].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        hit[right[ok]] = True
        hit[k] |= ok.any()
    return pdf.loc[hit, MET.replace(",", "").split()[::2]]


def _linked(least: float):
    """Links on full sets between the components of one block: one for each member and component."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["node", "outer", "inner", "text"])
        sets = shingle_sets([np.frombuffer(t.encode(), np.uint8) for t in pdf["text"]])
        sizes = np.array([len(s) for s in sets])
        every, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        left, right = (np.flatnonzero(pdf[c].to_numpy(bool)) for c in ("outer", "inner"))
        held = np.concatenate([ids[starts[k] : starts[k] + sizes[k]] for k in right]) if len(right) else ids[:0]
        heads = np.cumsum(sizes[right]) - sizes[right]
        mark = np.zeros(len(every), np.int32)
        links = set()
        for k in left:
            own = ids[starts[k] : starts[k] + sizes[k]]
            mark[own] = 1
            both = np.add.reduceat(mark[held], heads)
            mark[own] = 0
            ok = (100 * both >= least * 100 * (sizes[k] + sizes[right] - both)) & (label[right] != label[k])
            seen = {}
            for j in right[ok]:
                seen.setdefault(label[j], node[j])
            links |= {(max(node[k], n), min(node[k], n)) for n in seen.values()}
        return pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")

    return run


def _between(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links between components within buckets, beyond those with the hubs; written."""
    m = members.join(labels, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("label"))
    m = m_all = written(m, "members")
    per = m.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_ = per.groupBy("key").agg(F.sum("n").alias("all"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.count("*").alias("labels")).where("labels > 1 and all > 2")
    m = m.join(open_, "key").withColumn("other", F.col("label") != F.col("main"))
    n_out = F.ceil((F.col("all") - F.col("n_main")) / BLOCK).cast("int")
    n_main = F.ceil(F.col("n_main") / BLOCK).cast("int")
    cut = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    part = lambda o, kind, i, outer: F.struct(o.alias("o"), F.lit(kind).alias("kind"), i.alias("i"), F.lit(outer).alias("outer"))
    # others meet the main component's members (kind 0) and each other (kind 1), block by block
    among = lambda outer: F.when(F.col("all") - F.col("n_main") > 1, F.transform(steps(n_out), lambda j: part(cut(n_out), 1, j, True) if outer else part(j, 1, cut(n_out), False))).otherwise(F.array())
    outside = F.concat(F.transform(steps(n_main), lambda j: part(cut(n_out), 0, j, True)), among(True), among(False))
    inside = F.transform(steps(n_out), lambda j: part(j, 0, cut(n_main), False))
    met = m.select("key", "band", F.col("rep").alias("node"), "label", F.explode(F.when(F.col("other"), outside).otherwise(inside)).alias("g"))
    met = met.select("key", "band", "g.o", "g.kind", "g.i", "node", "label", "g.outer", (~F.col("g.outer")).alias("inner"))
    met = met.hint("merge").join(reps.select(F.col("rep").alias("node"), "sig"), "node")
    met = met.repartition(partitions(docs.sparkSession), *GROUP)
    near = written(met.groupBy(*GROUP).applyInPandas(_near, MET), "near")
    drop_written(m_all)
    texts = docs.join(near.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").where("text is not null")
    links = written(near.hint("merge").join(texts, "node").groupBy(*GROUP).applyInPandas(_linked(least), "a long, b long").distinct(), "links")
    drop_written(near)
    return links


def near_duplicates(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = written(docs.mapInArrow(_sign, SIGNED), "signed")
    signed = written(full.select("doc_id", "n_shingles", "h1", "h2"), "sizes")
    sets = full.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "sig", "low", "keys")).alias("r"), F.count("*").alias("copies"))
    reps = written(sets.select("h1", "h2", "copies", "r.rep", "r.sig", "r.low", "r.keys"), "sets")
    drop_written(full)

    bands = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1")
    members = written(join_skewed(bands, buckets, "key", "n", BANDS * reps.count()), "buckets")
    # only texts that share a bucket move on; always by a merge join, as their ids grow with the corpus
    ids = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    docs = written(docs.join(ids, "doc_id", "left_semi"), "texts")
    pairs = members.where("rep <> hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("n"))
    seen = _with_hubs(pairs, reps.select(F.col("rep").alias("doc_id"), "low"), ["low"])
    likely = written(seen.select("a", "b", "n", "low", "low_b").mapInArrow(_likely, "a long, b long, n long"), "likely")
    first = written(_confirmed(likely, docs, least), "links")
    drop_written(likely)
    labels = components(first)
    drop_written(first)

    second = _between(members, labels, reps, docs, least)
    drop_written(members)
    drop_written(docs)
    if not second.isEmpty():
        tree = labels
        labels = components(tree.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(second))
        drop_written(tree)
    drop_written(second)

    folded = reps.join(labels, F.col("rep") == F.col("node"), "left").where("copies > 1 or component is not null").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(folded.hint("merge"), ["h1", "h2"], "left")
    linked = F.col("c").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(linked, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "components")
    for t in (signed, reps, labels):
        drop_written(t)
    return out
