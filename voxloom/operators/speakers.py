"""Speaker clustering: similar pairs, single-linkage clusters, names by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import global_speaker, natural_rank
from .datasets import ready_for_checkpoints


#: Vectors of a side of the tiles in which blocks meet, and pairs whose cosines are taken at once.
TILE, AT_ONCE = 1024, 32_768
#: A block's vectors hold about so many numbers; so many blocks are made where each gets TILE nodes.
NUMBERS, LEAST_BLOCKS = 1 << 21, 12


def _units(flat, size: int):
    """Vectors over their lengths, in doubles; those without a length hold NaN, which is above nothing."""
    import numpy as np

    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(all="ignore"):
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x


def _above(u, v, threshold: float, same: bool, cosines: bool):
    """(i, j, cosine) of rows above the threshold, a tile at a time; i < j within one block.

    A product in floats finds those that can be above it, by the bound of its error; those near
    the threshold, or all with ``cosines``, are then taken in doubles.
    """
    import numpy as np

    error = (u.shape[1] + 8) * 2.0**-23
    f, g = u.astype(np.float32), v.astype(np.float32)
    low = np.float32(threshold - error - abs(threshold) * 2.0**-20)
    for a in range(0, len(f), TILE):
        for b in range(a if same else 0, len(g), TILE):
            s = f[a : a + TILE] @ g[b : b + TILE].T
            at = np.flatnonzero(s.ravel() > low)
            p, q, near = at // s.shape[1], at % s.shape[1], s.ravel()[at]
            if same and a == b:
                p, q, near = (x[ok] for ok in [p < q] for x in (p, q, near))
            for k in range(0, len(p), AT_ONCE):
                i, j, c = p[k : k + AT_ONCE] + a, q[k : k + AT_ONCE] + b, near[k : k + AT_ONCE].astype(np.float64)
                check = np.ones(len(i), bool) if cosines else c <= threshold + error
                c[check] = np.einsum("ij,ij->i", u[i[check]], v[j[check]])
                ok = c > threshold
                yield i[ok], j[ok], c[ok]


def _meetings(nodes: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Every two blocks of nodes whose vectors have one size, once: g, h, size, keys and flat vectors of both."""
    of = F.col(vector) if nodes.schema[vector].dataType.elementType.typeName() in ("float", "double") else F.col(vector).cast("array<double>")
    n = nodes.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), of.alias("v")).withColumn("size", F.size("v")).where("size > 0")
    rows, numbers = n.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-rows // block), -(-numbers // NUMBERS), min(LEAST_BLOCKS, rows // TILE))
    g = n.groupBy("size", F.pmod(F.xxhash64("k", "v"), F.lit(blocks)).cast("int").alias("g")).agg(F.collect_list(F.struct("k", "v")).alias("rows"))
    g = g.select("size", "g", F.transform("rows", lambda r: r["k"]).alias("keys"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"))
    left = g.withColumn("h", F.explode(F.sequence(F.col("g"), F.lit(blocks - 1))))
    right = g.select("size", F.col("g").alias("h"), F.col("keys").alias("keys_b"), F.col("flat").alias("flat_b"))
    # a meeting has its own number, by which both sides are dealt: a partition holds a few
    both = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("h"))))
    tasks = min(4096, blocks * (blocks + 1) // 2)
    return left.repartition(tasks, "size", "g", "h").join(both.repartition(tasks, "size", "g", "h").hint("merge"), ["size", "g", "h"])


def _met(nodes: DataFrame, key: str, vector: str, block: int, cosines: bool, threshold: float, columns: str, batches_of) -> DataFrame:
    def run(batches):
        for many in batches:
            for at in range(len(many)):
                b = many.slice(at, 1)
                one = {c: b.column(c)[0] for c in ("size", "g", "h", "keys", "flat", "keys_b", "flat_b")}
                size, same = one["size"].as_py(), one["g"].as_py() == one["h"].as_py()
                u = _units(one["flat"].values, size)
                v = u if same else _units(one["flat_b"].values, size)
                x = one["keys"].values
                y = x if same else one["keys_b"].values  # the two readings of one block may have its rows in different orders
                yield from batches_of(x, y, _above(u, v, threshold, same, cosines))

    return _meetings(nodes, key, vector, block).mapInArrow(run, columns)


def similar_pairs(nodes: DataFrame, threshold: float, key: str = "name", vector: str = "embedding", block: int = 32_768) -> DataFrame:
    """Pairs a < b whose cosine is above the threshold.

    Every node meets every other one once: nodes are dealt into blocks of about ``block``, or of
    NUMBERS numbers if that is less, and each two blocks meet in one row, whose vectors stay
    arrays from Arrow to numpy. They meet in tiles, by a product in floats; cosines of what it
    finds are taken in doubles. A task holds two blocks and a tile; the time still grows with the
    square of the nodes. Nulls, zero vectors and vectors of other lengths are similar to nothing.
    """
    kind = nodes.schema[key].dataType.simpleString()

    def pairs(x, y, found):
        import pyarrow as pa
        import pyarrow.compute as pc

        for i, j, c in found:
            m, n = x.take(pa.array(i)), y.take(pa.array(j))
            less, other = pc.less(m, n), pc.not_equal(m, n)
            yield pa.RecordBatch.from_arrays([pc.if_else(less, m, n), pc.if_else(less, n, m), pa.array(c)], ["a", "b", "similarity"]).filter(other)

    return _met(nodes, key, vector, block, True, threshold, f"a {kind}, b {kind}, similarity double", pairs)


def similar_links(nodes: DataFrame, threshold: float, key: str = "name", vector: str = "embedding", block: int = 32_768) -> DataFrame:
    """(a, b) that connect the same nodes as ``similar_pairs``: of each meeting of two blocks only every
    node with the least one that it reaches there, so that no more links than nodes leave it."""
    kind = nodes.schema[key].dataType.simpleString()

    def links(x, y, found):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, second = (x, 0) if y is x else (pa.concat_arrays([x, y]), len(x))
        place = np.empty(len(keys), np.int64)  # by the order of keys, so that the least of a group is its root
        order = pc.sort_indices(keys).to_numpy().astype(np.int64)
        place[order] = np.arange(len(keys))
        root = np.arange(len(keys))
        for i, j, _ in found:
            i, j = place[i], place[j + second]
            while len(i):
                a, b = root[i], root[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
        of = np.flatnonzero(root != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(order[root[of]])), keys.take(pa.array(order[of]))], ["a", "b"])

    return _met(nodes, key, vector, block, False, threshold, f"a {kind}, b {kind}", links)


def clusters(edges: DataFrame, nodes: DataFrame, key: str = "name", rounds: int = 50) -> DataFrame:
    """(key, root): the smallest node reachable. Labels take the least of their neighbours'
    labels, and labels of labels are followed, so long chains halve each round; each round is
    checkpointed, which cuts the lineage."""
    ready_for_checkpoints(nodes.sparkSession)
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select(F.col(key).alias("node"), F.col(key).alias("root")).distinct().checkpoint()
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        stepped = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        up = stepped.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = stepped.join(up, "root").select("node", F.least("root", "up").alias("root")).checkpoint()
        changed = nxt.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        labels = nxt
        if not changed:
            return labels.select(F.col("node").alias(key), "root")
    raise RuntimeError("clusters did not settle")


def cluster_speakers(nodes: DataFrame, threshold: float, base: str = "speaker", block: int = 32_768) -> DataFrame:
    """(name, embedding, speech_seconds) to name, root, rank from 0 and global name.

    Clusters rank by their total speech, longest first, ties to the smaller root. Nodes that
    repeat a name count once, the last position winning.
    """
    rooted = nodes.join(clusters(similar_links(nodes, threshold, block=block), nodes), "name")
    total = rooted.groupBy("root").agg(F.sum("speech_seconds").alias("speech"), F.count("*").alias("members"))
    ranked = total.withColumn("rank", F.row_number().over(W.orderBy(F.desc("speech"), "root")) - 1)
    return rooted.join(ranked, "root").select("name", "root", "rank", "members", "speech", global_speaker(F.lit(base), F.col("rank")).alias("speaker"))


def suffix(name):
    """The speaker part of base__video__speaker; the whole name otherwise."""
    parts = F.split(name, "__")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(name)


def fallback_map(names: DataFrame, base: str = "speaker") -> DataFrame:
    """Without embeddings: equal suffixes are one speaker; suffixes rank in natural order."""
    s = names.select("name", suffix(F.col("name")).alias("suffix"))
    ranked = s.select("suffix").distinct().withColumn("rank", F.row_number().over(W.orderBy(natural_rank(F.col("suffix")))) - 1)
    return s.join(ranked, "suffix").select("name", "suffix", global_speaker(F.lit(base), F.col("rank")).alias("speaker"))


def cluster_counts(assigned: DataFrame) -> DataFrame:
    """Speakers, clusters, single ones and clustered names."""
    per = assigned.groupBy("speaker").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("n").alias("names")).withColumn("clustered", F.greatest(F.lit(0), F.col("names") - F.col("singletons")))
