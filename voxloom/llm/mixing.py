"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size; together the sources share a budget in proportion
to their weights. A source whose share is above ``max_epochs`` times its size is clamped
there, and the excess is shared again among the others in proportion to their weights,
until no share is above its clamp. Because shares only rise when others are clamped, the
clamped sources are the first ones in the order of size per weight: one ordered pass over
the per-source totals finds them, without iteration.

A source's target is then taken as whole repetitions of all its documents, plus one more
repetition of a seeded part of them. The part is chosen by a keyed hash of the document
id: the hash's leading bits deal a source's documents into ``BINS`` bins, totals per bin
are aggregated map-side first, whole bins are taken in order, and only the one bin where
the target is reached is ordered document by document. So a source that holds a third of
all rows is never sorted in one task. A document is taken zero, one, ... ``max_epochs``
times, always whole, and reruns agree.

Defined cases: null text has size 0; null source is a source of its own, last in the
order; null ids hash as the empty string; an empty table gives no rows; repeated rows are
taken as documents of their own, all or none of one id, so a source that is mostly one id
comes near its target only by that id's size; when all sizes are 0 every target is 0;
columns of any name pass through, but for those named as the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import apart, written

BINS = 4096
#: Fixed by the contract: weights repeat over the ordered sources.
WEIGHTS = (3, 1, 2)


def draw(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, weight) to (source, source_size, target): one row per source.

    The windows run over per-source totals, one row per source, not over documents.
    """
    w = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    cap = F.col("source_size") * F.lit(max_epochs)
    d = sizes.withColumn("_cap", cap)
    d = d.withColumn("_before", F.sum("_cap").over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("_left_w", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
    budget = F.sum("source_size").over(every) * F.lit(share)
    d = d.withColumn("_rest", budget - F.coalesce("_before", F.lit(0)))
    # a source is clamped while its clamp is below its part of what the earlier clamps left
    d = d.withColumn("_clamped", F.col("_cap") * F.col("_left_w") < F.col("_rest") * F.col("weight"))
    d = d.withColumn("_cap_sum", F.sum(F.when(F.col("_clamped"), F.col("_cap"))).over(every))
    d = d.withColumn("_w_sum", F.sum(F.when(~F.col("_clamped"), F.col("weight"))).over(every))
    rest = budget - F.coalesce("_cap_sum", F.lit(0))
    target = F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(rest * F.col("weight") / F.col("_w_sum"))
    return d.select("source", "source_size", F.least(target, F.col("_cap").cast("double")).alias("target"))


def bin_of(drawn: Column) -> Column:
    return F.conv(F.substring(drawn, 1, 3), 16, 10).cast("int")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, seed: int = 20) -> DataFrame:
    """Each row of ``docs`` (doc_id, source, size, ...) with source_size, target, repeats and taken (words).

    Columns of ``docs`` named as the four results are replaced by them. The decisions are
    made on (source, hash, size) only and come down to one row per source, so whatever else
    the rows carry is joined once.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("source_size", "target", "repeats", "taken")))
    own, back = apart(kept, ["doc_id", "source", "size"])
    narrow = written(docs.select("source", "size", draw(F.col("doc_id"), seed).alias("d")), "mix")
    bins = narrow.groupBy("source", bin_of(F.col("d")).alias("bin")).agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (k % len(WEIGHTS) + 1).cast("int"))
    per_source = water_fill(sizes.select("source", "source_size", weight.alias("weight")), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per_source = per_source.withColumn("whole", whole).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    per_source = written(per_source, "mix-sources")

    s, b = per_source.alias("s"), bins.alias("b")
    before = F.coalesce(F.sum("bin_size").over(W.partitionBy("b.source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    filled = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "bin", "bin_size", (F.col("more") - before).alias("room"))
    cross = filled.where((F.col("room") > 0) & (F.col("room") < F.col("bin_size"))).select("source", "bin", "room")
    # the documents of the crossing bins alone, at most one bin of BINS for a source, are put in order
    n, c = narrow.alias("n"), cross.alias("c")
    inside = n.join(c, F.col("n.source").eqNullSafe(F.col("c.source")) & (bin_of(F.col("n.d")) == F.col("c.bin"))).select("n.source", "d", "size", "room")
    end = F.sum("size").over(W.partitionBy("source").orderBy("d"))
    last = inside.withColumn("end", end).where(F.col("end") - F.col("size") / 2 <= F.col("room")).groupBy("source").agg(F.max("d").alias("last"))
    full = filled.where(F.col("room") >= F.col("bin_size")).groupBy("source").agg(F.max("bin").alias("full"))
    rules = written(
        per_source.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").join(full.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        .select(F.col("s.source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), F.col("last").alias("_last"), F.coalesce("full", F.lit(-1)).alias("_full")),
        "mix-rules",
    )
    j = own.withColumn("_draw", draw(F.col("doc_id"), seed)).join(rules, F.col("source").eqNullSafe(F.col("_source")))
    times = F.col("_whole") + ((bin_of(F.col("_draw")) <= F.col("_full")) | F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False))).cast("long")
    return back(j, F.col("_size").alias("source_size"), F.col("_target").alias("target"), times.alias("repeats"), (F.col("size") * times).alias("taken"))
