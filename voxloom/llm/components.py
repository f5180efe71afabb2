"""Connected components by alternating large-star and small-star steps.

Every step is a map-side combined minimum per node and an equi-join, so a node with very
many links is never gathered in one task. Edges between rounds are written in the shared
folder, which cuts the lineage.

Defined cases: null ends and self links are ignored; repeated edges count once; without
edges there are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest node around u."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _state(e: DataFrame):
    return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) to (node, component), written: the smallest node reachable; linked nodes only."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(links, "links")
    before = _state(e)
    for _ in range(rounds):
        nxt = written(_small_star(_large_star(e).distinct()).distinct(), "links")
        drop_written(e)
        e, now = nxt, _state(nxt)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = written(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "labels")
    drop_written(e)
    return out
