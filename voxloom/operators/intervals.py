"""Overlap of open intervals: touching ones do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) > F.greatest(a0, b0)


def without_overlaps(segments: DataFrame, events: DataFrame, key: str = "video_id", bucket: float | None = None) -> DataFrame:
    """Segments that overlap no event of their key: an anti-join on the key.

    With ``bucket`` (a length of time), both sides are cut into time buckets and joined on
    key and bucket, so that a key of very many events is spread over tasks. Segments of the same
    key, start and end share their fate, so those values tell which ones go; a row number would
    not, as it changes from one reading of the rows to the next. A missing start or end is open,
    as in ``overlaps``; spans are cut at the first and the last time of all segments.
    """
    if bucket is None:
        e = events.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        return segments.join(e, (F.col(key) == F.col("_k")) & overlaps(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")), "left_anti")
    ends = segments.agg(F.min(F.least("start", "end")).alias("_lo"), F.max(F.greatest("start", "end")).alias("_hi"), F.max(F.col("start").isNull() | F.col("end").isNull()).alias("_open"))
    near = F.col("_open") | (F.coalesce(F.col("_s") < F.col("_hi"), F.lit(True)) & F.coalesce(F.col("_e") > F.col("_lo"), F.lit(True)))

    def cut(d: DataFrame) -> DataFrame:
        d = d.where(F.coalesce(F.col("end") > F.col("start"), F.lit(True))).select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        at = lambda c: F.floor(F.least(F.greatest(c, "_lo"), "_hi") / bucket)
        b = F.explode(F.sequence(at(F.coalesce("_s", "_lo")), at(F.coalesce("_e", "_hi"))))
        return d.join(F.broadcast(ends), F.col("_lo").isNotNull()).where(near).select("_k", "_s", "_e", b.alias("_b"))

    s, e = cut(segments), cut(events).select(F.col("_k").alias("_ek"), F.col("_s").alias("_es"), F.col("_e").alias("_ee"), F.col("_b").alias("_eb"))
    hit = s.join(e, (F.col("_k") == F.col("_ek")) & (F.col("_b") == F.col("_eb")) & overlaps(F.col("_s"), F.col("_e"), F.col("_es"), F.col("_ee")), "left_semi")
    hit = hit.select("_k", "_s", "_e").distinct()
    return segments.join(hit, (F.col(key) == F.col("_k")) & F.col("start").eqNullSafe(F.col("_s")) & F.col("end").eqNullSafe(F.col("_e")), "left_anti")


def overlaps_any(start: Column, end: Column, events: Column) -> Column:
    """The same test against events nested in the row: no join, no shuffle."""
    return F.coalesce(F.exists(events, lambda e: overlaps(start, end, e["start"], e["end"])), F.lit(False))
