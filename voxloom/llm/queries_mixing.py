"""op3: the mix of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, table
from .mixing import mix


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op3_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('20:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
b AS (SELECT *, ('0x' || substr(h, 1, 3))::INT AS bin FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS k
      FROM b GROUP BY source),
fill AS (  -- clamp, share again, until nothing is above its clamp
  SELECT 0 AS round, k, source_size, weight, false AS clamped FROM s
  UNION ALL
  SELECT round + 1, k, source_size, weight, clamped OR above FROM (
    SELECT *, NOT clamped AND (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN clamped THEN 2 * source_size END) OVER (), 0)) * weight
              > 2 * source_size * sum(CASE WHEN NOT clamped THEN weight END) OVER () AS above
    FROM fill) WHERE round < 60),
last AS (SELECT * FROM fill WHERE round = 60),
t AS (
  SELECT k, CASE WHEN clamped THEN (2 * source_size)::DOUBLE
              ELSE (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN clamped THEN 2 * source_size END) OVER (), 0))::DOUBLE * weight
                   / sum(CASE WHEN NOT clamped THEN weight END) OVER () END AS target
  FROM last),
p AS (SELECT s.*, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM s JOIN t USING (k)),
bins AS (SELECT source, bin, sum(size) AS bin_size FROM b GROUP BY source, bin),
f AS (
  SELECT p.source, bin, bin_size, target - whole * source_size
         - coalesce(sum(bin_size) OVER (PARTITION BY p.source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM bins JOIN p ON bins.source IS NOT DISTINCT FROM p.source),
r AS (SELECT b.*, f.room, f.bin_size, sum(size) OVER (PARTITION BY b.source, b.bin ORDER BY h) AS until
      FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source AND b.bin = f.bin)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (r.size * (p.whole + CASE WHEN room >= bin_size THEN 1 WHEN room > 0 AND until - size / 2 <= room THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
""",
}
QUERIES = {"op3_source_mixing": op3_source_mixing}
