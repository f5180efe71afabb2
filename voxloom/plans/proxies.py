"""The library's entities bound to the driver's tables by fixed integer rules.

The tables hold no transcripts; each rule below has a twin in SQL, so results can be
compared in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations as time-aligned segments of one video each."""
    turns = table(spark, sf_dir, "conversations")
    s = turns.select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))).alias("pos", "sentence")).where("trim(sentence) <> ''")
    s = s.withColumn("id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "pos")).cast("long") - 1)
    dur, gap = F.length("sentence") * 60, (F.col("id") * 137 + F.col("conv_id") * 53) % 500
    s = s.withColumn("dur_ms", dur.cast("long")).withColumn("end_ms", F.sum(dur + gap).over(W.partitionBy("conv_id").orderBy("id")).cast("long"))
    n = lambda a, b, m: (F.col("id") * a + F.col("conv_id") * b) % m
    return s.select(
        F.col("conv_id").alias("video_id"), "id", (F.col("end_ms") - F.col("dur_ms")).alias("start_ms"), "end_ms", F.col("sentence").alias("text"), F.col("role").alias("speaker_id"),
        (-n(7919, 104729, 120) / 100.0).alias("avg_logprob"), (n(31, 17, 70) / 100.0).alias("no_speech_prob"), (F.lit(1.0) + n(13, 7, 160) / 100.0).alias("compression_ratio"),
        F.lit(None).cast("string").alias("language"), F.lit(False).alias("alignment_failed"),
    )


SEGMENTS_SQL = r"""sent AS (
  SELECT conv_id, turn, role, pos, sentence, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS id
  FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS sentence,
               generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), 1) AS pos FROM conversations)
  WHERE trim(sentence) <> ''),
timed AS (SELECT *, 60 * length(sentence) AS dur_ms, sum(60 * length(sentence) + (id * 137 + conv_id * 53) % 500) OVER (PARTITION BY conv_id ORDER BY id)::BIGINT AS end_ms FROM sent),
seg AS (
  SELECT conv_id AS video_id, id, end_ms - dur_ms AS start_ms, end_ms, sentence AS text, role AS speaker_id,
         -((id * 7919 + conv_id * 104729) % 120) / 100.0 AS avg_logprob, ((id * 31 + conv_id * 17) % 70) / 100.0 AS no_speech_prob,
         1 + ((id * 13 + conv_id * 7) % 160) / 100.0 AS compression_ratio
  FROM timed)"""


def sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as sound events of a video."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    start = (F.col("event_id") * 997) % 120000
    return e.select((F.col("user_id") % 100).alias("video_id"), start.alias("start_ms"), (start + 50 + F.floor("value").cast("long") * 5).alias("end_ms"))


EVENTS_SQL = """ev AS (
  SELECT user_id % 100 AS video_id, (event_id * 997) % 120000 AS start_ms, (event_id * 997) % 120000 + 50 + floor(value)::BIGINT * 5 AS end_ms
  FROM events WHERE event_type = 'error')"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips of a speaker each; durations in milliseconds."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("clip_id"), F.col("source").alias("speaker_name"), "lang", "text", (F.col("n_chars") * 60).alias("ms"), (((F.col("doc_id") * 37) % 100) / 100.0).alias("score"))


CLIPS_SQL = "clips AS (SELECT doc_id AS clip_id, source AS speaker_name, lang, text, n_chars * 60 AS ms, ((doc_id * 37) % 100) / 100.0 AS score FROM documents)"
