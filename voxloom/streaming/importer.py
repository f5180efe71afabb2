"""Incremental import: new files of rows through the gates, accepted and rejected apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_field, first_text
from ..operators.gates import Lengths, import_reason


def judged(rows: DataFrame, max_wer: float = 0.3, n: Lengths = Lengths()) -> DataFrame:
    """Rows (id, text columns, has_audio, wer, declared, measured) with clean text and a reason."""
    texts = [F.col(c) for c in ("transcription", "text", "sentence") if c in rows.columns]
    d = rows.withColumn("text", clean_field(first_text(*texts)))
    return d.withColumn("reject_reason", import_reason(F.col("text"), F.col("has_audio"), F.col("wer"), F.col("declared"), F.col("measured"), max_wer, n))


def import_files(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 16, **gates):
    """Process what is new under ``path`` and stop. The checkpoint remembers files, so a second
    run imports only later ones; batches are written once under their own number."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    marked = judged(rows, **gates).withColumn("accepted", F.col("reject_reason").isNull())
    q = marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """An extension: the gap rule on a stream, as session windows with a watermark."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
