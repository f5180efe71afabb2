"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, whatever their names. ``run`` writes each stage's rows as Parquet
in the shared folder, reads them again for the next one and deletes what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, langid, minhash, mixing, tokens
from voxloom.llm.common import apart, drop_written, n_words, table, written
from voxloom.llm.queries_langid import held_out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie too far from every language, or hold no letter, go."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    own, back = apart(docs, ["text"])
    return back(langid.predict(own, model).where(~F.col("rejected")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    own, back = apart(docs, ["doc_id", "source", "text"])
    mixed = mixing.mix(own.withColumn("size", n_words(F.col("text"))))
    return back(mixed.where("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))))


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in training order; one row a sequence."""
    return tokens.shards(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_shards),
]

#: The models and the shards are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            drop_written(before)
        before = docs
    return docs
