"""op9: all documents as token ids in training order."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import shards


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict = {}
QUERIES = {"op9_token_shards": op9_token_shards}
