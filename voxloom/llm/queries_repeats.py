"""op10: repeated passages cut from all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import without_repeats


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


SQL: dict = {}
QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
