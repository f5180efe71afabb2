"""op4: the leaks of benchmark items in all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import leaks


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


SQL: dict = {}
QUERIES = {"op4_decontamination": op4_decontamination}
