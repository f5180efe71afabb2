"""op5: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from .block_labeller import extract
from .common import table


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL: dict = {}
QUERIES = {"op5_html_extraction": op5_html_extraction}
