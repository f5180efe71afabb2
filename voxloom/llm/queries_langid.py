"""op8: the language of every document, learned from the documents not held out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import table


def held_out(doc_id: Column) -> Column:
    """Fixed by the contract; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    seen = langid.predict(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score", "rejected")
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


SQL: dict = {}
QUERIES = {"op8_language_id": op8_language_id}
