"""op7: the pseudo-log-likelihood of every document."""

from pyspark.sql import DataFrame, SparkSession

from . import lm
from .common import table


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lm.vocabulary(docs)
    ids = lm.encoded(docs, words)
    return lm.score_encoded(ids, words, lm.train(ids, words))


SQL: dict = {}
QUERIES = {"op7_lm_scoring": op7_lm_scoring}
