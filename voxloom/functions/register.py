"""The text functions as SQL functions and table functions of a session."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from . import numbers as N
from . import stress as Z


class NumberSpans:
    """number_spans(text): one row a claimed span."""

    def eval(self, text: str) -> Iterator[tuple]:
        for name, m, _ in N.spans(text):
            yield name, m.start(), m.end(), m[0]


class Chunks:
    """chunks(text, most): one row a chunk, from 0."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        yield from enumerate(C.chunks(text, most))


def register(spark: SparkSession) -> None:
    """expand_numbers and repair_apostrophes as functions, number_spans and chunks as table functions."""

    @F.pandas_udf("string")
    def expand_numbers(s: pd.Series) -> pd.Series:
        return s.map(N.expand, na_action="ignore")

    @F.pandas_udf("string")
    def repair_apostrophes(s: pd.Series) -> pd.Series:
        return s.map(Z.repair_apostrophes, na_action="ignore")

    spark.udf.register("expand_numbers", expand_numbers)
    spark.udf.register("repair_apostrophes", repair_apostrophes)
    spark.udtf.register("number_spans", F.udtf(NumberSpans, returnType="rule string, start int, end int, span string"))
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="k int, chunk string"))
