import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    odd = [(9001, None, None, None, None), (9002, "", None, "src1", 0), (9003, "12 34", "en", "src1", 5), (9004, "Intro words here. " + item, "en", "src1", 99)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    names = ["size", "target", "repeats", "_draw", "score", "rejected", "lang_pred", "last", "full", "whole", "_copy", "component_id", "item_id"]
    docs = docs.select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in names))
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        out = spark.createDataFrame(rows, docs.schema)
        seen[name] = {r["doc_id"] for r in out.collect()}
        docs = out
    first, second, third, fourth = seen.values()
    assert 9001 not in first and 9002 not in first and 9003 not in first and 9004 in first
    assert second <= first and 9004 in second and 9004 not in third
    assert fourth <= third
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() > 0 and {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == fourth


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 0
    assert [n for n, _ in P.STAGES][0] == "language ID" and len(P.STAGES) == 5


@pytest.mark.parametrize("name", ["op1_exact_topk", "op2_warc_normalise", "op3_source_mixing", "op6_minhash_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    from voxloom.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    got = registry.queries()[name](spark, SF).select(*names)
    near = lambda row: tuple(round(x, 4) if isinstance(x, float) else x for x in row)
    assert sorted(str(near(x)) for x in got.collect()) == sorted(str(near(x)) for x in r.fetchall())
