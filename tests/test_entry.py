import ast
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest

REPO = Path(__file__).parents[1]
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["segment_reject_report", "junk_interval_nested", "eval_split", "number_spans", "nearest_rank_percentiles"])
def test_queries_match_sql(spark, name):
    from voxloom.plans import catalog

    con = duckdb.connect()
    for t in ("conversations", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(catalog.SQL[name])
    names = sorted(x[0] for x in r.description)
    at = [[x[0] for x in r.description].index(n) for n in names]
    want = sorted(str(tuple(row[k] for k in at)) for row in r.fetchall())
    got = sorted(str(tuple(row)) for row in catalog.QUERIES[name](spark, SF).select(*names).collect())
    assert got == want


def test_union_of_all_languages(spark, tmp_path):
    from voxloom.plans import catalog

    rows = [(i, x) for i, x in enumerate(["en", None, "pl", "de", "en", "", None, "uk", "fr"])]
    spark.createDataFrame(rows, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.SQL["union_datasets"]).fetchall()
    got = [tuple(x) for x in catalog.QUERIES["union_datasets"](spark, str(tmp_path)).select("lang", "doc_id", "seq", "file").collect()]
    assert len(got) == len(rows) and sorted(got, key=lambda x: x[2]) == sorted(want, key=lambda x: x[2])


def _against_sql(spark, name, tables):
    """Rows of a query and of its SQL, sorted, over tables by path."""
    from voxloom.plans import catalog

    con = duckdb.connect()
    for t in tables.iterdir():
        con.execute(f"CREATE VIEW {t.name.removesuffix('.parquet')} AS SELECT * FROM '{t}{'/*.parquet' if t.is_dir() else ''}'")
    r = con.execute(catalog.SQL[name])
    names = [x[0] for x in r.description]
    return sorted(map(str, map(tuple, catalog.QUERIES[name](spark, str(tables)).select(*names).collect()))), sorted(map(str, r.fetchall()))


def test_drifts_multiply_floats_as_sql_does(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = (rng.integers(-400, 400, (3000, 8)) / 1000).astype(np.float32)  # thousandths, whose products end on either side of a whole number
    assert (np.floor(x * np.float32(1000)) != np.floor(x.astype(float) * 1000)).any()
    spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("array_drift", "most_drifted"):
        got, want = _against_sql(spark, name, tmp_path)
        assert got == want and got


def test_bucketed_intervals_over_many_partitions(spark, tmp_path):
    for t in ("conversations", "events"):
        os.symlink(f"/root/testdata/sf0.1/{t}.parquet", tmp_path / f"{t}.parquet")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(was, ("40", "-1", "300k")):
            spark.conf.set(k, v)
        got, want = _against_sql(spark, "junk_interval_bucketed", tmp_path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == want and got


def test_nothing_else_imports_llm():
    for p in (REPO / "voxloom").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or n == "corpus_pipeline" for n in names), p
