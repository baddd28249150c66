import glob
import os
import subprocess
import sys

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("q_") and n not in entry.oracle_sql()))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_llm():
    code = "import sys; sys.modules['vellumflow.llm'] = None\nimport vellumflow.plans as p\nassert all(not q.startswith(('p1_', 'p5_')) for r in p.registries() for q in r.queries)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


@pytest.mark.parametrize("name", ["q_rule_extraction", "q_result_records"])
def test_documents_without_text_are_reported(spark, tmp_path, name):
    spark.createDataFrame([(1, "Vendor: Acme\nRegion: North"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in entry.queries()[name](spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_upsert_meets_existing_jobs(spark, monkeypatch):
    from vellumflow.operators import results

    met, plain = [], results.upserted

    def upserted(table, updates):
        met.append(table.join(updates, "job_id", "left_semi").count())
        return plain(table, updates)

    monkeypatch.setattr(results, "upserted", upserted)
    entry.queries()["q_job_upsert"](spark, DATA)
    assert met[-1] > 0
