import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    queries = entry.queries()
    assert entry.catalogue.FLAGSHIP in queries and set(entry.oracle_sql()) <= set(queries)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"doc_id", "score", "probability"} == set(rows[0].asDict())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["bm25_top10", "pair_feature_table", "document_text_features", "query_cleaning", "dataset_manifest"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("docs", "queries", "candidates"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = entry.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())


def test_the_core_stands_alone():
    """Nothing outside the optional subpackage imports it."""
    code = "import sys; sys.modules['termforge.llm'] = None; import termforge.catalogue, termforge.runner, termforge.streaming.ingest; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(entry.__file__).parent, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr
