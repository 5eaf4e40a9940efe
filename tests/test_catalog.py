"""Every query that SQL can express equals its SQL on whole tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from affinis import catalog


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        out.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return out


def plain(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    got = plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == plain(con.sql(f"SELECT {quoted} FROM ({catalog.SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_library_that_only_training_data_needs_may_be_missing():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'merge_knn_k3' in q and 'op8_bpe' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
