"""Every registered query of the engine against DuckDB on the same tables, and the entry points."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__
from gridloom import catalog

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.4g}" if abs(float(v)) > 1e5 else f"{round(float(v), 4) + 0.0:.4f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted([plain(dict(zip(columns, r))[c]) for c in sorted(columns)] for r in cursor.fetchall())
    got = sorted([plain(r[c]) for c in sorted(columns)] for r in df.collect())
    assert got == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ln", "a"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_regex_takes_whole_texts(spark, con):
    """Against Python's own expressions, without the oracle's SQL."""
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = catalog.queries()["table_regex"](spark, SF).collect()
    assert len(rows) == len(texts) and max(len(r.r) for r in rows if r.r) > 80
    assert all(r.r == (None if texts[r.doc_id] is None else re.sub("[aeiou]+", "_", texts[r.doc_id])) for r in rows)


def test_unnest_takes_the_whole_table(spark, con):
    """Against the vectors themselves, without the oracle's SQL."""
    vectors = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    got = {(r.vec_id, r.pos): r.v for r in catalog.queries()["table_unnest"](spark, SF).collect()}
    assert len(got) == sum(len(e) for _, e in vectors)
    assert all(abs(got[i, k] - v) < 1e-4 for i, e in vectors for k, v in enumerate(e))
