"""Driver contract: entry(), queries() vs oracle_sql() on sf0.001 with DuckDB."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from vigil.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"fraud_scores", "inference_batch", "train_metrics", "cv_auc", "stream_rolling", "stream_tumbling",
        "stream_dedupe", "stream_alerts"}


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 1000
    assert "txn_count_1h" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(sdf.columns, srows) == digest(ocols, orows)


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_rolling", "stream_alerts"])
def test_stream_matches_batch_sql(spark, duck, name):
    test_query_matches_oracle(spark, duck, name)
