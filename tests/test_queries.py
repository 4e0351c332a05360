"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from litmill.catalog import adapters as A
from tools.check import table_key

# The streaming, reader and writer queries run through tools/check.py; this keeps the suite short.
NAMES = [
    n for n in entry.oracle_sql()
    if n[0] in "dalw" or n.startswith(("p0", "p1", "p2", "j0", "j14", "rank_corpus", "screen", "t01", "t03"))
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in A.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = table_key(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert table_key(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_query_is_registered_once_and_named():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_incremental_ingest_covers_all_records(spark, sf):
    from litmill.operators import resolve

    out = entry.queries()["t06_incremental_ingest"](spark, sf)
    ids = [r["article_id"] for r in out.collect()]
    rec = A.records(spark, sf)
    whole = resolve.dedup_metrics(rec, resolve.components(resolve.identity_keys(rec))).first()["unique_count"]
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= whole
    dois = {r[0] for r in rec.select("doi").where("doi is not null").distinct().collect()}
    assert {r["doi"] for r in out.collect()} - {None} <= dois
