"""Paths of items in sessions longer than a session's memory."""

import os

import duckdb
import pytest

from hopwise.operators import provenance
from hopwise.plans import catalog
from tests.oracle import TABLES, differences

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_sessions(tmp_path_factory):
    """The tables with 500 events of all users in two sessions of some 250 hops."""
    folder = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{DATA}/{t}.parquet", f"{folder}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id % 2 AS user_id) FROM '{DATA}/events.parquet' WHERE event_id < 500) TO '{folder}/events.parquet'")
    return str(folder)


def test_a_path_begins_at_its_origin_however_far(spark):
    rows = spark.createDataFrame([(1, h, ["a"] if h in (1, 2, 70, 300) else []) for h in range(1, 301)], "session_id long, hop int, items array<string>")
    marked = spark.createDataFrame([(1, 2, "a", 1), (1, 66, "a", 1), (1, 67, "a", 2), (1, 300, "a", 2), (1, 9, None, None)], "session_id long, hop int, item string, origin_hop int")
    got = sorted((r.hop, r["at"], r.kind) for r in provenance.carriers(rows, marked, None).collect())
    assert got == [
        (2, 1, "origin"), (2, 2, "action"), (9, 9, "action"), (66, 1, "origin"), (66, 2, "relay"), (66, 66, "action"), (67, 2, "origin"), (67, 67, "action"),
        (300, 2, "origin"), (300, 70, "relay"), (300, 300, "action"),
    ]


def test_propagation_trace_is_whole(spark, long_sessions):
    query = catalog.queries()["propagation_trace"]
    assert not differences(spark, query, catalog.oracle_sql()["propagation_trace"], long_sessions)
    assert query(spark, long_sessions).where("at < hop - 64 and kind = 'origin'").count() > 0


def test_verdict_trace_is_whole(spark, long_sessions):
    query = catalog.queries()["verdict_trace"]
    assert not differences(spark, query, catalog.oracle_sql()["verdict_trace"], long_sessions)
    assert query(spark, long_sessions).where("at < hop - 64 and kind = 'origin'").count() > 0
