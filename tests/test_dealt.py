from pyspark.sql import functions as F

from hopwise.operators import fold, provenance
from hopwise.plans import catalog
from hopwise.sources import hops as H

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_hops_and_sessions_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "HOPS_PER_TASK", 50)
    hops = H.ev_hops(spark.read.parquet(f"{DATA}/events.parquet"))
    score = lambda role, text: F.length(text) / 1000
    for rows in (hops, fold.verdicts(hops), fold.verdicts(hops, scorer=score)):
        assert rows.rdd.getNumPartitions() == 20
        where = rows.select("session_id", F.spark_partition_id().alias("p")).distinct().collect()
        assert len(where) == len({r.session_id for r in where})
    assert "Join" not in _plan(fold.verdicts(hops, scorer=score))


def test_hops_are_gone_through_once_for_paths(spark):
    plan = _plan(catalog.queries()["propagation_trace"](spark, DATA))
    assert plan.count("FileScan") == 1 and "Join" not in plan
    rows = spark.createDataFrame([(1, h, ["a"] if h in (1, 2, 70) else []) for h in range(1, 80)], "session_id long, hop int, items array<string>")
    marked = spark.createDataFrame([(1, 2, "a", 1), (1, 66, "a", 1), (1, 67, "a", 2), (1, 79, "a", 2)], "session_id long, hop int, item string, origin_hop int")
    got = sorted((r.hop, r["at"], r.kind) for r in provenance.carriers(rows, marked).collect())
    assert got == [(2, 1, "origin"), (2, 2, "action"), (66, 2, "relay"), (66, 66, "action"), (67, 67, "action"), (79, 70, "relay"), (79, 79, "action")]


def test_sessions_are_judged_once_for_the_log_and_once_for_releases(spark):
    assert "MapIn" not in _plan(catalog.queries()["quarantine_review"](spark, DATA))
    assert _plan(catalog.queries()["controlled_verdicts"](spark, DATA)).count("MapIn") == 1


def test_sessions_are_judged_once_for_traces(spark):
    assert _plan(catalog.queries()["verdict_trace"](spark, DATA)).count("MapIn") == 1
