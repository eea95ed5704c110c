"""The catalogue on empty tables, and hops with nulls, ties and repeated rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from hopwise.operators import fold, prefix, provenance
from hopwise.plans import catalog
from hopwise.sources.hops import ev_hops, normalised

SMALL = "/root/testdata/sf0.001"
#: Queries that answer with rows even where there is nothing to ask about are not compared.
NAMES = [
    "normalize_hops", "render_hop", "prefix_state", "session_signals", "verdict_fold", "verdict_reasons", "verdict_trace", "tainted_items", "fragment_taint", "propagation_trace",
    "history_context", "build_texts", "chunk_scored", "chunk_spans", "extract_indicators", "summary", "best_threshold", "slice_metrics", "largest_remainder", "leakage_audit", "chunk_labels",
    "chunk_selection", "near_far_negatives", "shifted_windows", "sentence_starts", "session_messages", "best_epoch", "latency_mean_p95", "outbox", "quarantine_review",
]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        spark.createDataFrame([], spark.read.parquet(path).schema).coalesce(1).write.parquet(f"{folder}/{os.path.basename(path)}")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    rows = catalog.queries()[name](spark, empty)
    if rows.count():
        assert name in ("summary", "best_threshold", "leakage_audit")  # totals of nothing
    assert sorted(rows.columns) == sorted(catalog.queries()[name](spark, SMALL).columns)


def test_hops_with_nulls(spark):
    fields = ("role", "source", "target", "content", "tool_name", "tool_call", "tool_calls", "tool_response")
    rows = [(1, i + 1, *[None if (i >> k) & 1 else v for k, v in enumerate(("tool", "web", "agent", "mail x9@evil.example", "send_email", '{"a":"b"}', "[]", "ok"))]) for i in range(256)]
    hops = normalised(spark.createDataFrame(rows, "session_id long, hop int, " + ", ".join(f"{f} string" for f in fields)))
    got = fold.verdicts(hops).collect()
    assert len(got) == 256 and all(0 <= r.trust <= 1 for r in got)
    assert prefix.history(hops).count() == 256 and provenance.known(provenance.with_items(prefix.with_designation(prefix.with_prefix(hops)))).count() > 0


def test_order_of_rows_does_not_matter(spark):
    hops = ev_hops(spark.read.parquet(f"{SMALL}/events.parquet")).where("session_id < 20")
    one = {(r.session_id, r.hop): (r.tier, round(r.trust, 9)) for r in fold.verdicts(hops).collect()}
    two = {(r.session_id, r.hop): (r.tier, round(r.trust, 9)) for r in fold.verdicts(hops.orderBy(F.rand(3)).repartition(5)).collect()}
    assert one == two
