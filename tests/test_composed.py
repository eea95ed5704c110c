import json

import pytest
from pyspark.sql import functions as F

from hopwise.operators import audit, fold, provenance, records, replay
from hopwise.operators.fold import Session
from hopwise.plans.composed import dataset_write, label_replay
from hopwise.sources import datasets as DS
from hopwise.sources.hops import ev_hops, read_session_documents, read_sessions, session_errors


def test_replay_is_the_fold_with_given_risks(spark):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("session_id < 30")
    hops = hops.withColumn("risk", F.round((F.hash("session_id", "hop") % 100) / 100.0, 2)).withColumn("risk", F.abs("risk"))
    given = {(r.session_id, r.hop): r.risk for r in hops.collect()}

    class Replay(Session):
        def _commit(self, row, trust):
            super()._commit(row, 1.0 - given[row.session_id, row.hop])

    state, keys, at, want = None, [], None, {}
    for r in fold.prepared(hops).orderBy("session_id", "hop", "own", "item", "key", "exact").collect():
        if r.session_id != at:
            at, state, keys = r.session_id, Replay(), []
        if not r.own:
            keys.append({c: r[c] for c in provenance.KEYED})
            continue
        risks = dict(state.risks)
        _, _, before, _, shut, _, reused, supplied = state.judge(r, keys)
        want[r.session_id, r.hop] = (round(before, 4), shut, [x["key"] for x in reused], supplied, any(round(risks[x["hop"]], 3) >= 0.25 for x in reused))
        keys = []
    rows = replay.replayed(hops, "risk")
    assert {(r.session_id, r.hop): (r.sensitivity, r.suspended, list(r.reused), list(r.given), r.risky) for r in rows.collect()} == want
    assert any(x[2] for x in want.values()) and any(x[3] for x in want.values()) and any(x[1] for x in want.values())


def test_replay_needs_no_python_fold(spark):
    plan = label_replay(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_statistics_are_taken_in_the_writing_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["train", "test", None, "odd"][i % 4], i % 2) for i in range(40)], "id int, split string, label int")
    counts = DS.write_with_statistics(rows, f"{tmp_path}/x", {"split": ["train", "test"], "split/label": ["train/0"]})
    assert counts == {"total": {"all": 40}, "split": {"train": 10, "test": 10, "other": 20}, "split/label": {"train/0": 10, "other": 30}}
    assert spark.read.json(f"{tmp_path}/x").count() == 40
    assert {(r.field, r.value): r.n for r in DS.read_statistics(spark, f"{tmp_path}/x").collect()} == {(f, v): n for f, x in counts.items() for v, n in x.items()}
    assert DS.write_with_statistics(rows.limit(0), f"{tmp_path}/y", {"split": ["train"]})["total"] == {"all": 0}
    assert dataset_write(spark, "/root/testdata/sf0.001").count() == 13


def test_only_selected_files_are_read(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 10).alias("suite"))
    rows.repartition(1).write.partitionBy("suite").json(f"{tmp_path}/s")
    wanted = spark.createDataFrame([(0, "suite=7"), (1, "suite=2"), (2, "suite=none")], "place int, path string")
    got = DS.read_selected(spark, f"{tmp_path}/s", "id long", wanted, "suite")
    assert sorted((r.place, r.id) for r in got.collect()) == sorted([(0, i) for i in range(7, 100, 10)] + [(1, i) for i in range(2, 100, 10)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [suite" in plan


def walk(v):
    if isinstance(v, str):
        return v.replace("<Information>", "").replace("</INFORMATION>", "")
    return [walk(x) for x in v] if isinstance(v, list) else {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v


def test_nested_marks_at_any_depth(spark):
    mark = "a<Information>b</INFORMATION>"
    values = [mark, [mark, 1, None], {"x": {"y": [{mark: mark, "z": [[mark]]}]}}, 3.5, True, {"information>": "plain"}, {}, []]
    texts = [json.dumps(v) for v in values] + [str(v) for v in values[1:3]] + ["no literal " + mark, None, "", "[" * 5000 + "<information>"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", records.without_nested_marks(F.col("t"), "information").alias("c")).orderBy("i").collect()]
    for v, g in zip([*values, *values[1:3]], got):
        assert json.loads(g) == walk(v)
    assert got[len(values) + 2 :] == ["no literal ab", None, "", "[" * 5000]


def test_records_and_rejects(spark):
    cases = [(1, "do", "data"), (2, None, "data"), (3, "do", " "), (4, "a", "b"), (4, "c", "d"), (None, "a", "b")]
    good, bad = records.built(spark.createDataFrame(cases, "id int, ask string, found string"), [("ask", "user", "user"), ("found", "tool_response", "tool")])
    assert [(r.id, [(m.hop, m.role, m.content, m.tool_response) for m in r.messages]) for r in good.collect()] == [(1, [(1, "user", "do", None), (2, "tool_response", "data", "data")])]
    assert sorted((r.id or 0, r.reason) for r in bad.collect()) == [(0, "no id"), (2, "ask is missing"), (3, "found is blank"), (4, "id stands twice"), (4, "id stands twice")]


def test_written_sessions_and_their_mistakes(spark, tmp_path):
    talk = [{"role": "user", "source": "u", "target": "a", "content": "x"}, {"role": "assistant", "source": "a", "target": "t", "tool_name": "send", "tool_call": {"to": "x"}}, {"role": "tool", "source": "t", "target": "a"}]
    good = {"id": "g", "is_attack": False, "benign_kind": "normal", "messages": talk}
    bad = {"id": "b", "is_attack": True, "attack_class": "data_exfiltration", "messages": [{"role": "assistant", "source": "a", "target": "", "tool_name": "send", "tool_call": "now"}]}
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "one.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "d/two.json").write_text(json.dumps([bad, {"id": "g2", "messages": None}]))
    (tmp_path / "d/e/three.json").write_text("{ no json")
    (tmp_path / "d/four.json").write_text(json.dumps([{**good, "id": "t"}, {**good, "id": "t"}]))
    (tmp_path / "EXAMPLE_five.json").write_text(json.dumps({"id": "never"}))
    rows = read_session_documents(spark, str(tmp_path))
    got = {(r.file, r.id, r.error.partition(" one of")[0]) for r in session_errors(rows).collect()}
    assert got == {
        ("two.json", "b", "needs at least 3 messages"), ("two.json", "b", "attack_vector must be"), ("two.json", "b", "first message must be the user's request"), ("two.json", "b", "message 1: source and target are required"),
        ("two.json", "b", "message 1: tool_call must be an object"), ("two.json", "g2", "needs at least 3 messages"), ("two.json", "g2", "is_attack must be true or false"), ("two.json", "g2", "first message must be the user's request"),
        ("three.json", None, "invalid JSON"), ("four.json", "t", "id stands twice"),
    }


def test_missing_session_files_are_named(spark, tmp_path):
    with pytest.warns(UserWarning, match="none.jsonl does not exist"):
        assert read_sessions(spark, [f"{tmp_path}/none.jsonl"]).count() == 0


def test_groups_over_several_keys(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(30)] + [(100, None, None), (101, "x", None), (102, None, "y"), (103, "x", "y"), (50, "a3", "z")]
    got = {r.id: r.group for r in audit.connected(spark.createDataFrame(rows, "id long, p string, q string"), "id", ["p", "q"]).collect()}
    assert got == {**{i: 0 for i in [*range(30), 50]}, 100: 100, 101: 101, 102: 101, 103: 101}
    assert audit.connected(spark.createDataFrame([], "id long, p string"), "id", ["p"]).collect() == []


def test_every_rule_that_is_broken_is_told(spark):
    m = [(1, "user", "u", "a"), (2, "assistant", "a", "b")]
    rows = [(1, "train", False, None, m, "s", "g1"), (2, "test", True, "c", m, "s", "g1"), (3, "train", True, "odd", m[:1], "s", "g2"), (3, "train", False, "c", [(2, "user", "u", "a")], None, "g2"), (4, None, None, None, None, "s", None), (5, "dev", False, None, [(1, None, "u", "a")], "s", None)]
    schema = "sample_id int, split string, is_attack boolean, attack_class string, messages array<struct<hop:int,role:string,source:string,target:string>>, source string, k string"
    got = {r.rule: (r.n, r.example) for r in audit.integrity(spark.createDataFrame(rows, schema), ["k"], ["source"], ("c",)).collect()}
    assert got == {"unique_sample_ids": (2, 3), "required_fields": (1, 3), "message_structure": (3, 3), "valid_splits": (2, 4), "benign_class_null": (1, 3), "valid_attack_classes": (1, 3), "no_group_split_leakage": (1, 1)}
