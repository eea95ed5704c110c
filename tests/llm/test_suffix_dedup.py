import hashlib
import random

import numpy as np

import hopwise.llm.suffix_dedup as m
from hopwise.llm.suffix_dedup import dedup_strings, op4_suffix_dedup

L = 50


def slow(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - L + 1 if d is not None else 0):
            least[b[i : i + L]] = min(d, least.get(b[i : i + L], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - L + 1 if d is not None else 0):
            if least[b[i : i + L]] < d:
                gone[i : i + L] = b"\1" * L
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows):
    got = dedup_strings(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tag int")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == slow(rows)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_suffix_dedup(spark, d).collect()]
    assert sorted(got) == slow(docs)
    assert sum(r[2] for r in got) > 0


def copies(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    passages = [text(rng.choice((49, 50, 51, 60, 90, 400))) for _ in range(6)]
    rows = []
    for d in range(n):
        rows.append((d, text(rng.randint(0, 200)) + "".join(rng.choice(passages)[rng.randint(0, 9) :] + text(rng.randint(0, 30)) for _ in range(rng.randint(0, 4)))))
    return rows


def test_copied_passages(spark):
    check(spark, copies(1, 150))


def test_many_buckets_pieces_and_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 700)
    monkeypatch.setattr(m, "BUCKET_BYTES", 3_000)
    monkeypatch.setattr(m, "BUCKET_REQUESTS", 40)
    check(spark, copies(2, 120) + [(200 + i, "the same opening words of very many documents, all of them alike " * (1 + i % 3)) for i in range(150)])


def test_leading_bytes_across_buckets(spark, monkeypatch):
    """Units with the same leading bytes fall into several buckets and are compared all the same."""
    monkeypatch.setattr(m, "BUCKET_BYTES", 300)
    rng = random.Random(5)
    key = "same leading bytes "
    rows = [(d, "".join(key + "".join(rng.choice("ab") for _ in range(rng.randint(20, 34))) for _ in range(6))) for d in range(60)]
    check(spark, rows)
    check(spark, copies(6, 40))


def test_order_splitters_and_buckets():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = m.multikey_order(*words)
    assert [tuple(w[i] for w in words) for i in order] == sorted(zip(*words))
    # as many ranges as buckets, however many there are
    sample = {c: rng.integers(0, 1 << 63, 256_000).astype(np.uint64) for c in m.WORDS[:3]}
    assert len(m._cuts(sample, 64_000)["first"]) == 63_999
    # a leading word that all units share is cut by what follows
    same = sample | {c: np.zeros(256_000, np.uint64) for c in m.WORDS[:2]}
    assert len(m._cuts(same, 64_000)["run"]) == 63_999
    few = {c: w for c, w in zip(m.WORDS, words)}
    cuts = m._cuts(few, 20)
    sorted_cuts = list(zip(*(cuts[c] for c in m.WORDS[:3])))
    want = [sum(c <= u for c in sorted_cuts) for u in zip(*words[:3])]
    assert m._bucket_of(few, cuts).tolist() == want


def test_rows_that_share_an_id(spark):
    """Different texts under one id keep their own spans, however many they are."""
    rng = random.Random(8)
    passage = "a passage of well over fifty bytes that is repeated in later rows."
    rows = [(0, passage)] + [(1, "".join(rng.choice("xyz") for _ in range(rng.randint(5, 60))) + (passage if i % 3 else "")) for i in range(300)]
    check(spark, rows)


def test_odd_rows(spark):
    long = "".join(random.Random(3).choice("ab ") for _ in range(5_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 3_000), (5, "x" * 2_000), (4, "x" * 60), (None, "x" * 100), (7, long), (7, long), (8, long[:49]), (9, long[100:150]), (0, "\0" * 70), (10, "\0" * 80)]
    check(spark, rows)
    assert dedup_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(m, "PIECE", 700)
    texts = [t.encode() for _, t in copies(4, 60)] + [b"y" * 5_000]
    u = m._units(texts, L)
    windows = sorted((i, s + j) for i, s, z in zip(u["text"].tolist(), u["start"].tolist(), u["size"].tolist()) for j in range(z - L + 1))
    assert windows == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - L + 1)]


def test_one_passage_in_very_many_contexts(spark, monkeypatch):
    """The ends of the passage differ everywhere, so all its windows are asked for under one key."""
    monkeypatch.setattr(m, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(m, "BUCKET_REQUESTS", 20)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    check(spark, [(d % 390, "".join(rng.choice("uvwxyz") for _ in range(12)) + passage + "".join(rng.choice("uvwxyz") for _ in range(12))) for d in range(400)])


def test_of_a_hot_window_a_batch_sends_on_one_document():
    w = {c: np.array(x) for c, x in {"window": [7, 7, 9, 7, 9], "check": [1, 1, 2, 1, 2], "first": [0] * 5, "doc": [3, 5, 5, 3, 4], "row": [1, 2, 2, 1, 3], "start": [0, 4, 9, 60, 2]}.items()}
    ranked, gone = m._ranked_windows({c: x.astype(np.uint64) if c in ("window", "check", "first") else x for c, x in w.items()})
    assert sorted(zip(ranked["doc"][~gone].tolist(), ranked["window"][~gone].tolist())) == [(3, 7), (3, 7), (4, 9)]
    assert sorted(zip(ranked["row"][gone].tolist(), ranked["start"][gone].tolist())) == [(2, 4), (2, 9)]
