import random

import numpy as np
import pytest

from hopwise.llm.language_id import ORDER, fit, keep_identified, op6_language_id, predict, training_fold

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op6_language_id(spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def slow_trees(texts):
    """How often every byte followed every context, in plain dictionaries."""
    seen = {}
    for t in texts:
        s = b" " * ORDER + t.encode()
        for i in range(ORDER, len(s)):
            for o in range(ORDER + 1):
                counts = seen.setdefault(s[i - o : i], {})
                counts[s[i]] = counts.get(s[i], 0) + 1
    return seen


def slow_bits(text, seen):
    """PPM with escapes and exclusion, byte by byte."""

    def p(ctx, sym):
        lower = (lambda x: p(ctx[1:], x)) if ctx else (lambda x: 1 / 256)
        counts = seen.get(ctx)
        if not counts:
            return lower(sym)
        total = sum(counts.values()) + len(counts)
        if sym in counts:
            return counts[sym] / total
        return len(counts) / total * lower(sym) / (1 - sum(lower(x) for x in counts))

    s = b" " * ORDER + text.encode()
    return sum(-np.log2(p(s[i - ORDER : i], s[i])) for i in range(ORDER, len(s)))


SAYINGS = {
    "en": "the cat and the dog sat on the mat while it rained all day long",
    "fr": "le chat et le chien dorment à côté du vieux fauteuil près de la fenêtre",
    "ru": "кошка и собака спят на старом диване у окна",
    "bg": "котката и кучето спят на стария диван до прозореца",
    "zh": "猫和狗在旧沙发上睡觉窗外下着雨",
    "ja": "猫と犬は窓のそばの古いソファで眠っています",
}


def sayings(n=120, seed=1):
    """Rows of words drawn from the sayings."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        lang = list(SAYINGS)[i % len(SAYINGS)]
        units = SAYINGS[lang].split() if " " in SAYINGS[lang] else list(SAYINGS[lang])
        rows.append((i, (" " if " " in SAYINGS[lang] else "").join(draw.choices(units, k=draw.randrange(1, 12))), lang, "s"))
    return rows


@pytest.mark.parametrize("shard_bytes", [None, 1])
def test_query_against_brute_force(spark, tmp_path, shard_bytes, monkeypatch):
    """Labels and scores of the whole query, in one shard and with a shard a language."""
    from hopwise.llm import language_id

    if shard_bytes:
        monkeypatch.setattr(language_id.fit, "__defaults__", (language_id.DOCS_PER_LANGUAGE, shard_bytes))
    docs = spark.createDataFrame(sayings() + [(500, None, "en", "s"), (501, "12 ?", "fr", "s"), (502, "z", None, "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    trained = docs.where(training_fold(docs["doc_id"]) != 1).collect()
    trees = {l: slow_trees([r.text for r in trained if r.lang == l and r.text is not None]) for l in SAYINGS}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op6_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.bits_per_byte) == ("und", 0.0, None)
            continue
        n = len(text.encode())
        mean = {l: slow_bits(text, tree) / n for l, tree in trees.items()}
        best = min(mean, key=lambda l: (mean[l], l))
        assert np.isclose(r.bits_per_byte, mean[best], rtol=1e-5) and np.isclose(mean[r.lang_pred], mean[best], rtol=1e-5)
        assert np.isclose(r.score, 1 / sum(2 ** ((mean[best] - m) * min(n, 32)) for m in mean.values()), rtol=1e-3)
    right = {r[0]: r[2] for r in sayings()}
    assert sum(r.lang_pred == right.get(r.doc_id) for r in got) > 110


def test_many_labels_change_no_code_length(spark):
    """More languages than one table of the old bound held: every length as before."""
    train = spark.createDataFrame(sayings(), "doc_id long, text string, lang string, source string")
    more = train.unionByName(spark.createDataFrame([(1000 + i, f"qx{i} qy{i}", f"l{i}", "s") for i in range(40)], train.schema))
    few, many, split = fit(train), fit(more), fit(more, shard_bytes=100_000)
    assert [len(m) for m in (few, many)] == [1, 1] and len(split) > 1
    bits = [{l: x for shard in m for l, x in zip(shard.languages, shard.code_lengths("le chat спят 猫".encode()))} for m in (few, many, split)]
    assert len(bits[1]) == 46 and len(bits[2]) == 46
    for l in SAYINGS:
        assert np.isclose(bits[0][l], bits[1][l], rtol=1e-6) and np.isclose(bits[0][l], bits[2][l], rtol=1e-6)
    one, two = (sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in predict(train.union(train), m).collect()) for m in (many, split))
    assert one == two and len(one) == 240


def test_odd_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (None, "x", "es"), (4, "zzz", None)], "doc_id long, text string, lang string")
    model = fit(train)
    assert [l for shard in model for l in shard.languages] == ["en", "fr"]
    rows = [(1, None, 0), (2, "", 0), (3, "12 !?", 0), (None, "the dog", 0), (5, "chien", 0), (5, "chien", 0), (6, "the " * 500_000, 0)]
    got = predict(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("None", "en"), ("5", "fr"), ("5", "fr"), ("6", "en")])
    none = fit(train.where("lang is null"))
    assert none == [] and {r.lang_pred for r in predict(train, none).collect()} == {"und"}
    kept = keep_identified(spark.createDataFrame([(3, "the cat and the dog " * 5, "en", 1, 2), (8, None, None, 1, 2), (9, "123", "en", 1, 2)], "doc_id long, text string, lang string, _rank int, key int"))
    assert [r.doc_id for r in kept.collect()] == [3]
    assert keep_identified(train.limit(0)).count() == 0
