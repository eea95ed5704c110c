import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hopwise.functions import text as T
from hopwise.functions import vocabulary as V
from hopwise.operators import provenance
from hopwise.sources.hops import ev_hops
from hopwise.streaming.verdicts import stateless

CASES = [
    ("pay ＧＢ29 BARC 1234 5678 9012 34 now", {"gb29barc12345678901234"}),
    ("pay gb2 9ba rc1 234 5678 9012 34 now", {"gb29barc12345678901234"}),
    ("write ｊｏｅ＠ｈｏｓｔ．ｃｏｍ", {"joe@host.com"}),
    ("joe at a dot b dot c dot d dot e dot f dot g dot com", {"joe@a.b.c.d.e.f.g.com"}),
    ("see a dot b dot c dot d dot e dot f dot g dot com slash x", {"https://a.b.c.d.e.f.g.com/x", "a.b.c.d.e.f.g.com"}),
    ("joe @ a . b . c . d . e . f . g . com", {"joe@a.b.c.d.e.f.g.com"}),
    ("joe at host dot com", {"joe@host.com"}),
    ("nothing at all", set()),
]


def test_items_of_odd_spellings(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, hop_text string")
    got = {r.i: set(r["items"]) for r in provenance.with_items(rows).collect()}
    assert got == {i: items for i, (_, items) in enumerate(CASES)}


def test_reuse_of_an_account_in_groups_is_traced(spark):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    odd = F.when(F.col("hop") == 1, F.lit("to GB29 BARC 1234 5678 9012 34")).otherwise(F.lit("x"))
    items = {r.hop: r["items"] for r in stateless(hops.where("session_id = 1").withColumn("hop_text", odd)).select("hop", "items").collect()}
    assert items[1] == ["gb29barc12345678901234"]


def slow_unspelled(text):
    dots = re.compile("(?a)" + V.SPELLED_DOT)
    text = re.sub("(?a)" + V.SPELLED_EMAIL, lambda m: f"{m[1]}@{dots.sub('.', m[2])}", text)
    text = re.sub("(?a)" + V.SPELLED_URL, lambda m: f"https://{dots.sub('.', m[1])}/{m[2]}", text)
    return re.sub("(?a)" + V.SPACED_EMAIL, lambda m: m[1] + "@" + re.sub(r"(?a)\s+", "", m[2]), text)


def test_spelled_addresses_against_the_patterns():
    draw = random.Random(11)
    parts = ["dot", "DOT", "at", "AT", "slash", "@", "a", "b-", "-", "--c", "d.e", "f,", "(g", "h:i", "é", "jé", "x/y", ".", "k.", "+l", "dot,", "slash/z", "m_n", "o\u00a0p"]
    for _ in range(40_000):
        words = draw.choices(parts if draw.random() < 0.5 else parts[:8], k=draw.randint(2, 12))
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\n", ""]) for w in words)
        assert T._unspelled(text) == slow_unspelled(text), text


@pytest.mark.parametrize("unit", ["a dot ", "a at ", "dot ", "x@ ", "a.b-", "at b dot - ", "a slash ", " ", "1a ", "[dot] "])
def test_long_texts_are_linear(unit):
    began = time.process_time()
    T.canonical_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 10


def test_long_runs_of_an_item_are_linear(spark):
    texts = ["a.b-" * 50_000, "a" * 300_000, "1" * 300_000, " " * 200_000 + "[dot]", "x@" * 100_000]
    began = time.time()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, hop_text string")
    assert provenance.with_items(rows).selectExpr("sum(size(items))").first()[0] == 1
    assert time.time() - began < 60


def test_words_are_taken_apart_only_where_an_address_or_account_may_be(monkeypatch):
    def never(*_):
        raise AssertionError("taken apart for nothing")

    monkeypatch.setattr(T, "_Words", never)
    monkeypatch.setattr(T, "_account_tokens", never)
    monkeypatch.setattr(T, "_ACCOUNT_START", None)
    plain = "Meet at noon, the slash is at-home. one two three 4 five"
    assert T.canonical_text(plain) == plain
    assert T.canonical_text("non‑breaking ﬁle number 5") == "non-breaking file number 5"
