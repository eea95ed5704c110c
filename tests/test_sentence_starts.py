import re
import time

from hopwise.operators import datasets as D


def test_long_texts_are_read_in_little_time(spark):
    texts = [None, "", "one. ", "no end", "a.. b?!  c.\n", ". . x", "é. 𝒳! ", "ab. " * 40_000 + "tail" * 100_000, " ".join(f"{'x' * (i % 7)}!" for i in range(1_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").where("t is not null")
    began = time.monotonic()
    got = {r["i"]: list(r["at"]) for r in rows.select("i", D.sentence_starts(rows["t"]).alias("at")).collect()}
    assert time.monotonic() - began < 60
    assert got == {i: [0, *[m.end() for m in re.finditer(r"(?a)[.!?]\s+", t)]] for i, t in enumerate(texts) if t is not None}
