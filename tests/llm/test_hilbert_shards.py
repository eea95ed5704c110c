import zlib
from itertools import product

from pyspark.sql import functions as F

from hopwise.llm import hilbert_shards
from hopwise.llm.hilbert_shards import cuts_of_labels, hilbert_index, label_cuts, op7_hilbert_shards, quantised_text, shard_documents, write_shards


def test_the_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = list(product(range(1 << bits), repeat=dims))
        rows = spark.createDataFrame([(list(c),) for c in cells], "x array<int>").select("x", hilbert_index(F.col("x"), dims, bits).alias("h")).collect()
        path = [r.x for r in sorted(rows, key=lambda r: r.h)]
        assert sorted(r.h for r in rows) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def laws(rows, texts, shards=8):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    counts = [len(by.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(texts)
    last = -1
    for i in range(shards):
        run = sorted(by.get(i, []), key=lambda r: r.slot)
        assert [r.slot for r in run] == list(range(len(run)))
        for r in run:
            assert r.hilbert >= last
            last = r.hilbert
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = op7_hilbert_shards(spark, d).collect()
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    laws(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_odd_rows(spark, tmp_path):
    rows = [(i // 2, None if i % 5 == 0 else "x" * (i % 7), None if i % 3 else "en", "s", 1) for i in range(45)] + [(None, "é" * 100_000, "en", None, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, hilbert int")
    laws(shard_documents(docs).collect(), [(r[0], r[1]) for r in rows])
    assert shard_documents(docs.limit(0)).count() == 0
    laws(shard_documents(docs.limit(3)).collect(), [(r[0], r[1]) for r in rows[:3]])
    write_shards(docs, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == len(rows) and {r.hilbert for r in out.collect()} == {1} and {"shard", "hilbert_"} <= set(out.columns)


def test_shards_can_be_pruned_by_ranges(spark):
    """Readers that look for one source, language or size skip many shards by minima and maxima."""
    rows = [(i, "x" * (1 << i % 9), ("de", "en", "es", "fr")[i // 9 % 4], f"src{i // 36 % 40:02}") for i in range(8_640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = shard_documents(docs, 64).select("doc_id", "shard").join(docs, "doc_id").withColumn("size", F.length("text"))
    shares = []
    for column in ("lang", "source", "size"):
        spans = placed.groupBy("shard").agg(F.min(column).alias("low"), F.max(column).alias("high"))
        values = placed.select(column).distinct()
        read = values.join(spans, (F.col(column) >= F.col("low")) & (F.col(column) <= F.col("high"))).count()
        shares.append(read / values.count() / 64)
    assert max(shares) < 0.85 and sum(shares) / 3 < 0.6, shares


def test_label_classes_keep_order_and_size(spark):
    docs = spark.createDataFrame([(f"s{i:03}",) for i in range(300) for _ in range(3)] + [("big",)] * 900, "source string")
    cuts = label_cuts(docs, "source", 3)
    assert cuts == sorted(cuts) and len(cuts) <= 7 and cuts[0] == "big"
    got = docs.select("source", quantised_text(F.col("source"), cuts).alias("c")).distinct().orderBy("source").collect()
    assert [r.c for r in got] == sorted(r.c for r in got) and got[0].c == 1


def test_cuts_on_the_driver_are_those_of_running_counts(spark, monkeypatch):
    rows = [(f"é{i % 7}" if i % 11 else None, f"s{i * i % 90}") for i in range(700)]
    docs = spark.createDataFrame(rows, "lang string, source string")
    here = cuts_of_labels(docs, "lang", "source", bits=4)
    monkeypatch.setattr(hilbert_shards, "MOST_LABELS", 3)
    assert here == cuts_of_labels(docs, "lang", "source", bits=4) == [label_cuts(docs, c, 4) for c in ("lang", "source")]
    assert cuts_of_labels(docs.limit(0), "lang", "source") == [[], []]
