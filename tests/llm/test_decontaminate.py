from collections import Counter

from pyspark.sql import functions as F

from hopwise.llm.decontaminate import BLOCKS, OP3_SQL, RADIUS, block_balls, block_radii, blocks, keep_clean, leaks, op3_decontaminate, simhash
from tests.oracle import differences


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert not differences(spark, op3_decontaminate, OP3_SQL, f"/root/testdata/{sf}")


def test_simhash_and_blocks(spark):
    hs = [3, 5, -1, 7 << 40, 1 << 63 - 1]
    got = spark.range(1).select(simhash(F.array(*[F.lit(h).cast("long") for h in hs])).alias("fp")).first().fp
    want = sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))
    assert got & (2**64 - 1) == want
    parts = spark.range(1).select(blocks(F.lit(-2).cast("long"), 24).alias("b")).first().b
    assert len(parts) == 25 and parts[0].value == 2 and sum(p.value.bit_length() for p in parts) == 64


def jaccard(a, b, k=5):
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_every_window_by_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, [rng.choice(vocabulary) for _ in range(20 + i)]) for i in range(6)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        leak = list(items[d % 6][1])
        for _ in range(d % 3):
            leak[rng.randrange(len(leak))] = "changed"
        docs.append((d, words + (leak[12:] + leak[:12] if d % 5 == 0 else leak) + words if d % 4 else words))
    want = {}
    for d, w in docs:
        for i, b in items:
            best = max(jaccard(w[s : s + len(b)], b) for s in range(max(1, len(w) - len(b) + 1)))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    got = leaks(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want and want
    text = dict(docs)
    assert all(round(jaccard(text[r.doc_id][r.start_word :][: r.n_words], items[r.item_id][1]), 9) == want[r.doc_id, r.item_id] for r in got)


def test_similarity_of_multisets(spark):
    import random

    from hopwise.llm.decontaminate import weighted_jaccard

    rng = random.Random(3)
    rows = [([rng.randrange(5) for _ in range(rng.randint(1, 30))], [rng.randrange(6) for _ in range(rng.randint(1, 30))]) for _ in range(50)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<long>, b array<long>").select("i", weighted_jaccard(F.col("a"), F.col("b")).alias("x"), simhash(F.col("a"), 200).alias("f8"), simhash(F.col("a")).alias("f16"), simhash(F.col("a"), 10**6).alias("f32"))
    for r in got.collect():
        x, y = map(Counter, rows[r.i])
        assert abs(r.x - sum((x & y).values()) / sum((x | y).values())) < 1e-12
        assert r.f8 == r.f16 == r.f32


def test_fingerprints_find_nearly_all(spark):
    """Recall of the blocks alone, without the windows beyond the radius."""
    d = "/root/testdata/sf0.01"
    found = leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).select("hamming").collect()
    assert found and sum(r.hamming <= RADIUS for r in found) >= 0.9 * len(found)


def test_blocks_meet_within_the_radius_and_seldom_beyond(spark):
    """Every difference of up to RADIUS bits is within some block's radius; few random ones are."""
    import random

    rng, radii = random.Random(9), block_radii(RADIUS)
    balls = spark.range(1).select(F.inline(block_balls(RADIUS))).collect()
    ball = {i: {r.mask for r in balls if r.ball == i} for i in range(BLOCKS)}
    meets = lambda x: any(x >> 16 * i & 0xFFFF in ball[i] for i in range(BLOCKS))
    assert sum(r + 1 for r in radii) == RADIUS + 1
    assert all(meets(sum(1 << b for b in rng.sample(range(64), n))) for n in range(RADIUS + 1) for _ in range(2000))
    assert sum(len(ball[i]) for i in range(BLOCKS)) / 2**16 < 0.05 and sum(meets(rng.getrandbits(64)) for _ in range(20_000)) < 0.05 * 20_000


def test_repetitive_texts(spark):
    """Windows without number that are all alike are looked up once."""
    bench = spark.createDataFrame([(1, "word " * 200)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 5_000), (2, "word " * 150), (3, "other " + "word " * 199)], "doc_id long, text string")
    got = {r.doc_id: (r.start_word, r.n_words, r.similarity) for r in leaks(docs, bench).collect()}
    assert got[1] == (0, 200, 1.0) and got[3][2] > 0.97 and 2 not in got


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 0), (2, "Short one", 0), (3, None, 0), (4, " ! ", 0)], "item_id long, text string, key int")
    rows = [(1, None), (2, ""), (3, "x short ONE."), (None, "Alpha beta, gamma delta epsilon zeta"), (5, "a " * 100_000 + "alpha beta gamma delta epsilon zeta"), (6, "clean text here"), (6, "clean text here")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, item_id int")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == {(3, 2), (None, 1), (5, 1)}
    kept = keep_clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 6] and kept.columns == docs.columns
    clash = docs.withColumnRenamed("item_id", "id").withColumn("_bad", F.lit(1))
    assert keep_clean(clash, bench).columns == clash.columns and keep_clean(clash, bench).count() == 4
    assert leaks(docs.limit(0), bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0
