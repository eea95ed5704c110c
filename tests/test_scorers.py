import math

from pyspark.sql import functions as F

from hopwise.operators import fold, scorers
from hopwise.sources.hops import ev_hops


class Loud:
    def __init__(self):
        self.asked = []

    def trust(self, texts):
        self.asked.append([len(t) for t in texts])
        assert len(texts) <= 4 and self.asked[-1] == sorted(self.asked[-1])
        return [len(t) / 100 for t in texts]


def test_batches_are_of_like_length_and_come_back_in_order(spark):
    texts = ["x" * ((i * 37) % 90) for i in range(50)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.s for r in rows.select("i", scorers.batched_trust(Loud, 4)(F.lit("tool"), F.col("t")).alias("s")).collect()}
    assert got == {i: len(t or "") / 100 for i, t in enumerate(texts)}


def test_linear_scorer_is_the_fitted_pipeline(spark):
    rows = [(f"please {w} the report number {i}", int(w in ("ignore", "bypass"))) for i in range(40) for w in ("read", "ignore", "send", "bypass")]
    train = spark.createDataFrame(rows, "text string, label int")
    model = scorers.fit_lexical(train, 200)
    mine = scorers.linear_scorer(model)
    texts = [t for t, _ in rows[:12]] + ["", "quite other words here", "ignore ignore the report"]
    want = {r.text: r.trust for r in scorers.score_lexical(model, spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for t, trust in zip(texts, mine.trust(texts)):
        assert math.isclose(1 - trust, want[t], abs_tol=1e-9)


def test_verdicts_with_a_fitted_scorer_take_the_worst_chunk(spark):
    hops = ev_hops(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("session_id < 5")
    long = F.when(F.col("hop") == 2, F.concat(F.repeat(F.lit("fine words only. "), 80), F.lit("bad "), F.repeat(F.lit("more of it. "), 30))).otherwise(F.col("content"))
    hops = hops.withColumn("content", long).withColumn("event_text", F.coalesce("content", F.lit("")))
    model = scorers.LinearScorer({"bad": 9.0}, -3.0, r"\w+")
    scorer = scorers.batched_trust(lambda: model)
    chunks = {(r.session_id, r.hop): r for r in fold.chunk_scored(hops, scorer).collect()}
    judged = fold.verdicts(hops, scorer=scorer).collect()
    assert any(r.hop == 2 and r.model_trust is not None for r in judged)
    for r in judged:
        if r.model_trust is not None:
            assert math.isclose(r.model_trust, chunks[r.session_id, r.hop].model_trust)
    bad = [r for r in chunks.values() if r.hop == 2 and r.model_trust is not None]
    assert bad and all(r.n_chunks > 2 and r.worst > 0 and r.model_trust < 0.01 for r in bad)


def test_word_odds_of_an_empty_table(spark):
    model = scorers.fit_word_odds(spark.createDataFrame([], "text string, label int"))
    assert model.weights == {} and model.trust(["x", ""]) == [0.5, 0.5]
