import corpus_pipeline
from hopwise.llm.language_id import fit_on_training_fold, predict
from tests.llm.test_near_copies import slow_kept

D = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r.doc_id for r in out.collect()}
        if name == "language_id":
            good = {r.doc_id for r in predict(docs, fit_on_training_fold(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
            assert kept == good and len(kept) > 0.95 * len(rows)
        elif name == "near_duplicates":
            assert kept == set(slow_kept([(r.doc_id, r.text) for r in rows.values()])) and len(kept) < len(rows)
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            whole = {d for d, r in rows.items() if any(t in r.text for t in items)}
            assert not kept & whole and len(rows) - len(kept) <= len(whole) + 3
        elif name == "source_mixing":
            assert 0.6 * len(rows) < len(kept) < len(rows)
        else:
            assert kept == set(rows)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = out


def test_run(spark):
    from __spark_entry__ import queries

    rows = queries()["pipeline"](spark, D).collect()
    assert {r.shard for r in rows} == set(range(8))


def test_odd_rows(spark, tmp_path):
    text = "the cat and the dog went to the market and bought a fish with the money"
    rows = [(1, text, "en", "src1", 1), (1, text, "en", "src1", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " too", "en", "src2", 1), (4, "12 34", "fr", "x", 1), (5, "un chat et un chien vont au marché", "fr", "src3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{name}-{start is docs}"
            stage(spark, at, D).write.parquet(out)
            at = spark.read.parquet(out)
        assert (at.count() > 0) == (start is docs)
