from hopwise.plans import sessions
from tests.test_canonical import CASES


def test_items_beyond_the_start_of_a_text(spark, tmp_path):
    far = "word, " * 100
    spark.createDataFrame([(i, far + t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: set(r["items"].split()) for r in sessions.canonical_full(spark, str(tmp_path)).collect()}
    planted = {"gb29barc12345678901234"}
    assert got == {i: items | planted for i, (_, items) in enumerate(CASES)} | {99: planted}
