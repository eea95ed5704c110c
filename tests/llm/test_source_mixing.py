from pyspark.sql import functions as F

from hopwise.llm.source_mixing import OP5_SQL, keep_mixed, leaf_budgets, mix, op5_source_mixing, token_rows, with_domain
from tests.oracle import differences


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert not differences(spark, op5_source_mixing, OP5_SQL, f"/root/testdata/{sf}")


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("A", "x", "1", 10), ("A", "x", "2", 1000), ("A", "y", "3", 50), ("B", "x", "4", 1000)]
    rows = spark.createDataFrame([(i, t, *p) for i, (*p, t) in enumerate(leaves)], "doc_id long, tokens long, domain string, lang string, source string")
    got = {r.source: r.budget for r in leaf_budgets(rows, weights={}, share=800 / 2060, max_epochs=1).collect()}
    # 800: A and B 400 each; A: y can hold only 50, so x gets 350; x: source 1 holds 10, source 2 the rest
    assert got == {"1": 10, "2": 340, "3": 50, "4": 400}
    got = {r.source: r.budget for r in leaf_budgets(rows, weights={"domain": {"A": 0}}, share=1.0, max_epochs=3).collect()}
    assert got == {"4": 2060}


def test_epochs_and_odd_rows(spark):
    rows = [(1, "a b c", "en", "src1", 0), (1, "a b c", "en", "src1", 0), (2, None, None, None, 0), (3, "", "en", "x", 0), (None, "d e", None, None, 0), (5, "w " * 50_000, "de", "src99999999999", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start int")
    got = mix(token_rows(with_domain(docs)), share=2.0, max_epochs=2).collect()
    assert sorted((str(r.doc_id), r.epoch) for r in got) == sorted([("1", 0), ("1", 0), ("1", 1), ("1", 1), ("None", 0), ("None", 1), ("5", 0), ("5", 1)])
    assert mix(token_rows(with_domain(docs.limit(0)))).count() == 0
    assert keep_mixed(docs, share=1.0).count() == 4 and keep_mixed(docs).columns == docs.columns


def test_columns_that_clash(spark):
    rows = [(i, f"word {i}", "en", "src1", i, i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id int, id int")
    kept = keep_mixed(docs, share=0.5)
    assert kept.columns == docs.columns and kept.count() == 10
