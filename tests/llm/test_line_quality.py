from hopwise.llm.line_quality import OP8_SQL, boilerplate_lines, judge, op8_line_quality, without_boilerplate
from tests.oracle import differences


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert not differences(spark, op8_line_quality, OP8_SQL, f"/root/testdata/{sf}")


def docs_with_footer(spark):
    def body(i):
        return " ".join("".join(chr(97 + int(c)) for c in f"{i}{j:03}") for j in range(60))

    rows = [(i, f"{body(i)}\nFooter  {i % 10} of the site", "h", 1) for i in range(30)]
    rows += [(100 + i, "Footer 1 of the site\n" * 11 + body(400 + i)[:100], "h", 1) for i in range(2)]
    rows += [(200, None, "h", 1), (201, "", None, 1), (None, body(300), None, 1), (202, body(301), None, 1), (202, body(301), None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host int")


def test_boilerplate_and_odd_rows(spark):
    docs = docs_with_footer(spark).drop("host")
    assert [(r.host, r.n_docs) for r in boilerplate_lines(docs).collect()] == [("h", 32)]
    got = {(r.doc_id, r.kept, r.words_removed) for r in judge(docs).collect()}
    assert {(i, True, 5) for i in range(30)} <= got
    assert {(100, False, 55), (101, False, 55), (200, False, 0), (201, False, 0), (None, True, 0), (202, True, 0)} <= got
    assert judge(docs).count() == docs.count()
    assert judge(docs.limit(0)).count() == 0


def test_text_without_boilerplate_keeps_other_columns(spark):
    docs = docs_with_footer(spark)
    out = without_boilerplate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not [r for r in out.collect() if r.text and "Footer" in r.text]


def test_columns_that_clash(spark):
    rows = [(i, f"the same line\n{"own " * (i + 1)}", "h", 1, 2, 3) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _cut int, cut int, _row int")
    out = without_boilerplate(docs)
    assert out.columns == docs.columns and {r.text for r in out.collect()} == {"own " * (i + 1) for i in range(30)}
    assert judge(docs).count() == 30
