import glob
import gzip
import hashlib

from hopwise.llm.warc import OP9_SQL, op9_warc, read_warc, shard_cuts, write_warc
from tests.oracle import differences


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert not differences(spark, op9_warc, OP9_SQL, f"/root/testdata/{sf}")


def pages(spark):
    a, b = "é" * 60, "x" * 99
    rows = [(5, "http://h/a b\n", a, 0), (3, None, a, 0), (9, "u", a, 0), (1, "u", b, 0), (2, "u", b, 0), (7, "u", None, 0), (8, "u", "", 0), (10, "u", "z\r\n\r\n" * 200_000, 0), (11, "u", "z\r\n\r\n" * 200_000, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), {r[0]: (r[2] or "").encode() for r in rows}


def test_round_trip_rolled_files_and_odd_rows(spark, tmp_path):
    docs, payloads = pages(spark)
    manifest = write_warc(docs, f"{tmp_path}/w", file_bytes=200, shard_bytes=2_000)
    files = sorted(glob.glob(f"{tmp_path}/w/part-*"))
    assert sorted(r.final for r in manifest.collect()) == [f.rsplit("/", 1)[1] for f in files] and len(files) > 3
    got = {r.page_id: r for r in read_warc(spark, f"{tmp_path}/w").collect()}
    assert set(got) == set(payloads)
    for i, p in payloads.items():
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert bytes(r.payload or b"") == (p if r.record_type == "response" else b"")
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3, 11: 10}


def test_the_same_rows_give_the_same_files(spark, tmp_path):
    docs, _ = pages(spark)
    for name, rows in (("a", docs), ("b", docs.repartition(7).orderBy("html"))):
        write_warc(rows, f"{tmp_path}/{name}", file_bytes=200, shard_bytes=2_000)
    a, b = ({f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{n}/part-*")} for n in "ab")
    assert a == b


def test_empty_and_repeated_rows(spark, tmp_path):
    docs, _ = pages(spark)
    write_warc(docs.limit(0), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").count() == 0
    twice = docs.where("page_id = 3").unionByName(docs.where("page_id = 3")).unionByName(docs.selectExpr("cast(null as long) page_id", "url", "html", "digest").limit(1))
    write_warc(twice, f"{tmp_path}/t")
    got = [(r.page_id, r.record_type, r.payload_bytes) for r in read_warc(spark, f"{tmp_path}/t").collect()]
    assert sorted(got, key=str) == [(3, "response", 120)] * 2 + [(None, "response", 120)]


def test_shards_do_not_depend_on_where_ids_lie(spark):
    def cuts(ids):
        return shard_cuts(spark.createDataFrame([(i, "x" * 488) for i in ids], "page_id long, html string"), 100_000).tolist()

    plain = cuts(range(5_000))
    assert plain == list(range(100, 5_000, 100))
    assert cuts([*range(4_999), 10**17]) == plain
    least, most = -(1 << 63), (1 << 63) - 1
    assert cuts([least, *range(1, 4_999), most]) == plain


def test_files_open_with_their_description(spark, tmp_path):
    docs = spark.createDataFrame([(1, "http://h/é b?q=1&r=[2]", "x"), (2, None, "y")], "page_id long, url string, html string")
    write_warc(docs, f"{tmp_path}/w")
    for f in glob.glob(f"{tmp_path}/w/part-*"):
        text = gzip.open(f).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and f"WARC-Filename: {f.rsplit('/', 1)[1]}".encode() in text
    assert {r.page_id: r.url for r in read_warc(spark, f"{tmp_path}/w").collect()} == {1: "http://h/%C3%A9%20b?q=1&r=[2]", 2: ""}
