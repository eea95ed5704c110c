import glob
import time
from collections import Counter

import numpy as np

from hopwise.llm import near_copies
from hopwise.llm.near_copies import keep_one_copy, text_tokens


def slow_kept(rows):
    bags = []
    for _, t in rows:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if a and b and a.keys().isdisjoint(b):
                continue
            both = sum((a & b).values())
            if 5 * both >= 4 * (sum(a.values()) + sum(b.values()) - both):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                parent[y] = x
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def kept(spark, rows):
    return sorted(r.doc_id for r in keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_near_copies_at_the_threshold(spark):
    words = [f"w{i}" for i in range(300)]

    def edited(*at):
        return " ".join("other" if i in at else w for i, w in enumerate(words))

    # an edit changes five of 296 shingles: 6 edits 266 / 326 = 0.816, 7 edits 261 / 331 = 0.789
    rows = [(1, edited()), (2, edited(*range(20, 290, 45))), (3, edited(*range(10, 290, 40))), (4, " ".join(words[:100] * 3)), (5, " ".join(words[:100]))]
    assert kept(spark, rows) == slow_kept(rows) == [1, 3, 4, 5]


def test_brute_force_with_boilerplate_and_chains(spark):
    words = [f"word{i}" for i in range(200)]
    rows = [(i, f"own{i} text{i} " + "this line of the license is in each and every one of the files " * (1 + i % 3)) for i in range(60)]
    for i in range(60):
        words[(i * 37) % 200] = f"new{i}"
        words[(i * 53) % 200] = f"also{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A b"), (2004, "a c")]
    assert kept(spark, rows) == slow_kept(rows)


def test_same_id_other_text(spark):
    rows = [(1, "one text of more than five words"), (1, "and quite another with the same id"), (1, "one text of more than five words"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in keep_one_copy(docs).collect()) == ["a b", rows[1][1], rows[0][1]]


def test_all_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == slow_kept(rows)


def test_unlike_texts_with_one_common_token(spark):
    common = "one line that all have"
    texts = [f"{common} " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(2000)]
    token = int(text_tokens(common.encode())[0])
    rows, lists = [], []
    for i, t in enumerate(texts):
        own = text_tokens(t.encode())
        rows.append((near_copies._node(own), i, t))
        lists.append((token - (1 << 64) if token >> 63 else token, (rows[-1][0], len(own), 0), rows[-1][0]))
    docs = spark.createDataFrame([(i, t) for _, i, t in rows], "doc_id long, text string")
    nodes = spark.createDataFrame([(n, i) for n, i, _ in rows], "node long, doc_id long").join(docs.selectExpr("doc_id", "xxhash64(text) as h"), "doc_id")
    members = spark.createDataFrame(lists, "token long, y struct<node:long,n:int,at:int>, c long")
    left = near_copies._remaining(members, docs, nodes, np.zeros(0, np.uint64), 5, 0.8)
    assert left.count() <= len(texts)


def test_long_lists_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LONG_LIST", 2)
    monkeypatch.setattr(near_copies, "MOST_FREQUENT", 3)
    monkeypatch.setattr(near_copies, "HUB_NODES", 3)
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(12)]
    rows = [(i, "\n".join(lines[(i * 5 + k * (1 + i % 3)) % 12] for k in range(7)) + f" tail{i // 2} x{i}") for i in range(120)]
    assert kept(spark, rows) == slow_kept(rows)


def test_common_lines_come_last(spark, monkeypatch):
    asked = []
    remaining = near_copies._remaining
    monkeypatch.setattr(near_copies, "_remaining", lambda *a: asked.append(remaining(*a)) or asked[-1])
    line = "this line of a dozen words is the first of all these texts "
    rows = [(i, line + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(1500)]
    assert len(kept(spark, rows)) == 1500
    assert asked[0].count() == 0


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in disk.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_shuffles_go_with_their_step(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs = spark.createDataFrame([(i, f"text {i // 2} " + " ".join(f"w{i // 2}x{j}" for j in range(60)) + f" end{i}") for i in range(200)], "doc_id long, text string")
    before, was = shuffle_files(spark), spark.conf.get(key, None)
    groups = near_copies.near_copy_groups(docs)
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key, None) == was
    assert groups.select("component").distinct().count() == 100


def test_shingles_and_hashes_are_one_to_one():
    seen = {}
    for text in ("a b c d e f", "b a c d e f a b c d e f", "a b", "B A", "a b a b", "a b c d e", "x" * 40 + " a b c d", "", " A\tb\nC d  e F "):
        words = text.lower().split()
        shingles = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        one = {s: int(near_copies._hashes(" ".join(s).encode(), 5)[0]) for s in shingles}
        assert sorted(one[s] for s in shingles) == near_copies._hashes(text.encode(), 5).tolist()
        seen |= one
    assert len(set(seen.values())) == len(seen)


def test_stars_give_each_node_once(spark):
    rows = [(1, 5, 9, 0), (1, 5, 9, 0), (2, 7, 9, 1), (2, -3, 8, 2), (2, 7, 9, 1), (2, -3, 8, 2), (2, 9, 9, 0), (3, 1, 5, 0)]
    met = near_copies._stars(spark.createDataFrame(rows, "token long, node long, n int, at int")).collect()
    assert sorted((r.token, tuple(r.y), tuple(r.x)) for r in met) == [(2, (-3, 8, 2), (-3, 8, 2)), (2, (7, 9, 1), (-3, 8, 2)), (2, (9, 9, 0), (-3, 8, 2))]


def test_sketches_never_part_a_pair():
    rng = np.random.default_rng(1)
    for n, m in ((4, 5), (90, 100), (300, 340), (1000, 1100), (70_000, 75_000)):
        for both in (int(0.95 * n), int(0.5 * n)):
            own = rng.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
            x, y = (near_copies._sketch(t) for t in (own[:n], own[n - both :]))
            size = min(len(x), len(y))
            far = int(np.bitwise_count(near_copies._folded(x, size) ^ near_copies._folded(y, size)).sum())
            assert far <= n + m - 2 * both


def listed(spark, texts, *lists):
    """What is asked for of lists of texts, each a component of its own, and the ids of their nodes."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [text_tokens(t.encode()) for t in texts]
    ids = {near_copies._node(t): i for i, t in enumerate(own)}
    nodes = spark.createDataFrame([(n, i) for n, i in ids.items()], "node long, doc_id long").join(docs.selectExpr("doc_id", "xxhash64(text) as h"), "doc_id")
    rows = [(k, (near_copies._node(own[i]), len(own[i]), 0), near_copies._node(own[i])) for k, at in enumerate(lists) for i in at]
    found = near_copies._remaining(spark.createDataFrame(rows, "token long, y struct<node:long,n:int,at:int>, c long"), docs, nodes, np.zeros(0, np.uint64), 5, 0.8)
    return sorted(tuple(sorted((ids[r.a], ids[r.b]))) for r in found.collect())


def test_unlike_texts_with_a_common_passage(spark):
    passage = " ".join(f"c{j}" for j in range(30))
    texts = [f"{passage} " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    assert listed(spark, texts, *[range(k, 300) for k in range(20)]) == []


def test_lists_in_blocks_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LONG_LIST", 3)
    texts = [" ".join(f"g{i // 4}w{j}" for j in range(100)) + f" end{i}" for i in range(20)]
    pairs = [(i, j) for i in range(20) for j in range(i + 1, 20) if i // 4 == j // 4]
    assert listed(spark, texts, range(20), range(20), range(2, 18)) == pairs


def test_a_pair_of_many_lists_is_given_once(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"g{j}" if j != i else f"own{i}" for j in range(150)) for i in range(100)]
    own = [text_tokens(t.encode()) for t in texts]
    nodes = spark.createDataFrame([(near_copies._node(t), len(t), near_copies._sketch(t)) for t in own], "node long, n long, sketch binary")
    rows = [(k, (near_copies._node(own[i]), len(own[i]), 0), near_copies._node(own[i])) for k in range(30) for i in rng.permutation(100)[:80].tolist()]
    lists = spark.createDataFrame(rows, "token long, y struct<node:long,n:int,at:int>, c long")
    found = near_copies._in_lists(lists, nodes, 0.8)
    assert found.count() == found.distinct().count() == 100 * 99 // 2
