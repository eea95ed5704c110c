import hashlib
import random
import zlib

from hopwise.llm.prefix_trie import OP13_SQL, op13_prefix_trie, prefix_trie
from tests.oracle import differences

SCHEMA = "conv_id long, turn long, role string, text string"


def slow_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    nodes, ends = {}, {}
    for c, own in turns.items():
        base, h = c - (abs(c) % 5) * (1 if c > 0 else -1), zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(members) - 1) * (len(path[-1][1].encode()) if path else 0)
    out = []
    for path, members in nodes.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids.get(path, 0), leaves[path], saved[path], digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.drop("a", "b").collect()), key=str)


def test_against_sql(spark):
    assert not differences(spark, op13_prefix_trie, OP13_SQL, "/root/testdata/sf0.001")


def test_brute_force_on_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, d)) == slow_trie(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (0, None, None, None), (0, 3, "user", "a"), (0, 3, "user", "a"), (0, 3, "user", "b"), (1, 1, "user", "é,\n"), (2, 1, None, "q"), (-7, 1, "user", "z"), (-5, 0, "user", "y"), (-5, 9, "assistant", "w"), (14, 1, "user", "short"), (2**62, 1, "user", "a"), (99, 1, "a", "bc"), (98, 1, "ab", "c")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, digest string")
    assert found(prefix_trie(df)) == slow_trie(rows)
    assert prefix_trie(df.limit(0)).collect() == [] and prefix_trie(df.where("conv_id is null")).collect() == []


def test_deep_and_hot(spark):
    draw, rows = random.Random(3), []
    for c in range(150):
        n = draw.choice([1, 2, 3, 5, 9]) if c not in (10, 11, 50) else 700
        for t in range(n):
            hot = c % 3 == 0 and t < 4 or c in (10, 50) and t < 600
            rows.append((c, t, ["user", "assistant"][t % 2], f"same {t}" if hot else f"own {draw.randint(0, 2)}"))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefix_trie(df)) == slow_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
