import re

import xxhash

from hopwise.llm.simhash_dedup import keep_one_per_group, near_duplicate_groups


def slow_fp(text):
    data = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", data)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    fp = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in shingles)
        fp |= (2 * ones > len(shingles)) << b
    return fp


def slow_components(rows):
    fps = [slow_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f, least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def check(spark, rows):
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == slow_components(rows)


def test_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chains_of_small_edits(spark):
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        words[(i * 37) % 300] = f"other{i}"
        rows.append((1000 - i, " ".join(words)))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n "), (4, "one two"), (4, "one two"), (7, "One TWO"), (8, "É é"), (6, "x" * 100_000), (2, "a b c d " * 20_000)]
    check(spark, rows)
    check(spark, rows[:1])


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_groups(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 8), (None, "a b c d e", 9)], "doc_id long, text string, fp int")
    kept = sorted((r.doc_id or 0, r.fp) for r in keep_one_per_group(docs).collect())
    assert kept == [(0, 9), (1, 7)]
