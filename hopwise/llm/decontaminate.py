"""Benchmark decontamination by SimHash over item-sized windows.

For an item of m words every document window of m words is a possible leak; it is one if the
weighted Jaccard similarity of their five-word shingles (weight: how often a shingle occurs)
reaches 0.8.  All steps are DataFrame expressions:

1.  Windows.  Sliding a window to the right until it starts with a shingle of the item (or
    ends with the document) loses no shared shingle.  So windows are cut where any shingle of
    the benchmark stands, in the lengths of the items that hold it; which item it may be is
    left to the fingerprints.
2.  SimHash.  Window and item fingerprints (64 bits) are cut into BLOCKS blocks; two fingerprints
    within RADIUS bits differ in at most three bits in the first or two in another, so items stand
    for all values that near their own, and the join on (length, block, value) yields every pair
    within the radius; the Hamming distance drops the others.  A window and an item that have
    nothing in common meet with odds of one in 59.  Equal windows of a document are looked up once.
3.  Exact verification of the pairs that are left, on their shingles.
4.  The rest.  A radius guarantees a distance, not a similarity: at 0.8 two fingerprints differ
    in about 10 bits, but some in more.  Windows that hold 0.8 of an item's shingles and lie
    beyond the radius are verified, too, so no leak is lost.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed, unused

WIDTH, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 12, 4
#: Up to this many rows of a two-column table are broadcast; beyond, Spark shuffles the join.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(words: Column, width: int) -> Column:
    n = F.size(words) - width + 1
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))


def simhash(hashes: Column, most: int = 32_767) -> Column:
    """Bit b is 1 if it is set in over half of the hashes, of which there are ``most`` at most.

    Counters are lanes of longs: lane k of long j counts bit ``j + k x width``, so a hash takes
    as many additions as a lane has bits.
    """
    width = next(w for w in (8, 16, 32) if most < 1 << (w - 1))  # the top lane has the sign
    ones = F.lit(sum(1 << k for k in range(0, 64, width))).cast("long")
    none = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(width)])

    def add(sums, h):
        return F.struct(*[(sums[f"c{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(ones)).alias(f"c{j}") for j in range(width)])

    def bits(sums):
        out = F.lit(0).cast("long")
        for j in range(width):
            for k in range(0, 64, width):
                count = F.shiftrightunsigned(sums[f"c{j}"], k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
                bit = (1 << (j + k)) - (1 << 64 if j + k == 63 else 0)
                out = out.bitwiseOR(F.when(2 * count > F.size(hashes), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return F.aggregate(hashes, none, add, bits)


def blocks(fp: Column, cuts: int) -> Column:
    """(block, value) of the cuts + 1 blocks of nearly equal width."""
    at = [64 * i // (cuts + 1) for i in range(cuts + 2)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftright(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"))
            for i, (a, b) in enumerate(zip(at, at[1:]))
        ]
    )


def block_radii(radius: int) -> list[int]:
    """How many bits each block may differ in: fingerprints that exceed this in every block differ in
    more than ``radius``."""
    every, more = divmod(radius + 1, BLOCKS)
    return [every - 1 + (i < more) for i in range(BLOCKS)]


def block_balls(radius: int) -> Column:
    """(ball, mask) of all differences within the blocks' radii."""
    width = 64 // BLOCKS
    masks = [(i, sum(1 << b for b in at)) for i, most in enumerate(block_radii(radius)) for r in range(most + 1) for at in combinations(range(width), r)]
    return F.array(*[F.struct(F.lit(i).alias("ball"), F.lit(m).cast("long").alias("mask")) for i, m in masks])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as multisets: sum of the lesser counts over sum of the greater.  One pass over
    both in order."""
    zero = F.lit(0)
    tagged = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(0).alias("side"))), F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(1).alias("side")))))

    def state(last, left, right, both):
        return F.struct(last.alias("last"), left.alias("left"), right.alias("right"), both.alias("both"))

    def add(s, e):
        same, mine = e["x"].eqNullSafe(s["last"]), 1 - e["side"]
        run = state(s["last"], s["left"] + mine, s["right"] + e["side"], s["both"])
        return F.when(same, run).otherwise(state(e["x"], mine, e["side"], s["both"] + F.least(s["left"], s["right"])))

    first = F.element_at(tagged, 1)["x"]
    both = F.aggregate(tagged, state(F.when(F.lit(False), first), zero, zero, zero), add, lambda s: s["both"] + F.least(s["left"], s["right"]))
    return both / (F.size(a) + F.size(b) - both)


def _sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_words, m, width) of the items with words; shorter items than five words
    are one shingle."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    return items.select("item_id", "item_words", F.size("item_words").alias("m"), F.least(F.lit(WIDTH), F.size("item_words")).alias("width"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of every
    document and item with one of at least ``similarity``; of equals the first that starts with
    a shingle of the item or ends with the document.

    Whole texts and all items take part.  A document shorter than an item is one window.  Null
    or empty texts and items have no words and match nothing; rows that repeat an id share its
    row; a null doc_id is kept as such; no items or documents: no rows.
    """
    items = checkpointed(item_table(benchmark))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # 1 to 5
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    if not widths:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0).alias(c) for c in ("start_word", "n_words", "hamming")], F.lit(0.0).alias("similarity")).limit(0)

    def hashes(words):
        return F.array(*[F.struct(F.lit(w).alias("width"), shingle_hashes(words, w).alias("h")) for w in widths])

    def own_hashes(words, width):
        chosen = F.array().cast("array<long>")
        for w in widths:
            chosen = F.when(width == w, shingle_hashes(words, w)).otherwise(chosen)
        return chosen

    most = items.agg(F.max("m")).first()[0]
    item_shingles = checkpointed(
        items.select("item_id", "m", "width", F.inline(hashes(F.col("item_words"))).alias("w", "h"))
        .where("w = width")
        .select("item_id", "m", "width", F.posexplode("h").alias("j", "h"))
    )
    right = items.select("item_id", "m", own_hashes(F.col("item_words"), F.col("width")).alias("item_hashes"))
    right = checkpointed(right.select("*", simhash(F.col("item_hashes"), most).alias("item_fp")))
    n_items = right.count()

    # 1. places of benchmark shingles, and windows of the items' lengths there
    seeds = _sized(item_shingles, item_shingles.count())
    worded = docs.select("key", words_of(F.col("text")).alias("words"))
    found = worded.select("key", F.size("words").alias("n"), F.inline(hashes(F.col("words"))).alias("width", "hs"))
    found = found.select("key", "n", "width", F.posexplode("hs").alias("i", "h")).join(seeds, ["width", "h"])
    found = checkpointed(found.select("key", "item_id", "n", "m", "width", "i").distinct())
    last = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    windows = found.select("key", "m", "width", F.least("i", last).alias("s"), last.alias("last")).distinct()
    keys = checkpointed(found.select("key").distinct())
    there = docs.join(_sized(keys, keys.count()), "key").select("key", "doc_id", words_of(F.col("text")).alias("words"))
    cut = windows.join(there, "key").select("key", "doc_id", "m", "width", "s", (F.col("s") == F.col("last")).alias("at_end"), F.slice("words", F.col("s") + 1, F.col("m")).alias("window"))
    width = F.least("width", F.size("window"))
    cut = cut.select("key", "doc_id", "m", "s", "at_end", F.size("window").alias("n_words"), own_hashes(F.col("window"), width).alias("hashes"))
    # written out, so that what follows refers to columns, not to their formulas many times over
    left = checkpointed(cut.select("*", simhash(F.col("hashes"), most).alias("fp")))

    # 2. fingerprints that agree in a block; a pair that meets in several counts in its first
    alike = F.xxhash64("hashes").alias("alike")
    one = left.groupBy("key", "doc_id", "m", "at_end", "fp", alike).agg(F.min("s").alias("s")).select("key", "doc_id", "m", "s", "fp", F.inline(blocks(F.col("fp"), BLOCKS - 1)))
    own = right.select("item_id", "m", "item_fp", blocks(F.col("item_fp"), BLOCKS - 1).alias("own"), F.inline(block_balls(radius)))
    listed = own.withColumns({"block": F.col("ball"), "value": F.get("own", F.col("ball"))["value"]})
    listed = checkpointed(listed.select("item_id", "m", "item_fp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value")))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    distance = F.bit_count(differ)
    within = F.array(*[F.bit_count(F.get(blocks(differ, BLOCKS - 1), F.lit(i))["value"]) <= most for i, most in enumerate(block_radii(radius))])
    agree = F.array_position(within, True) - 1
    near = one.join(_sized(listed, listed.count()), ["m", "block", "value"]).where((distance <= radius) & (F.col("block") == agree))
    near = near.select("key", "doc_id", "m", "s", "item_id", distance.alias("hamming"))

    # 4. at: sorted places of the item's shingles; k of them lie in the window that starts at the
    # t-th exactly if the (t + k - 1)-th is not beyond its last shingle
    at = found.groupBy("key", "item_id", "n", "m", "width").agg(F.array_sort(F.collect_list("i")).alias("at"))
    at = at.withColumn("least", F.ceil(similarity * (F.col("m") - F.col("width") + 1) - 1e-9).cast("int")).withColumn("last", last)
    reach = F.col("m") - F.col("width")
    starts = F.filter(F.col("at"), lambda p, t: (p <= F.col("last")) & (F.get(F.col("at"), t + F.col("least") - 1) <= p + reach))
    tail = F.size(F.filter("at", lambda p: p >= F.col("last"))) >= F.col("least")
    starts = F.when(tail, F.array_union(starts, F.array("last"))).otherwise(starts)
    full = at.select("key", "item_id", "m", F.explode(starts).alias("s"))
    full = full.join(left.select("key", "doc_id", "m", "s", "fp"), ["key", "m", "s"]).join(_sized(right.select("item_id", "item_fp"), n_items), "item_id")
    rest = full.where(distance > radius).select("key", "doc_id", "m", "s", "item_id", distance.alias("hamming"))

    # 3. exact verification; a window counts for an item if it starts with one of its shingles
    pairs = checkpointed(near.unionByName(rest))
    score = weighted_jaccard(F.col("hashes"), F.col("item_hashes"))
    both = pairs.join(left.select("key", "m", "s", "at_end", "n_words", "hashes").dropDuplicates(["key", "m", "s"]), ["key", "m", "s"]).join(_sized(right.select("item_id", "item_hashes"), n_items), "item_id")
    both = both.where(F.col("at_end") | F.array_contains("item_hashes", F.get("hashes", F.lit(0))))
    good = both.select("doc_id", "item_id", F.col("s").alias("start_word"), "n_words", "hamming", score.alias("similarity"))
    good = good.where(F.col("similarity") >= similarity)
    best = F.min(F.struct((-F.col("similarity")).alias("x"), "start_word", "n_words", "hamming", "similarity")).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[f"best.{c}" for c in ("start_word", "n_words", "hamming", "similarity")])


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, columns as they were, without any leak.  Rows that share the id of a
    leaking row go with it."""
    id = unused("id", docs)
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(id)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id)), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
), b AS (SELECT item_id, w, len(w) AS m, least({WIDTH}, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark) WHERE len(w) > 0
), bs AS (SELECT item_id, m, k, j, array_to_string(w[j : j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, m - k + 2)) AS j FROM b)
), ks AS (SELECT DISTINCT k FROM b
), ds AS (SELECT doc_id, n, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, len(w) AS n, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)
), win AS (SELECT DISTINCT doc_id, item_id, m, bs.k AS k, least(i - 1, greatest(0, n - m)) AS s, n FROM ds JOIN bs ON ds.g = bs.g AND ds.k = bs.k
), wg AS (SELECT win.doc_id, win.item_id, s, win.m, least(win.m, win.n) AS len_w, win.k, ds.g, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.k = win.k AND ds.i > s AND ds.i + ds.k - 1 <= s + win.m GROUP BY ALL
), bg AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL
), inter AS (SELECT wg.doc_id, wg.item_id, s, sum(least(wg.c, bg.c)) AS x FROM wg JOIN bg USING (item_id, g) GROUP BY ALL
), tot AS (SELECT doc_id, item_id, s, m, any_value(len_w) AS len_w, any_value(k) AS k, sum(c) AS c FROM wg GROUP BY ALL
), sim AS (SELECT doc_id, item_id, s, len_w, x / CAST(c + (m - k + 1) - x AS DOUBLE) AS similarity FROM tot JOIN inter USING (doc_id, item_id, s)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM sim WHERE similarity >= {SIMILARITY})
SELECT doc_id, item_id, CAST(s AS INTEGER) AS start_word, CAST(len_w AS INTEGER) AS n_words, round(similarity, 6) AS similarity FROM ranked WHERE r = 1
"""
