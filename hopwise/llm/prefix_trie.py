"""Prefix trie of conversations by pointer jumping.

Conversations are first rebuilt, so that some share their first turns.  A node is the sequence of
the first d turns of some rebuilt conversation; its key is the exclusive-or of 128-bit digests of
(place, role, text), so keys are running values that can be carried from range to range, and the
edge to the parent takes the last digest out again.  Numbers of a node's whole subtree are summed in
doubling rounds: in round k every node gives what it has from below to its ancestor 2^k above, then
takes that ancestor's pointer.  Only nodes deeper than 2^k take part, so a few very long
conversations cost rounds and not rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed, table, written
from hopwise.llm.turns import joined_sha256, numbered

#: Conversations in groups of so many share turns of the first; so many turns at most.
GROUP, SHARED = 5, 8
_EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _turns(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, p, digest, bytes): turns in order; ties by role, then digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        role.alias("role"),
        F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = numbered(rows, "conv_id", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")])
    return written(placed.select("part", "conv_id", "p", "digest", "bytes"))


def _mixed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "depth", "digest")


def members(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rebuilt conversations: their turns (a, b, up_a, up_b, depth, bytes, conv_id), where
    (a, b) is the key of the node that ends in the turn and (up_a, up_b) that of its parent; their
    ends (conv_id, a, b); and the ids (conv_id)."""
    turns = _turns(conversations)
    ranges = checkpointed(turns.groupBy("part", "conv_id").agg(F.max("p").alias("last")))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = ranges.groupBy("conv_id").agg(F.max("last").alias("n")).select("conv_id", "n", base.alias("base"))
    firsts = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    h = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1))
    convs = convs.join(firsts, "base", "left").withColumn("h", h)
    # h own turns go, for m of the base
    convs = checkpointed(convs.select("conv_id", "base", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")))

    known = ranges.join(convs, "conv_id").select("part", "conv_id", "n", "h", "m")
    own = turns.join(known, ["part", "conv_id"]).where("p > h").withColumn("depth", F.col("p") - F.col("h") + F.col("m"))
    own = own.withColumns({"x": _mixed(1), "y": _mixed(2)})
    so_far = Window.partitionBy("part", "conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"run_x": F.bit_xor("x").over(so_far), "run_y": F.bit_xor("y").over(so_far)})
    own = written(own.select("part", "conv_id", "p", "n", "depth", "bytes", "x", "y", "run_x", "run_y"))

    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("part", "conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = checkpointed(carried.select("part", "conv_id", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"in_{c}") for c in "xy"]))

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"a": F.col("run_x").bitwiseXOR(F.col("in_x")), "b": F.col("run_y").bitwiseXOR(F.col("in_y"))})
        return rows.withColumns({"up_a": F.col("a").bitwiseXOR(F.col("x")), "up_b": F.col("b").bitwiseXOR(F.col("y"))})

    node = ["a", "b", "up_a", "up_b", "depth", "bytes"]
    shared = own.where((F.col("conv_id") % GROUP == 0) & (F.col("depth") <= SHARED)).join(carried, ["part", "conv_id"])
    shared = keyed(shared).select(F.col("conv_id").alias("base"), *node)
    inherited = checkpointed(convs.where("m > 0").select("conv_id", "base", "m").join(shared, "base").where("depth <= m"))
    seeds = inherited.where("depth = m").select("conv_id", F.col("a").alias("of_x"), F.col("b").alias("of_y"))
    begun = carried.join(seeds, "conv_id", "left").select(
        "part", "conv_id", *[F.col(f"in_{c}").bitwiseXOR(F.coalesce(f"of_{c}", F.lit(0))).alias(f"in_{c}") for c in "xy"]
    )
    own = written(keyed(own.join(begun, ["part", "conv_id"])).select(*node, "conv_id", (F.col("p") == F.col("n")).alias("is_last")))

    short = convs.where("n <= h").join(seeds, "conv_id", "left").select("conv_id", F.coalesce("of_x", F.lit(0)).alias("a"), F.coalesce("of_y", F.lit(0)).alias("b"))
    ends = own.where("is_last").select("conv_id", "a", "b").unionByName(short)
    return own.select(*node, "conv_id").unionByName(inherited.select(*node, "conv_id")), ends, convs.select("conv_id")


def subtree_sums(nodes: DataFrame, amounts: list[str]) -> DataFrame:
    """(a, b, amounts) summed over the subtree of every node; the node of depth 0 has the key (0, 0).

    Nodes are (a, b, up_a, up_b, depth, amounts), a tree.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = [F.sum(c).alias(c) for c in amounts]
    found, step = [nodes.select("a", "b", *amounts)], 1
    active = nodes.where("depth >= 1").select("a", "b", "up_a", "up_b", "depth", *amounts)
    while step <= deepest:
        got = checkpointed(active.groupBy("up_a", "up_b").agg(*sums).toDF("a", "b", *amounts))
        found.append(got)
        if 2 * step > deepest:
            break
        deeper = active.where(F.col("depth") >= 2 * step)
        added = deeper.join(got.toDF("a", "b", *[f"got_{c}" for c in amounts]), ["a", "b"], "left")
        added = added.select("a", "b", "up_a", "up_b", "depth", *[(F.col(c) + F.coalesce(f"got_{c}", F.lit(0))).alias(c) for c in amounts])
        # those at 2^(k+1) reach the root; of the others the ancestor is still active
        at_root = added.where(F.col("depth") == 2 * step).withColumns({"up_a": F.lit(0).cast("long"), "up_b": F.lit(0).cast("long")})
        beyond = checkpointed(added.where(F.col("depth") > 2 * step).withColumnsRenamed({"up_a": "via_a", "up_b": "via_b"}))
        pointers = active.select(F.col("a").alias("via_a"), F.col("b").alias("via_b"), "up_a", "up_b")
        jumped = beyond.join(pointers, ["via_a", "via_b"]).select("a", "b", "up_a", "up_b", "depth", *amounts)
        active, step = checkpointed(jumped.unionByName(at_root)), 2 * step
    return reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(*sums)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the node's key (a, b).

    Null roles and texts are empty; turns without a number come first; rows of one turn go by role
    and digest; repeated rows are turns of their own; rows without a conv_id take no part; a table
    without conversations has no nodes, not even the root.
    """
    turns, ends, ids = members(conversations)
    same = [F.min(c).alias(c) for c in ("up_a", "up_b", "depth", "bytes", "conv_id")]
    nodes = turns.groupBy("a", "b").agg(*same, F.count("*").alias("n_convs"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("depth"), zero.alias("bytes"), "conv_id", "n_convs")
    nodes = checkpointed(nodes.select(root.columns).unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    nodes = checkpointed(nodes.withColumns({"n_leaves": leaf, "saved_tokens": saved}))
    totals = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    listed = joined_sha256(ends.withColumn("id", F.col("conv_id").cast("string")), ["a", "b"], "conv_id", "id", b",").withColumnRenamed("sha256", "ends_sha256")
    found = nodes.drop("n_leaves", "saved_tokens", "bytes").join(totals, ["a", "b"]).join(listed, ["a", "b"], "left")
    found = checkpointed(found).join(parents, ["up_a", "up_b"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY_SHA256)).alias("ends_sha256"), "a", "b",
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("a", "b")


#: CRC-32 of a decimal number's digits, bit by bit.
_CRC32 = """(xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END)))"""

OP13_SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % {GROUP} AS base FROM turns),
h AS (SELECT conv_id, base, {_CRC32} % {SHARED + 1} AS h FROM ids),
rebuilt AS (
    SELECT h.conv_id, 0 AS own, p, role, text FROM h JOIN turns t ON t.conv_id = h.base AND p <= h
    UNION ALL
    SELECT h.conv_id, 1, p, role, text FROM h JOIN turns t ON t.conv_id = h.conv_id AND p > h),
placed AS (
    SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
        sha256(length(role)::VARCHAR || ':' || role || text) AS digest
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)),
paths AS (
    SELECT conv_id, depth, bytes, list(digest) OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS n
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
    UNION ALL
    SELECT conv_id, 0, 0, []::VARCHAR[], (SELECT count(*) FROM rebuilt r WHERE r.conv_id = ids.conv_id) FROM ids),
nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM paths GROUP BY path, depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
above AS (
    SELECT path[:unnest(generate_series(0, depth))] AS path, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * bytes AS saved
    FROM full_nodes),
sums AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (path) LEFT JOIN nodes u ON f.depth > 0 AND u.path = f.path[:f.depth - 1]
"""
