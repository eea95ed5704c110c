"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of metadata columns (domain, language, source).  At every
node the children share their parent's budget by weight, none beyond its capacity (what its
leaves hold in ``max_epochs`` passes): what a short child cannot use goes to its siblings by
weight, and only what no sibling can use had already been given to the parent's siblings, as
a parent's capacity is the sum of its children's.  The shares are a water level, found from
one sort of the siblings by capacity over weight.

Each leaf then takes a prefix of its seeded epochs: epoch e orders the leaf's documents by a
hash of (seed, e, id), epochs follow each other, and documents are taken while the budget is
not yet reached, the last one whole.

Running token sums are taken over hash buckets first and inside a bucket after; rows are dealt
by bucket, so a leaf that holds a third of all rows spreads over up to 4,096 tasks an epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed, unused

TREE = ("domain", "lang", "source")
#: Production weights: by level and label; what is not named weighs 1.
WEIGHTS = {
    "domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 1.0},
    "lang": {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 1.0},
    "source": {"src0": 2.0},
}
SHARE, MAX_EPOCHS, SEED = 0.6, 2, 17
_WORDS = "[^\\x20\\x09-\\x0D]+"
_BUCKET_DIGITS = 3
#: Leaf budgets are broadcast up to this many leaves; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def token_rows(docs: DataFrame, tree: tuple[str, ...] = TREE) -> DataFrame:
    """doc_id, tokens (words of the whole text) and the tree's columns, null labels as ''."""
    return docs.select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("tokens"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in tree],
    ).where("tokens > 0")


def _weight(level: str, weights: dict) -> Column:
    named = [x for k, w in weights.get(level, {}).items() for x in (F.lit(k), F.lit(float(w)))]
    return F.coalesce(F.create_map(*named)[F.col(level)], F.lit(1.0)) if named else F.lit(1.0)


def leaf_budgets(rows: DataFrame, tree: tuple[str, ...] = TREE, weights: dict = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(*tree, supply, budget): each leaf's tokens and the whole tokens it may contribute.

    The total is ``share`` of all tokens, or all capacity of positively weighted leaves if
    that is less.  A weight of 0 takes nothing.
    """
    leaves = rows.groupBy(*tree).agg(F.sum("tokens").alias("supply"))
    usable = F.lit(True)
    for level in tree:
        usable = usable & (_weight(level, weights) > 0)
    nodes = leaves.select(*tree, "supply", F.when(usable, F.col("supply") * max_epochs).otherwise(0).cast("double").alias("cap"))
    given = None
    for depth in range(1, len(tree) + 1):
        keys, parent = list(tree[:depth]), list(tree[: depth - 1])
        level = nodes.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply")).withColumn("w", _weight(tree[depth - 1], weights))
        if parent:
            level = level.join(given, parent)
        else:  # the first level's nodes are few: they are counted by the first label alone
            every = Window.partitionBy()
            level = level.withColumn("budget", F.least(F.sum("supply").over(every) * share, F.sum("cap").over(every)))
        level = level.where("cap > 0").withColumn("ratio", F.col("cap") / F.col("w"))
        upward = Window.partitionBy(*parent).orderBy("ratio", tree[depth - 1])
        below = upward.rowsBetween(Window.unboundedPreceding, -1)
        above = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        level = level.select(*keys, "supply", "cap", "w", "budget", F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("under"), F.sum("w").over(above).alias("over_w"), "ratio")
        full = F.col("under") + F.col("ratio") * F.col("over_w") <= F.col("budget") + 1e-6
        siblings = Window.partitionBy(*parent)
        level = level.withColumn("full", full).withColumn("held", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(siblings)).withColumn("free_w", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(siblings))
        amount = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("held")) * F.col("w") / F.col("free_w"))
        given = level.select(*keys, amount.alias("budget")) if depth < len(tree) else level.select(*keys, "supply", amount.alias("budget"))
    return given.select(*tree, "supply", F.floor(F.col("budget") + 1e-3).cast("long").alias("budget"))


def mix(rows: DataFrame, tree: tuple[str, ...] = TREE, weights: dict = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """From token rows to the selected (doc_id, *tree, tokens, epoch, start, budget).

    One row per document and epoch; ``start`` is the leaf's token count before it.  Texts
    without words hold no tokens and are not selected.  Rows that repeat an id are separate
    documents next to each other.  No rows in, no rows out.
    """
    rows = checkpointed(rows)  # ids, labels and counts: the texts are read once
    budgets = checkpointed(leaf_budgets(rows, tree, weights, share, max_epochs).where("budget > 0"))
    budgets = F.broadcast(budgets) if budgets.count() <= BROADCAST_ROWS else budgets
    passes = F.ceil(F.col("budget") / F.col("supply")).cast("int")
    drawn = rows.join(budgets, list(tree)).select("doc_id", *tree, "tokens", "budget", F.explode(F.sequence(F.lit(0), passes - 1)).alias("epoch"))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    drawn = drawn.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, _BUCKET_DIGITS))
    # by bucket, not by leaf: a join that deals rows by leaf would satisfy the window below
    drawn = drawn.repartition(*tree, "epoch", "_bucket")
    groups = drawn.groupBy(*tree, "epoch", "_bucket").agg(F.sum("tokens").alias("_sum"))
    along = Window.partitionBy(*tree).orderBy("epoch", "_bucket")
    groups = groups.select(*tree, "epoch", "_bucket", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*tree, "epoch", "_bucket").orderBy("_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.withColumn("_run", F.sum("tokens").over(inside) - F.col("tokens"))
    placed = placed.join(groups, [*tree, "epoch", "_bucket"]).withColumn("start", F.col("_before") + F.col("_run"))
    return placed.where("start < budget").select("doc_id", *tree, "tokens", "epoch", "start", "budget")


def with_domain(docs: DataFrame) -> DataFrame:
    """The documents with a ``domain`` derived from the number of their source."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("domain"), number % 3))


def keep_mixed(docs: DataFrame, share: float = 0.8, **options) -> DataFrame:
    """The documents, columns as they were, that one seeded epoch of the mix selects."""
    rows = token_rows(with_domain(docs))
    id, tokens = unused("id", docs), unused("tokens", docs)
    chosen = mix(rows, share=share, max_epochs=1, **options).select(F.col("doc_id").alias(id), F.col("tokens").alias(tokens)).distinct()
    words = F.regexp_count("text", F.lit(_WORDS))
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(id)) & (words == F.col(tokens)), "left_semi")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(token_rows(with_domain(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def _sql_weight(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1.0 END"


def _sql_level(depth: int) -> str:
    keys, parent = ", ".join(TREE[:depth]), ", ".join(TREE[: depth - 1])
    by = f"PARTITION BY {parent}" if parent else ""
    joined = f"JOIN given{depth - 1} USING ({parent})" if parent else "CROSS JOIN given0"
    return f"""
, l{depth} AS (SELECT {keys}, sum(CAST(cap AS DOUBLE)) AS cap, sum(supply) AS supply, {_sql_weight(TREE[depth - 1])} AS w FROM leaves GROUP BY {keys}
), r{depth} AS (SELECT *, cap / w AS ratio FROM l{depth} {joined}
), s{depth} AS (SELECT *,
    coalesce(sum(cap) OVER ({by} ORDER BY ratio, {TREE[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under,
    sum(w) OVER ({by} ORDER BY ratio, {TREE[depth - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_w FROM r{depth}
), f{depth} AS (SELECT *, under + ratio * over_w <= budget + 1e-6 AS is_full FROM s{depth}
), h{depth} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS held, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS free_w FROM f{depth}
), given{depth} AS (SELECT {keys}, {"supply, " if depth == len(TREE) else ""}CASE WHEN is_full THEN cap ELSE (budget - held) * w / free_w END AS budget FROM h{depth})"""


OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS tokens,
    'domain' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 3 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), tok AS (SELECT * FROM docs WHERE tokens > 0
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap FROM tok GROUP BY 1, 2, 3
), given0 AS (SELECT least(sum(supply) * CAST({SHARE} AS DOUBLE), sum(cap)) AS budget FROM leaves)
{_sql_level(1)}{_sql_level(2)}{_sql_level(3)}
, budgets AS (SELECT domain, lang, source, supply, CAST(floor(budget + 1e-3) AS BIGINT) AS budget FROM given3
), drawn AS (SELECT doc_id, domain, lang, source, tokens, budget, CAST(epoch AS INTEGER) AS epoch
  FROM (SELECT *, unnest(range(CAST(ceil(budget / CAST(supply AS DOUBLE)) AS BIGINT))) AS epoch FROM tok JOIN budgets USING (domain, lang, source) WHERE budget > 0)
), placed AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, md5('{SEED}-' || epoch || '-' || doc_id), doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS start FROM drawn)
SELECT doc_id, domain, lang, source, tokens, epoch, start, budget FROM placed WHERE start < budget
"""
