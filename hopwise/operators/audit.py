"""What must hold of a set of session records, rule by rule, with leakage over several keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.sources.folders import scratch

SPLITS = ("train", "validation", "test")


def connected(rows: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """(id, group): rows that share a value of any of the ``keys`` (null: none), directly or through
    others, have the same group, their least id.

    Every round gives each row the least group of those it shares a key with, then the group of
    that; rounds go on until no group changes, and each is written to the shared folder.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "hopwise-groups")
    at = rows.groupBy(F.col(id).alias("id")).agg(*[F.collect_set(k).alias(f"k{i}") for i, k in enumerate(keys)]).withColumn("group", F.col("id"))
    at.write.parquet(f"{folder}/0")
    for n in range(1, 1_000):
        at = now = spark.read.parquet(f"{folder}/{n - 1}")
        for i in range(len(keys)):
            least = at.select("group", F.explode(f"k{i}").alias("key")).groupBy("key").agg(F.min("group").alias("g"))
            met = now.select("id", F.explode(f"k{i}").alias("key")).join(least, "key").groupBy("id").agg(F.min("g").alias("g"))
            now = now.join(met, "id", "left").withColumn("group", F.least("group", "g")).drop("g")
        heads = now.select(F.col("id").alias("group"), F.col("group").alias("g"))
        now = now.join(heads, "group", "left").withColumn("group", F.least("group", "g")).drop("g").withColumnRenamed("group", "now")
        now = now.join(at.select("id", "group"), "id").select("id", *[f"k{i}" for i in range(len(keys))], F.col("now").alias("group"), (F.col("now") != F.col("group")).alias("moved"))
        now.write.parquet(f"{folder}/{n}")
        if spark.read.parquet(f"{folder}/{n}").where("moved").limit(1).count() == 0:
            break
    return spark.read.parquet(f"{folder}/{n}").select("id", "group")


def integrity(records: DataFrame, keys: list[str], required: list[str], classes: tuple[str, ...]) -> DataFrame:
    """One row a rule: (rule, n, example), how many records (for leakage: groups) break it, and the least
    of their ids; n is 0 and the example null where it holds.

    Records have sample_id, split, is_attack, attack_class, messages (hop, role, source, target) and
    the ``keys``.  Ids are unique; ``required`` fields are there; messages are there, numbered from 1
    and addressed; splits are known; records without attack have no class and others one of the
    ``classes`` or none; no group of records that ``connected`` joins stands in two splits.
    """
    role = F.exists("messages", lambda m: m["role"].isNull() | m["source"].isNull() | m["target"].isNull())
    numbers = F.transform("messages", lambda m: m["hop"].cast("int"))
    structure = F.coalesce(F.size("messages") > 0, F.lit(False)) & (numbers == F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("messages")))) & ~role
    twice = F.count("*").over(Window.partitionBy("sample_id")) > 1
    attack = F.coalesce("is_attack", F.lit(False))
    broken: dict[str, Column] = {
        "unique_sample_ids": F.col("_twice"),
        "required_fields": F.array_contains(F.array(*[F.col(c).isNull() for c in required]), True),
        "message_structure": ~F.coalesce(structure, F.lit(False)),
        "valid_splits": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "benign_class_null": ~attack & F.col("attack_class").isNotNull(),
        "valid_attack_classes": attack & F.col("attack_class").isNotNull() & ~F.col("attack_class").isin(*classes),
    }
    marked = records.withColumn("_twice", twice).select("sample_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in broken.items()]))).alias("rule"))
    found = marked.groupBy("rule").agg(F.count("*").alias("n"), F.min("sample_id").alias("example"))
    groups = connected(records, "sample_id", keys).withColumnRenamed("id", "sample_id")
    apart = records.join(groups, "sample_id").groupBy("group").agg(F.count_distinct("split").alias("s")).where("s > 1")
    leaks = apart.agg(F.count("*").alias("n"), F.min("group").alias("example")).select(F.lit("no_group_split_leakage").alias("rule"), "n", "example")
    rules = records.sparkSession.createDataFrame([(r,) for r in [*broken, "no_group_split_leakage"]], "rule string")
    return rules.join(found.unionByName(leaks), "rule", "left").select("rule", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "example")
