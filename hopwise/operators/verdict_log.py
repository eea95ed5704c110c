"""The verdict log: append, query and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import vocabulary as V


def append(verdicts: DataFrame, path: str) -> None:
    """Add verdicts to the log, a folder a tier."""
    verdicts.withColumn("created_at", F.current_timestamp()).write.mode("append").partitionBy("tier").parquet(path)


def stats(log: DataFrame) -> DataFrame:
    """Count of every tier, also of those without events, and the share not passed in percent."""
    tiers = log.sparkSession.createDataFrame([(t,) for t in V.TIERS], "tier string")
    counts = tiers.join(log.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy()
    total, held = F.sum("n").over(whole), F.sum(F.when(F.col("tier") != "PASS", F.col("n")).otherwise(0)).over(whole)
    return counts.select("tier", "n", F.round(F.when(total == 0, 0.0).otherwise(100.0 * held / total), 2).alias("intercept_rate"))


def latest(log: DataFrame, limit: int = 100, session=None, min_tier: str = "PASS") -> DataFrame:
    """The newest events first, optionally of one session and from a tier upwards."""
    rows = log.where(R.severity(F.col("tier")) >= V.TIERS.index(min_tier))
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
    return rows.orderBy(F.desc("id")).limit(limit)


def trace(log: DataFrame) -> DataFrame:
    return log.where("tier <> 'PASS'").orderBy("id")


def reviewed(log: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add ``status``: open, or what the last review (id, action, seq) of a quarantined event says.
    Reviews of other events and other actions have no effect."""
    last = reviews.where("action in ('release', 'reject')").groupBy("id").agg(F.max_by("action", "seq").alias("_action"))
    status = F.when((F.col("tier") == "QUARANTINE") & (F.col("_action") == "release"), "released").when((F.col("tier") == "QUARANTINE") & (F.col("_action") == "reject"), "rejected").otherwise("open")
    return log.join(last, "id", "left").withColumn("status", status).drop("_action")


def drop_session(log: DataFrame, session) -> DataFrame:
    return log.where(F.col("session_id") != session)


def sessions(log: DataFrame) -> DataFrame:
    return log.select("session_id").distinct().orderBy("session_id")
