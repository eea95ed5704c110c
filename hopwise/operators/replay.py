"""Replay of labelled sessions: with the risk of every hop given, nothing feeds back through the
score, so what the fold carries are running sums and first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import vocabulary as V
from hopwise.operators import prefix, provenance
from hopwise.sources.hops import dealt


def replayed(hops: DataFrame, risk: str) -> DataFrame:
    """(session_id, hop, sensitivity, suspended, reused, given, risky) of every hop before it is judged,
    as the fold has them if every hop's risk is the column ``risk``.

    ``reused`` are the tainted keys (if no item is tainted, the fragments), ``given`` the items that
    a user, or a source that the user named and that was safe, had supplied; ``risky`` tells whether
    a reused key came from a hop at risk.  No hop is judged, so no Python is needed.
    """
    rows = prefix.with_designation(prefix.with_prefix(dealt(provenance.with_items(hops), hops)))
    rows = rows.select("session_id", "hop", "role", F.col(risk).alias("_risk"), "designated", "known", "items", F.concat("source", F.lit("->"), "target").alias("channel"))
    # an untrusted hop's keys are as good as a user's if the user named it and it is safe
    kind = F.when(R.trusted(F.col("role")) | (F.col("designated") & (F.col("_risk") < 0.25)), "trusted").when(R.untrusted(F.col("role")), "plain")
    trust, step = 1.0 - F.col("_risk"), (1.0 - F.col("_risk") < V.PASS_AT).cast("int")
    earlier = prefix.before()
    shut = F.max((trust < V.QUARANTINE_AT).cast("int")).over(prefix.before("channel"))
    rows = rows.withColumns(
        {
            "sensitivity": F.least(F.lit(V.SENSITIVITY_CAP), V.SENSITIVITY_STEP * F.coalesce(F.sum(step).over(earlier), F.lit(0))),
            "suspended": ~R.trusted(F.col("role")) & (F.coalesce(shut, F.lit(0)) > 0),
        }
    )
    entries = provenance.with_entries(rows.withColumn("source", F.col("_risk").cast("string")), itself=True).withColumn("_kind", kind)
    met = provenance.with_known(entries).where("key is null or (item is not null and (supplied or plain is not null))")
    item = Window.partitionBy("session_id", "hop", "item")
    exact_ok, exact_bad = F.col("exact") & F.col("supplied"), F.col("exact") & ~F.col("supplied")
    met = met.withColumn("_given", F.max(exact_ok).over(item))
    hit = ~F.col("supplied") & F.col("plain").isNotNull()
    whole = F.array_sort(F.collect_set(F.when(hit & F.col("exact"), F.struct("key", F.col("plain.source").cast("double").alias("risk")))))
    parts = F.array_sort(F.collect_set(F.when(hit & ~F.col("exact") & ~F.coalesce("_given", F.lit(False)), F.struct("key", F.col("plain.source").cast("double").alias("risk")))))
    per = met.groupBy("session_id", "hop").agg(
        F.max("sensitivity").alias("sensitivity"), F.max("suspended").alias("suspended"), whole.alias("_whole"), parts.alias("_parts"),
        F.max(exact_bad & F.col("plain").isNotNull()).alias("_any"), F.array_sort(F.collect_set(F.when(exact_ok, F.col("item")))).alias("given"),
    )
    used = F.when(F.coalesce("_any", F.lit(False)), F.col("_whole")).otherwise(F.col("_parts"))
    return per.select(
        "session_id", "hop", F.round("sensitivity", 4).alias("sensitivity"), "suspended", F.transform(used, lambda u: u["key"]).alias("reused"), "given",
        F.exists(used, lambda u: F.round(u["risk"], 3) >= 0.25).alias("risky"),
    )
