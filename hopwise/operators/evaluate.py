"""Detection quality: confusion counts, rates with intervals, threshold search, slices.

Label 0 is malicious and counts as positive; an event is flagged if its trust is below a
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R


def confusion(label: Column, flagged: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((label == 0) & flagged),
        "fn": F.count_if((label == 0) & ~flagged),
        "fp": F.count_if((label == 1) & flagged),
        "tn": F.count_if((label == 1) & ~flagged),
    }


def summarised(counts: DataFrame) -> DataFrame:
    """Add n, accuracy, precision, recall, f1, fpr and the 95 % intervals to tp, fn, fp, tn."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    rows = counts.withColumns({"n": tp + fn + fp + tn, "precision": R.rate(tp, tp + fp), "recall": R.rate(tp, tp + fn), "fpr": R.rate(fp, fp + tn)})
    rows = rows.withColumns({"accuracy": R.rate(tp + tn, F.col("n")), "f1": R.rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))})
    (a, b), (c, d) = R.wilson(tp, tp + fn), R.wilson(fp, fp + tn)
    return rows.withColumns({"recall_low": a, "recall_high": b, "fpr_low": c, "fpr_high": d})


def summary(rows: DataFrame, flagged: Column, *by: str) -> DataFrame:
    return summarised(rows.groupBy(*by).agg(*[c.alias(n) for n, c in confusion(F.col("label"), flagged).items()]))


def threshold_counts(rows: DataFrame, score: str = "trust", *by: str) -> DataFrame:
    """Confusion counts of "score < t" for every distinct score t and for t = 1.

    Rows are first counted per score, so the running sums go over distinct scores only.
    """
    per = rows.groupBy(*by, F.col(score).alias("t")).agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"))
    top = per.select(*by).distinct().select(*by, F.lit(1.0).alias("t"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("good"))
    per = per.unionByName(top).groupBy(*by, "t").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    below, every = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    tp, fp = F.coalesce(F.sum("bad").over(below), F.lit(0)), F.coalesce(F.sum("good").over(below), F.lit(0))
    return per.select(*by, "t", tp.alias("tp"), (F.sum("bad").over(every) - tp).alias("fn"), fp.alias("fp"), (F.sum("good").over(every) - fp).alias("tn"))


def best_threshold(rows: DataFrame, max_fpr: float = 0.05, score: str = "trust", default: float = 0.5) -> DataFrame:
    """One row: the lowest of the thresholds with the highest F1 whose false alarms stay within
    ``max_fpr``; ``default`` if none does."""
    good = summarised(threshold_counts(rows, score)).where(F.col("fpr") <= max_fpr)
    best = good.agg(F.max_by(F.struct("t", "f1"), F.struct("f1", (-F.col("t")).alias("low"))).alias("b"))
    return best.select(F.coalesce("b.t", F.lit(default)).alias("threshold"), F.coalesce("b.f1", F.lit(-1.0)).alias("f1"))


def budget_threshold(rows: DataFrame, budget: float, *by: str, score: str = "trust", most: float = 0.5) -> DataFrame:
    """Per group the first threshold up to ``most`` with the highest recall, rounded to four
    places, among those whose rounded false-alarm rate stays within ``budget``; candidates are
    every score and the next value above it."""
    counts = threshold_counts(rows, score, *by)
    after = Window.partitionBy(*by).orderBy("t")
    counts = counts.withColumns({"tp2": F.lead("tp").over(after), "fp2": F.lead("fp").over(after), "bad": F.col("tp") + F.col("fn"), "good": F.col("fp") + F.col("tn")})
    above = F.struct((F.col("t") + 1e-9).alias("t"), F.coalesce("tp2", "bad").alias("tp"), F.coalesce("fp2", "good").alias("fp"))
    both = counts.select(*by, "bad", "good", F.inline(F.array(F.struct("t", "tp", "fp"), above)))
    both = both.where(F.col("t") <= most).withColumns({"recall": F.round(F.col("tp") / F.greatest(F.lit(1), "bad"), 4), "fpr": F.round(F.col("fp") / F.greatest(F.lit(1), "good"), 4)})
    best = F.max_by(F.struct("t", "recall", "fpr"), F.struct("recall", (-F.col("t")).alias("low")))
    return both.where(F.col("fpr") <= budget).groupBy(*by).agg(best.alias("b")).select(*by, "b.t", "b.recall", "b.fpr")


def best_run(runs: DataFrame, run: str, max_fpr: float) -> DataFrame:
    """The first run with the best F1, one less for those with more false alarms than ``max_fpr``."""
    score = F.col("f1") - F.when(F.col("fpr") > max_fpr, 1.0).otherwise(0.0)
    best = runs.agg(F.max_by(F.struct(*runs.columns), F.struct(score.alias("score"), (-F.col(run)).alias("order"))).alias("b"))
    return best.where("b is not null").select("b.*")


def first_mistakes(rows: DataFrame, flagged: Column, limit: int, order: str = "doc_id") -> DataFrame:
    """Of each label the first ``limit`` rows that are held but safe, or missed; adds ``held`` and the
    number ``n`` of all of them."""
    wrong = rows.withColumn("held", flagged).where(F.col("held") != (F.col("label") == 0))
    first = wrong.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(order))).where(F.col("_r") <= limit).drop("_r")
    return first.join(F.broadcast(wrong.groupBy("label").agg(F.count("*").alias("n"))), "label")


def slices(rows: DataFrame, flagged: Column, **names: Column) -> DataFrame:
    """Summary of every slice; one row counts in each slice that its names (null: none) give."""
    labels = F.filter(F.array(*names.values()), lambda s: s.isNotNull())
    return summary(rows.withColumn("slice", F.explode(labels)), flagged, "slice")


def p95(rows: DataFrame, value: str, by: str, ranges: int = 256) -> DataFrame:
    """(by, p95): the value at place int(0.95 n) of the sorted values, counted from 0; nulls do
    not count.

    Rows are counted per value and the counts added up per range of values; only the range that
    holds the place is then gone through, so no group's values meet in one task.  Approximate
    quantiles cut the ranges, which decides where work lies, not what comes out.
    """
    rows = rows.select(F.col(by).alias("k"), F.col(value).alias("v")).where("v is not null")
    cuts = rows.groupBy("k").agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    counts = rows.groupBy("k", "v").agg(F.count("*").alias("c"))
    within = F.size(F.filter("cuts", lambda x: x < F.col("v")))
    counts = counts.join(cuts, counts["k"].eqNullSafe(cuts["k"])).select(counts["k"], "v", "c", within.alias("range"))
    sums = counts.groupBy("k", "range").agg(F.sum("c").alias("c"))
    before, every = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k")
    sums = sums.select("k", "range", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.floor(0.95 * F.sum("c").over(every)).alias("place"))
    hit = sums.where("before <= place and place < before + c").select(F.col("k").alias("hk"), F.col("range").alias("hr"), "before", "place")
    near = counts.join(hit, F.col("k").eqNullSafe(F.col("hk")) & (F.col("range") == F.col("hr")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("upto", upto).where("upto > place").groupBy("k").agg(F.min("v").alias("p95")).withColumnRenamed("k", by)


def report(rows: DataFrame, validation: Column, *by: str, max_fpr: float = 0.05, score: str = "trust", default: float = 0.5) -> DataFrame:
    """Counts, rates and intervals of every ``split`` and of each value of ``by`` in it, at the threshold
    that is best on the ``validation`` rows: (split, what, value, threshold, ...).

    All groupings are one aggregation; validation rows are not reported.
    """
    best = best_threshold(rows.where(validation), max_fpr, score, default).select("threshold")
    tested = rows.where(~validation).crossJoin(F.broadcast(best))  # one row
    flagged = F.col(score) < F.col("threshold")
    sets = [[F.col("split"), F.col("threshold")], *[[F.col("split"), F.col("threshold"), F.col(c)] for c in by]]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in by], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in by], F.lit("all"))
    counts = tested.groupingSets(sets, "split", "threshold", *by).agg(*[c.alias(n) for n, c in confusion(F.col("label"), flagged).items()], which.alias("what"), value.alias("value"))
    return summarised(counts.drop(*by))
