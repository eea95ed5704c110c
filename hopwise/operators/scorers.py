"""Scorers that are trained here: lexical classifiers, their use over texts in batches, and the
temperature of a model's logits."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a fitted temperature.
LEAST_T, MOST_T = 0.05, 20.0


def fit_lexical(train: DataFrame, features: int = 50_000, min_docs: int = 2, iterations: int = 50) -> PipelineModel:
    """TF-IDF over words and pairs of words with balanced logistic regression, from (text, label).

    The vocabulary takes the ``features`` most frequent terms of each kind that stand in at least
    ``min_docs`` texts; classes weigh inversely to their size.
    """
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a class
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    stages = [
        SQLTransformer(statement="SELECT *, coalesce(text, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_w", minDF=min_docs, vocabSize=features // 2),
        CountVectorizer(inputCol="_pairs", outputCol="_p", minDF=min_docs, vocabSize=features // 2),
        VectorAssembler(inputCols=["_w", "_p"], outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol="label", weightCol="_weight", maxIter=iterations, regParam=1e-3),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("_weight", weight))


def score_lexical(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """Add ``trust``, the probability of label 1, to (text, ...)."""
    rows = texts if "label" in texts.columns else texts.withColumn("label", F.lit(0))
    scored = model.transform(rows.withColumn("_weight", F.lit(1.0)))
    return scored.select(*texts.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("trust"))


class LinearScorer:
    """Weights of words (and of pairs, "a b") as a model that tasks can hold: the trust in a text is
    one minus the logistic of ``intercept`` and its terms' weights."""

    def __init__(self, weights: dict[str, float], intercept: float, pattern: str, pairs: bool = False, once: bool = False):
        self.weights, self.intercept, self.pattern, self.pairs, self.once = weights, intercept, pattern, pairs, once

    def logit(self, text: str) -> float:
        words = re.findall(self.pattern, text.lower(), re.ASCII)
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])] if self.pairs else words
        return self.intercept + math.fsum(self.weights.get(w, 0.0) for w in (set(terms) if self.once else terms))

    def trust(self, texts: list[str]) -> list[float]:
        return [0.5 - 0.5 * math.tanh(self.logit(t) / 2) for t in texts]


def linear_scorer(model: PipelineModel) -> LinearScorer:
    """What ``fit_lexical`` has learnt, with label 1 as the risk."""
    words, pairs, idf, regression = (model.stages[i] for i in (3, 4, 6, 7))
    weights = np.asarray(regression.coefficients) * np.asarray(idf.idf)
    return LinearScorer(dict(zip([*words.vocabulary, *pairs.vocabulary], weights.tolist())), regression.intercept, r"\w\w+", pairs=True)


def fit_word_odds(train: DataFrame, features: int = 50_000) -> LinearScorer:
    """Smoothed log odds of label 1 for each word that texts (text, label) have, by counting texts;
    the ``features`` words in most texts are taken."""
    rows = train.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = total["n1"], total["n"] - total["n1"]
    words = rows.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{3,})"), 1))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("in1"), F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(features).collect()  # the model itself
    odds = {r["word"]: math.log((r["in1"] + 1) / (n1 + 2)) - math.log((r["n"] - r["in1"] + 1) / (n0 + 2)) for r in counts}
    return LinearScorer(odds, math.log((n1 + 1) / (n0 + 1)), "[a-z0-9]{3,}", once=True)


def batched_trust(load: Callable[[], object], batch_size: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer for ``fold.chunk_scored`` and ``fold.verdicts`` from a model with ``trust(texts)``.

    ``load`` runs once for each task's stream of batches, on the worker (a broadcast's value is there
    once a worker); texts go to the model ``batch_size`` at a time, those of like length together,
    and come back in their order.  Null texts are empty.
    """

    @F.pandas_udf("double")
    def trust(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            texts = texts.fillna("").tolist()
            order, out = sorted(range(len(texts)), key=lambda i: len(texts[i])), np.empty(len(texts))
            for at in range(0, len(order), batch_size):
                some = order[at : at + batch_size]
                out[some] = model.trust([texts[i] for i in some])
            yield pd.Series(out)

    return lambda role, text: trust(text)


def temperature(rows: DataFrame, steps: int = 48, rounds: int = 4) -> DataFrame:
    """One row (temperature, nll): the divisor of the two logits (z0, z1) that makes the mean
    negative log-likelihood of ``label`` least, between LEAST_T and MOST_T.

    Each round aggregates the loss of ``steps`` + 1 temperatures at once, evenly apart by their
    logarithm, and goes on between the neighbours of the best; ties go to the least.
    """
    own, other = F.when(F.col("label") == 1, F.col("z1")).otherwise(F.col("z0")), F.when(F.col("label") == 1, F.col("z0")).otherwise(F.col("z1"))
    gap = rows.select((other - own).alias("g")).where("g is not null")
    low, high, best = math.log(LEAST_T), math.log(MOST_T), None
    for _ in range(rounds):
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        loss = gap.agg(*[F.avg(F.when(F.col("g") / math.exp(x) > 30, F.col("g") / math.exp(x)).otherwise(F.log1p(F.exp(F.col("g") / math.exp(x))))).alias(f"l{i}") for i, x in enumerate(grid)]).first()
        if loss[0] is None:
            return rows.sparkSession.createDataFrame([], "temperature double, nll double")
        at = min(range(steps + 1), key=lambda i: (loss[i], i))
        best = (math.exp(grid[at]), loss[at])
        low, high = grid[max(0, at - 1)], grid[min(steps, at + 1)]
    return rows.sparkSession.createDataFrame([best], "temperature double, nll double")
