"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree holds how often every byte followed every context of up
to three bytes.  A byte's probability is its count in the longest context that has it, reached
by escapes (method C: an escape is as likely as the context has distinct bytes) with exclusion
of what the longer context had ruled out.  A text's code length in a language is the sum of its
bytes' exact code lengths under these frozen statistics; the shortest code names the language.

Trees are sparse: only contexts that occur are kept, so order and alphabet are the same however
many languages there are.  Languages are scored together in shards of bounded size; a model of
many shards is scored shard by shard, each in tasks of its own, and the shards' best meet in one
aggregation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map, checkpointed, unused, utf8

ORDER = 3
#: Bound of the fitted model: documents a language.
DOCS_PER_LANGUAGE = 1_000
#: Bytes of code lengths that a task holds at once; more languages make more shards.
SHARD_BYTES = 96 << 20
#: Sizes of languages are broadcast up to this many labels; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
_BEFORE = np.full(ORDER, 0x20, np.uint8)  # blanks stand before a text
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _grams(data: bytes, size: int = 1 << 20):
    """Each byte with its three predecessors as one number, in pieces."""
    for at in range(0, len(data), size):
        lead = min(at, ORDER)
        s = np.concatenate((_BEFORE[: ORDER - lead], np.frombuffer(data[at - lead : at + size], np.uint8))).astype(np.uint32)
        n = len(s) - ORDER
        yield s[:n] << 24 | s[1 : n + 1] << 16 | s[2 : n + 2] << 8 | s[3:]


def has_letter(data: bytes) -> bool:
    return bool(_LETTER[np.frombuffer(data, np.uint8)].any()) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def context_tree(grams: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """For orders 0 to 3 (keys, bits, contexts, escape bits) of one language, keys being a
    context and its next byte; an escape's bits include the exclusion."""
    levels, p, below = [], None, None
    for order in range(ORDER + 1):
        keys, at = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.bincount(at, weights=counts)
        lower = np.full(len(keys), 1 / 256) if p is None else p[np.searchsorted(below, keys & np.uint32((1 << 8 * order) - 1))]
        contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(of, weights=n), np.bincount(of)
        free = np.where(kinds < 256, 1 - np.bincount(of, weights=lower), 0)
        escape = np.where(free > 1e-12, kinds, 0)
        p, below = n / (total + escape)[of], keys
        with np.errstate(divide="ignore"):
            levels.append((keys, -np.log2(p), contexts, -np.log2(np.where(escape > 0, escape / (total + escape) / np.where(escape > 0, free, 1), 0))))
    return levels


class _Places:
    """Where each of some distinct 32-bit keys stands, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint32(32 - max(4, (2 * len(keys)).bit_length()))
        self.key, self.at = np.zeros(1 << (32 - int(self.shift)), np.uint32), np.full(1 << (32 - int(self.shift)), -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            left, slot = left[self.at[slot] != left], slot[self.at[slot] != left]
            slot = (slot + 1) % len(self.at)
        used = self.at >= 0
        self.key[used] = keys[self.at[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, -1 for those that are not there."""
        slot = self._slot(keys)
        out = self.at[slot]
        again = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        slot = slot[again]
        while len(again):
            slot = (slot + 1) % len(self.at)
            out[again] = self.at[slot]
            wrong = (self.key[slot] != keys[again]) & (self.at[slot] >= 0)
            again, slot = again[wrong], slot[wrong]
        return out


class Shard:
    """Code lengths of some languages, merged: one row a key, one column a language."""

    def __init__(self, languages: list[str], trees: list[list[tuple]]):
        self.languages, self.levels = languages, []
        bits, below = None, None
        for order in range(ORDER + 1):
            keys, contexts = (np.unique(np.concatenate([t[order][c] for t in trees])) for c in (0, 2))
            escapes = np.zeros((len(contexts), len(trees)))
            for i, t in enumerate(trees):
                escapes[np.searchsorted(contexts, t[order][2]), i] = t[order][3]
            lower = 8.0 if bits is None else bits[np.searchsorted(below, keys & np.uint32((1 << 8 * order) - 1))]
            bits, below = lower + escapes[np.searchsorted(contexts, keys >> np.uint32(8))], keys
            for i, t in enumerate(trees):
                bits[np.searchsorted(keys, t[order][0]), i] = t[order][1]
            self.levels.append((_Places(keys), bits.astype(np.float32), _Places(contexts), escapes.astype(np.float32)))

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of a whole text in each language."""
        total = np.zeros(len(self.languages))
        for grams in _grams(data):
            for order in range(ORDER, -1, -1):
                places, bits, contexts, escapes = self.levels[order]
                at = places.find(grams)
                known = at >= 0
                total += bits[at[known] if not known.all() else at].sum(axis=0, dtype=np.float64)
                grams = grams[~known]
                if not len(grams):
                    break
                at = contexts.find(grams >> np.uint32(8))
                total += escapes[at[at >= 0]].sum(axis=0, dtype=np.float64)
                grams = grams & np.uint32((1 << 8 * order) - 1) if order else grams
            else:
                total += 8.0 * len(grams)
        return total


def training_fold(doc_id: Column) -> Column:
    """0 to 2; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, shard_bytes: int = SHARD_BYTES) -> list[Shard]:
    """The model, a list of shards of languages, from (doc_id, text, lang); empty if nothing is
    labelled.

    At most ``docs_per_language`` whole texts of each language are counted: those first by
    the MD5 of their id.  A language's count gives the fraction of ids (by hash) that holds
    about three times as many; only those are ranked, so no task sees all of a language.
    Counting is distributed; what reaches the driver are the contexts of that sample.
    """
    keyed = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = checkpointed(keyed.groupBy("lang").agg(F.count("*").alias("_n")))
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = keyed.join(few, "lang").where(place * F.col("_n") < 3 * docs_per_language)
    first = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "text")
    sample = some.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= docs_per_language)

    def count(batch: pa.RecordBatch) -> dict:
        by: dict = {}
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).extend(_grams(data))
        langs, keys, numbers = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lang, parts in by.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (keys[0], numbers[0])
            langs += [lang] * len(grams)
            keys.append(grams)
            numbers.append(n)
        return {"lang": langs, "gram": np.concatenate(keys).astype(np.int64), "n": np.concatenate(numbers)}

    parts = arrow_map(sample.repartition("doc_id").select("lang", utf8(F.col("text")).alias("t")), count, "lang string, gram long, n long")
    rows = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().sort_by("lang")
    names = rows.column("lang").to_numpy(zero_copy_only=False)
    grams, n = (rows.column(c).to_numpy() for c in ("gram", "n"))
    shards, held, size = [], [], 0
    for lang in sorted(set(names)):
        own = slice(np.searchsorted(names, lang, "left"), np.searchsorted(names, lang, "right"))
        number = own.stop - own.start
        if held and (len(held) + 1) * (size + number) * 4 > shard_bytes:
            shards.append(Shard(*map(list, zip(*held))))
            held, size = [], 0
        held.append((lang, context_tree(grams[own].astype(np.uint32), n[own])))
        size += number
    return shards + ([Shard(*map(list, zip(*held)))] if held else [])


def predict(docs: DataFrame, model: list[Shard], evidence_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, bits_per_byte.

    ``score`` is the language's posterior, equal priors, if the text's mean code lengths held
    for only ``evidence_bytes`` bytes (whole texts would always score 1).  Of equal code lengths
    the first label wins.  Null texts, texts without letters and everything under an empty
    model: ``und``, score 0, null bits.  Whole texts are read; other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t"))
    if not model:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    found = reduce(DataFrame.unionByName, [_scored(rows, shard, evidence_bytes) for shard in model])
    if len(model) > 1:  # every row has been scored once in each shard; rows with equal id and text are alike
        met = found.groupBy("doc_id", "h", "evidence").agg(F.min(F.struct("bits", "lang")).alias("best"), F.collect_set(F.struct("lang", "bits", "mass")).alias("shards"), F.count("*").alias("n"))
        mass = F.aggregate("shards", F.lit(0.0), lambda s, x: s + x["mass"] * F.pow(F.lit(2.0), (F.col("best.bits") - x["bits"]) * F.col("evidence")))
        met = met.select("doc_id", "best.lang", "best.bits", mass.alias("mass"), F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"n div {len(model)}"))).alias("copy"))
        found = met
    score = F.when(F.col("bits").isNull(), 0.0).otherwise(1 / F.col("mass"))
    return found.select("doc_id", F.col("lang").alias("lang_pred"), score.alias("score"), F.col("bits").alias("bits_per_byte"))


def _scored(rows: DataFrame, shard: Shard, evidence_bytes: int) -> DataFrame:
    """Per row of (doc_id, h, t) the shard's best language, its bits a byte, the bytes of evidence,
    and the sum of all the shard's likelihoods over the best one's."""
    shared = rows.sparkSession.sparkContext.broadcast(shard)

    def fn(batch: pa.RecordBatch) -> dict:
        shard = shared.value
        out: dict = {"doc_id": batch.column(0), "h": batch.column(1), "lang": [], "bits": [], "evidence": [], "mass": []}
        for data in batch.column(2).to_pylist():
            lang, bits, evidence, mass = "und", None, 0, 1.0
            if data and has_letter(data):
                mean = shard.code_lengths(data) / len(data)
                i = int(mean.argmin())
                lang, bits, evidence = shard.languages[i], float(mean[i]), min(len(data), evidence_bytes)
                mass = float(np.exp2(-(mean - mean[i]) * evidence).sum())
            for c, x in zip(("lang", "bits", "evidence", "mass"), (lang, bits, evidence, mass)):
                out[c].append(x)
        return out

    return arrow_map(rows, fn, "doc_id long, h long, lang string, bits double, evidence int, mass double")


def fit_on_training_fold(docs: DataFrame):
    return fit(docs.where(training_fold(F.col("doc_id")) != 1))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents, columns as they were, whose language is identified with ``least_score``.

    Rejected: null texts, texts without letters, and texts no language fits clearly.  The
    verdict is joined on the id and the text's hash, so rows that share an id are judged each.
    """
    model = fit_on_training_fold(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.xxhash64(F.col("doc_id"), text).alias("doc_id"), "text")
    good = predict(keyed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    key = unused("key", docs)
    return docs.join(good.select(F.col("doc_id").alias(key)).distinct(), F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))) == F.col(key), "left_semi")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit_on_training_fold(docs)).select(
        "doc_id",
        F.coalesce(training_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "bits_per_byte",
    )
