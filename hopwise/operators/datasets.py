"""Dataset operators: deterministic sampling and splits, allocation, audits, chunk labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(text: Column, digits: int = 8) -> Column:
    """The first hex digits of a SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def hash_subsample(rows: DataFrame, key: Column, keep: int, *by: str) -> DataFrame:
    """The first max(1, keep // 2) rows of each group by the SHA-256 of their key."""
    order = Window.partitionBy(*by).orderBy(F.sha2(key, 256), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(1, keep // 2)).drop("_r")


def largest_remainder(counts: DataFrame, target: int, key: str) -> DataFrame:
    """(key, n, quota): ``target`` places shared in proportion to n, left-over places to the
    largest fractions, then to the largest keys."""
    total = F.sum("n").over(Window.partitionBy())
    share = F.col("n") * target / total
    rows = counts.withColumns({"_base": F.floor(F.col("n") * target / total), "_part": share - F.floor(share)})
    left = target - F.sum("_base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_part"), F.desc(key)))
    return rows.withColumns({"_left": left, "_place": place}).select(key, "n", (F.col("_base") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def rank_split(groups: DataFrame, key: str) -> DataFrame:
    """Ordered groups cut 70 / 15 / 15, halves rounded to even."""
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(key))
    rows = groups.withColumns({"_n": n, "_at": at})
    train, val = F.bround(0.7 * F.col("_n"), 0), F.bround(0.15 * F.col("_n"), 0)
    return rows.withColumn("split", F.when(F.col("_at") <= train, "train").when(F.col("_at") <= train + val, "validation").otherwise("test")).drop("_n", "_at")


def mod_split(index: Column) -> Column:
    """Of every 17: twelve to train, two to validation, three to test."""
    return F.when(F.pmod(index, F.lit(17)) < 12, "train").when(F.pmod(index, F.lit(17)) < 14, "validation").otherwise("test")


def hash_split(key: Column) -> Column:
    n = hash_number(key) % 1000 / 10
    return F.when(n < 70, "train").when(n < 85, "validation").otherwise("test")


def aligned_splits(benign: DataFrame, attacks: DataFrame, *key: str) -> DataFrame:
    """Benign rows take their attack group's split where that group has exactly one."""
    one = attacks.groupBy(*key).agg(F.count_distinct("split").alias("_n"), F.min("split").alias("_split")).where("_n = 1")
    return benign.join(one.select(*key, "_split"), list(key), "left").withColumn("split", F.coalesce("_split", "split")).drop("_split")


def keep_preferred(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def text_id(*parts: Column, digits: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def label_event(role: Column, is_attack: Column, carries: Column, acts_on_it: Column) -> Column:
    """(label, source) by the ordered policy: anchors are never labelled, benign sessions are safe
    throughout, carriers and actions of an attack are malicious, untouched data of an attack is
    safe, everything else stays open."""

    def as_label(label, source):
        return F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"))

    return (
        F.when(role.isin("user", "system"), as_label("unlabeled", "trusted_role"))
        .when(~is_attack, as_label("safe", "benign_session"))
        .when(carries, as_label("malicious", "carrier"))
        .when(acts_on_it, as_label("malicious", "action"))
        .when(role == "tool", as_label("safe", "clean_data"))
        .otherwise(as_label("unlabeled", "unknown"))
    )


def chunk_labels(texts: DataFrame, spans: Column, least: float = 0.6) -> DataFrame:
    """Chunks of (id, start, stop) texts with a known span: malicious if they hold at least
    ``least`` of it, safe if none of it, else unlabeled."""
    rows = texts.select("id", "start", "stop", F.posexplode(spans).alias("chunk", "s"))
    overlap = F.greatest(F.lit(0), F.least("stop", "s.end") - F.greatest("start", "s.start"))
    share = F.when(F.col("start").isNull(), 0.0).otherwise(overlap / (F.col("stop") - F.col("start")))
    label = F.when(share >= least, "malicious").when(share == 0, "safe").otherwise("unlabeled")
    return rows.select("id", "chunk", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.round(share, 6).alias("share"), label.alias("label"))


def violations(rows: DataFrame, *key: str, **rules: Column) -> DataFrame:
    """One row (*key, rule) for every named rule that a row breaks (a null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


# fixed values: chunks kept of a safe event, and clean ones of an event with an injection
SAFE_CHUNKS, NEAR_NEGATIVES, FAR_NEGATIVES = 6, 2, 1


def _hash_order(id: Column, index: Column) -> Column:
    return hash_number(F.concat_ws("|", id.cast("string"), index.cast("string")), 12)


def select_safe_chunks(chunks: DataFrame, keep: int = SAFE_CHUNKS) -> DataFrame:
    """Of each (id)'s chunks 0, 1, ... the first, the last and then those of least hash, ``keep`` in
    all; adds ``place``, their place in this order from 1."""
    own = Window.partitionBy("id")
    rank = F.when(F.col("chunk") == 0, 0).when(F.col("chunk") == F.max("chunk").over(own), 1).otherwise(2)
    place = F.row_number().over(own.orderBy("_rank", _hash_order(F.col("id"), F.col("chunk")), "chunk"))
    return chunks.withColumn("_rank", rank).withColumn("place", place).where(F.col("place") <= keep).drop("_rank")


def select_negatives(chunks: DataFrame, near: int = NEAR_NEGATIVES, far: int = FAR_NEGATIVES) -> DataFrame:
    """Clean chunks (span_start, span_end) of texts with a known span (start, stop): the ``near``
    closest to it, and of the others the ``far`` of least hash; adds ``kind``."""
    clean = chunks.where("start is not null and (span_end <= start or span_start >= stop)")
    distance = F.least(F.abs(F.col("span_start") - F.col("stop")), F.abs(F.col("span_end") - F.col("start")))
    clean = clean.withColumn("_near", F.row_number().over(Window.partitionBy("id").orderBy(distance, "chunk")))
    beyond = F.col("_near") > near
    order = Window.partitionBy("id", beyond).orderBy(_hash_order(F.col("id"), F.col("chunk")), "chunk")
    clean = clean.withColumn("_far", F.row_number().over(order))
    return clean.where(~beyond | (F.col("_far") <= far)).withColumn("kind", F.when(beyond, "far").otherwise("near")).drop("_near", "_far")


def shifted_windows(length: Column, start: Column, stop: Column, size: int = 900, margin: int = 120) -> Column:
    """(start, end, kind) windows around a known span of a text longer than ``size``: it stands at
    their start, middle and end (positive), and the clean text just before and after it, if there
    are ``margin`` characters of it (negative)."""
    held = F.least(stop - start, F.lit(size))

    def window(a, b, kind):
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("kind"))

    def placed(lead):
        at = F.greatest(F.lit(0), F.least(start - lead, length - size))
        return window(at, at + size, "positive")

    before = F.when(start >= margin, window(F.greatest(F.lit(0), start - size), start, "negative"))
    after = F.when(length - stop >= margin, window(stop, F.least(length, stop + size), "negative"))
    every = F.array(placed(F.lit(0)), placed(F.floor((size - held) / 2)), placed(size - held), before, after)
    return F.when((length > size) & start.isNotNull(), F.array_compact(every)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def unwrapped(text: Column, opening: str, closing: str) -> Column:
    """(text, start, stop): the first passage between two marks, without the marks; of an unclosed
    one everything after it.  Null places if there is none."""
    at = F.locate(opening, text) - 1
    rest = F.substring(text, at + len(opening) + 1, F.length(text))
    end = F.locate(closing, rest)
    inner = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    tail = F.when(end > 0, F.substring(rest, end + len(closing), F.length(rest))).otherwise("")
    there = at >= 0
    clean = F.concat(F.substring(text, F.lit(1), at), inner, tail)
    return F.struct(
        F.when(there, clean).otherwise(text).alias("text"), F.when(there, at).cast("int").alias("start"), F.when(there, at + F.length(inner)).cast("int").alias("stop")
    )


def _bound(value: Column, of) -> Column:
    """``of(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _running(numbers: Column) -> Column:
    """0 and the running sums of an array; each step copies what there is."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def _running_in_blocks(numbers: Column) -> Column:
    """The same by blocks of the square root of their number, so that little is copied."""
    wide = F.ceil(F.sqrt(F.size(numbers))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / wide).cast("int") - 1), lambda b: _running(F.slice(numbers, b * wide + 1, wide)))

    def joined(blocks):
        before = F.slice(_running(F.transform(blocks, lambda x: F.element_at(x, -1))), 1, F.size(blocks))
        return F.concat(F.array(F.lit(0)), F.flatten(F.zip_with(blocks, before, lambda x, o: F.transform(F.slice(x, 2, F.size(x)), lambda v: v + o))))

    return F.when(F.size(numbers) == 0, F.array(F.lit(0))).otherwise(_bound(blocks, joined))


def sentence_starts(text: Column) -> Column:
    """0 and every place after blanks that follow the end of a sentence.  The text is read twice,
    from end to end, however many sentences it has and however long the last one is."""
    end = r"[.!?]\s+"
    both = F.zip_with(F.split(text, end, -1), F.regexp_extract_all(text, F.lit(end), 0), lambda body, e: F.length(body) + F.length(e))
    return _bound(F.filter(both, lambda n: n.isNotNull()), _running_in_blocks)


def overridden(label: Column, labels: Column, hop: Column) -> Column:
    """A session's own label of a hop where it has one (a map of hop numbers as text)."""
    return F.coalesce(F.element_at(labels, hop.cast("string")), label)


def routed_split(split: Column, dataset: Column, unseen: Column, routes: dict[str, str]) -> Column:
    """The test split of its dataset's own name; unseen templates and external data have theirs."""
    own = F.lit(None).cast("string")
    for name, route in routes.items():
        own = F.when(dataset == name, route).otherwise(own)
    rest = F.when(unseen, "test_ood").when(split == "external", "test_external").otherwise(split)
    return F.when(own.isNotNull(), F.when(split == "test", own).otherwise(split)).otherwise(rest)
