"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; a line that stands in too many different documents of its
host is boilerplate; what is left of a document without its boilerplate decides whether it
is kept.  Documents with equal texts are one document here: if every copy counted, a text copied
eleven times would make all its own lines boilerplate, and clean documents would be rejected for
having copies, which is another operator's business.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map, unused, utf8

#: A line is boilerplate in more distinct documents of a host than the larger of these.
MOST_DOCUMENTS, MOST_SHARE = 10, 0.02
#: A document is depleted if boilerplate holds more than this share of its words.
MOST_REMOVED = 0.7

_WORDS = "[^\\x20\\x09-\\x0D]+"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    code = w[:n]
    for j in range(1, width):
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(ids) + w[j : j + n]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[j : j + n] |= again
    return int(covered.sum())


def text_measures(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = data.split()
    b = np.frombuffer(data, np.uint8)
    chars = int(((b & 0xC0) != 0x80).sum() - _BLANK[b].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, int(_IS_SYMBOL[b].sum()), len(lines) - len(set(lines)), _repeated_window_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per input row doc_id, text_hash, host and the five base counts; null text: all 0."""

    def fn(batch: pa.RecordBatch) -> dict:
        got = np.array([text_measures(t) for t in batch.column(3).to_pylist()], np.int64).reshape(-1, 5)
        return {c: batch.column(i) for i, c in enumerate(("doc_id", "text_hash", "host"))} | {c: got[:, i] for i, c in enumerate(COUNTS)}

    return arrow_map(
        docs.select("doc_id", _text_hash().alias("h"), F.col(host).cast("string").alias("host"), utf8(F.col("text")).alias("t")),
        fn,
        "doc_id long, text_hash long, host string, " + ", ".join(f"{c} long" for c in COUNTS),
    )


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+", " "))


def host_lines(docs: DataFrame, host: str, *more: str) -> DataFrame:
    """(doc_id, text_hash, host, line_hash, words) and ``more`` of every line with a word."""
    lines = docs.select(*more, "doc_id", _text_hash().alias("text_hash"), F.col(host).cast("string").alias("host"), F.explode(F.split("text", "\n")).alias("_line"))
    return lines.select(
        *more,
        "doc_id",
        "text_hash",
        "host",
        F.xxhash64(normalised(F.col("_line"))).alias("line_hash"),
        F.regexp_count("_line", F.lit(_WORDS)).cast("long").alias("words"),
    ).where("words > 0")


def boilerplate_lines(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """(host, line_hash, n_docs): lines in more distinct documents of a host than
    max(most_documents, most_share x the host's distinct documents).

    Both counts first take distinct pairs, pre-aggregated before the shuffle, so a hot host
    or line spreads over its documents.  A null host is a host of its own.
    """
    lines = host_lines(docs, host).select("host", "line_hash", "text_hash").distinct()
    counts = lines.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > most_documents)
    sizes = docs.select(F.col(host).cast("string").alias("host"), _text_hash().alias("h")).distinct().groupBy("host").agg(F.count("*").alias("_host_docs"))
    return counts.join(sizes, counts["host"].eqNullSafe(sizes["host"])).where(F.col("n_docs") > most_share * F.col("_host_docs")).select(counts["host"], "line_hash", "n_docs")


def _hits(docs: DataFrame, boilerplate: DataFrame, host: str) -> DataFrame:
    """Every boilerplate line of every row.  A hot line is on the many side of this join,
    where a skewed partition is split; ``row`` tells rows with equal ids and texts apart."""
    own = docs.select("doc_id", "text", F.col(host).alias("_own_host"), F.monotonically_increasing_id().alias("_row"))
    lines = host_lines(own, "_own_host", "_row")
    bad = boilerplate.select(F.col("host").alias("_host"), F.col("line_hash").alias("_hash"))
    return lines.join(bad, (F.col("line_hash") == F.col("_hash")) & F.col("host").eqNullSafe(F.col("_host")))


def removed_words(docs: DataFrame, boilerplate: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, text_hash, host, words_removed) for the documents with a boilerplate line."""
    key = ["doc_id", "text_hash", "host"]
    per_row = _hits(docs, boilerplate, host).groupBy(*key, "_row").agg(F.sum("words").alias("w"))
    return per_row.groupBy(*key).agg(F.max("w").alias("words_removed"))


def _on_document(left: DataFrame, right: DataFrame):
    """Null-safe match of (doc_id, text_hash, host) with right's _doc_id, _text_hash, _host."""
    return (
        left["doc_id"].eqNullSafe(right["_doc_id"])
        & (left["text_hash"] == right["_text_hash"])
        & left["host"].eqNullSafe(right["_host"])
    )


def judge(docs: DataFrame, host: str = "source", most_removed: float = MOST_REMOVED, **limits) -> DataFrame:
    """One row per input row: doc_id, the five counts, words_removed, base_failed, kept.

    ``base_failed``: under 50 words, or more than half of them in repeated 3-word windows.
    ``kept``: neither base_failed nor depleted (over ``most_removed`` of the words in
    boilerplate lines of the host).  Null or empty texts fail the base; rows with equal ids
    are judged each by its own text; an empty table gives no rows; other columns are ignored.
    """
    bad = boilerplate_lines(docs, host, **limits)
    removed = removed_words(docs, bad, host)
    removed = removed.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "host")], "words_removed")
    base = measures(docs, host)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = base.join(removed, _on_document(base, removed), "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("long")))
    depleted = F.col("words_removed") > most_removed * F.col("n_words")
    return joined.select("doc_id", *COUNTS, "words_removed", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_boilerplate(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents, columns as they were, with their boilerplate lines cut out of ``text``."""
    names = docs.columns
    id, hash, of, cut = (unused(c, docs) for c in ("id", "hash", "host", "cut"))
    hits = _hits(docs, boilerplate_lines(docs, host, **limits), host)
    per = hits.groupBy(F.col("doc_id").alias(id), F.col("text_hash").alias(hash), F.col("host").alias(of)).agg(F.collect_set("line_hash").alias(cut))
    same = F.col("doc_id").eqNullSafe(F.col(id)) & (_text_hash() == F.col(hash)) & F.col(host).cast("string").eqNullSafe(F.col(of))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(cut), F.xxhash64(normalised(x))))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return docs.join(per, same, "left").select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names])


def op8_line_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1
), lines AS (
  SELECT doc_id, source, text, l,
    len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words,
    trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)
), worded AS (SELECT * FROM lines WHERE words > 0
), dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY 1
), hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY 1
), bad AS (
  SELECT b.source, b.k FROM (SELECT source, k, count(DISTINCT text) AS n FROM worded GROUP BY 1, 2) b JOIN hosts h ON b.source = h.source
  WHERE b.n > {MOST_DOCUMENTS} AND b.n > {MOST_SHARE} * h.n
), removed AS (SELECT doc_id, sum(words) AS n FROM worded JOIN bad USING (source, k) GROUP BY 1
), counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS words_removed
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_removed <= {MOST_REMOVED} * n_words AS kept
FROM counts
"""
