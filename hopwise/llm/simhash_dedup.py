"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 4 bits exactly if the balls of radius 2
around them share a value.  So every distinct fingerprint stands for all its 2,081
variants within radius 2, variants are brought together by value, and fingerprints
that meet are linked; by the triangle inequality a meeting needs no further proof,
and one link to the smallest id of each meeting place loses no connection.

Shuffling 2,081 rows a fingerprint would cost 33 kB a document.  The shuffle key is
therefore only the variant's leading ``k`` bits: a fingerprint is sent once to every
prefix within radius 2 of its own (1 + k + k(k-1)/2 rows), with the radius that is
left for the other bits, and the task that owns the prefix writes out the remaining
variants.  ``k`` grows with the number of fingerprints so that a prefix owns a bounded
number of variants; a prefix that is hot anyway is split again inside its task, bit by
bit, so memory follows fingerprints, not variants.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map, checkpointed, utf8
from hopwise.llm.components import connected_components

BITS = 64
#: Variants that one shuffle key may own on average, and that a task holds at once.
VARIANTS_PER_KEY, VARIANTS_AT_ONCE = 8_000_000, 1_000_000


def _fingerprint(data: bytes, width: int) -> int:
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    total, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_digest
    for at in range(0, n, 65_536):
        s, e = starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist()
        raw = b"".join([digest(joined[i:j], 42) for i, j in zip(s, e)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text as a signed long.

    A-Z are lower-cased, words are runs of non-blank bytes, shingles are
    ``shingle_words`` words joined by a space (fewer words: all of them), hashed with
    XXH64, seed 42, repeats included.  No words, empty or null text: 0.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column(0),
            "fp": np.fromiter((_fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows),
        }

    return arrow_map(docs.select("doc_id", utf8(F.col("text")).alias("t")), fn, "doc_id long, fp long")


def ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def _prefixes(fp: Column, k: int, radius: int) -> Column:
    """Every k-bit prefix within ``radius`` of the fingerprint's own, with the radius left."""
    own = F.shiftrightunsigned(fp, BITS - k) if k else F.lit(0).cast("long")
    masks = [(sum(1 << b for b in at), radius - r) for r in range(min(radius, k) + 1) for at in combinations(range(k), r)]
    return F.array(*[F.struct(own.bitwiseXOR(F.lit(m).cast("long")).alias("prefix"), F.lit(r).alias("left")) for m, r in masks])


def _masks(bits: int, radius: int) -> np.ndarray:
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    for r in range(1, radius + 1):
        pairs = np.array(list(combinations(range(bits), r)), np.int64).reshape(-1, r)
        out.append(np.bitwise_xor.reduce(one[pairs], axis=1) if len(pairs) else np.zeros(0, np.uint64))
    return np.concatenate(out)


def _meetings(low: np.ndarray, who: np.ndarray, left: np.ndarray, bits: int):
    """Pairs of members next to each other at some shared variant of ``bits`` low bits."""
    sizes = np.array([ball_size(bits, r) for r in range(int(left.max()) + 1)], np.int64)
    if len(low) < 2:
        return
    if sizes[left].sum() > VARIANTS_AT_ONCE and bits > 8:
        top = np.uint64(bits - 1)
        rest = low & ((np.uint64(1) << top) - np.uint64(1))
        bit = (low >> top).astype(np.int64)
        for side in (0, 1):  # the variants whose next bit is `side`
            r = left - (bit != side)
            ok = r >= 0
            if ok.any():
                yield from _meetings(rest[ok], who[ok], r[ok], bits - 1)
        return
    variants, owner = [], []
    for r in np.unique(left):
        at, m = left == r, _masks(bits, int(r))
        variants.append((low[at][:, None] ^ m[None, :]).ravel())
        owner.append(np.repeat(who[at], len(m)))
    v, o = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(v, kind="stable")
    v, o = v[order], o[order]
    same = v[1:] == v[:-1]
    if same.any():
        a, b = o[1:][same].astype(np.int64), o[:-1][same].astype(np.int64)
        yield np.unique(np.maximum(a, b) << 32 | np.minimum(a, b))


def _least_reachable(n: int, codes: Iterator[np.ndarray]) -> np.ndarray:
    """The least member connected to each of ``n``; pairs that say nothing new are dropped
    as they come, so no list of pairs builds up."""
    label = np.arange(n)
    for code in codes:
        a, b = label[code >> 32], label[code & 0xFFFFFFFF]
        new = a != b
        if new.any():
            label = _least_root(n, a[new], b[new])[label]
    return label


def _least_root(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if np.array_equal(was, label):
            return label


def near_links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """From distinct (fp, node) to links (a, b) that join exactly the nodes connected by
    steps of at most ``distance`` (even) differing bits."""
    radius = distance // 2
    n = nodes.count()
    k = max(0, math.ceil(math.log2(max(1, n * ball_size(BITS, radius) / VARIANTS_PER_KEY))))
    k = max(k, min(6, max(0, n.bit_length() - 8)))
    mask = (1 << (BITS - k)) - 1

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        low = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64) & np.uint64(mask)
        left = pdf["left"].to_numpy().astype(np.int64)
        label = _least_reachable(len(node), _meetings(low, np.arange(len(node), dtype=np.uint32), left, BITS - k))
        linked = label != np.arange(len(node))
        return pd.DataFrame({"a": node[linked], "b": node[label[linked]]})

    sent = nodes.select("fp", "node", F.inline(_prefixes(F.col("fp"), k, radius)))
    return sent.groupBy("prefix").applyInPandas(meet, "a long, b long")


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp and component_id, the smallest doc_id reachable
    over documents whose fingerprints differ in at most ``distance`` bits.

    Equal fingerprints are one node from the start, so exact copies are never paired.
    Rows without a doc_id get the component of the others with their fingerprint (null if
    there are none).  Repeated rows come out as often as they go in; an empty table gives
    no rows; other columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, shingle_words))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    found = connected_components(near_links(nodes, distance))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, shingle_words: int = 4, distance: int = 4) -> DataFrame:
    """The documents whose doc_id is their group's smallest, with all columns as they were.

    Of rows that repeat a doc_id one stays.  Rows without a doc_id stay: nothing can name
    them as the copy that was kept.
    """
    groups = near_duplicate_groups(docs, shingle_words, distance)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_groups(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
