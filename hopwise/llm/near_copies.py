"""Groups of near copies by similarity: five-word shingles, weighted Jaccard of at least 0.8.

The balls of SimHash (``simhash_dedup.near_links``) meet first: texts whose five-word fingerprints
differ in at most 4 bits are compared exactly.  At similarity 0.8 two fingerprints differ in about
10 bits, and often in more, so no radius that ball hashing can afford reaches all pairs; the rest
is found by an exact filter.  The tokens of a text are its shingles, the k-th repeat of one being
a token of its own, so that the similarity of multisets is that of sets.  If all texts order their
tokens in the same way, two sets of similarity t share one of the first ``n - ceil(t n) + 1``
tokens of each.

Which order that is does not touch the result.  By hash, a fifth of a text's tokens lead; those
that lead in many texts are counted and come last instead, so that boilerplate does not bring
unrelated texts together.  Texts with the same tokens are one
node from the start.  Nodes that share a token are compared with the least of them first; then
only those pairs are left that are not connected yet.

Before texts are read, pairs are judged by sketches: the parity of the number of tokens that fall to
each of about n places.  A token that one set has alone changes one bit, so two sketches never differ
in more bits than the sets have tokens of their own, and no pair of the similarity is lost.  The lists
of nodes that share a token carry sketches and give only the pairs that these allow, so neither
unlike texts with tokens in common nor the many tokens of one pair become rows: a list leaves a pair
to the list of the least token that the two share.

Pairs are verified hub by hub: the text of the smaller node passes once for a few hundred others,
and of each node the pair with the nearest sketches is verified before the rest, most of which is
connected by then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_batches, arrow_map, checkpointed, dropped, shuffles_released, unused, utf8, written
from hopwise.llm.components import connected_components
from hopwise.llm.simhash_dedup import near_links

WIDTH, SIMILARITY = 5, 0.8
#: Nodes whose texts are looked up are broadcast up to this many; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Nodes that are compared with a hub in one go.
HUB_NODES = 256
#: Nodes of a token beyond which it comes last in the order; the most tokens that are ordered by
#: this, the most frequent ones; and nodes of a token beyond which it is gone through in blocks.
OFTEN, MOST_FREQUENT, LONG_LIST = 16, 1_000_000, 4_096
#: Fewest and most bits of a sketch.
SKETCH_BITS = 128, 65_536
#: Tokens of a node, just before a list's in their order, that tell whether an earlier list has the pair.
EARLIER = 64


def _hashes(data: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the shingles of ``width`` words (fewer words: all of them), repeats
    included; A-Z lower-cased, words being runs of non-blank bytes.

    Every word is hashed once, and all shingles of the text take in their next word together.
    """
    words = data.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out ^= own[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.sort(out)


def _tokens(hashes: np.ndarray) -> np.ndarray:
    hashes, first = hashes.copy(), np.searchsorted(hashes, hashes, "left")
    repeat = (np.arange(len(hashes)) - first).astype(np.uint64)
    for i in np.nonzero(repeat)[0].tolist():
        hashes[i] = xxhash.xxh64_intdigest(hashes[first[i]].tobytes() + repeat[i].tobytes(), 43)
    return np.sort(hashes)


def text_tokens(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit tokens of a text: its shingles, every repeat a token of its own."""
    return _tokens(_hashes(data, width))


def _fingerprint(hashes: np.ndarray) -> int:
    bits = sum((np.unpackbits(hashes[at : at + 65_536, None].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), 65_536)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big", signed=True)


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), 42) - (1 << 63)


def _sketch(tokens: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens are i modulo the number of bits, a power of two."""
    bits = min(max(1 << (len(tokens) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch in ``size`` bytes, if it has more."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _least_shared(n, similarity: float):
    return math.ceil(similarity * n - 1e-9)


def _most_apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The most tokens that one of two sets of n and m tokens may have alone."""
    return n + m - 2 * np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, node, n, fp, sketch): the text's hash, its tokens' hash and number, its
    fingerprint and sketch."""

    def fn(batch: pa.RecordBatch) -> dict:
        node, n, fp, sketch = [], [], [], []
        for t in batch.column(2).to_pylist():
            hashes = _hashes(t, width)
            tokens = _tokens(hashes)
            node.append(_node(tokens))
            n.append(len(hashes))
            fp.append(_fingerprint(hashes))
            sketch.append(_sketch(tokens))
        return {"doc_id": batch.column(0), "h": batch.column(1), "node": node, "n": n, "fp": fp, "sketch": sketch}

    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), utf8(F.col("text")).alias("t"))
    return arrow_map(rows, fn, "doc_id long, h long, node long, n long, fp long, sketch binary")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text ``t`` for every row of ``nodes``, which have doc_id and h, beside their columns."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), utf8(F.col("text")).alias("t"))
    named = checkpointed(nodes)
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return rows.join(named, ["doc_id", "h"])


def _prefixes(texts: DataFrame, frequent: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(token, node, n, at) of texts (t): the leading tokens of every node, of which similar ones
    have one in common, with their place in the order.  A task gives each node once."""
    order = texts.sparkSession.sparkContext.broadcast(frequent)
    seen: set = set()

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        last = order.value
        token, node, size, at = [], [], [], []
        for t in batch.column(0).to_pylist():
            own = text_tokens(t, width)
            who = _node(own)
            n = len(own)
            if who in seen or not n:
                continue
            seen.add(who)
            if len(last):
                found = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                own = np.concatenate((own[~found], own[found]))
            own = own[: n - _least_shared(n, similarity) + 1]
            token.append(own.view(np.int64))
            at.append(np.arange(len(own), dtype=np.int32))
            node.append(np.full(len(own), who, np.int64))
            size.append(np.full(len(own), n, np.int32))
        if token:
            yield {"token": np.concatenate(token), "node": np.concatenate(node), "n": np.concatenate(size), "at": np.concatenate(at)}

    return arrow_batches(texts.select("t"), fn, "token long, node long, n int, at int")


def _frequent(texts: DataFrame, width: int, similarity: float) -> np.ndarray:
    """Sorted tokens that lead in many nodes when tokens are ordered by hash."""
    leading = _prefixes(texts, np.zeros(0, np.uint64), width, similarity)
    counts = leading.groupBy("token").count().where(F.col("count") > OFTEN)
    top = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def _compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose texts reach ``similarity``."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for x, y, t in zip(*(batch.column(c).to_pylist() for c in ("hub", "member", "t"))):
                tokens = text_tokens(t, width)
                if y is None:
                    hub, own = x, tokens
                elif x == hub:
                    both = len(np.intersect1d(own, tokens, assume_unique=True))
                    if both >= similarity * (len(own) + len(tokens) - both) - 1e-9:
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = checkpointed(pairs)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_NODES).alias("parts"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("member"))
    hubs = members.select(F.col("hub").alias("node"), "hub", "part", F.lit(None).cast("long").alias("member")).distinct()
    asked = members.unionByName(hubs).join(nodes.select("node", "doc_id", "h"), "node").drop("node")
    texts = _texts_of(docs, asked).select("hub", "part", "member", "t")
    dealt = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("member"))
    return checkpointed(dealt.mapInArrow(fn, "a long, b long").distinct())


def _verified(pairs: DataFrame, links: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """``links`` and those of the pairs (a, b, far) that reach ``similarity``, but for pairs that
    links connect already.

    Each node's pair with the nearest sketches comes first, then all that is still apart.
    """
    pairs = checkpointed(_apart(pairs, _heads(links)))
    first = pairs.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b")
    links = checkpointed(links.unionByName(_compared(first, docs, nodes, width, similarity)))
    left = _apart(pairs.join(first, ["a", "b"], "left_anti"), _heads(links))
    return checkpointed(links.unionByName(_compared(left.select("a", "b"), docs, nodes, width, similarity)))


def _heads(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes: the least node within two links, which nodes of other
    components never share; most that are connected do, and no rounds are needed to tell."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    one = checkpointed(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("head")))
    two = one.select(F.col("node").alias("head"), F.col("head").alias("component"))
    return one.join(two, "head").select("node", "component")


def _candidates(x, y, similarity: float):
    """Whether sizes, and the places of a shared token, allow the similarity."""
    (n, i), (m, j) = ((F.col(f"{c}.n"), F.col(f"{c}.at")) for c in (x, y))
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9)
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (1 + F.least(n - i - 1, m - j - 1) >= least)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) whose nodes are in different components of (node, component)."""
    columns = pairs.columns
    for end in ("a", "b"):
        own = found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return pairs.where("of_a <> of_b").select(*columns)


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, far): those of the distinct pairs (a, b) of nodes whose sketches allow the
    similarity, with the bits in which these differ."""

    def fn(batch: pa.RecordBatch) -> dict:
        a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
        far = []
        for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            size = min(len(x), len(y))
            far.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))
        far = np.array(far, np.int64)
        ok = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (far <= _most_apart(n, m, similarity))
        return {"a": a[ok], "b": b[ok], "far": far[ok]}

    for end, c in (("a", "n"), ("b", "m")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(c), F.col("sketch").alias(f"of_{c}")), end)
    return arrow_map(pairs.select("a", "b", "n", "m", "of_n", "of_m"), fn, "a long, b long, far long")


def _near_in_lists(rows: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, far) of whole lists, sorted by list and n: pairs of nodes of different components
    whose sketches allow the similarity and that have no list of ``earlier`` in common.

    All lists are gone through together: each row meets the row d places further on, for every d
    that stays in its list and among sizes that the similarity allows.
    """
    earlier = list(map(frozenset, rows.column("earlier").to_pylist()))
    token, p, q, own, node, c, n = (rows.column(k).to_numpy() for k in ("token", "p", "q", "own", "node", "c", "n"))
    sketches = rows.column("sketch").to_pylist()
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
    starts = np.flatnonzero(new)
    end = np.append(starts[1:], len(token))[np.cumsum(new) - 1]
    found = []
    for bytes_ in np.unique(size).tolist():
        at = np.flatnonzero(size == bytes_)
        # rows that may follow these: of this size, or larger and not too large
        others = np.flatnonzero((size >= bytes_) & (similarity * n <= n[at].max() + 1e-9))
        place = np.zeros(len(token), np.int64)
        place[others] = np.arange(len(others))
        words = np.stack([_folded(sketches[k], bytes_) for k in others.tolist()])
        d = 0
        while len(at):
            d += 1
            at = at[at + d < end[at]]
            at = at[n[at] >= similarity * n[at + d] - 1e-9]
            x = at[(c[at] != c[at + d]) & ((own[at] != own[at + d]) | (p[at] == q[at]))]
            if len(x):
                y = x + d
                far = np.bitwise_count(words[place[x]] ^ words[place[y]]).sum(axis=1, dtype=np.int64)
                ok = np.flatnonzero(far <= _most_apart(n[x], n[y], similarity))
                ok = ok[[earlier[i].isdisjoint(earlier[j]) for i, j in zip(x[ok].tolist(), y[ok].tolist())]] if len(ok) else ok
                found.append((node[x[ok]], node[y[ok]], far[ok]))
    x, y, far = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    return np.minimum(x, y), np.maximum(x, y), far


def _remaining(lists: DataFrame, docs: DataFrame, nodes: DataFrame, frequent: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(a, b, far): pairs of nodes that share a token of ``lists`` (token, y, c), c being the
    component of the node y, that are in different components and whose sketches allow the
    similarity."""
    if "sketch" not in nodes.columns:
        nodes = _nodes(docs, width).groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(nodes.select("node"), "node", "left_semi")
    return checkpointed(_in_lists(lists, nodes, similarity).distinct())


def _in_lists(lists: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``_remaining``, where a pair stands again only if ``EARLIER`` tokens of one of its nodes lie
    between two that both have.

    Lists of the same nodes, as the tokens of one passage make them, are gone through once.  Long
    ones are cut into blocks of ``LONG_LIST``, of which every two meet, so that no task holds more.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def given(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "far"), _near_in_lists(rows, similarity))})

        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = [rows.column(k).to_numpy() for k in ("token", "p", "q")]
            differ = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if rows.num_rows else []
            whole = int(differ[-1]) + 1 if len(differ) else 0  # the last list may go on in the next batch
            if whole:
                yield given(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and rest.num_rows:
            yield given(rest)

    rows = lists.select("token", F.col("y.node").alias("node"), "c")
    per = rows.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    once = per.groupBy("size", "x", "y").agg(F.min("token").alias("token"))
    rows = rows.join(once.select("token", F.ceil(F.col("size") / LONG_LIST).alias("blocks")), "token")
    # two nodes with several lists in common are left to the first of these, where neither has a common one earlier
    own = Window.partitionBy("node").orderBy("token").rowsBetween(-EARLIER, -1)
    rows = rows.withColumn("earlier", F.collect_list("token").over(own))
    rows = rows.join(nodes.select("node", F.col("n").cast("long").alias("n"), "sketch"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "c", "n", "sketch", "earlier")
    dealt = rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "n", "node")
    return dealt.mapInArrow(fn, "a long, b long, far long")


def _stars(entries: DataFrame) -> DataFrame:
    """(token, y, x): every node y of a token that has several, once, and the least of them, x."""
    rows = Window.partitionBy("token").orderBy("node")
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    node = F.struct("node", "n", "at")
    met = entries.select("token", node.alias("y"), F.first(node).over(whole).alias("x"), F.last("node").over(whole).alias("most"), F.lag("node").over(rows).alias("before"))
    return met.where("x.node < most and (before is null or before < y.node)").select("token", "y", "x")


def near_copy_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, component): every row with an id, the hash of its text, and a number that is
    the same exactly for rows joined by steps of at least ``similarity``.

    Texts without words are copies of each other.  Rows without a doc_id take no part.
    """
    with shuffles_released(docs.sparkSession):
        return _groups(docs, width, similarity)


def _groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    rows = checkpointed(_nodes(docs, width))
    least = F.min(F.struct("doc_id", "h")).alias("row")
    nodes = rows.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "sketch")])
    nodes = checkpointed(nodes.select("node", "row.doc_id", "row.h", "n", "fp", "sketch"))
    # fingerprints that meet, and nodes of one fingerprint with the least of them
    heads = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    same = nodes.select("fp", F.col("node").alias("b")).join(heads, "fp").where("b <> node").select(F.col("node").alias("a"), "b")
    met = same.unionByName(near_links(heads)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _compared(_likely(met, nodes, similarity).select("a", "b"), docs, nodes, width, similarity)
    # the rest by their leading tokens, dealt by token once
    texts = docs.where("doc_id is not null").select(utf8(F.col("text")).alias("t"))
    frequent = _frequent(texts, width, similarity)
    entries = _prefixes(texts, frequent, width, similarity).repartition("token")
    met = written(_stars(entries))
    stars = met.where("x.node < y.node").where(_candidates("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = _verified(_likely(stars, nodes, similarity), links, docs, nodes, width, similarity)
    found = connected_components(links)
    # pairs of one token that this has not connected; only tokens whose members are still apart
    of = met.select("token", "y", F.col("y.node").alias("node")).join(found, "node", "left").select("token", "y", F.coalesce("component", "node").alias("c"))
    apart = of.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    lists = written(of.join(apart, "token", "left_semi"))
    dropped(met)
    rest = _remaining(lists, docs, nodes, frequent, width, similarity)
    dropped(lists)
    found = connected_components(_verified(rest, links, docs, nodes, width, similarity))
    return rows.join(found, "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("component"))


def keep_one_copy(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies, columns as they were.

    Rows are told apart by id and text, so texts that share an id but are no copies all stay.
    Rows without a doc_id stay: nothing can name them as the copy that was kept.
    """
    hash = unused("h", docs)
    kept = near_copy_groups(docs, width, similarity).groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("row")).select("row.doc_id", F.col("row.h").alias(hash))
    named = docs.where("doc_id is not null").withColumn(hash, F.xxhash64("text"))
    one = named.join(kept, ["doc_id", hash], "left_semi").dropDuplicates(["doc_id", hash])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
