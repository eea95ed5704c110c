"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits; a row's cell is its place on the Hilbert curve
through the grid, so runs of the curve are compact in every dimension and a reader can prune
files on any of them.  Rows are ordered by (curve index, salt, id) and cut into runs whose
counts differ by at most one.

Nothing is sorted globally: counts per (cell, salt) are added up along the curve, and only
rows of the same cell and salt are ranked with each other.  The salt, 12 bits of a hash of
what identifies a row, keeps a cell that holds a third of all rows in thousands of ranking groups.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import running_totals, unused

BITS = 5
SALTS = 4_096
#: Combinations of labels that are counted on the driver.
MOST_LABELS = 100_000


def hilbert_index(axes: Column, dims: int, bits: int = BITS) -> Column:
    """The Hilbert index of an array of ``dims`` integers below 2**bits (transpose form by
    Skilling's published bit operations, then interleaved)."""

    def replaced(x, i, value):
        return F.transform(x, lambda v, j: F.when(j == i, value).otherwise(v))

    def swap(x, step):
        """For one bit ``q`` and axis ``i``: invert or exchange the low bits of axes 0 and i."""
        q, i = step["q"], step["i"]
        low, first, own = q - 1, F.get(x, F.lit(0)), F.get(x, step["i"])
        mixed = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = replaced(x, F.lit(0), first.bitwiseXOR(low))
        swapped = F.transform(
            x, lambda v, j: F.when((j == 0) & (i == 0), v).when((j == 0) | (j == i), v.bitwiseXOR(mixed)).otherwise(v)
        )
        return F.when(own.bitwiseAND(q) != 0, inverted).otherwise(swapped)

    def literal(pairs):
        return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in pairs])

    steps = literal([(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(dims)])
    turned = F.aggregate(steps, axes, swap)
    gray = F.aggregate(literal([(0, i) for i in range(1, dims)]), turned, lambda x, s: replaced(x, s["i"], F.get(x, s["i"]).bitwiseXOR(F.get(x, s["i"] - 1))))
    last = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
        F.lit(0),
        lambda t, q: F.when(F.get(gray, F.lit(dims - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    final = F.transform(gray, lambda v: v.bitwiseXOR(last))
    order = literal([(1 << b, i) for b in range(bits - 1, -1, -1) for i in range(dims)])
    return F.aggregate(order, F.lit(0).cast("long"), lambda h, s: h * 2 + F.when(F.get(final, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0).cast("long"))


def cuts_of_labels(rows: DataFrame, *labels: str, bits: int = BITS) -> list[list[str]]:
    """For each label column the first labels of up to 2**bits - 1 classes that hold nearly equal
    numbers of rows.  Up to ``MOST_LABELS`` combinations are counted in one job and cut here; beyond,
    each column is cut by running counts in Spark, with the same result."""
    counts = rows.groupBy(*labels).agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        return [label_cuts(rows, c, bits) for c in labels]
    out = []
    for label in labels:
        sizes: Counter = Counter()
        for r in counts:
            if r[label] is not None:
                sizes[r[label].encode()] += r["n"]
        total, upto, firsts = sizes.total(), 0, {}
        for value in sorted(sizes):
            firsts.setdefault(upto * ((1 << bits) - 1) // total, value.decode())
            upto += sizes[value]
        out.append(list(firsts.values()))
    return out


def label_cuts(rows: DataFrame, label: str, bits: int = BITS) -> list[str]:
    """The first labels of up to 2**bits - 1 classes that hold nearly equal numbers of rows."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    placed = running_totals(counts, label, "n")
    total = placed.agg(F.sum("n")).first()[0] or 1
    firsts = placed.groupBy(F.expr(f"upto * {(1 << bits) - 1} div {total}").alias("class")).agg(F.min(label).alias("first"))
    return sorted((r["first"] for r in firsts.collect()), key=lambda s: s.encode())  # at most one a class


def quantised_text(value: Column, cuts: list[str]) -> Column:
    """The class of a label, in the labels' own order, so that a range of the curve is a range of
    labels; 0 is left for null."""
    below = F.filter(F.array(*map(F.lit, cuts)).cast("array<string>"), lambda c: c <= value)
    return F.when(value.isNull(), 0).otherwise(F.size(below)).cast("int")


def quantised_size(size: Column, bits: int = BITS) -> Column:
    """Half octaves of a positive number."""
    return F.least(F.floor(2 * F.log2(size.cast("double"))), F.lit((1 << bits) - 1)).cast("int")


def with_curve_order(rows: DataFrame, axes: list[Column], *order: str) -> DataFrame:
    """Add ``hilbert``, ``rank`` (0, 1, ... along the curve) and ``total`` to the rows."""
    dims = [f"_x{i}" for i in range(len(axes))]
    rows = rows.select("*", *[a.alias(d) for a, d in zip(axes, dims)], F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int").alias("_salt"))
    groups = rows.groupBy(*dims, "_salt").agg(F.count("*").alias("_n"))
    cells = groups.groupBy(*dims).agg(F.sum("_n").alias("_cell_n")).withColumn("hilbert", hilbert_index(F.array(*dims), len(dims)))
    # at most 2**(BITS x dims) cells, whatever the input
    along = Window.orderBy("hilbert")
    cells = cells.select(
        *dims, "hilbert", (F.sum("_cell_n").over(along) - F.col("_cell_n")).alias("_before"), F.sum("_cell_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")
    )
    inside = Window.partitionBy(*dims).orderBy("_salt")
    starts = groups.join(cells, dims).select(*dims, "_salt", "hilbert", "total", (F.col("_before") + F.sum("_n").over(inside) - F.col("_n")).alias("_start"))
    own = Window.partitionBy(*dims, "_salt").orderBy(*order)
    ranked = rows.withColumn("_k", F.row_number().over(own) - 1)
    return ranked.join(starts, [*dims, "_salt"]).withColumn("rank", F.col("_start") + F.col("_k")).drop(*dims, "_salt", "_k", "_start")


def document_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, hilbert, shard, slot.

    Dimensions: language and source (in classes of their own order with nearly equal numbers of
    rows), half octaves of the size.  Shard counts differ by at most
    one; ``slot`` counts from 0 inside a shard, along the curve.  Null languages, sources and
    texts (size 1) have cells of their own; ties are broken by id, size and checksum, so rows
    equal in all these are interchangeable; an empty table gives no rows; other columns are
    ignored.
    """
    rows = document_rows(docs)
    named = ("lang", "source")
    labels = [quantised_text(F.col(c), cuts) for c, cuts in zip(named, cuts_of_labels(rows, *named))]
    axes = [*labels, quantised_size(F.col("size"))]
    ranked = with_curve_order(rows, axes, "doc_id", "size", "text_crc32")
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"((rank * {shards}) div total * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", shard.cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write whole documents, one folder a shard, in curve order inside each file.

    Rows are matched on id, size and checksum; rows equal in all three go together.  The columns
    ``shard`` and ``hilbert`` are added, under lengthened names if the documents have such columns.
    """
    placed = shard_documents(docs, shards).groupBy("doc_id", "size", "text_crc32").agg(F.min("shard").alias("shard"), F.min("hilbert").alias("hilbert"))
    names = {c: unused(c, docs) for c in ("shard", "hilbert", "size", "text_crc32", "id")}
    shard, hilbert, size, crc, id = names.values()
    placed = placed.select(F.col("doc_id").alias(id), F.col("size").alias(size), F.col("text_crc32").alias(crc), F.col("shard").alias(shard), F.col("hilbert").alias(hilbert))
    text = F.coalesce("text", F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col(id)) & ((F.octet_length(text) + 1) == F.col(size)) & (F.crc32(text.cast("binary")) == F.col(crc))
    whole = docs.join(placed, same).drop(id, size, crc)
    whole.repartitionByRange(shard, hilbert).sortWithinPartitions(shard, hilbert).write.partitionBy(shard).parquet(path)


def op7_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
