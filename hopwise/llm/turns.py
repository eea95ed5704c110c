"""Rows of conversations in order, for conversations of any length.

A conversation is not one task's business: rows are sorted in ranges that may cut it anywhere, and
what a range needs to know of the ranges before it is one row for each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import written

#: Bytes of packed pieces in one row on their way to a hash.
PACK_BYTES = 1 << 20


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``part``, the range a row is in, and ``p``, its place within its key from 1.

    Rows that are equal in the key and all of ``order`` share a range and get places as they come.
    """
    ranged = written(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part", key).count()
    before = F.sum("count").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a range continues at most one key of the ranges before it
    began = sizes.select(F.col("part").alias("_part"), F.col(key).alias("_key"), before.alias("_before")).where("_before > 0")
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("part", key).orderBy(*order)))
    placed = placed.join(F.broadcast(began), (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return placed.withColumn("p", F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_at", "_part", "_key", "_before")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int):
    """(keys, order, piece) of sorted rows; a row that repeats the key and order before it is
    left out."""
    last = None
    for batch in batches:
        for *place, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if place != last:
                last = place
                yield tuple(place[:n_keys]), place[n_keys], piece


def joined_sha256(rows: DataFrame, keys: list[str], order: str, piece: str, separator: bytes) -> DataFrame:
    """(keys, sha256): the digest of each key's pieces (strings) in order, joined.

    Pieces are sorted and packed in ranges that may cut a key anywhere.  The digest of one string
    is a chain by its nature, so a key's packs pass one task, a pack at a time.
    """
    n = len(keys)
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    head = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds))

    def out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def schema_of(batches_schema: list[tuple[str, pa.DataType]]) -> pa.Schema:
        return pa.schema(batches_schema)

    key_types = [(k, {"bigint": pa.int64(), "string": pa.string()}[t]) for k, t in zip(keys, kinds)]
    packed_schema = schema_of([*key_types, ("first", pa.int64()), ("pack", pa.binary())])
    digest_schema = schema_of([*key_types, ("sha256", pa.string())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, own, first, pieces, size = [], 0, None, None, [], 0

        def close():
            if pieces:
                done.append((*own, first, separator.join(pieces)))

        for key, at, text in _runs(batches, n):
            if key != own or size > PACK_BYTES:
                close()
                held += size
                own, first, pieces, size = key, at, [], 0
                if held > PACK_BYTES:
                    yield out(done, packed_schema)
                    done, held = [], 0
            data = text.encode()
            pieces.append(data)
            size += len(data) + len(separator)
        close()
        if done:
            yield out(done, packed_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, own, chain = [], None, None
        for key, _, data in _runs(batches, n):
            if key != own:
                if chain is not None:
                    done.append((*own, chain.hexdigest()))
                if len(done) >= 10_000:
                    yield out(done, digest_schema)
                    done = []
                own, chain = key, hashlib.sha256()
            else:
                chain.update(separator)
            chain.update(data)
        if chain is not None:
            done.append((*own, chain.hexdigest()))
            yield out(done, digest_schema)

    place = [*keys, order]
    sorted_rows = rows.select(*place, F.col(piece).cast("string")).repartitionByRange(*place).sortWithinPartitions(*place)
    packs = sorted_rows.mapInArrow(pack, f"{head}, first long, pack binary")
    return packs.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{head}, sha256 string")
