"""Deterministic sharded WARC writer and reader.

Records are put in order of their id and cut into shards where the running sum of payload bytes
passes a multiple of the shard's size.  The sum is exact (ids and sizes are sorted in ranges, the
ranges' sums are added up first), so the shards depend on the rows alone, however ids lie.
A task writes each of its shards in id order, one gzip member a record after the file's
``warcinfo``, and rolls to a new file when the compressed size is reached.  Files are written under temporary names; the
manifest then names them, they are moved to their final names, and ``_MANIFEST`` (a Parquet
table) is what readers go by: a file that no manifest names was never committed, so lost or
repeated tasks leave nothing that is read.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
id is a response; the others are revisits of it and carry no payload.
"""

from __future__ import annotations

import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed, running_totals, shared_dir, utf8

REVISIT_BYTES = 100
#: Compressed size at which a file is rolled, and payload bytes of a shard (one task): several files.
FILE_BYTES, SHARD_BYTES = 4 << 20, 32 << 20
#: Bytes that a record counts besides its payload.
HEADER_BYTES = 512
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1c1b1e-5a44-5b1c-9d1a-0d0a4c5e7a11")
_MANIFEST = "shard int, seq int, temporary string, final string, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(*named) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, named)))}>"


def target_uri(url: str | None) -> str:
    """The URL as an ASCII URI: what no URI may hold is percent-encoded."""
    return urllib.parse.quote(url or "", safe="%:/?#[]@!$&'()*+,;=-._~", errors="replace")


def info_bytes(name: str) -> bytes:
    """The ``warcinfo`` record that opens a file."""
    block = b"software: hopwise\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('warcinfo', name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with headers made anew from the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest) if page_id is not None else record_id('', digest, target_uri(url))}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): every page with a null refers_to and, for each
    revisit, a mark without payload that names its response.

    Only ids and digests are shuffled to find the first page of each payload; the minimum is
    pre-aggregated, and the join back to a payload that a third of all pages share can be split.
    Marks travel with the pages to the writer, so the payloads themselves are shuffled once.
    Pages without an id cannot be ranked and are responses.
    """
    base = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    light = base.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha2("payload", 256).alias("digest"))
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    again = light.join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    marks = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    own = base.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(marks)


def shard_cuts(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """The first id of each shard but the first: one number for ``shard_bytes`` of payload."""
    size = (F.octet_length(utf8(F.col("html"))) + HEADER_BYTES).cast("long")
    ids = pages.where("page_id is not null").groupBy("page_id").agg(F.sum(size).alias("b"))
    shard = F.expr(f"upto div {shard_bytes}").alias("shard")
    firsts = running_totals(ids, "page_id", "b").groupBy(shard).agg(F.min("page_id").alias("first"))
    return np.sort(firsts.select("first").toArrow().column("first").to_numpy())[1:]


class _Writer:
    """Gzip members of one shard, rolled by compressed size."""

    def __init__(self, root: str, shard: int, file_bytes: int, attempt: str):
        self.fs, self.path = _file_system(root)
        self.shard, self.file_bytes, self.attempt, self.seq, self.out, self.done = shard, file_bytes, attempt, 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"_temporary/part-{self.shard:06}-{self.seq:04}-{self.attempt}.warc.gz"
            self.out, self.hash, self.size, self.records = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), hashlib.sha256(), 0, 0
            self._write(info_bytes(self.final()))
        self._write(record)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def final(self) -> str:
        return f"part-{self.shard:06}-{self.seq:04}.warc.gz"

    def _write(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.name, self.final(), self.records, self.size, self.hash.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def write_warc(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write (page_id, url, html) under ``root``, a folder that all executors share (any path
    that pyarrow's file systems open), and return the committed manifest.

    A null html is an empty payload, a null url an empty target.  Rows without a page_id go to a
    shard by the hash of their payload; rows that repeat one are written each.  Other columns
    are ignored; an empty table commits an empty manifest.
    """
    cuts = shard_cuts(pages, shard_bytes)
    shards = len(cuts) + 1
    files, path = _file_system(root)
    files.create_dir(f"{path}/_temporary", recursive=True)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, page_id.to_numpy(), side="right"))

    unnamed = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(shards))
    rows = with_revisits(pages)
    rows = rows.withColumn("shard", F.when(F.col("page_id").isNull(), unnamed).otherwise(shard_of(F.coalesce("page_id", F.lit(0).cast("long")))).cast("int"))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.desc_nulls_last("refers_to"), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, writer = uuid.uuid4().hex[:12] if TaskContext.get() is None else f"{TaskContext.get().taskAttemptId()}", None
        done, mark = [], (None, None, None)
        for batch in batches:
            for page_id, url, payload, digest, refers_to, shard in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if refers_to is not None:
                    mark = (page_id, digest, refers_to)
                    continue
                refers_to = mark[2] if mark[:2] == (page_id, digest) else None
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        writer.close()
                        done += writer.done
                    writer = _Writer(root, shard, file_bytes, attempt)
                writer.add(record_bytes(page_id, url, payload, refers_to))
        if writer is not None:
            writer.close()
            done += writer.done
        if done:
            names = [f.split()[0] for f in _MANIFEST.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*done), _MANIFEST.split(", "))], names=names)

    written = checkpointed(dealt.select("page_id", "url", "payload", "digest", "refers_to", "shard").mapInArrow(write, _MANIFEST))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _file_system(root)
        for batch in batches:
            for r in batch.to_pylist():
                if files.get_file_info(f"{path}/{r['temporary']}").type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    files.move(f"{path}/{r['temporary']}", f"{path}/{r['final']}")
            yield batch

    manifest = written.mapInArrow(commit, _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{root}/_MANIFEST")
    files.delete_dir(f"{path}/_temporary")  # what lost attempts have left
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{root}/_MANIFEST")


def _parse(raw) -> Iterator[tuple]:
    """Records of a stream of gzip members, one member in memory at a time."""
    inflate, parts = zlib.decompressobj(31), []
    while chunk := raw.read(1 << 20):
        while chunk:
            parts.append(inflate.decompress(chunk))
            chunk = b""
            if inflate.eof:
                chunk = inflate.unused_data
                if (record := _record(b"".join(parts))) is not None:
                    yield record
                inflate, parts = zlib.decompressobj(31), []


def _record(data: bytes) -> tuple | None:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
        refers = None
    else:
        refers, payload = int(fields["X-Refers-To-Page-Id"]), None
    page_id = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
    return page_id, fields["WARC-Target-URI"], fields["WARC-Type"], refers, size, digest, payload


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of all committed files, digests checked; a revisit has a null payload."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/_MANIFEST").select("final")
    names, kinds = [f.split()[0] for f in _RECORD.split(", ")], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in _RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _file_system(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    rows, size = [], 0
                    for r in _parse(raw):
                        rows.append(r)
                        size += len(r[6] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.repartition(max(1, manifest.count()), "final").mapInArrow(read, _RECORD)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark).rstrip('/')}/hopwise-warc/{uuid.uuid4()}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (SELECT page_id, html, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND first < page_id THEN first END AS refers_to
FROM f
"""
