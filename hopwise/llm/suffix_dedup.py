"""Removal of repeated byte strings with a range-partitioned, sparse suffix array.

A byte is removed if it lies in a string of LENGTH bytes that also starts in a document with a
smaller id.  A suffix array over all suffixes would be sorted at a cost of many bytes for each
byte of text; here only suffixes at content-defined anchors are, which is enough:

*   Of the KEY-byte strings inside a window of LENGTH bytes the one with the least hash (the
    leftmost of equals) is the window's anchor.  Equal windows have equal anchors at equal
    places, so windows need comparing only with those whose anchor suffix starts alike.
    About one byte in eighteen is an anchor.
*   A *unit* is an anchor with the run of windows that it serves.  Splitters sampled from the
    units range-partition them by their leading KEY bytes, then by the hash of the run, so that
    leading bytes that very many units share are cut into several buckets.
*   A bucket sorts its units by multikey quicksort: by one word of leading bytes at a time, each
    word only where the ones before tie, then by the run's hash (96 bits).  Units whose whole run
    of windows is equal are settled there: all but those of the least document are removed.
*   Of the others with company under their leading bytes (the ends of copied passages), one for
    each distinct run fetches its bytes and is compared window by window.  Leading bytes that lie
    on a boundary are compared across it: a bucket reports its first and last ones, and what is
    alone in its bucket but not beyond it is fetched as well.

Before anything is sent, equal units of one batch are settled among themselves, so a passage
that a third of all documents share reaches its bucket once a batch, not once a document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_batches, arrow_map, free_memory, utf8, written

LENGTH, KEY = 50, 16
#: Bytes of text cut into units at once, and bytes of text for each bucket.
PIECE, BUCKET_BYTES = 1 << 17, 4 << 20
#: Bytes of text, or spans, that a task holds at once (one longer text is held alone).
HELD, HELD_SPANS = 4 << 20, 200_000
#: Least number of documents in the sample behind the splitters, units of each, and units a bucket.
SAMPLE_DOCS, SAMPLE_UNITS, UNITS_A_BUCKET = 2_000, 16, 8
#: Requests for bytes that share a bucket; leading bytes with more are compared by window.
BUCKET_REQUESTS = 50_000
_U = np.uint64


@lru_cache(maxsize=2)
def _bytes_table(which: int) -> np.ndarray:
    return np.random.default_rng(20 + which).integers(1, 1 << 63, 256).astype(_U) * _U(2) + _U(1)


@lru_cache(maxsize=2)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Spans:
    """Two 64-bit hashes of any spans of one byte array."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(18, int(len(data)).bit_length())
        self.sums = []
        for which in (0, 1):
            power, inverse = _powers(size, which)
            self.sums.append((np.concatenate((np.zeros(1, _U), np.cumsum(_bytes_table(which)[data] * power[: len(data)], dtype=_U))), inverse))

    def hash(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        out = []
        for sums, inverse in self.sums:
            h = (sums[end] - sums[start]) * inverse[start] + salt
            h ^= h >> _U(31)
            out.append(h * _U(0xD6E8FEB86659FD93) ^ (h >> _U(29)))
        return out


def _pieces(texts: list[bytes], length: int):
    """Lists of (text index, offset, bytes) of about PIECE bytes; together they hold every
    window exactly once."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            if len(t) >= length:
                part = t[at : at + PIECE + length - 1]
                group.append((i, at, part))
                size += len(part)
                if size >= PIECE:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _units_of(group, length: int) -> dict[str, np.ndarray]:
    lens = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(lens)
    n = int(ends[-1])
    data = np.frombuffer(b"".join(p for _, _, p in group) + bytes(64), np.uint8)
    two = data.astype(_U)
    two = (two[:-1] << _U(8)) | two[1:]
    four = (two[:-2] << _U(16)) | two[2:]
    eight = (four[:-4] << _U(32)) | four[4:]
    first, second = eight[:n], eight[8 : n + 8]
    h = (first * _U(0x9E3779B97F4A7C15)) ^ ((second ^ (second >> _U(29))) * _U(0xC2B2AE3D27D4EB4F))
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(30)
    place = _U((1 << 22) - 1)
    least = (h & ~place) | np.arange(n, dtype=_U)
    width, span = length - KEY + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    piece = np.repeat(np.arange(len(group)), lens)
    start = np.flatnonzero(np.arange(len(least)) + length <= ends[piece[: len(least)]])
    anchor = (least[start] & place).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    head, tail = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)])) - 1
    s, e, a = start[head], start[tail] + length, anchor[head]
    run, check = _Spans(data[:n]).hash(s, e, ((a - s) * 4096 + (e - s)).astype(_U))
    of = piece[s]
    base = np.array([at for _, at, _ in group]) - (ends - lens)
    return {
        "text": np.array([i for i, _, _ in group])[of],
        "start": s + base[of],
        "size": (e - s).astype(np.uint16),
        "lead": (a - s).astype(np.uint16),
        "first": first[a],
        "second": second[a],
        "run": run,
        "check": (check >> _U(32)).astype(np.uint32),
    }


def _units(texts: list[bytes], length: int) -> dict[str, np.ndarray] | None:
    parts = [_units_of(g, length) for g in _pieces(texts, length)]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else None


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Maximal runs of the spans of each row: (row, start, end)."""
    row, start, end = row.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
    order = np.argsort(row << 40 | start, kind="stable")
    row, start, end = row[order], start[order], end[order]
    shift = row << 40
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:], [len(row)])) - 1
    return row[new], start[new], (reach - shift)[last]


def _pack(**columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed message."""
    out = []
    for name, c in columns.items():
        out.append(f"{name}:{c.dtype.str}".encode())
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes())
    sizes = np.array([len(next(iter(columns.values()))), len(columns)], np.int64)
    names = b",".join(out[::2])
    head = np.array([len(names)], np.int64).tobytes() + sizes.tobytes() + names
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(out[1::2]))


def _unpack(message: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(message)
    names, n, _ = np.frombuffer(raw[:24], np.int64)
    at, out = 24 + int(names), {}
    for item in raw[24:at].decode().split(","):
        name, kind = item.split(":")
        size = np.dtype(kind).itemsize * int(n)
        flat = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, int(n)).T
        out[name] = np.ascontiguousarray(flat).view(kind).ravel()
        at += size
    return out


def _gathered(messages: list[bytes]) -> dict[str, np.ndarray] | None:
    parts = [_unpack(m) for m in messages]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else None


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _least(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each element of sorted runs the least value of its run."""
    return np.minimum.reduceat(x, np.flatnonzero(new))[np.cumsum(new) - 1] if len(x) else x


def multikey_order(*words: np.ndarray) -> np.ndarray:
    """The order of rows by their words, the first word first: quicksort by one word at a time,
    the next one only among rows that tie in all before."""
    order = np.argsort(words[0])
    new = _first_of(words[0][order])
    for word in words[1:]:
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(order)))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((word[rows], np.cumsum(new)[tied]))]
        new |= _first_of(word[order])
    return order


#: What tells runs apart: leading bytes, then the 96-bit hash of the run.
WORDS = ("first", "second", "run", "check")


def _ranked_windows(w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Windows in order, and which of them are not those of the least document that has them."""
    order = multikey_order(w["window"], w["check"], w["first"])
    w = {c: x[order] for c, x in w.items()}
    return w, w["doc"] > _least(w["doc"], _first_of(w["window"], w["check"], w["first"]))


def _settle_windows(w: dict[str, np.ndarray], length: int):
    """Of equal windows all but those of the least document go: (row, start, end)."""
    w, gone = _ranked_windows(w)
    return w["row"][gone], w["start"][gone], w["start"][gone] + length


def _windows(data: bytes, base, size, lead, length, **more):
    """Every window of the byte strings that follow each other in ``data``."""
    size = size.astype(np.int64)
    count = size - length + 1
    at = np.repeat(np.cumsum(size) - size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    inside = at - np.repeat(np.cumsum(size) - size, count)
    salt = (np.repeat(lead.astype(np.int64), count) - inside).astype(_U)
    window, check = _Spans(np.frombuffer(data, np.uint8)).hash(at, at + length, salt)
    return {"window": window, "check": check, "start": np.repeat(base.astype(np.int64), count) + inside} | {c: np.repeat(x, count) for c, x in more.items()}


def _cuts(sample: dict[str, np.ndarray], buckets: int) -> dict[str, np.ndarray]:
    """Splitters (first, second, run) that cut the sample into equal ranges."""
    order = multikey_order(*(sample[c] for c in WORDS[:3]))
    at = order[np.linspace(0, len(order) - 1, buckets + 1).astype(int)[1:-1]] if buckets > 1 and len(order) else order[:0]
    cuts = {c: sample[c][at] for c in WORDS[:3]}
    new = _first_of(*cuts.values())
    return {c: x[new] for c, x in cuts.items()}


def _bucket_of(u: dict[str, np.ndarray], cuts: dict[str, np.ndarray]) -> np.ndarray:
    """How many splitters are not above each unit."""
    out = np.searchsorted(cuts["first"], u["first"], side="right")
    tie = np.flatnonzero(out != np.searchsorted(cuts["first"], u["first"], side="left"))
    if len(tie):  # among splitters with these leading bytes: place units and splitters together
        both = [np.concatenate((cuts[c], u[c][tie])) for c in WORDS[:3]]
        n = len(cuts["first"])
        order = np.lexsort((np.arange(len(both[0])), *both[::-1]))  # a splitter before its equals
        out[tie] = np.cumsum(order < n)[np.argsort(order)][n:]
    return out


def _splitters(texts: DataFrame, n: int, buckets: int, length: int) -> dict[str, np.ndarray]:
    """Cuts from a sample that grows with the buckets: some units (those of least run hash) of
    documents drawn by chance."""

    def units(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [np.zeros(0, np.int64)] for c in WORDS[:3]}
        for part, data in _texts(batch, 2):
            u = _units(data, length)
            if u is not None:
                order = np.lexsort((u["run"], u["text"]))
                place = np.arange(len(order)) - np.flatnonzero(_first_of(u["text"][order]))[np.cumsum(_first_of(u["text"][order])) - 1]
                for c in out:
                    out[c].append(u[c][order[place < SAMPLE_UNITS]].view(np.int64))
        return {c: np.concatenate(x) for c, x in out.items()}

    docs = max(SAMPLE_DOCS, -(-buckets * UNITS_A_BUCKET // SAMPLE_UNITS))
    sample = texts.sample(min(1.0, docs / max(1, n)), seed=7) if buckets > 1 else texts.limit(0)
    got = arrow_map(sample.select("row", "doc_id", "packed"), units, "first long, second long, run long").toArrow()
    return _cuts({c: got.column(c).to_numpy().view(_U) for c in WORDS[:3]}, buckets)


def _slices(weights: np.ndarray, most: int):
    """(from, to) of runs of rows of ``most`` weight, one row at least."""
    ends, at = np.cumsum(weights), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _texts(batch: pa.RecordBatch, column: int):
    """(part of the batch, its texts) of HELD bytes of packed text each."""
    unpack = zstandard.ZstdDecompressor().decompress
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for at, to in _slices(sizes * 3, HELD):
        part = batch.slice(at, to - at)
        yield part, [unpack(t) for t in part.column(column).to_pylist()]


def _map_units(doc, row, texts, length, cuts):
    """Messages (bucket, kind, payload) of some texts: r removed spans, u units."""
    u = _units(texts, length)
    if u is None:
        return
    u["doc"], u["row"] = doc[u["text"]], row[u["text"]]
    order = multikey_order(*(u[c] for c in WORDS))
    least = np.empty(len(order), np.int64)
    least[order] = _least(u["doc"][order], _first_of(*(u[c][order] for c in WORDS)))
    gone = u["doc"] > least
    to = _bucket_of(u, cuts)
    if gone.any():
        i, s, e = _merged(u["text"][gone], u["start"][gone], u["start"][gone] + u["size"][gone])
        yield int(to[0]), "r", _pack(row=row[i], start=s, end=e)
    kept = np.flatnonzero(~gone)
    kept = kept[np.argsort(to[kept], kind="stable")]
    u = {c: u[c][kept] for c in (*WORDS, "doc", "row", "start", "size", "lead")}
    heads = np.flatnonzero(_first_of(to[kept]))
    for a, b in zip(heads, np.append(heads[1:], len(kept))):
        yield int(to[kept[a]]), "u", _pack(**{c: x[a:b] for c, x in u.items()})


_STEP = "kind string, row long, start long, end long, doc_id long, lead int, first long, second long, bucket int"


def _table(kind: str, row, start, end, **more) -> pa.Table:
    n = len(row)
    zero = np.zeros(n, np.int64)
    columns = {"row": row, "start": start, "end": end} | {c: more.get(c, zero) for c in ("doc_id", "lead", "first", "second", "bucket")}
    types = {"lead": pa.int32(), "bucket": pa.int32()}
    return pa.table({"kind": pa.array([kind] * n, pa.string())} | {c: pa.array(np.asarray(x).astype(np.int64), types.get(c, pa.int64())) for c, x in columns.items()})


def _rows_merged(row, start, end) -> pa.Table:
    if not len(row):
        return _table("r", row, start, end)
    names, at = np.unique(row, return_inverse=True)
    i, s, e = _merged(at, start, end)
    return _table("r", names[i], s, e)


def _settle_bucket(bucket: int, kinds: list[str], payloads: list[bytes]) -> pa.Table:
    """Removed spans (r), units whose bytes are asked for (a), units that are asked for if their
    leading bytes go on in another bucket (b), and the bucket's first and last leading bytes (m)."""
    by = {k: _gathered([p for kind, p in zip(kinds, payloads) if kind == k]) for k in "ru"}
    gone, more = [], []
    if (r := by["r"]) is not None:
        gone.append((r["row"], r["start"], r["end"]))
    if (u := by["u"]) is not None:
        order = multikey_order(*(u[c] for c in WORDS))
        u = {c: x[order] for c, x in u.items()}
        new_key, new_run = _first_of(u["first"], u["second"]), _first_of(*(u[c] for c in WORDS))
        key = np.cumsum(new_key) - 1
        copy = u["doc"] > _least(u["doc"], new_run)
        runs = np.bincount(key[new_run])[key]
        end = u["start"].astype(np.int64) + u["size"]
        gone.append((u["row"][copy], u["start"][copy], end[copy]))
        edge = (key == 0) | (key == key[-1])

        def rows(kind, at):
            return _table(kind, u["row"][at], u["start"][at], end[at], doc_id=u["doc"][at], lead=u["lead"][at], first=u["first"][at].view(np.int64), second=u["second"][at].view(np.int64), bucket=np.full(at.sum(), bucket))

        more = [rows("a", ~copy & (runs > 1)), rows("b", ~copy & (runs == 1) & edge), rows("m", new_key & edge)]
    return pa.concat_tables([_rows_merged(*map(np.concatenate, zip(*gone)))] + more)


def removed_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, end): byte spans, ends exclusive, that cover what is to be removed.

    ``texts`` has row (a number of its own for each row), doc_id (not null) and packed (the
    compressed bytes).  Spans may overlap; only strings of documents with smaller ids count.
    """
    n_docs, n_bytes = texts.agg(F.count("*"), F.sum("n_bytes")).first()
    buckets = max(1, -(-(n_bytes or 0) // BUCKET_BYTES))
    cuts = _splitters(texts, n_docs, buckets, length)

    def cut(batch: pa.RecordBatch):
        for part, data in _texts(batch, 2):
            row, doc = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            got = list(_map_units(doc, row, data, length, cuts))
            yield {c: [g[i] for g in got] for i, c in enumerate(("bucket", "kind", "payload"))}

    def settle(messages: pa.Table) -> pa.Table:
        done = _settle_bucket(messages["bucket"][0].as_py(), messages["kind"].to_pylist(), messages["payload"].to_pylist())
        free_memory()
        return done

    messages = arrow_batches(texts.select("row", "doc_id", "packed"), cut, "bucket int, kind string, payload binary")
    step = written(messages.groupBy("bucket").applyInArrow(settle, _STEP))

    # across boundaries: leading bytes that stand at the edge of several buckets
    over = step.where("kind = 'm'").groupBy("first", "second").agg(F.countDistinct("bucket").alias("n")).where("n > 1").select("first", "second")
    asked = step.where("kind = 'a'").unionByName(step.where("kind = 'b'").join(over, ["first", "second"], "left_semi").select(*step.columns))

    # fetch their bytes, compare window by window
    parts = max(1, -(-asked.count() // BUCKET_REQUESTS))
    often = asked.groupBy("first", "second").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_REQUESTS).select("first").toArrow()
    often = np.unique(often.column("first").to_numpy())  # at most one in BUCKET_REQUESTS requests
    per = asked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("start", "end", "lead", "first", "second")).alias("asked"))

    def fetch(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor().decompress
        row, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        offsets, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values
        asked = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "lead", "first", "second")}
        sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) * 3 + np.diff(offsets) * 128
        for at, to in _slices(sizes, HELD):
            own = slice(offsets[at], offsets[to])
            count = np.diff(offsets[at : to + 1])
            data = []
            for i in range(at, to):
                text = unpack(batch.column(2)[i].as_py())
                data += [text[a:b] for a, b in zip(asked["start"][offsets[i] : offsets[i + 1]].tolist(), asked["end"][offsets[i] : offsets[i + 1]].tolist())]
            u = {
                "row": np.repeat(row[at:to], count), "doc": np.repeat(doc[at:to], count), "start": asked["start"][own], "size": asked["end"][own] - asked["start"][own],
                "lead": asked["lead"][own].astype(np.int64), "first": asked["first"][own].view(_U), "second": asked["second"][own].view(_U),
            }
            hot = np.isin(u["first"].view(np.int64), often)
            where = np.where(hot, -1, ((u["first"] ^ u["second"] * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93) >> _U(33)).astype(np.int64) % parts)
            out: dict = {"part": [], "kind": [], "payload": [], "data": []}
            for b in np.unique(where):
                i = np.flatnonzero(where == b)
                raw = b"".join(data[j] for j in i.tolist())
                v = {c: x[i] for c, x in u.items()}
                if b >= 0:
                    out["part"].append(int(b)), out["kind"].append("u"), out["payload"].append(_pack(**v)), out["data"].append(zstandard.ZstdCompressor(level=3).compress(raw))
                    continue
                # what goes already by this batch alone goes by its row; of a window that very many
                # contexts share, a batch sends on one document
                w, gone = _ranked_windows(_windows(raw, v["start"], v["size"], v["lead"], length, doc=v["doc"], row=v["row"], first=v["first"]))
                settled = {"row": w["row"][gone], "start": w["start"][gone], "end": w["start"][gone] + length}
                by_row = settled["row"] % parts
                for f in np.unique(by_row):
                    out["part"].append(int(f)), out["kind"].append("d"), out["payload"].append(_pack(**{c: x[by_row == f] for c, x in settled.items()})), out["data"].append(b"")
                w = {c: x[~gone] for c, x in w.items()}
                far = (w["window"] >> _U(33)).astype(np.int64) % parts
                for f in np.unique(far):
                    out["part"].append(int(f)), out["kind"].append("w"), out["payload"].append(_pack(**{c: x[far == f] for c, x in w.items()})), out["data"].append(b"")
            yield out

    def compare(messages: pa.Table) -> pa.Table:
        kinds, payloads, packed = (messages[c].to_pylist() for c in ("kind", "payload", "data"))
        w = [_unpack(p) for k, p in zip(kinds, payloads) if k == "w"]
        if (u := _gathered([p for k, p in zip(kinds, payloads) if k == "u"])) is not None:
            data = b"".join(zstandard.ZstdDecompressor().decompress(d) for k, d in zip(kinds, packed) if k == "u")
            w.append(_windows(data, u["start"], u["size"], u["lead"], length, doc=u["doc"], row=u["row"], first=u["first"]))
        d = [_unpack(p) for k, p in zip(kinds, payloads) if k == "d"]
        done = [[x[c] for c in ("row", "start", "end")] for x in d]
        if w:
            done.append(_settle_windows({c: np.concatenate([x[c] for x in w]) for c in w[0]}, length))
        done = _rows_merged(*(np.concatenate(x) for x in zip(*done))).select(["row", "start", "end"])
        free_memory()
        return done

    fetched = arrow_batches(texts.select("row", "packed").join(per, "row").select("row", "doc_id", "packed", "asked"), fetch, "part int, kind string, payload binary, data binary")
    more = fetched.groupBy("part").applyInArrow(compare, "row long, start long, end long")
    return step.where("kind = 'r'").select("row", "start", "end").unionByName(more)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, packed), written out: every row under a number of its own, with its
    bytes compressed for cheaper shuffles."""

    def fn(batch: pa.RecordBatch):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for at, to in _slices(sizes, HELD):
            part = batch.slice(at, to - at)
            yield {"row": part.column(0), "doc_id": part.column(1), "n_bytes": sizes[at:to], "packed": [squeeze(t) for t in part.column(2).to_pylist()]}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8(F.col("text")).alias("data"))
    return written(arrow_batches(rows, fn, "row long, doc_id long, n_bytes long, packed binary"))


def dedup_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, kept (bytes), spans (array of removed
    start, end).

    Texts are taken as UTF-8 bytes, whole; matches never cross documents and are judged on the
    input.  Null or empty texts have no bytes; rows without a doc_id are left as they are and
    are nobody's source; rows that repeat an id are the same document and do not remove each
    other; an empty table gives no rows; other columns are ignored.
    """
    texts = numbered(docs)
    spans = removed_spans(texts.where("doc_id is not null"), length).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = texts.join(spans, "row", "left").select("doc_id", "packed", "spans")

    def cut(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor().decompress
        lists = batch.column(2)
        count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(lists)
        first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        at_span = np.concatenate(([0], np.cumsum(count)))
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) * 3
        for at, to in _slices(sizes + count * (HELD // HELD_SPANS), HELD):
            own = slice(at_span[at], at_span[to])
            row, s, e = _merged(np.repeat(np.arange(to - at), count[at:to]), first[own], last[own]) if own.stop > own.start else (np.zeros(0, np.int64),) * 3
            bounds = np.searchsorted(row, np.arange(to - at + 1))
            n_bytes, kept = [], []
            for i in range(to - at):
                text, parts, done = unpack(batch.column(1)[at + i].as_py()), [], 0
                for a, b in zip(s[bounds[i] : bounds[i + 1]].tolist(), e[bounds[i] : bounds[i + 1]].tolist()):
                    parts.append(text[done:a])
                    done = b
                kept.append(b"".join(parts) + text[done:])
                n_bytes.append(len(text))
            gone = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"])
            yield {"doc_id": batch.column(0).slice(at, to - at), "n_bytes": n_bytes, "kept": kept, "spans": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), gone)}

    return arrow_batches(whole, cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
