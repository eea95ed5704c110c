"""Conversation structure repair by lazy weighted determinisation.

The grammar of role initials, ``(s?(ua)+)?``, has four states.  What the rest of a conversation
costs from each of them is a vector; less its minimum it is a state of a deterministic automaton,
of which there are few, made as they are met and kept in a transition table.  Costs are a scan of
that table from the last row to the first; the cheapest edits are read off the way back, along the
arcs that are tight, taking the least letter and every grammar state that it leaves open.

Rows are classified in Spark, in ranges that may cut a conversation anywhere; a conversation comes
together as one character a row, as its edits do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map, table, written
from hopwise.llm.turns import joined_sha256, numbered

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows whose symbols are gathered at a time.
BLOCK_ROWS = 4096
_EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_BLANKS = " \t\n\x0b\x0c\r"

#: Symbols of rows: the initial (s, u, a, other) and the fault, in this order from "A" on.
INITIALS, FAULTS = ("s", "u", "a"), ("ok", "blank", "duplicate", "truncated")

#: The grammar: start, after s, after u, after a; where it may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_FAR = 1 << 40


class Repairs:
    """The automaton with its table; one a worker."""

    def __init__(self):
        self.vectors, self.ids = [], {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.ways: dict[tuple[frozenset, int, str], tuple[str, frozenset]] = {}
        self.end, _ = self._state(self._inserts([0 if q in _ENDS else _FAR for q in range(4)]))

    def _state(self, vector: list[int]) -> tuple[int, int]:
        least = min(vector)
        own = tuple(v - least for v in vector)
        if own not in self.ids:
            self.ids[own] = len(self.vectors)
            self.vectors.append(own)
        return self.ids[own], least

    @staticmethod
    def _inserts(vector: list[int]) -> list[int]:
        for _ in vector:
            vector = [min([v, *(INSERT + vector[t] for r, t in _NEXT[q].items() if r != "s")]) for q, v in enumerate(vector)]
        return vector

    @staticmethod
    def _edits(symbol: str, q: int) -> Iterator[tuple[str, int, int]]:
        """(letter, next grammar state, cost) of the edits that take the row from state ``q``."""
        fault, initial = divmod(ord(symbol) - 65, 4)
        yield "D", q, DELETE
        if FAULTS[fault] not in ("blank", "duplicate"):
            more = TRUNCATED if FAULTS[fault] == "truncated" else 0
            for role, t in _NEXT[q].items():
                if initial < 3 and role == INITIALS[initial]:
                    yield "K", t, more
                if role != "s":
                    yield "R", t, REROLE + more

    def _step(self, state: int, symbol: str) -> tuple[int, int]:
        """The state before the row, and what the normalised costs rise by."""
        if (state, symbol) not in self.steps:
            after = self.vectors[state]
            vector = [min(cost + after[t] for _, t, cost in self._edits(symbol, q)) for q in range(4)]
            self.steps[state, symbol] = self._state(self._inserts(vector))
        return self.steps[state, symbol]

    def _way(self, here: frozenset, state: int, symbol: str) -> tuple[str, frozenset]:
        """The least letters up to and with the row's own, and the grammar states they lead to;
        ``state`` stands behind the row, no symbol stands for the end of the rows."""
        if (here, state, symbol) not in self.ways:
            after = self.vectors[state]
            before, rise = self._step(state, symbol) if symbol else (state, 0)
            now, letters, at = self.vectors[before], "", here
            while letters[-1:] in ("", "I") if symbol else not any(q in _ENDS and now[q] == 0 for q in at):
                tight: dict[str, set[int]] = {}
                for q in at:
                    for letter, t, cost in self._edits(symbol, q) if symbol else ():
                        if cost + after[t] == now[q] + rise:
                            tight.setdefault(letter, set()).add(t)
                    for role, t in _NEXT[q].items():
                        if role != "s" and INSERT + now[t] == now[q]:
                            tight.setdefault("I", set()).add(t)
                letter = min(tight)
                letters, at = letters + letter, frozenset(tight[letter])
            self.ways[here, state, symbol] = letters, at
        return self.ways[here, state, symbol]

    def repair(self, symbols: str) -> tuple[int, str]:
        """The least cost, and the least string of edits that has it."""
        states, total = np.empty(len(symbols) + 1, np.int32), 0
        states[-1] = state = self.end
        for i in range(len(symbols) - 1, -1, -1):
            state, rise = self._step(state, symbols[i])
            states[i] = state
            total += rise
        letters, here = [], frozenset([0])
        for i, symbol in enumerate(symbols):
            own, here = self._way(here, int(states[i + 1]), symbol)
            letters.append(own)
        letters.append(self._way(here, self.end, "")[0])
        return total + self.vectors[state][0], "".join(letters)


def count_illegal(symbols: str) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    initials = [(ord(c) - 65) % 4 for c in symbols]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:]))


def output_rows(audit: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Of the rows that an audit leaves: the place of their row (0: inserted), their own place in
    the result, and the role that is written over theirs (None: kept)."""
    letters = np.frombuffer(audit.encode(), np.uint8)
    is_row = letters != ord("I")
    stays = letters != ord("D")
    place = np.where(is_row, np.cumsum(is_row), 0)[stays]
    letters = letters[stays]
    seq = np.arange(1, len(letters) + 1)
    # an odd number of rows starts with the system's
    user = (seq - len(letters)) % 2 == 1
    return place, seq, [None if x == ord("K") else "user" if u else "assistant" for x, u in zip(letters.tolist(), user.tolist())]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows damaged by crc32 of ``conv_id:turn`` mod 20 (0 drops
    the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets the role user).  Nulls in
    role, text and the hashed string are one space."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("damage")
    ).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("times"))


def _same_rows(x: DataFrame, y: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which conv_id and turn may be null; the right side's keys go."""
    on = [x[k].eqNullSafe(y[k]) for k in keys]
    return x.join(y, on, how).select(x["*"], *[y[c] for c in y.columns if c not in keys])


def _classified(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, p, symbol): every row with its first fault."""
    bare = F.rtrim("text", trim=F.lit(_BLANKS))
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    light = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), fault.alias("fault"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_"))
    placed = written(numbered(light.drop("_"), "conv_id", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]))
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("p").alias("p")).select("conv_id", "p", F.lit(True).alias("is_first"))
    placed = _same_rows(placed, firsts, ["conv_id", "p"], "left")
    fault = F.when((F.col("fault") != 1) & F.col("is_first").isNull(), 2).otherwise(F.col("fault"))
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    return written(placed.select("conv_id", "turn", "role", "digest", "p", F.char(65 + 4 * fault + initial).alias("symbol")))


def _joined(rows: DataFrame, by: list[Column], order: str, value: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda s: s[value]), "").alias(value))


def _repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of classified rows."""
    block = F.floor((F.col("p") - 1) / BLOCK_ROWS).alias("block")
    symbols = _joined(_joined(rows, ["conv_id", block], "p", "symbol"), ["conv_id"], "block", "symbol")
    automaton: list[Repairs] = []

    def fn(batch: pa.RecordBatch) -> dict:
        automaton.extend([] if automaton else [Repairs()])
        every = batch.column(1).to_pylist()
        found = [automaton[0].repair(s) for s in every]
        faults = {name: [sum(map(s.count, map(chr, range(65 + 4 * k, 69 + 4 * k)))) for s in every] for k, name in enumerate(FAULTS)}
        return {"conv_id": batch.column(0), **faults, "illegal": list(map(count_illegal, every)), "cost": [c for c, _ in found], "audit": [a for _, a in found]}

    return written(arrow_map(symbols, fn, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))


def _pieces(rows: DataFrame, placed: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, seq, piece): the rows that the audits leave, as ``role:text``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit in zip(*(c.to_pylist() for c in batch.columns)):
                p, seq, role = output_rows(audit)
                for at in range(0, len(p), 10_000):
                    cut = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv] * len(p[cut]), pa.int64()), pa.array(p[cut], pa.int64()), pa.array(seq[cut], pa.int64()), pa.array(role[cut], pa.string())], ["conv_id", "p", "seq", "new_role"]
                    )

    left = written(repairs.select("conv_id", "audit").mapInArrow(each, "conv_id long, p long, seq long, new_role string"))
    named = placed.select("conv_id", "p", "turn", "role", "digest")
    named = _same_rows(left.where("p > 0"), named, ["conv_id", "p"], "inner")
    texts = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "text")
    whole = _same_rows(named, texts, ["conv_id", "turn", "role", "digest"], "inner")
    whole = whole.select("conv_id", "seq", F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text").alias("piece"))
    return whole.unionByName(left.where("p = 0").select("conv_id", "seq", F.concat("new_role", F.lit(":")).alias("piece")))


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation, and
    the repaired rows (conv_id, seq, piece) with ``role:text`` as the piece.

    ``rows`` (conv_id, turn, role, text, times) are what is repaired, ``conversations`` damaged if
    not given.  Rows of one turn go by role, then by the text's digest; equal rows are duplicates.
    Rows without a conv_id are one conversation.  A conversation without rows has zeros and an empty
    audit, as has any whose rows are all deleted but for its cost.
    """
    rows = damaged(conversations) if rows is None else rows
    placed = _classified(rows)
    repairs = _repaired(placed)
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    wide = F.col("turn").cast("decimal(20,0)")
    gaps = turns.agg((F.max(wide) - F.min(wide) + 1 - F.count("turn")).cast("long").alias("gaps"))
    found = _same_rows(conversations.select(F.col("conv_id").cast("long")).distinct(), repairs, ["conv_id"], "left")
    found = _same_rows(found, gaps, ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit")), _pieces(rows, placed, repairs)


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    found, pieces = repair(table(spark, sf_dir, "conversations"))
    digests = joined_sha256(pieces, ["conv_id"], "seq", "piece", b"\n").withColumnRenamed("sha256", "repaired_sha256")
    return _same_rows(found, digests, ["conv_id"], "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA256)))
