"""The keyed verdict fold: a session's hops in order, each judged by the state before it.

Everything that does not depend on earlier verdicts is computed in columns beforehand; the fold
itself carries what feeds back through the score: sensitivity, suspended channels, the risk of
the hops that items come from, and which keys a user-designated source has made known.  It runs
over partitions sorted by (session, hop) as a stream of batches, so a session of any length needs
no group in memory.  A hop and the keys that it asks for are rows of one table from the prefix
windows to the fold: hops are read and taken apart once, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import text as T
from hopwise.functions import vocabulary as V
from hopwise.operators import prefix, provenance
from hopwise.sources.hops import dealt

SIGNALS = ("instruction", "drift", "provenance", "behaviour")
_ORIGIN = "array<struct<key:string,hop:int,source:string>>"
#: What the fold adds to the columns that it carries.
_JUDGED = f"model_trust double, provenance double, sensitivity double, trust double, suspended boolean, matches {_ORIGIN}, reused {_ORIGIN}, given array<string>"
_ORIGINS = pa.list_(pa.struct([("key", pa.string()), ("hop", pa.int32()), ("source", pa.string())]))
_JUDGED_TYPES = (*[pa.float64()] * 4, pa.bool_(), _ORIGINS, _ORIGINS, pa.list_(pa.string()))
CARRIED = ("session_id", "hop", "role", "channel", "instruction", "drift", "behaviour")


class _Hop(NamedTuple):
    """What ``Session.judge`` reads of a hop."""

    hop: int
    source: str
    role: str
    channel: str
    instruction: float
    drift: float
    behaviour: float
    model: float
    echo: int
    outbound: bool
    unasked: bool
    acts: bool
    designates: list | None


def _there(column: str) -> str:
    """What a hop's column is called beside those of a key."""
    return f"{column}_" if column in provenance.KEYED else column


def rule_trust(instruction: Column) -> Column:
    """The rule detector: trust in a hop by its instruction risk alone."""
    return 1.0 - 0.9 * instruction


def prepared(hops: DataFrame, *more: str, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows of hops (``own``) and of the keys that each asks for, with all that the fold needs and is
    fixed before it, and the columns ``more``.  Trust of a hop by itself is that of the rule
    detector, or the least that ``scorer`` gives to a chunk of it."""
    rows = provenance.with_items(hops).drop("canonical").withColumn("_own", F.lit(True))
    if scorer is not None:
        scores = chunk_scored(hops, scorer).select("session_id", "hop", F.coalesce("model_trust", F.lit(1.0)).alias("_score"))
        rows = rows.unionByName(scores, allowMissingColumns=True)
    rows = dealt(rows, hops)
    if scorer is not None:  # scores come as rows beside the hops, so wide rows are dealt once
        rows = rows.withColumn("_score", F.max("_score").over(Window.partitionBy("session_id", "hop"))).where("_own")
    # behaviour first: the windows after it are of one order
    rows = prefix.with_echo(prefix.with_drift(prefix.with_designation(prefix.with_prefix(prefix.with_behaviour(rows)))))
    rows = rows.withColumn("model", rule_trust(F.col("instruction")) if scorer is None else F.col("_score"))
    acts = ((F.col("role") == "assistant") & (F.col("action_text") != "")) | (F.col("role") == "memory_write")
    rows = rows.withColumns(
        {
            "channel": F.concat("source", F.lit("->"), "target"),
            "unasked": F.coalesce((F.col("claims") > 0) & F.col("verb_unasked"), F.lit(False)),
            "acts": acts,
            "designates": F.when(F.col("designated"), F.col("known")),
        }
    )
    entries = provenance.with_entries(rows, itself=True)
    own = F.col("key").isNull()
    carried = [c for c in dict.fromkeys([*CARRIED, "model", "echo", "outbound", "unasked", "acts", "designates", *more]) if c not in ("session_id", "hop", "source")]
    entries = entries.select("session_id", "hop", "source", "key", "item", "exact", "_kind", own.alias("own"), *[F.when(own, F.col(c)).alias(c) for c in map(_there, carried)])
    met = provenance.with_known(entries).where(f"own or ({provenance._MET})")
    return met.drop("designated")


class Session:
    """The state of one session between two hops."""

    def __init__(self, signals=SIGNALS):
        self.signals = signals
        self.sensitivity, self.suspended = 0.0, set()
        #: risk of every hop that brought data; keys that a designated hop without risk had; and
        #: the first (hop, source) of those that one with risk had
        self.risks, self.safe, self.doubtful = {}, set(), {}

    def _trusted(self, key) -> bool:
        return key["supplied"] or key["key"] in self.safe

    def _origin(self, key) -> tuple | None:
        plain, doubtful = key["plain"], self.doubtful.get(key["key"])
        return min((o for o in ((plain["hop"], plain["source"]) if plain else None, doubtful) if o), default=None)

    def _tainted(self, keys) -> dict[str, tuple]:
        """Keys of tainted items with their origins; if there are none, of fragments."""
        for exact in (True, False):
            own = set() if exact else {k["item"] for k in keys if k["exact"] and self._trusted(k)}
            found = {k["key"]: self._origin(k) for k in keys if bool(k["exact"]) == exact and k["item"] not in own and not self._trusted(k)}
            if found := {k: o for k, o in sorted(found.items()) if o is not None}:
                return found
        return {}

    def release(self, channels) -> None:
        """Channels that somebody has let go on are no longer suspended."""
        self.suspended.difference_update(channels)

    def judge(self, row, keys: list[dict]) -> tuple:
        """(model trust, provenance, sensitivity before, trust, suspended, matches, reused, given) of
        the next hop, which asks for ``keys``; then fold it in."""
        before, on = self.sensitivity, self.signals
        tainted = self._tainted(keys)
        given = sorted({k["item"] for k in keys if k["exact"] and self._trusted(k)})
        model, reuse, matches, shut = None, 0.0, {}, False
        if row.role in V.TRUSTED_ROLES:
            trust = 1.0
        elif row.channel in self.suspended:
            trust, shut = 0.0, True
        else:
            model = row.model
            if "provenance" in on:
                if row.acts and tainted:
                    matches = tainted
                    risky = any(round(self.risks[hop], 3) >= 0.25 for hop, _ in matches.values())
                    reuse = (1.0 if risky else 0.9 if row.outbound else 0.5) * (0.6 if row.role == "memory_write" else 1.0)
                if row.echo > 0:
                    reuse = max(reuse, 0.9)
                elif row.unasked and not given:
                    reuse = max(reuse, 0.75)
            survive = model
            for name, risk in (("instruction", row.instruction), ("drift", row.drift), ("provenance", reuse), ("behaviour", row.behaviour)):
                if name in on:
                    survive *= 1.0 - V.WEIGHTS[name] * risk
            trust = 1.0 - min(1.0, (1.0 - survive) * (1.0 + before))
        self._commit(row, trust)
        return model, reuse, before, trust, shut, _listed(matches), _listed(tainted), given

    def _commit(self, row, trust: float) -> None:
        if trust < V.QUARANTINE_AT:
            self.suspended.add(row.channel)
        if trust < V.PASS_AT:
            self.sensitivity = min(V.SENSITIVITY_CAP, self.sensitivity + V.SENSITIVITY_STEP)
        if row.role in V.UNTRUSTED_ROLES:
            self.risks[row.hop] = 1.0 - trust
            for key in () if row.designates is None else row.designates:
                if 1.0 - trust < 0.25:
                    self.safe.add(key)
                else:
                    self.doubtful.setdefault(key, (row.hop, row.source))


def _listed(origins: dict[str, tuple]) -> list[dict]:
    return [{"key": k, "hop": hop, "source": source} for k, (hop, source) in origins.items()]


def _segmented(hops: DataFrame, releases: DataFrame | None, resets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Hops and releases with (session_id, resets so far) as their session_id."""
    marks = resets.select("session_id", "hop", F.lit(0).alias("_place"))
    if releases is not None:
        marks = marks.unionByName(releases.select("session_id", "hop", F.lit(1).alias("_place"), F.col("channel").alias("_channel")), allowMissingColumns=True)
    rows = hops.withColumn("_place", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    so_far = F.sum((F.col("_place") == 0).cast("int")).over(Window.partitionBy("session_id").orderBy("hop", "_place"))
    rows = rows.withColumn("_segment", so_far).withColumn("session_id", F.struct("session_id", "_segment"))
    gone = None if releases is None else rows.where("_place = 1").select("session_id", "hop", F.col("_channel").alias("channel"))
    return rows.where("_place = 2").select(hops.columns), gone


def verdicts(
    hops: DataFrame, signals: tuple[str, ...] = SIGNALS, more: tuple[str, ...] = (), releases: DataFrame | None = None, scorer: Callable[[Column, Column], Column] | None = None,
    resets: DataFrame | None = None,
) -> DataFrame:
    """A verdict for every hop: signals, trust, tier, severity, delivered, and the columns ``more``.

    ``releases`` (session_id, hop, channel) name channels that are released before a hop is judged.
    ``matches`` are the keys that decided provenance risk; ``reused`` all tainted keys and
    ``given`` all user-supplied items of a hop, whatever its role.  Sessions are dealt out by key
    and sorted inside the partition; ``signals`` switches the fused signals off one by one (model
    only: none); ``scorer`` takes the place of the rule detector.  ``resets`` (session_id, hop) name
    hops before which a session forgets all it knows.
    """
    if resets is not None:
        hops, releases = _segmented(hops, releases, resets)
        return verdicts(hops, signals, more, releases, scorer).withColumn("session_id", F.col("session_id.session_id"))
    rows = prepared(hops, *more, scorer=scorer).withColumn("released", F.lit(None).cast("string"))
    if releases is not None:
        gone = releases.select("session_id", "hop", F.lit(False).alias("own"), F.col("channel").alias("released"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    carried = list(dict.fromkeys([*CARRIED, *more]))
    there = {c: _there(c) for c in carried}
    names = [c.split()[0] for c in _JUDGED.split(", ")]
    kinds = dict(rows.dtypes)
    rows = rows.withColumns({"plain_hop": F.col("plain.hop"), "plain_source": F.col("plain.source")}).drop("plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, keys = None, None, []
        for batch in batches:
            out = []
            asked = zip(*(batch.column(c).to_pylist() for c in ("session_id", "own", "released", "key", "item", "exact", "supplied", "plain_hop", "plain_source")))
            own_rows = batch.filter(batch.column("own"))
            hops = map(_Hop._make, zip(*(own_rows.column(c).to_pylist() for c in _Hop._fields)))
            for session, own, released, key, item, exact, supplied, hop, source in asked:
                if state is None or session != at:
                    at, state, keys = session, Session(signals), []
                if own:
                    out.append(state.judge(next(hops), keys))
                    keys = []
                elif released is not None:
                    state.release([released])
                else:
                    keys.append({"key": key, "item": item, "exact": exact, "supplied": supplied, "plain": None if hop is None else {"hop": hop, "source": source}})
            if out:
                found = [pa.array(values, kind) for values, kind in zip(zip(*out), _JUDGED_TYPES)]
                yield pa.RecordBatch.from_arrays([*(own_rows.column(c) for c in there.values()), *found], names=[*carried, *names])

    judged = dealt(rows, hops).sortWithinPartitions("session_id", "hop", "own", "item", "key", "exact")
    judged = judged.mapInArrow(run, ", ".join([*[f"{c} {kinds[there[c]]}" for c in carried], _JUDGED]))
    tier = R.tier(F.col("trust"))
    return judged.withColumns({"tier": tier, "severity": R.severity(tier), "delivered": tier.isin("PASS", "FLAG")})


def reasons() -> Column:
    """Why a verdict is what it is, in words, from the columns of ``verdicts`` and its input."""
    fused = ~R.trusted(F.col("role")) & ~F.col("suspended")
    agent = F.col("source")
    tool = F.concat(F.lit("'"), "tool_name", F.lit("'"))
    after = " after untrusted content claimed an exemption"
    found = F.transform("matches", lambda m: F.concat(F.lit("'"), m["key"], F.lit("' first appeared in untrusted hop "), m["hop"], F.lit(" ("), m["source"], F.lit(") and now reaches an action")))
    claimed = fused & (F.col("claims") > 0) & F.col("mutating")
    waiver = F.concat(F.lit("action uses waiver wording ('"), "echo", F.lit("' term(s))" + after))
    unasked = F.col("verb_unasked") & (F.size("given") == 0)
    outside = F.when(F.col("outbound"), F.concat(agent, F.lit(" used outbound tool "), tool, F.lit(" outside its baseline"))).otherwise(F.concat(agent, F.lit(" used new tool "), tool))
    first = F.array(
        F.when(F.col("suspended"), F.concat(F.lit("channel "), "channel", F.lit(" is suspended after an earlier BLOCK"))),
        F.when(F.col("model_trust") < V.PASS_AT, F.format_string("classifier trust %.2f", "model_trust")),
        F.when(fused & (F.col("cue_count") > 0), F.concat(F.lit("instruction-like text in a data channel ("), "cue_count", F.lit(" cue(s))"))),
    )
    last = F.array(
        F.when(claimed & (F.col("echo") > 0), waiver).when(claimed & unasked, F.concat(tool, F.lit(" was never requested by the user," + after))),
        F.when(fused & F.col("new_tool"), outside).when(fused & F.col("long_message"), F.concat(agent, F.lit(" message 4x longer than its usual"))),
        F.when(fused & (F.col("sensitivity") > 0), F.format_string("session sensitivity +%.2f after earlier flags", "sensitivity")),
    )
    return F.array_compact(F.concat(first, found, last))


def chunk_scored(hops: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """(session_id, hop, n_chunks, model_trust, worst): the least trust that ``scorer`` gives to the
    role and text of any chunk of a hop, and the first chunk that has it; null for trusted roles."""
    rows = hops.select("session_id", "hop", "role", "event_text", F.posexplode(T.chunk_spans(F.length("event_text"))).alias("chunk", "s"))
    piece = F.substring("event_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = rows.select("session_id", "hop", "chunk", F.when(~R.trusted(F.col("role")), scorer(F.col("role"), piece)).alias("t"))
    return rows.groupBy("session_id", "hop").agg(F.count("*").cast("int").alias("n_chunks"), F.min("t").alias("model_trust"), F.min_by("chunk", F.struct("t", "chunk")).alias("worst"))
