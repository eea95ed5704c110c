"""The verdict fold on a stream: keyed state in Structured Streaming.

Text work is done in columns before the shuffle; the keyed operator carries a session's state
and judges events in hop order inside each micro-batch.  What is known of keys lies in pages of
about 64 in a map of the state store, of which a micro-batch reads and writes only those it meets; goal, counts and
the fold's own Session are one small value, and the last 64 hops a list.  State expires after an
hour without events.  An event that comes with a hop number already judged is late and is dropped,
as verdicts are never revised.

Controls are rows of the same stream: ``release`` lets a channel go on, ``reset`` clears all that a
session's state holds, both before the hop that they name, or at once if that has been judged.
With event time, hops wait in the state until the watermark has passed them, so files may come in
any order; what comes later still is dropped and can be told by ``late_hops``.  There a session
expires an hour of event time after its last hop.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hopwise.functions import risk as R
from hopwise.functions import text as T
from hopwise.functions import vocabulary as V
from hopwise.operators import provenance
from hopwise.operators.fold import SIGNALS, Session

VERDICT = "session_id long, hop int, role string, channel string, tier string, trust double, provenance double, drift double, behaviour double, instruction double, suspended boolean, matches string, history string"
#: A control: before which hop it acts, what it does (release or reset), and for a release the channel.
CONTROL = "session_id long, hop int, control string, channel string"
TTL_MS = 3_600_000
_PLAIN_KEY = re.compile("[A-Za-z0-9]+")


def stateless(hops: DataFrame, *more: str) -> DataFrame:
    """Everything about a hop that needs no other hop, and the columns ``more``."""
    role, tool, action = F.col("role"), F.col("tool_name"), F.col("action_text")
    rows = provenance.with_items(hops)
    words = F.create_map(*[x for v in dict.fromkeys(V.MUTATING_VERBS) for x in (F.lit(v), F.array(*map(F.lit, V.words_for(v))))])
    none = F.array().cast("array<string>")
    stems = F.filter(F.array(*map(F.lit, V.CLAIM_STEMS)), lambda s: F.contains(F.lower(action), s))
    return rows.select(
        "session_id", "hop", "role", "source", F.concat("source", F.lit("->"), "target").alias("channel"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce(tool, F.lit("")).alias("tool_name"), action.alias("action"),
        R.instruction_risk(role, F.col("data_text")).alias("instruction"), R.authority_claims(role, F.col("data_text")).alias("own_claims"), R.is_mutating(role, tool).alias("mutating"), R.is_outbound(tool).alias("outbound"),
        F.coalesce(words[R.mutating_verb(tool)], none).alias("words"), stems.alias("stems"), R.tokens(action).alias("tokens"), "items",
        "known", F.transform("items", lambda i: F.filter(T.item_parts(i), lambda k: F.length(k) >= 6)).alias("parts"),
        F.concat(T.call_strings(F.col("tool_call")), T.call_strings(F.col("tool_calls"))).alias("strings"), *more,
    )


#: Keys to a page, on average, and by how much each level of pages is wider than the one before.
_PAGE_KEYS, _WIDER = 64, 4


class _Keys:
    """What a session knows of its keys, in pages that are read from the store when first met and
    written back once.

    An entry tells whether a user or system hop had the key, its first plain untrusted hop with
    its source and risk, whether a designated hop without risk had it, and the first designated
    one with risk.  Reading an entry restores what the fold knows of it.

    The first keys of a session share one page.  When a level of pages is full, the next one has
    four times as many, so pages stay small and none is ever dealt anew: a key lies in the page of
    its hash on one of the levels, which are few.  A ``new`` session has nothing to read.
    """

    def __init__(self, fold: Session, stored=None, count: int = 0, new: bool = False):
        self.fold, self.stored, self.count, self.new = fold, stored, count, new
        self.pages, self.changed, self.restored = {}, set(), set()

    def _level(self) -> int:
        """The level that takes new keys."""
        level, room = 0, _PAGE_KEYS
        while self.count >= room:
            level, room = level + 1, room + _PAGE_KEYS * _WIDER ** (level + 1)
        return level

    def _page(self, key: str, level: int) -> tuple[str, dict]:
        name = f"{level}:{zlib.crc32(key.encode()) % _WIDER**level}"
        if name not in self.pages:
            there = self.stored is not None and not self.new and self.stored.containsKey((name,))
            self.pages[name] = json.loads(self.stored.getValue((name,))[0]) if there else {}
        return name, self.pages[name]

    def _found(self, key: str) -> tuple[str, list] | None:
        for level in range(self._level() + 1):
            name, page = self._page(key, level)
            if key in page:
                return name, page[key]
        return None

    def entry(self, key: str) -> list | None:
        found = self._found(key)
        if found is None:
            return None
        if key not in self.restored:
            self.restored.add(key)
            _, hop, _, risk, safe, doubt_hop, doubt_source, doubt_risk = found[1]
            self.fold.risks.update({h: r for h, r in ((hop, risk), (doubt_hop, doubt_risk)) if h is not None})
            if safe:
                self.fold.safe.add(key)
            if doubt_hop is not None:
                self.fold.doubtful[key] = (doubt_hop, doubt_source)
        return found[1]

    def learn(self, row, named: bool) -> None:
        """Take in a judged hop's keys."""
        trusted = row.role in V.TRUSTED_ROLES
        for key in row.known if trusted or row.role in V.UNTRUSTED_ROLES else ():
            e = self.entry(key) or [False, None, None, None, False, None, None, None]
            if trusted:
                e[0] = True
            elif named:
                e[4] = key in self.fold.safe
                if key in self.fold.doubtful:
                    e[5:] = [*self.fold.doubtful[key], self.fold.risks[self.fold.doubtful[key][0]]]
            elif e[1] is None:
                e[1:4] = [row.hop, row.source, self.fold.risks[row.hop]]
            self._put(key, e)

    def _put(self, key: str, entry: list) -> None:
        self.restored.add(key)
        found = self._found(key)
        name, page = (found[0], self.pages[found[0]]) if found else self._page(key, self._level())
        self.count += found is None
        page[key] = entry
        self.changed.add(name)

    def write(self) -> None:
        for name in sorted(self.changed):
            self.stored.updateValue((name,), (json.dumps(self.pages[name]),))


class SessionState:
    """One session between two events."""

    def __init__(self, saved: str | None = None, stored=None):
        """``saved`` is None for a session of which nothing is stored."""
        s = json.loads(saved) if saved else {}
        self.goal, self.claims, self.last, self.previous = s.get("goal"), s.get("claims", 0), s.get("last", 0), s.get("previous")
        self.agents = s.get("agents", {})  # by source: [messages, characters, tools]
        self.sizes = set(s.get("sizes", []))  # lengths of known keys of letters and digits
        self.fold = Session(SIGNALS)
        self.fold.sensitivity, self.fold.suspended = s.get("sensitivity", 0.0), set(s.get("suspended", []))
        self.keys = _Keys(self.fold, stored, s.get("keys", 0), new=saved is None)

    def saved(self) -> str:
        own = {c: getattr(self, c) for c in ("goal", "claims", "last", "previous", "agents")}
        return json.dumps(own | {"keys": self.keys.count, "sizes": sorted(self.sizes), "sensitivity": self.fold.sensitivity, "suspended": sorted(self.fold.suspended)})

    def _asked(self, row) -> list[dict]:
        out = []
        for item, parts in zip(row.items_, row.parts):
            sizes = [n for n in self.sizes if 6 <= n < len(item)] if _PLAIN_KEY.fullmatch(item) else []
            fragments = dict.fromkeys([*parts, *[x for n in sizes for x in (item[:n], item[-n:])]])
            for key, exact in [(item, True)] + [(f, False) for f in fragments]:
                if e := self.keys.entry(key):
                    plain = None if e[1] is None else {"hop": e[1], "source": e[2]}
                    out.append({"item": item, "key": key, "exact": exact, "supplied": e[0], "plain": plain})
        return out

    def judge(self, row) -> tuple:
        goal = (self.goal or "").lower()
        messages, characters, tools = self.agents.setdefault(row.source, [0, 0, []])
        known_agent = messages >= 3
        behaviour = max(
            (0.8 if row.outbound else 0.3) if known_agent and row.tool_name and row.tool_name not in tools else 0.0,
            0.3 if known_agent and 0 < 4 * characters < len(row.content) * messages else 0.0,
        )
        drifts = row.mutating and goal and row.action
        drift = R.drift_of(R.bag_cosine(re.findall("[a-z0-9]{3,}", goal), row.tokens)) if drifts else 0.0
        waived = row.mutating and self.claims
        named = row.role in V.UNTRUSTED_ROLES and goal and any(len(a) >= 4 and a.lower() in goal for a in self.previous or ())
        seen = SimpleNamespace(
            hop=row.hop, role=row.role, source=row.source, channel=row.channel, instruction=row.instruction, model=1.0 - 0.9 * row.instruction, drift=drift, behaviour=behaviour, outbound=row.outbound,
            echo=sum(s not in goal for s in row.stems) if waived else 0, unasked=bool(waived and not any(w in goal for w in row.words)),
            acts=(row.role == "assistant" and row.action != "") or row.role == "memory_write", designates=row.known if named else None,
        )
        _, reuse, _, trust, shut, matches, _, _ = self.fold.judge(seen, self._asked(row))
        self.keys.learn(row, bool(named))
        self.sizes.update(len(k) for k in row.known if _PLAIN_KEY.fullmatch(k))
        if row.role in V.TRUSTED_ROLES:
            self.goal = self.goal or row.content[: V.GOAL_CHARS] or None
        elif row.role in V.UNTRUSTED_ROLES:
            self.claims += row.own_claims
        self.agents[row.source] = [messages + 1, characters + len(row.content), tools + [row.tool_name] * bool(row.tool_name and row.tool_name not in tools)]
        self.previous = list(row.strings) if row.role == "assistant" else None
        self.last = row.hop
        tier = V.TIERS[sum(trust < t for t in (V.PASS_AT, V.FLAG_AT, V.QUARANTINE_AT))]
        return row.session_id, row.hop, row.role, row.channel, tier, trust, reuse, drift, behaviour, row.instruction, shut, ",".join(m["key"] for m in matches)


def history(past: list[tuple], recent: int = V.CONTEXT_HOPS, older: int = 3) -> list[int]:
    """Of the last hops (hop, role) those that stay in memory, as ``prefix.history`` has them."""
    head, tail = past[: max(0, len(past) - recent)], past[max(0, len(past) - recent) :]
    first = [h for h, role in past if role == "user"][:1]
    return sorted({*first, *[h for h, role in head if role in V.UNTRUSTED_ROLES][-older:], *[h for h, role in tail if role != "system"]})


class _Judge(StatefulProcessor):
    ttl: int | None = TTL_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "saved string", self.ttl)
        self.known = handle.getMapState("known", "page string", "entries string", self.ttl)
        self.hops = handle.getListState("hops", "hop int, role string", self.ttl)

    def forget(self) -> None:
        for state in (self.state, self.known, self.hops):
            state.clear()

    def judged(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Verdicts of a session's rows in hop order, a hop's controls first."""
        session = SessionState(self.state.get()[0] if self.state.exists() else None, self.known)
        past = list(self.hops.get()) if self.hops.exists() else []
        rows = rows.assign(_own=rows["control"].isna()).sort_values(["hop", "_own"], kind="stable").drop(columns="_own").rename(columns={"items": "items_"})
        out = []
        for row in rows.itertuples(index=False):
            if row.control == "release":
                session.fold.release([row.channel])
            elif row.control == "reset":
                self.forget()
                last, session, past = session.last, SessionState(None, self.known), []
                session.last = last
            elif row.hop > session.last:
                out.append((*session.judge(row), ",".join(map(str, history(past)))))
                past = [*past, (row.hop, row.role)][-V.WINDOW_HOPS :]
        session.keys.write()
        self.state.update((session.saved(),))
        if past:
            self.hops.put(past)
        return pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.judged(pd.concat(list(rows)))

    def close(self) -> None:
        pass


class _TimedJudge(_Judge):
    """Holds rows back until the watermark has passed their time; a timer an hour after the last
    hop clears the session."""

    ttl = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "at long", "rows binary")
        self.judged_at = handle.getValueState("judged_at", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, some in part.groupby(part["ts"].astype("datetime64[ms]").astype("int64")):
                held = [pickle.loads(self.waiting.getValue((at,))[0])] if self.waiting.containsKey((at,)) else []
                self.waiting.updateValue((at,), (pickle.dumps(pd.concat([*held, some])),))
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((at,)):
            rows = pickle.loads(self.waiting.getValue((at,))[0])
            self.waiting.removeKey((at,))
            self.judged_at.update((at,))
            self.handle.registerTimer(at + TTL_MS)
            yield self.judged(rows)
        elif self.judged_at.exists() and self.judged_at.get()[0] + TTL_MS <= at:
            self.forget()
            self.judged_at.clear()


def stream_verdicts(hops: DataFrame, controls: DataFrame | None = None, delay: str | None = None) -> DataFrame:
    """Verdicts of a streaming frame of hops, with ``controls`` (see ``CONTROL``) merged in.

    With a ``delay``, hops (and controls) have an event time ``ts`` and are judged in its order once
    the watermark, that far behind the latest, has passed them; hop numbers must rise with it.
    Needs the RocksDB state store provider; with the availableNow trigger and no delay also
    ``spark.sql.streaming.noDataMicroBatches.enabled=false``, as expiry runs on processing time.
    """
    time = ["ts"] if delay else []
    rows = stateless(hops, *time).withColumn("control", F.lit(None).cast("string"))
    if controls is not None:
        rows = rows.unionByName(controls.select("session_id", "hop", "control", "channel", *time), allowMissingColumns=True)
    if delay:
        return rows.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(_TimedJudge(), VERDICT, "Append", "EventTime")
    return rows.groupBy("session_id").transformWithStateInPandas(_Judge(), VERDICT, "Append", "ProcessingTime")


def late_hops(hops: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of all hops that came those that no verdict was given for: they were late."""
    return hops.join(verdicts.select("session_id", "hop"), ["session_id", "hop"], "left_anti")


def log_batches(log: str, counts: str):
    """A ``foreachBatch`` function that writes verdicts to the ``log`` and their number by tier to
    ``counts``, each in a folder of the batch that a repeated batch overwrites: what is run again
    after a failure between the two writes, or after them, leaves both as they should be."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        batch.groupBy("tier").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        batch.unpersist()

    return write


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stream(spark: SparkSession, hops: DataFrame, folder: str, controls: DataFrame | None = None) -> DataFrame:
    """Judge hops, with controls among them, as a stream of files below ``folder`` until all are done,
    and return the logged verdicts.  The stream runs in a session of its own, so the caller's
    settings stay as they are."""
    own = spark.newSession()
    for k, v in {"stateStore.providerClass": _ROCKS, "noDataMicroBatches.enabled": "false"}.items():
        own.conf.set(f"spark.sql.streaming.{k}", v)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def source(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return own.readStream.schema(rows.schema).parquet(f"{folder}/{name}")

    judged = stream_verdicts(source(hops, "hops"), None if controls is None else source(controls, "controls"))
    out = judged.writeStream.foreachBatch(log_batches(f"{folder}/verdicts", f"{folder}/counts")).option("checkpointLocation", f"{folder}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(VERDICT).parquet(f"{folder}/verdicts")
