"""Ordered prefix state of a session: window functions that read only earlier hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import vocabulary as V
from hopwise.functions.text import call_strings


def before(*by: str):
    return Window.partitionBy("session_id", *by).orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)


def with_prefix(hops: DataFrame) -> DataFrame:
    """Add goal, cues and claims so far, the previous hop's call, and each hop's own counts."""
    order = Window.partitionBy("session_id").orderBy("hop")
    named = F.when(R.trusted(F.col("role")) & (F.coalesce("content", F.lit("")) != ""), F.substring("content", 1, V.GOAL_CHARS))
    own = hops.withColumns(
        {
            "instruction": R.instruction_risk(F.col("role"), F.col("data_text")),
            "cue_count": R.cue_count(F.col("role"), F.col("data_text")),
            "own_claims": R.authority_claims(F.col("role"), F.col("data_text")),
            "mutating": R.is_mutating(F.col("role"), F.col("tool_name")),
            "outbound": R.is_outbound(F.col("tool_name")),
            "_named": named,
        }
    )
    return own.withColumns(
        {
            "goal": F.first("_named", ignorenulls=True).over(before()),
            "cues": F.coalesce(F.sum((F.col("instruction") > 0).cast("int")).over(before()), F.lit(0)).cast("int"),
            "claims": F.coalesce(F.sum("own_claims").over(before()), F.lit(0)).cast("int"),
            "previous_role": F.lag("role").over(order),
            "previous_call": F.lag("tool_call").over(order),
            "previous_calls": F.lag("tool_calls").over(order),
        }
    ).drop("_named")


def with_designation(hops: DataFrame) -> DataFrame:
    """``designated``: untrusted data that a call fetched whose target the user had named."""
    goal = F.lower("goal")
    strings = F.concat(call_strings(F.col("previous_call")), call_strings(F.col("previous_calls")))
    named = F.exists(strings, lambda a: (F.length(a) >= 4) & F.contains(goal, F.lower(a)))
    return hops.withColumn("designated", F.coalesce(R.untrusted(F.col("role")) & (F.col("previous_role") == "assistant") & named, F.lit(False)))


def with_behaviour(hops: DataFrame) -> DataFrame:
    """``behaviour`` risk of an agent: a tool it never used, or a message four times its mean."""
    agent, tool = before("source"), before("source", "tool_name")
    size = F.length(F.coalesce("content", F.lit("")))
    rows = hops.withColumns(
        {
            "agent_count": F.count("*").over(agent).cast("int"),
            "agent_chars": F.coalesce(F.sum(size).over(agent), F.lit(0)).cast("long"),
            "tool_seen": F.count("*").over(tool) > 0,
        }
    )
    new_tool = (F.coalesce("tool_name", F.lit("")) != "") & (F.col("agent_count") >= 3) & ~F.col("tool_seen")
    first = F.when(new_tool, F.when(R.is_outbound(F.col("tool_name")), 0.8).otherwise(0.3)).otherwise(0.0)
    long = (F.col("agent_count") >= 3) & (F.col("agent_chars") > 0) & (size * F.col("agent_count") > 4 * F.col("agent_chars"))
    score = F.when(long, F.greatest(first, F.lit(0.3))).otherwise(first)
    return rows.withColumns({"behaviour": score, "new_tool": F.coalesce(new_tool, F.lit(False)), "long_message": F.coalesce(long, F.lit(False))})


def with_drift(hops: DataFrame) -> DataFrame:
    return hops.withColumn("drift", R.drift_risk(F.col("goal"), F.col("action_text"), F.col("mutating")))


def with_echo(hops: DataFrame) -> DataFrame:
    verb = R.mutating_verb(F.col("tool_name"))
    return hops.withColumns(
        {
            "echo": R.claim_echo(F.col("goal"), F.col("claims"), F.col("action_text"), F.col("mutating")),
            "verb_unasked": F.when(F.col("mutating"), R.never_asked(F.col("goal"), verb)),
        }
    )


def history(hops: DataFrame, recent: int = V.CONTEXT_HOPS, older: int = 3) -> DataFrame:
    """``history``: hop numbers that stay in memory, from the last 64 hops: the first user hop,
    the last ``recent`` but system ones, and the ``older`` last untrusted ones before those."""
    window = Window.partitionBy("session_id").orderBy("hop").rowsBetween(-V.WINDOW_HOPS, -1)
    past = F.collect_list(F.struct("hop", "role")).over(window)
    rows = hops.withColumn("_past", past)
    n = F.size("_past")
    tail = F.filter(F.slice("_past", F.greatest(F.lit(1), n - recent + 1), recent), lambda h: h["role"] != "system")
    head = F.filter(F.slice("_past", 1, F.greatest(F.lit(0), n - recent)), lambda h: h["role"].isin(*V.UNTRUSTED_ROLES))
    head = F.slice(head, F.greatest(F.lit(1), F.size(head) - older + 1), older)
    first = F.slice(F.filter("_past", lambda h: h["role"] == "user"), 1, 1)
    numbers = F.transform(F.concat(first, head, tail), lambda h: h["hop"])
    return rows.withColumn("history", F.array_sort(F.array_distinct(numbers))).drop("_past")
