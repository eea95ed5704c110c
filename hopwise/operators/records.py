"""Records of sessions and examples: transcripts, supervised rows, allocation, audits, replacement."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import text as T

#: What stands in the place of a held call and of held data.
HELD_CALL, HELD_DATA = "[call withheld]", "[data withheld]"
#: Characters of a transcript, and what is left out of the middle of one.
TRANSCRIPT_CHARS, LEFT_OUT = 30_000, "\n[... middle of session omitted ...]\n"


def message_text(content: Column, response: Column, action: Column) -> Column:
    """What a message says and does, in one line."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (content, response, action)])


def elided(text: Column, head: int, tail: int, mark: str, most: int) -> Column:
    """The first and last characters of a text of more than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -tail, tail))).otherwise(text)


def transcripts(hops: DataFrame, total: int = TRANSCRIPT_CHARS, per_hop: int | None = None) -> DataFrame:
    """(session_id, transcript): hops in order, long ones without their middle, and so the whole.

    A transcript is one string, so a session is put together by one task; hops are cut first.
    """
    per_hop = per_hop or max(400, total // 10)
    body = F.concat_ws(" ", F.nullif("content", F.lit("")), F.nullif("tool_response", F.lit("")))
    said = F.concat(body, F.when(F.col("action_text") != "", F.concat(F.lit(" | CALL "), "action_text")).otherwise(""))
    said = elided(said, per_hop // 2, per_hop // 2, " [...] ", per_hop)
    line = F.concat(F.lit("[hop "), "hop", F.lit("] "), "role", F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" -> "), F.coalesce("target", F.lit("")), F.lit(": "), said)
    lines = hops.select("session_id", F.struct("hop", line.alias("line")).alias("x")).groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return lines.select("session_id", elided(whole, total // 3, -(-2 * total // 3), LEFT_OUT, total).alias("transcript"))


def supervised_events(chunks: DataFrame) -> DataFrame:
    """(id, label, n_chunks, texts) from chunk rows (id, chunk, label, text): events with a label, all
    their texts in order; an event with a malicious chunk is malicious (0), else safe (1)."""
    known = chunks.where(F.col("label").isin("malicious", "safe"))
    rows = known.groupBy("id").agg(F.min(F.when(F.col("label") == "malicious", 0).otherwise(1)).alias("label"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("x"))
    return rows.select("id", "label", "n_chunks", F.transform("x", lambda x: x["text"]).alias("texts"))


def without_marks(text: Column, mark: str) -> Column:
    """A text without the opening and closing marks of a name, in either case."""
    return F.regexp_replace(text, f"(?i)</?{mark}>", "")


def filled(text: Column, placeholder: str, pool: list[str], index: Column) -> Column:
    """The placeholder replaced by the pool's entry of the row."""
    return F.replace(text, F.lit(placeholder), F.get(F.array(*map(F.lit, pool)), F.pmod(index, F.lit(len(pool))).cast("int")))


def addresses(text: Column) -> Column:
    return F.filter(T.indicators(text), lambda i: i.contains("@"))


def first_group(rows: DataFrame, key: str, index: str, groups: int = 17) -> DataFrame:
    """(key, group): the first index that has a key, modulo the number of groups."""
    return rows.groupBy(key).agg((F.min(index) % groups).alias("group"))


def drawn(rows: DataFrame, options: DataFrame, key: list[str], order: Column, *by: str) -> DataFrame:
    """For each row (named by ``by``) the option with its key that comes first by ``order``."""
    joined = rows.join(options, key)
    return joined.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_r = 1").drop("_r")


def transferred_threshold(validation: DataFrame, test: DataFrame, by: str) -> DataFrame:
    """Counts on ``test`` (by, label, trust) at its group's ``threshold`` of ``validation`` (by,
    threshold), 0.5 where it has none."""
    rows = test.join(validation.select(by, "threshold"), by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    flagged = F.col("trust") < F.col("threshold")
    return rows.groupBy(by, "threshold").agg(
        F.count_if((F.col("label") == 0) & flagged).alias("tp"), F.count_if(F.col("label") == 0).alias("bad"), F.count_if((F.col("label") == 1) & flagged).alias("fp"), F.count_if(F.col("label") == 1).alias("good")
    )


def replaced(verdicts: DataFrame) -> DataFrame:
    """Add ``executed`` and ``output``: held calls are not executed, held data is replaced."""
    call = F.col("role") == "assistant"
    said = F.coalesce(F.nullif("content", F.lit("")), "action_text")
    return verdicts.withColumns({"executed": call & F.col("delivered"), "output": F.when(F.col("delivered"), said).when(call, HELD_CALL).otherwise(HELD_DATA)})


def session_audit(sessions: DataFrame) -> DataFrame:
    """One row of what must hold of (sample_id, split, group, hops: array of numbers): ids are unique,
    hops are 1 to n, splits are known, no group stands in two splits."""
    per = sessions.groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s"), F.count_if(F.col("hops") != F.sequence(F.lit(1), F.size("hops"))).alias("gaps"), F.count_if(~F.col("split").isin("train", "validation", "test")).alias("strange"))
    twice = F.count("*").over(Window.partitionBy("sample_id")) > 1
    marked = sessions.withColumn("_twice", twice)
    per = per.join(marked.groupBy("group").agg(F.count_if("_twice").alias("twice")), "group")
    none = {name: (F.coalesce(F.sum(c), F.lit(0)) == 0).alias(name) for name, c in (("numbered", "gaps"), ("known_splits", "strange"), ("unique_ids", "twice"))}
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *none.values(), F.count_if(F.col("s") > 1).alias("leaking_groups"))


def _walked(value, clean):
    if isinstance(value, str):
        return clean(value)
    if isinstance(value, list):
        return [_walked(v, clean) for v in value]
    return {k: _walked(v, clean) for k, v in value.items()} if isinstance(value, dict) else value


def without_nested_marks(value: Column, mark: str) -> Column:
    """A JSON text without the marks of a name in any of its strings, at any depth; keys stay.

    Literals of the other spelling (single quotes, True, None) are read as well and come out as
    JSON; what is neither is cleaned as plain text.  Keys are sorted; null stays null.
    """
    pattern = re.compile(f"</?{re.escape(mark)}>", re.IGNORECASE)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                return json.dumps(_walked(parse(text), lambda s: pattern.sub("", s)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
                continue
        return pattern.sub("", text)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    # only values that have such a mark go to Python
    return F.when(F.contains(F.lower(value), F.lit(f"{mark.lower()}>")), cleaned(value)).otherwise(value)


def built(cases: DataFrame, parts: list[tuple[str, str, str]], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Session records from wide cases, and the cases that cannot be one.

    ``parts`` are (column, role, source) in order: each becomes a message, numbered from 1, with its
    text as content and, of tool roles, as tool_response.  Records are (id, messages, n_messages);
    rejects (id, reason): the first part that is missing or blank, or an id that is null or stands
    in several cases, of which none is taken.  Both come from one pass.
    """

    def message(i: int, column: str, role: str, source: str) -> Column:
        text = F.col(column)
        return F.struct(
            F.lit(i).alias("hop"), F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit("agent").alias("target"), text.alias("content"),
            (text if role.startswith("tool") else F.lit(None).cast("string")).alias("tool_response"),
        )

    messages = F.array(*[message(i, *p) for i, p in enumerate(parts, 1)])
    lacking = [F.when(F.col(c).isNull(), f"{c} is missing").when(F.trim(c) == "", f"{c} is blank") for c, _, _ in parts]
    n = F.count("*").over(Window.partitionBy(id))
    reason = F.coalesce(F.when(F.col(id).isNull(), "no id"), F.when(n > 1, "id stands twice"), *lacking)
    rows = cases.withColumns({"reason": reason, "messages": messages})
    return rows.where("reason is null").select(id, "messages", F.lit(len(parts)).alias("n_messages")), rows.where("reason is not null").select(id, "reason")
