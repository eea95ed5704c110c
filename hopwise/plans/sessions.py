"""Catalogue queries over hops: rendering, signals, provenance, verdicts and the verdict log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import text as T
from hopwise.functions import vocabulary as V
from hopwise.operators import fold, prefix, provenance, scorers, verdict_log
from hopwise.plans import sql as S
from hopwise.plans.registry import query, read
from hopwise.sources.folders import scratch
from hopwise.sources.hops import CONV_SQL, EV_SQL, conv_hops, dealt, ev_hops
from hopwise.streaming import verdicts

EV, CONV = f"WITH {EV_SQL}", f"WITH {CONV_SQL}"
PRE, SIG, KNOWN = f"{EV}, {S.PREFIX}", f"{EV}, {S.PREFIX}", f"{EV}, {S.PREFIX}, {S.ORIGINS}"
VER = f"WITH RECURSIVE {EV_SQL}, {S.PREFIX}, {S.ORIGINS}, {S.verdicts()}"
#: Verdicts from static signals: what the log queries run on, without the fold.
STATIC = f"{SIG}, log AS (SELECT *, session_id * 100000 + hop AS id, (1 - 0.9 * instruction) * (1 - 0.5 * instruction) * (1 - 0.15 * drift) * (1 - 0.15 * behaviour) AS trust FROM sig), vlog AS (SELECT *, {S.tier('trust')} AS tier FROM log)"


def events_hops(spark, d) -> DataFrame:
    return ev_hops(read(spark, d, "events"))


def signalled(spark, d, items: bool = False) -> DataFrame:
    hops = events_hops(spark, d)
    rows = dealt(provenance.with_items(hops), hops) if items else hops
    return prefix.with_echo(prefix.with_drift(prefix.with_designation(prefix.with_prefix(prefix.with_behaviour(rows)))))


def static_log(spark, d) -> DataFrame:
    none = F.lit(0.0)
    trust = R.noisy_or(1 - 0.9 * F.col("instruction"), F.col("instruction"), F.col("drift"), none, F.col("behaviour"))
    rows = signalled(spark, d).withColumn("trust", trust)
    return rows.withColumns({"id": F.col("session_id") * 100000 + F.col("hop"), "tier": R.tier(F.col("trust"))})


@query(f"{EV} SELECT session_id, hop, role, content_state, event_text, action_text, hop_text, {S.TRUSTED} AS trusted, {S.UNTRUSTED} AS untrusted FROM ev")
def normalize_hops(spark, d):
    h = events_hops(spark, d)
    return h.select("session_id", "hop", "role", "content_state", "event_text", "action_text", "hop_text", R.trusted(F.col("role")).alias("trusted"), R.untrusted(F.col("role")).alias("untrusted"))


@query(f"{EV} SELECT content_state, role, count(*) AS n FROM ev GROUP BY ALL")
def content_state_counts(spark, d):
    return events_hops(spark, d).groupBy("content_state", "role").agg(F.count("*").alias("n"))


@query("""SELECT event_id, '{"a":"' || event_type || '","k":' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) || ',"z":true}' AS canonical FROM events""")
def canonical_json(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    loose = F.concat(F.lit('{"z": true, "k": '), "k", F.lit(', "a": "'), "event_type", F.lit('"}'))
    return rows.select("event_id", T.sorted_json(loose).alias("canonical"))


@query("""SELECT doc_id, CASE WHEN length(text) > 110 THEN left(text, 110) || '…' ELSE text END AS clipped, left(text, 160) AS preview, left(text, 200) AS snippet FROM documents""")
def clip_preview(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.clip(t, 110).alias("clipped"), T.preview(t, F.lit("")).alias("preview"), T.preview(t, F.lit(""), 200).alias("snippet"))


def _render_sql(limit: int | None, call: int) -> str:
    def cut(c, n):
        return c if n is None else f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '…' ELSE {c} END"

    return f"""concat_ws(chr(10), '[HOP ' || hop || '] role=' || role || ' source=' || source || ' target=' || target, 'content_state=' || content_state, 'content=' || {cut('content', limit)},
      'tool_name=' || tool_name, 'tool_call=' || {cut('tool_call', call)})"""


@query(f"{EV} SELECT session_id, hop, {_render_sql(None, V.CALL_CHARS)} AS rendered, {_render_sql(V.CONTEXT_CHARS, V.CONTEXT_CHARS)} AS short FROM ev")
def render_hop(spark, d):
    return events_hops(spark, d).select("session_id", "hop", T.render_hop(F.col).alias("rendered"), T.render_hop(F.col, V.CONTEXT_CHARS).alias("short"))


def _bucket(drift, mutating):
    return F.when(~mutating, "n/a").when(drift < 0.15, "low").when(drift < 0.5, "medium").otherwise("high")


#: Columns of the fold's input that signals and reasons are made of.
_MORE = ("source", "target", "tool_name", "drift", "cues", "claims", "echo", "mutating", "verb_unasked", "cue_count", "outbound", "new_tool", "long_message")


def session_signal_columns(judged: DataFrame) -> DataFrame:
    """The session signals of every judged hop, as they stood before it, in words and small numbers."""
    reuse = F.slice(F.transform("reused", lambda r: F.concat(r["key"], F.lit("<-hop"), r["hop"], F.lit(" "), r["source"])), 1, 3)
    unrequested = F.when(~F.col("mutating"), "n/a").when((F.size("given") > 0) | ~F.col("verb_unasked"), "no").otherwise("yes")
    behaviour = F.when(F.col("behaviour") == 0, "normal").when(F.col("behaviour") >= 0.8, "new_outbound_tool").otherwise("new_tool_or_long_message")
    return judged.select(
        "session_id", "hop", _bucket(F.col("drift"), F.col("mutating")).alias("drift"), F.least(F.lit(3), "cues").alias("cues"), F.least(F.lit(3), "claims").alias("claims"),
        reuse.alias("reuse"), F.slice("given", 1, 3).alias("trusted"), unrequested.alias("unrequested"), F.least(F.lit(3), "echo").alias("echo"), behaviour.alias("behaviour"),
    )


def _session_signals(spark, d) -> DataFrame:
    return session_signal_columns(fold.verdicts(events_hops(spark, d), more=_MORE))


_SS = """rr AS (SELECT session_id, hop, unnest(reused) AS u FROM ver
), rs AS (SELECT rr.session_id, rr.hop, list(u.key || '<-hop' || u.hop || ' ' || o.source ORDER BY u.key)[1:3] AS reuse FROM rr JOIN sig o ON o.session_id = rr.session_id AND o.hop = u.hop GROUP BY 1, 2
), ss AS (SELECT sig.session_id, sig.hop, CASE WHEN NOT mutating THEN 'n/a' WHEN sig.drift < 0.15 THEN 'low' WHEN sig.drift < 0.5 THEN 'medium' ELSE 'high' END AS drift, least(3, cues) AS cues, least(3, claims) AS claims,
  coalesce(reuse, CAST([] AS VARCHAR[])) AS reuse, given[1:3] AS trusted, CASE WHEN NOT mutating THEN 'n/a' WHEN len(given) > 0 OR NOT verb_unasked THEN 'no' ELSE 'yes' END AS unrequested, least(3, echo) AS echo,
  CASE WHEN sig.behaviour = 0 THEN 'normal' WHEN sig.behaviour >= 0.8 THEN 'new_outbound_tool' ELSE 'new_tool_or_long_message' END AS behaviour
  FROM sig JOIN ver ON ver.session_id = sig.session_id AND ver.hop = sig.hop LEFT JOIN rs ON rs.session_id = sig.session_id AND rs.hop = sig.hop)"""
_SIGNALS = f"{VER}, {_SS}"
_RENDERED = """'drift=' || drift || ' | untrusted_cues=' || cues || ' | authority_claims=' || claims || ' | untrusted_item_reuse=' || coalesce(nullif(array_to_string(reuse, '; '), ''), 'none') ||
  ' | user_supplied_items=' || coalesce(nullif(array_to_string(trusted, '; '), ''), 'none') || ' | unrequested_action=' || unrequested || ' | claim_echo=' || echo || ' | behaviour=' || behaviour"""


@query(f"{_SIGNALS} SELECT session_id, hop, drift, CAST(cues AS INTEGER) AS cues, CAST(claims AS INTEGER) AS claims, array_to_string(reuse, '; ') AS reuse, array_to_string(trusted, '; ') AS trusted, unrequested, CAST(echo AS INTEGER) AS echo, behaviour FROM ss")
def session_signals(spark, d):
    return _session_signals(spark, d).withColumns({c: F.array_join(c, "; ") for c in ("reuse", "trusted")})


@query(f"{_SIGNALS} SELECT session_id, hop, {_RENDERED} AS line FROM ss")
def render_signals(spark, d):
    return signal_lines(_session_signals(spark, d))


def signal_lines(signals: DataFrame) -> DataFrame:
    """(session_id, hop, line): the signals as one line that a scorer reads."""

    def listed(c):
        return F.coalesce(F.nullif(F.array_join(c, "; "), F.lit("")), F.lit("none"))

    line = F.concat(
        F.lit("drift="), "drift", F.lit(" | untrusted_cues="), "cues", F.lit(" | authority_claims="), "claims", F.lit(" | untrusted_item_reuse="), listed("reuse"),
        F.lit(" | user_supplied_items="), listed("trusted"), F.lit(" | unrequested_action="), "unrequested", F.lit(" | claim_echo="), "echo", F.lit(" | behaviour="), "behaviour",
    )
    return signals.select("session_id", "hop", line.alias("line"))


_HISTORY = """past AS (SELECT *, list({'hop': hop, 'role': role}) OVER (PARTITION BY session_id ORDER BY hop ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS p FROM %s
), past2 AS (SELECT *, coalesce(len(p), 0) AS n FROM past), his AS (SELECT *, list_sort(list_distinct(list_concat(
  list_transform(list_filter(p, lambda h: h.role = 'user')[1:1], lambda h: h.hop), list_concat(
  list_transform(list_filter(p[1:greatest(0, n - 4)], lambda h: h.role IN ('tool', 'tool_response', 'memory_read', 'memory_write'))[-3:], lambda h: h.hop),
  list_transform(list_filter(p[greatest(1, n - 3):n], lambda h: h.role <> 'system'), lambda h: h.hop))))) AS history FROM past2)"""


@query(f"{EV}, {_HISTORY % 'ev'} SELECT session_id, hop, coalesce(array_to_string(history, ','), '') AS history FROM his")
def history_context(spark, d):
    return prefix.history(events_hops(spark, d)).select("session_id", "hop", F.array_join(F.transform("history", lambda h: h.cast("string")), ",").alias("history"))


#: Headings of the scorer's text.
TITLES = ("CURRENT EVENT", "SESSION SIGNALS", "SESSION HISTORY")
_GAP = "chr(10) || chr(10)"
_SCORER = f"""WITH RECURSIVE {CONV_SQL}, {S.PREFIX}, {S.ORIGINS}, {S.verdicts()}, {_SS}, lt AS (SELECT session_id AS ls, hop AS lh, {_RENDERED} AS line FROM ss), {_HISTORY % 'ev'}
, lines AS (SELECT session_id, hop AS h, role AS r, {_render_sql(V.CONTEXT_CHARS, V.CONTEXT_CHARS)} AS short FROM ev
), ah AS (SELECT session_id, hop, unnest(history) AS h FROM his
), js AS (SELECT ah.session_id, ah.hop, ah.h, r, short, min(CASE WHEN r = 'user' THEN ah.h END) OVER (PARTITION BY ah.session_id, ah.hop) AS goal FROM ah JOIN lines ON ah.session_id = lines.session_id AND ah.h = lines.h
), ctx AS (SELECT session_id, hop, string_agg(short, {_GAP} ORDER BY CASE WHEN h = goal THEN 0 ELSE 1 END, h DESC) AS context FROM js GROUP BY 1, 2
), bt AS (SELECT his.*, context, line FROM his JOIN lt ON his.session_id = ls AND his.hop = lh LEFT JOIN (SELECT session_id AS cs, hop AS ch, context FROM ctx) ON his.session_id = cs AND his.hop = ch)"""
_TEXT = f"""'{TITLES[0]}' || {_GAP} || {_render_sql(None, V.CALL_CHARS)} || {_GAP} || '{TITLES[1]}' || {_GAP} || line || CASE WHEN context IS NULL THEN '' ELSE {_GAP} || '{TITLES[2]}' || {_GAP} || context END"""


def scorer_texts(hops: DataFrame, signals: DataFrame | None, titles=TITLES) -> DataFrame:
    """(session_id, hop, chunk, text): what a scorer reads, one text for each chunk of a hop.

    The chunk comes first, then the session's signals, the goal and the rest of the history,
    newest first.  A hop of one chunk is rendered whole; of several, each stands for its content.
    Without ``signals`` the text is the stateless view, the event alone.
    """
    rows = prefix.history(hops).withColumn("_spans", T.chunk_spans(F.length("event_text")))
    pieces = rows.select("*", F.posexplode("_spans").alias("chunk", "_span")).withColumn("_whole", F.size("_spans") == 1)
    part = F.substring("event_text", F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start"))
    own = {c: F.when(F.col("_whole"), F.col(c)).otherwise(x) for c, x in (("content", part), ("content_state", F.lit("text")), ("tool_response", F.lit(None).cast("string")))}
    event = T.render_hop(lambda c: own.get(c, F.col(c)))
    key = ["session_id", "hop"]
    if signals is None:
        return pieces.select(*key, "chunk", F.concat_ws("\n\n", F.lit(titles[0]), event).alias("text"))
    lines = rows.select("session_id", F.col("hop").alias("h"), F.col("role").alias("r"), T.render_hop(F.col, V.CONTEXT_CHARS).alias("short"))
    at = rows.select(*key, F.explode("history").alias("h")).join(lines, ["session_id", "h"])
    goal = F.min(F.when(F.col("r") == "user", F.col("h"))).over(Window.partitionBy(*key))
    at = at.withColumn("order", F.when(F.col("h") == goal, F.lit(-1 << 30)).otherwise(-F.col("h")))
    context = at.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "short"))), lambda x: x["short"]), "\n\n").alias("context"))
    told = signal_lines(signals).join(context, key, "left").withColumn("_after", F.concat_ws("\n\n", F.lit(titles[1]), "line", F.when(F.col("context").isNotNull(), F.lit(titles[2])), "context"))
    return pieces.join(told.select(*key, "_after"), key).select(*key, "chunk", F.concat_ws("\n\n", F.lit(titles[0]), event, "_after").alias("text"))


def _scorer_texts(spark, d) -> DataFrame:
    hops = conv_hops(read(spark, d, "conversations"))
    return scorer_texts(hops, session_signal_columns(fold.verdicts(hops, more=_MORE)))


@query(f"{_SCORER} SELECT session_id, hop, {_TEXT} AS text FROM bt WHERE length(event_text) <= {V.CHUNK_CHARS}")
def build_text(spark, d):
    """The scorer's text of events that need no chunks."""
    hops = conv_hops(read(spark, d, "conversations")).where(F.length("event_text") <= V.CHUNK_CHARS).select("session_id", "hop")
    return _scorer_texts(spark, d).join(hops, ["session_id", "hop"], "left_semi").select("session_id", "hop", "text")


_CHUNK = f"CASE WHEN length(event_text) <= {V.CHUNK_CHARS} THEN [0] ELSE list_append(range(0, length(event_text) - {V.CHUNK_CHARS}, {V.CHUNK_STRIDE}), length(event_text) - {V.CHUNK_CHARS}) END"


@query(f"""{_SCORER}, ct AS (SELECT *, CAST(unnest(range(len(st))) AS INTEGER) AS chunk, unnest(st) AS s FROM (SELECT *, {_CHUNK} AS st FROM bt))
, cp AS (SELECT * REPLACE (CASE WHEN len(st) = 1 THEN content ELSE substr(event_text, CAST(s + 1 AS BIGINT), {V.CHUNK_CHARS}) END AS content, CASE WHEN len(st) = 1 THEN content_state ELSE 'text' END AS content_state) FROM ct)
SELECT session_id, hop, chunk, sha256({_TEXT}) AS text_sha256 FROM cp""")
def build_texts(spark, d):
    return _scorer_texts(spark, d).select("session_id", "hop", "chunk", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {CONV_SQL}, c AS (SELECT session_id, hop, role, event_text, unnest(st) AS s, CAST(unnest(range(len(st))) AS INTEGER) AS chunk, len(st) AS n FROM (SELECT *, {_CHUNK} AS st FROM ev)
), r AS (SELECT *, CASE WHEN role IN ('user', 'system') THEN NULL ELSE 1.0 - 0.9 * {S.instruction(f"substr(event_text, CAST(s + 1 AS BIGINT), {V.CHUNK_CHARS})")} END AS t FROM c)
SELECT session_id, hop, CAST(n AS INTEGER) AS n_chunks, round(min(t), 6) AS model_trust, arg_min(chunk, (t, chunk)) AS worst FROM r GROUP BY session_id, hop, n""")
def chunk_scored(spark, d):
    """The scorer slot: any column of trust over chunk texts, here the rule detector; an event is
    as trustworthy as its worst chunk."""
    hops = conv_hops(read(spark, d, "conversations"))
    return fold.chunk_scored(hops, lambda role, text: 1.0 - 0.9 * R.instruction_risk(role, text)).select("session_id", "hop", "n_chunks", F.round("model_trust", 6).alias("model_trust"), "worst")


_SPANS = "CASE WHEN length(text) <= 900 THEN [0] ELSE list_append(range(0, length(text) - 900, 450), length(text) - 900) END"


@query(f"SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(least(s + 900, length(text)) AS INTEGER) AS span_end FROM (SELECT doc_id, text, unnest({_SPANS}) AS s FROM documents)")
def chunk_spans(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.inline(T.chunk_spans(F.length("text"))))
    return rows.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(f"SELECT doc_id, CAST(s AS INTEGER) AS span_start, substr(text, CAST(s + 1 AS BIGINT), 900) AS chunk FROM (SELECT doc_id, text, unnest({_SPANS}) AS s FROM documents)")
def chunk_text(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", F.inline(T.chunk_spans(F.length("text"))))
    return rows.select("doc_id", F.col("start").alias("span_start"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("chunk"))


@query(f"{EV} SELECT session_id, hop, {S.hits('data_text', V.INSTRUCTION_CUES, 'is')} * CAST({S.UNTRUSTED} AS INTEGER) AS hits, {S.instruction()} AS risk FROM ev")
def instruction_risk(spark, d):
    h, role, text = events_hops(spark, d), F.col("role"), F.col("data_text")
    return h.select("session_id", "hop", R.instruction_hits(role, text).alias("hits"), R.instruction_risk(role, text).alias("risk"))


@query(f"{EV} SELECT session_id, hop, CAST({S.claims()} AS INTEGER) AS n FROM ev")
def authority_claims(spark, d):
    return events_hops(spark, d).select("session_id", "hop", R.authority_claims(F.col("role"), F.col("data_text")).alias("n"))


@query(f"{EV} SELECT session_id, hop, {S.MUTATING} AS mutating, {S.OUTBOUND} AS outbound, CASE WHEN {S.MUTATING} THEN {S.VERB} END AS verb FROM ev")
def mutating_outbound(spark, d):
    m = R.is_mutating(F.col("role"), F.col("tool_name"))
    return events_hops(spark, d).select("session_id", "hop", m.alias("mutating"), R.is_outbound(F.col("tool_name")).alias("outbound"), F.when(m, R.mutating_verb(F.col("tool_name"))).alias("verb"))


_TEXTS = "(SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'u' || page_id, url FROM pages)"


def _texts(spark, d) -> DataFrame:
    docs, pages = read(spark, d, "documents"), read(spark, d, "pages")
    first = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    return first.unionByName(pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("t"))).unionByName(pages.select(F.concat(F.lit("u"), "page_id").alias("id"), F.col("url").alias("t")))


@query(f"SELECT id, unnest({S.indicators('t')}) AS item FROM {_TEXTS}")
def extract_indicators(spark, d):
    return _texts(spark, d).select("id", F.explode(T.indicators(F.col("t"))).alias("item"))


@query(f"SELECT id, unnest({S.text_parts('t')}) AS part FROM {_TEXTS}")
def text_parts(spark, d):
    return _texts(spark, d).select("id", F.explode(T.text_parts(F.col("t"))).alias("part"))


@query(f"SELECT id, item, array_to_string({S.item_parts('item')}, ' ') AS parts FROM (SELECT id, unnest({S.indicators('t')}) AS item FROM {_TEXTS})")
def item_parts(spark, d):
    return extract_indicators(spark, d).withColumn("parts", F.array_join(T.item_parts(F.col("item")), " "))


_ODD = "replace(replace(item, '@', CASE k % 4 WHEN 0 THEN '[at]' WHEN 1 THEN ' at ' WHEN 2 THEN ' @ ' ELSE '@' END), '.', CASE k % 4 WHEN 0 THEN ' (dot) ' WHEN 1 THEN ' dot ' WHEN 2 THEN ' . ' ELSE '{.}' END)"


@query(f"{EV}, o AS (SELECT session_id, hop, 'to hxxp' || replace({_ODD}, 'https', '') || ' now' AS t FROM ev) SELECT session_id, hop, {S.deobfuscated('t')} AS spelled FROM o")
def deobfuscate(spark, d):
    k = F.col("k") % 4
    at = F.when(k == 0, "[at]").when(k == 1, " at ").when(k == 2, " @ ").otherwise("@")
    dot = F.when(k == 0, " (dot) ").when(k == 1, " dot ").when(k == 2, " . ").otherwise("{.}")
    t = F.replace(F.replace(F.replace("item", F.lit("@"), at), F.lit("."), dot), F.lit("https"), F.lit(""))
    return events_hops(spark, d).select("session_id", "hop", T.deobfuscated(F.concat(F.lit("to hxxp"), t, F.lit(" now"))).alias("spelled"))


@query()
def canonical_full(spark, d):
    """With Unicode compatibility forms and account numbers in groups; no SQL has NFKC."""
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("ＧＢ29 BARC 1234 5678 9012 34, "), F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", T.canonical(F.col("t")).alias("spelled"), F.array_join(T.indicators(T.canonical(F.col("t"))), " ").alias("items"))


@query("SELECT string_split(url, '/')[3] AS host, count(*) AS n FROM pages WHERE url LIKE 'http%' GROUP BY 1")
def url_hosts(spark, d):
    return read(spark, d, "pages").where("url like 'http%'").groupBy(F.get(F.split("url", "/"), F.lit(2)).alias("host")).agg(F.count("*").alias("n"))


@query(f"{SIG} SELECT session_id, hop, goal, round(drift, 6) AS drift, CASE WHEN NOT mutating THEN 'n/a' WHEN drift < 0.15 THEN 'low' WHEN drift < 0.5 THEN 'medium' ELSE 'high' END AS bucket FROM sig")
def goal_drift(spark, d):
    return signalled(spark, d).select("session_id", "hop", "goal", F.round("drift", 6).alias("drift"), _bucket(F.col("drift"), F.col("mutating")).alias("bucket"))


@query(f"{_SIGNALS} SELECT session_id, hop, CASE unrequested WHEN 'yes' THEN true WHEN 'no' THEN false END AS unrequested FROM ss")
def unrequested_action(spark, d):
    s = _session_signals(spark, d)
    return s.select("session_id", "hop", F.when(F.col("unrequested") != "n/a", F.col("unrequested") == "yes").alias("unrequested"))


@query(f"{SIG} SELECT session_id, hop, claims, CAST(echo AS INTEGER) AS echo FROM sig WHERE mutating")
def claim_echo(spark, d):
    return signalled(spark, d).where("mutating").select("session_id", "hop", "claims", "echo")


@query(f"{_SIGNALS} SELECT ss.session_id, ss.hop, CAST(CASE WHEN sig.claims = 0 OR NOT mutating THEN 0.0 WHEN sig.echo > 0 THEN 0.9 WHEN ss.unrequested = 'yes' THEN 0.75 ELSE 0.0 END AS DOUBLE) AS risk FROM ss JOIN sig ON ss.session_id = sig.session_id AND ss.hop = sig.hop")
def escalation_risk(spark, d):
    s = _session_signals(spark, d)
    return s.select("session_id", "hop", F.when((F.col("claims") == 0) | (F.col("unrequested") == "n/a"), 0.0).when(F.col("echo") > 0, 0.9).when(F.col("unrequested") == "yes", 0.75).otherwise(0.0).alias("risk"))


@query(f"{SIG} SELECT session_id, hop, agent_count, agent_chars, tool_seen, behaviour FROM sig")
def behaviour_risk(spark, d):
    return signalled(spark, d).select("session_id", "hop", "agent_count", "agent_chars", "tool_seen", "behaviour")


@query(f"{PRE} SELECT session_id, hop, goal, cues, claims, previous_role, previous_call FROM pre")
def prefix_state(spark, d):
    return prefix.with_prefix(events_hops(spark, d)).select("session_id", "hop", "goal", "cues", "claims", "previous_role", "previous_call")


@query(f"{KNOWN} SELECT session_id, key, trusted_hop, plain_hop, plain_source FROM org")
def first_seen_taint(spark, d):
    o = provenance.origins(provenance.registered(signalled(spark, d, items=True)))
    return o.select("session_id", "key", "trusted_hop", F.col("plain.hop").alias("plain_hop"), F.col("plain.source").alias("plain_source"))


_TAINT = """SELECT session_id, hop, item, list_min(list_concat(list_filter([plain_hop], lambda p: p IS NOT NULL), named)) AS origin_hop,
  CASE WHEN plain_hop IS NOT NULL AND (len(named) = 0 OR plain_hop < named[1]) THEN plain_source ELSE named_sources[1] END AS origin_source FROM kn WHERE exact AND NOT supplied AND (plain_hop IS NOT NULL OR len(named) > 0)"""


@query(f"{KNOWN} {_TAINT}")
def tainted_items(spark, d):
    return provenance.tainted_items(signalled(spark, d, items=True))


@query(f"{KNOWN} SELECT DISTINCT session_id, hop, item, key FROM kn WHERE NOT exact AND NOT supplied AND (plain_hop IS NOT NULL OR len(named) > 0) AND (session_id, hop) NOT IN (SELECT (session_id, hop) FROM kn WHERE exact AND NOT supplied AND (plain_hop IS NOT NULL OR len(named) > 0)) AND (session_id, hop, item) NOT IN (SELECT (session_id, hop, item) FROM kn WHERE exact AND supplied)")
def fragment_taint(spark, d):
    return provenance.fragment_items(signalled(spark, d, items=True))


@query(f"{SIG} SELECT session_id, hop, source, previous_call FROM sig WHERE designated")
def designated_sources(spark, d):
    return signalled(spark, d).where("designated").select("session_id", "hop", "source", "previous_call")


@query(f"""{KNOWN}, t AS ({_TAINT}), r AS (SELECT t.session_id, t.hop, max(CASE WHEN o.instruction > 0 THEN 1 ELSE 0 END) AS risky FROM t JOIN sig o ON o.session_id = t.session_id AND o.hop = t.origin_hop GROUP BY 1, 2)
SELECT sig.session_id, sig.hop, CAST((CASE WHEN risky = 1 THEN 1.0 WHEN outbound THEN 0.9 ELSE 0.5 END) * (CASE WHEN role = 'memory_write' THEN 0.6 ELSE 1.0 END) AS DOUBLE) AS risk
FROM sig JOIN r ON r.session_id = sig.session_id AND r.hop = sig.hop WHERE (role = 'assistant' AND action_text <> '') OR role = 'memory_write'""")
def provenance_risk_static(spark, d):
    """Reuse risk where an origin's own risk is given by a label (here: an instruction cue)."""
    rows = signalled(spark, d, items=True)
    labels = rows.select("session_id", F.col("hop").alias("origin_hop"), (F.col("instruction") > 0).alias("risky"))
    found = provenance.tainted_items(rows).join(labels, ["session_id", "origin_hop"]).groupBy("session_id", "hop").agg(F.bool_or("risky").alias("risky"))
    base = F.when(F.col("risky"), 1.0).when(F.col("outbound"), 0.9).otherwise(0.5) * F.when(F.col("role") == "memory_write", 0.6).otherwise(1.0)
    acts = ((F.col("role") == "assistant") & (F.col("action_text") != "")) | (F.col("role") == "memory_write")
    return rows.where(acts).join(found, ["session_id", "hop"]).select("session_id", "hop", base.alias("risk"))


@query(f"""{KNOWN}, t AS ({_TAINT}), uses AS (SELECT session_id, hop AS at, unnest(items) AS item FROM sig), m AS (SELECT t.* FROM t JOIN sig ON sig.session_id = t.session_id AND sig.hop = t.hop WHERE role = 'assistant')
SELECT m.session_id, m.hop, m.item, u.at, CASE WHEN u.at = origin_hop THEN 'origin' ELSE 'relay' END AS kind FROM m JOIN uses u ON u.session_id = m.session_id AND u.item = m.item WHERE u.at >= origin_hop AND u.at < m.hop
UNION ALL SELECT session_id, hop, item, hop, 'action' FROM m""")
def propagation_trace(spark, d):
    return provenance.tainted_paths(signalled(spark, d, items=True), "assistant")


@query("SELECT event_id, round(t, 6) AS trust, " + S.tier("t") + " AS tier, CASE WHEN t >= 0.75 THEN 0 WHEN t >= 0.5 THEN 1 WHEN t >= 0.25 THEN 2 ELSE 3 END AS severity, t >= 0.5 AS delivered FROM (SELECT event_id, (1 - 0.5 * a) * (1 - 0.15 * b) * (1 - 0.8 * c) * (1 - 0.15 * a) AS t FROM (SELECT event_id, (event_id % 7) / 7.0::DOUBLE AS a, (event_id % 11) / 11.0::DOUBLE AS b, (event_id % 13) / 13.0::DOUBLE AS c FROM events))")
def noisy_or_tier(spark, d):
    a, b, c = ((F.col("event_id") % n) / F.lit(float(n)) for n in (7, 11, 13))
    rows = read(spark, d, "events").select("event_id", R.noisy_or(F.lit(1.0), a, b, c, a).alias("t"))
    tier = R.tier(F.col("t"))
    return rows.select("event_id", F.round("t", 6).alias("trust"), tier.alias("tier"), R.severity(tier).alias("severity"), tier.isin("PASS", "FLAG").alias("delivered"))


_FOLD = "session_id, hop, role, channel, tier, round(trust, 6) AS trust, round(provenance, 4) AS provenance, round(drift, 6) AS drift, behaviour, instruction, round(before, 4) AS sensitivity, shut AS suspended, array_to_string(matches, ',') AS matches"


@query(f"{VER} SELECT {_FOLD} FROM ver")
def verdict_fold(spark, d):
    """Flagship: the stateful verdict of every event."""
    rounded = {"trust": 6, "provenance": 4, "drift": 6, "sensitivity": 4}
    cols = ["session_id", "hop", "role", "channel", "tier", *[F.round(c, n).alias(c) for c, n in rounded.items()], "behaviour", "instruction", "suspended", F.array_join("matches.key", ",").alias("matches")]
    return fold.verdicts(events_hops(spark, d)).select(*cols)


@query(f"{VER} SELECT session_id, hop, tier, round(trust, 6) AS trust, shut AS suspended, array_to_string(matches, ',') AS matches FROM ver")
def stream_verdicts(spark, d):
    """The fold in Structured Streaming: what a stream of the same hops says."""
    judged = verdicts.run_stream(spark, events_hops(spark, d), scratch(spark, "hopwise-stream"))
    return judged.select("session_id", "hop", "tier", F.round("trust", 6).alias("trust"), "suspended", "matches")


_NONE = dict.fromkeys(V.WEIGHTS, 0.0)


@query(f"WITH RECURSIVE {EV_SQL}, {S.PREFIX}, {S.ORIGINS}, {S.verdicts(_NONE)} SELECT session_id, hop, tier, round(trust, 6) AS trust FROM ver")
def model_only_verdicts(spark, d):
    """The ablation without fused signals: the scorer, sensitivity and suspension alone."""
    return fold.verdicts(events_hops(spark, d), ()).select("session_id", "hop", "tier", F.round("trust", 6).alias("trust"))


_WORDS = S.tokens("piece")
_ODDS = f"""lab AS (SELECT event_text AS piece, k % 10 IN (1, 2) AS risky FROM ev WHERE {S.UNTRUSTED}
), tot AS (SELECT count(*) FILTER (risky) AS n1, count(*) FILTER (NOT risky) AS n0 FROM lab
), odds AS (SELECT word, ln((count(*) FILTER (risky) + 1.0) / (any_value(n1) + 2.0)) - ln((count(*) FILTER (NOT risky) + 1.0) / (any_value(n0) + 2.0)) AS w
  FROM (SELECT risky, unnest(list_distinct({_WORDS})) AS word FROM lab), tot GROUP BY word
), pcs AS (SELECT session_id, hop, chunk, substr(event_text, CAST(s + 1 AS BIGINT), {V.CHUNK_CHARS}) AS piece FROM (SELECT session_id, hop, event_text, unnest(st) AS s, CAST(unnest(range(len(st))) AS INTEGER) AS chunk FROM (SELECT *, {_CHUNK} AS st FROM ev))
), pw AS (SELECT session_id, hop, chunk, unnest(list_distinct({_WORDS})) AS word FROM pcs
), ps AS (SELECT session_id, hop, chunk, sum(w) AS w FROM pw JOIN odds USING (word) GROUP BY 1, 2, 3
), scored AS (SELECT pcs.session_id, pcs.hop, min(1 / (1 + exp(ln((n1 + 1.0) / (n0 + 1.0)) + coalesce(w, 0)))) AS model FROM pcs CROSS JOIN tot LEFT JOIN ps ON ps.session_id = pcs.session_id AND ps.hop = pcs.hop AND ps.chunk = pcs.chunk GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {EV_SQL}, {S.PREFIX}, {S.ORIGINS}, {_ODDS}, {S.verdicts(scores='scored')} SELECT session_id, hop, tier, round(model_trust, 6) AS model_trust, round(trust, 6) AS trust FROM ver")
def scored_verdicts(spark, d):
    """The fold with a trained scorer: word odds of data that carries a note or a claim, over the
    chunks of every hop, in place of the rule detector."""
    hops = events_hops(spark, d)
    model = spark.sparkContext.broadcast(scorers.fit_word_odds(hops.where(R.untrusted(F.col("role"))).select(F.col("event_text").alias("text"), (F.col("k") % 10).isin(1, 2).alias("label"))))
    judged = fold.verdicts(hops, scorer=scorers.batched_trust(lambda: model.value))
    return judged.select("session_id", "hop", "tier", F.round("model_trust", 6).alias("model_trust"), F.round("trust", 6).alias("trust"))


_FUSED = "sig.role NOT IN ('user', 'system') AND NOT shut"


@query(f"""{VER}, mm AS (SELECT session_id, hop, unnest(reused) AS u FROM ver WHERE len(matches) > 0), ml AS (SELECT mm.session_id, mm.hop, list('''' || u.key || ''' first appeared in untrusted hop ' || u.hop || ' (' || o.source || ') and now reaches an action' ORDER BY u.key) AS why
  FROM mm JOIN sig o ON o.session_id = mm.session_id AND o.hop = u.hop GROUP BY 1, 2
), rz AS (SELECT sig.session_id, sig.hop, ver.tier, list_concat(list_concat([CASE WHEN shut THEN 'channel ' || channel || ' is suspended after an earlier BLOCK' END, CASE WHEN model_trust < {V.PASS_AT} THEN printf('classifier trust %.2f', model_trust) END,
    CASE WHEN {_FUSED} AND cue_count > 0 THEN 'instruction-like text in a data channel (' || cue_count || ' cue(s))' END], coalesce(why, CAST([] AS VARCHAR[]))),
  CASE WHEN {_FUSED} THEN [CASE WHEN claims > 0 AND mutating THEN CASE WHEN echo > 0 THEN 'action uses waiver wording (''' || CAST(echo AS INTEGER) || ''' term(s)) after untrusted content claimed an exemption'
      WHEN verb_unasked AND len(given) = 0 THEN '''' || tool_name || ''' was never requested by the user, after untrusted content claimed an exemption' END END,
    CASE WHEN coalesce(tool_name, '') <> '' AND agent_count >= 3 AND NOT tool_seen THEN source || CASE WHEN outbound THEN ' used outbound tool ''' || tool_name || ''' outside its baseline' ELSE ' used new tool ''' || tool_name || '''' END
      WHEN agent_count >= 3 AND agent_chars > 0 AND length(coalesce(content, '')) * agent_count > 4 * agent_chars THEN source || ' message 4x longer than its usual' END,
    CASE WHEN before > 0 THEN printf('session sensitivity +%.2f after earlier flags', before) END] ELSE CAST([] AS VARCHAR[]) END) AS reasons
  FROM sig JOIN ver ON ver.session_id = sig.session_id AND ver.hop = sig.hop LEFT JOIN ml ON ml.session_id = sig.session_id AND ml.hop = sig.hop)
SELECT session_id, hop, tier, array_to_string(list_filter(reasons, lambda r: r IS NOT NULL), ' | ') AS reasons FROM rz""")
def verdict_reasons(spark, d):
    judged = fold.verdicts(events_hops(spark, d), more=_MORE)
    return judged.select("session_id", "hop", "tier", F.array_join(fold.reasons(), " | ").alias("reasons"))


@query(f"""{VER}, lm AS (SELECT session_id, hop, list_last(matches) AS item, list_last(reused).hop AS origin_hop FROM ver WHERE tier <> 'PASS' AND len(matches) > 0), uses AS (SELECT session_id, hop AS at, unnest(items) AS item FROM sig)
SELECT lm.session_id, lm.hop, u.at, CASE WHEN u.at = origin_hop THEN 'origin' ELSE 'relay' END AS kind, lm.item FROM lm JOIN uses u ON u.session_id = lm.session_id AND u.item = lm.item WHERE u.at >= origin_hop AND u.at < lm.hop
UNION ALL SELECT session_id, hop, hop, 'action', item FROM lm
UNION ALL SELECT session_id, hop, hop, 'origin', NULL FROM ver WHERE tier <> 'PASS' AND len(matches) = 0""")
def verdict_trace(spark, d):
    """The forensic trace of every verdict but PASS: the path of its last match, else the hop alone."""
    hops = events_hops(spark, d)
    last = F.get("matches", F.size("matches") - 1)
    marked = fold.verdicts(hops).where("tier <> 'PASS'").select("session_id", "hop", last["key"].alias("item"), last["hop"].alias("origin_hop"))
    paths = provenance.carriers(provenance.with_items(hops), marked, None)  # of a hop without a match: itself
    return paths.withColumn("kind", F.when(F.col("item").isNull(), "origin").otherwise(F.col("kind")))


@query(f"{VER}, g AS (SELECT session_id, min(hop) FILTER (tier IN ('QUARANTINE', 'BLOCK')) AS stop FROM ver GROUP BY 1) SELECT ver.session_id, hop, tier FROM ver JOIN g ON g.session_id = ver.session_id WHERE stop IS NULL OR hop <= stop")
def pipeline_gate(spark, d):
    """Events up to the first that is held; later ones are never produced."""
    v = fold.verdicts(events_hops(spark, d)).select("session_id", "hop", "tier", "delivered")
    stop = F.min(F.when(~F.col("delivered"), F.col("hop"))).over(Window.partitionBy("session_id"))
    return v.withColumn("stop", stop).where("stop is null or hop <= stop").select("session_id", "hop", "tier")


@query(f"{VER} SELECT session_id, min(hop) FILTER (tier IN ('QUARANTINE', 'BLOCK')) AS first_held, bool_and(tier IN ('PASS', 'FLAG')) AS sent FROM ver GROUP BY 1")
def outbox(spark, d):
    v = fold.verdicts(events_hops(spark, d))
    return v.groupBy("session_id").agg(F.min(F.when(~F.col("delivered"), F.col("hop"))).alias("first_held"), F.bool_and("delivered").alias("sent"))


@query(f"{VER} SELECT session_id, max(CASE tier WHEN 'PASS' THEN 0 WHEN 'FLAG' THEN 1 WHEN 'QUARANTINE' THEN 2 ELSE 3 END) >= 2 AS held, count(*) AS n_events, CASE WHEN max(CASE tier WHEN 'PASS' THEN 0 WHEN 'FLAG' THEN 1 WHEN 'QUARANTINE' THEN 2 ELSE 3 END) >= 2 THEN CASE WHEN session_id % 3 = 0 THEN 'stopped' ELSE 'false alarm' END ELSE CASE WHEN session_id % 3 = 0 THEN 'MISSED' ELSE 'passed' END END AS outcome FROM ver GROUP BY session_id")
def session_detection(spark, d):
    """Held sessions, and how that meets an attack label (here: every third session)."""
    s = fold.verdicts(events_hops(spark, d)).groupBy("session_id").agg((F.max("severity") >= 2).alias("held"), F.count("*").alias("n_events"))
    attack = F.col("session_id") % 3 == 0
    return s.withColumn("outcome", F.when(F.col("held"), F.when(attack, "stopped").otherwise("false alarm")).otherwise(F.when(attack, "MISSED").otherwise("passed")))


_TIERS = "(SELECT unnest(['PASS', 'FLAG', 'QUARANTINE', 'BLOCK']) AS tier)"


@query(f"{STATIC}, c AS (SELECT t.tier, count(v.id) AS n FROM {_TIERS} t LEFT JOIN vlog v ON v.tier = t.tier GROUP BY 1) SELECT tier, n, round(100.0 * (SELECT sum(n) FROM c WHERE tier <> 'PASS') / (SELECT sum(n) FROM c), 2) AS intercept_rate FROM c")
def tier_stats(spark, d):
    return verdict_log.stats(static_log(spark, d))


@query(f"{STATIC} SELECT id, session_id, hop, tier, round(trust, 6) AS trust FROM vlog WHERE tier <> 'PASS' ORDER BY id DESC LIMIT 100")
def latest_events(spark, d):
    return verdict_log.latest(static_log(spark, d), min_tier="FLAG").select("id", "session_id", "hop", "tier", F.round("trust", 6).alias("trust"))


@query(f"{STATIC} SELECT id, session_id, hop, tier FROM vlog WHERE tier <> 'PASS' AND session_id = (SELECT min(user_id) FROM events)")
def session_trace(spark, d):
    log = static_log(spark, d)
    first = read(spark, d, "events").agg(F.min("user_id").alias("session_id"))
    return verdict_log.trace(log.join(first, "session_id", "left_semi")).select("id", "session_id", "hop", "tier")


@query(f"{VER} SELECT id, CASE id % 3 WHEN 0 THEN 'released' WHEN 1 THEN 'rejected' ELSE 'open' END AS status FROM (SELECT session_id * 100000 + hop AS id FROM ver WHERE tier = 'QUARANTINE')")
def quarantine_review(spark, d):
    path = scratch(spark, "hopwise-log")  # the log is a table: sessions are judged once
    verdict_log.append(fold.verdicts(events_hops(spark, d)).select((F.col("session_id") * 100000 + F.col("hop")).alias("id"), "tier"), path)
    log = spark.read.schema("id long, tier string").parquet(path)
    reviews = log.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "release").otherwise("reject").alias("action"), F.lit(1).alias("seq"))
    return verdict_log.reviewed(log, reviews).where("tier = 'QUARANTINE'").select("id", "status")


@query(f"""{STATIC} SELECT session_id, hop, tier, CAST(least(0.6, 0.15 * coalesce(sum(CAST(tier <> 'PASS' AS INTEGER)) OVER {S.BEFORE}, 0)) AS DOUBLE) AS sensitivity FROM vlog""")
def sensitivity_path(spark, d):
    n = F.coalesce(F.sum((F.col("tier") != "PASS").cast("int")).over(prefix.before()), F.lit(0))
    return static_log(spark, d).select("session_id", "hop", "tier", F.round(F.least(F.lit(V.SENSITIVITY_CAP), V.SENSITIVITY_STEP * n), 4).alias("sensitivity"))


@query(f"{STATIC}, ch AS (SELECT *, source || '->' || target AS channel FROM vlog), b AS (SELECT session_id, channel, min(hop) AS since FROM ch WHERE trust < 0.5 GROUP BY 1, 2) SELECT ch.session_id, ch.hop, ch.channel, coalesce(since < hop, false) AS suspended FROM ch LEFT JOIN b ON b.session_id = ch.session_id AND b.channel = ch.channel")
def suspended_channels(spark, d):
    """A channel is shut from its first held event on (here: trust under 0.5)."""
    rows = static_log(spark, d).withColumn("channel", F.concat("source", F.lit("->"), "target"))
    shut = rows.where("trust < 0.5").groupBy("session_id", "channel").agg(F.min("hop").alias("since"))
    return rows.join(shut, ["session_id", "channel"], "left").select("session_id", "hop", "channel", F.coalesce(F.col("since") < F.col("hop"), F.lit(False)).alias("suspended"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events
), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) + 3600 AS expires_s FROM s GROUP BY user_id, k""")
def session_ttl(spark, d):
    """State that expires an hour after the last event."""
    w = F.session_window("ts", "1 hour")
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", "n", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("expires_s"))
