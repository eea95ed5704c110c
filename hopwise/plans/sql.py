"""The same columns in DuckDB's SQL, for the queries' oracles."""

from __future__ import annotations

from hopwise.functions import vocabulary as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(text: str, patterns, flags: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({text}, {q(f'(?{flags}){p}')}) AS INTEGER)" for p in patterns) + ")"


UNTRUSTED = "role IN ('tool', 'tool_response', 'memory_read', 'memory_write')"
TRUSTED = "role IN ('user', 'system')"


def instruction(text: str = "data_text") -> str:
    h = hits(text, V.INSTRUCTION_CUES, "is")
    score = f"(CASE WHEN {h} = 0 THEN 0.0 WHEN {h} = 1 THEN 0.5 ELSE 0.9 END)"
    return f"CAST(CASE WHEN NOT ({UNTRUSTED}) THEN 0.0 WHEN regexp_matches({text}, {q(V.HIDDEN_CHARACTERS)}) THEN least(1.0, {score} + 0.4) ELSE {score} END AS DOUBLE)"


def claims(text: str = "data_text") -> str:
    return f"CASE WHEN {UNTRUSTED} THEN least(3, {hits(text, V.AUTHORITY_CLAIMS, 'i')}) ELSE 0 END"


MUTATING = f"(role = 'assistant' AND coalesce(regexp_matches(tool_name, {q(V.MUTATING)}), false))"
OUTBOUND = f"coalesce(regexp_matches(tool_name, {q(V.OUTBOUND)}), false)"
VERB = f"lower(regexp_extract(tool_name, {q(V.MUTATING)}, 1))"


def deobfuscated(t: str) -> str:
    def sub(x, p, r):
        return f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"

    t = sub(t, "[​‌‍⁠﻿­]", "")
    t = f"translate({t}, '‐‑‒–', '----')"
    t = sub(t, r"(?i)hxxp\[s\]", "https")
    t = sub(t, r"(?i)\bhxxp(s?)", r"http\1")
    t = sub(t, r"(?i)\s*[\[\(\{]\s*(?:dot|\.)\s*[\]\)\}]\s*", ".")
    t = sub(t, r"(?i)\s*[\[\(\{]\s*(?:at|@)\s*[\]\)\}]\s*", "@")
    for n in range(5, 0, -1):
        t = sub(t, r"\b([\w.+-]+)\s+(?:at|AT)\s+([\w-]+)" + r"\s+(?:dot|DOT)\s+([\w-]+)" * n + r"\b", r"\1@" + ".".join(f"\\{i + 2}" for i in range(n + 1)))
    for n in range(5, 0, -1):
        t = sub(t, r"\b([\w-]+)" + r"\s+(?:dot|DOT)\s+([\w-]+)" * n + r"\s+(?:slash|SLASH)\s+([\w/-]+)", "https://" + ".".join(f"\\{i + 1}" for i in range(n + 1)) + f"/\\{n + 2}")
    for n in range(5, 0, -1):
        t = sub(t, r"([\w.+-]+)\s+@\s+([\w-]+)" + r"\s*\.\s*([\w-]+)" * n, r"\1@" + ".".join(f"\\{i + 2}" for i in range(n + 1)))
    return t


def indicators(t: str) -> str:
    found = f"list_transform(regexp_extract_all({t}, {q(V.INDICATOR)}), lambda m: regexp_replace(lower(m), '[.,;:]+$', ''))"
    hosts = f"list_transform(list_filter({found}, lambda m: starts_with(m, 'http') AND len(string_split(m, '/')) > 2), lambda m: string_split(m, '/')[3])"
    return f"list_sort(list_distinct(list_concat({found}, {hosts})))"


def text_parts(t: str) -> str:
    domains = f"regexp_extract_all({t}, {q('(?i)' + V.BARE_DOMAIN)})"
    tokens = f"list_filter(regexp_extract_all({t}, {q(chr(92) + 'b[A-Za-z0-9]{6,}' + chr(92) + 'b')}), lambda x: regexp_matches(x, '[0-9]'))"
    return f"list_sort(list_distinct(list_transform(list_concat({domains}, {tokens}), lambda x: lower(x))))"


def item_parts(i: str) -> str:
    local, domain = f"string_split({i}, '@')[1]", f"regexp_extract({i}, '^[^@]*@(.*)$', 1)"
    return f"""(CASE WHEN contains({i}, '@') THEN CASE WHEN length({local}) >= 6 AND regexp_matches({local}, '[0-9]') THEN [{domain}, {local}] ELSE [{domain}] END
      WHEN starts_with({i}, 'http') AND len(string_split({i}, '/')) > 2 THEN [string_split({i}, '/')[3]] ELSE CAST([] AS VARCHAR[]) END)"""


def call_strings(c: str) -> str:
    pattern = r'"((?:[^"\\]|\\.)*)"\s*(?:[,}\]]|$)'
    return f"regexp_extract_all(coalesce({c}, ''), {q(pattern)}, 1)"


def cosine(a: str, b: str) -> str:
    def square(x):
        return f"coalesce(list_sum(list_transform(list_distinct({x}), lambda t: len(list_filter({x}, lambda y: y = t)) * len(list_filter({x}, lambda y: y = t)))), 0)"

    dot = f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda t: len(list_filter({a}, lambda y: y = t)) * len(list_filter({b}, lambda y: y = t)))), 0)"
    norm = f"(sqrt(CAST({square(a)} AS DOUBLE)) * sqrt(CAST({square(b)} AS DOUBLE)))"
    return f"(CASE WHEN {norm} > 0 THEN CAST({dot} AS DOUBLE) / {norm} ELSE 0.0 END)"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-z0-9]{{3,}}')"


def tier(t: str) -> str:
    return f"CASE WHEN {t} >= {V.PASS_AT} THEN 'PASS' WHEN {t} >= {V.FLAG_AT} THEN 'FLAG' WHEN {t} >= {V.QUARANTINE_AT} THEN 'QUARANTINE' ELSE 'BLOCK' END"


def unasked() -> str:
    cases = " ".join(f"WHEN {q(v)} THEN [{', '.join(map(q, V.words_for(v)))}]" for v in dict.fromkeys(V.MUTATING_VERBS))
    return f"len(list_filter(CASE {VERB} {cases} ELSE CAST([] AS VARCHAR[]) END, lambda w: contains(lower(coalesce(goal, '')), w))) = 0"


def echo() -> str:
    n = " + ".join(f"CAST(contains(lower(action_text), {q(s)}) AND NOT contains(lower(coalesce(goal, '')), {q(s)}) AS INTEGER)" for s in V.CLAIM_STEMS)
    return f"CASE WHEN {MUTATING} AND claims > 0 THEN {n} ELSE 0 END"


BEFORE = "(PARTITION BY session_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

PREFIX = f"""
pre0 AS (SELECT *, {instruction()} AS instruction, {claims()} AS own_claims, CASE WHEN {UNTRUSTED} THEN {hits('data_text', V.INSTRUCTION_CUES, 'is')} + CAST(regexp_matches(data_text, {q(V.HIDDEN_CHARACTERS)}) AS INTEGER) ELSE 0 END AS cue_count, {MUTATING} AS mutating, {OUTBOUND} AS outbound,
  CASE WHEN {TRUSTED} AND coalesce(content, '') <> '' THEN left(content, {V.GOAL_CHARS}) END AS named FROM ev
), pre AS (SELECT *, first(named IGNORE NULLS) OVER {BEFORE} AS goal,
  CAST(coalesce(sum(CAST(instruction > 0 AS INTEGER)) OVER {BEFORE}, 0) AS INTEGER) AS cues, CAST(coalesce(sum(own_claims) OVER {BEFORE}, 0) AS INTEGER) AS claims,
  lag(role) OVER (PARTITION BY session_id ORDER BY hop) AS previous_role, lag(tool_call) OVER (PARTITION BY session_id ORDER BY hop) AS previous_call, lag(tool_calls) OVER (PARTITION BY session_id ORDER BY hop) AS previous_calls,
  CAST(count(*) OVER (PARTITION BY session_id, source ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS agent_count,
  CAST(coalesce(sum(length(coalesce(content, ''))) OVER (PARTITION BY session_id, source ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS agent_chars,
  count(*) OVER (PARTITION BY session_id, source, tool_name ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS tool_seen FROM pre0
), sig0 AS (SELECT *,
  coalesce({UNTRUSTED} AND previous_role = 'assistant' AND len(list_filter(list_concat({call_strings('previous_call')}, {call_strings('previous_calls')}), lambda a: length(a) >= 4 AND contains(lower(goal), lower(a)))) > 0, false) AS designated,
  CAST(greatest(CASE WHEN coalesce(tool_name, '') <> '' AND agent_count >= 3 AND NOT tool_seen THEN CASE WHEN outbound THEN 0.8 ELSE 0.3 END ELSE 0.0 END,
    CASE WHEN agent_count >= 3 AND agent_chars > 0 AND length(coalesce(content, '')) * agent_count > 4 * agent_chars THEN 0.3 ELSE 0.0 END) AS DOUBLE) AS behaviour,
  CAST(CASE WHEN mutating AND coalesce(goal, '') <> '' AND action_text <> '' THEN greatest(0.0, least(1.0, (0.35 - {cosine(tokens("coalesce(goal, '')"), tokens('action_text'))}) / 0.35)) ELSE 0.0 END AS DOUBLE) AS drift,
  {echo()} AS echo, CASE WHEN mutating THEN {unasked()} END AS verb_unasked, {deobfuscated('hop_text')} AS canonical FROM pre
), sig AS (SELECT *, {indicators('canonical')} AS items FROM sig0)"""

ORIGINS = f"""
reg AS (SELECT session_id, hop, source, CASE WHEN {TRUSTED} THEN 'trusted' WHEN designated THEN 'designated' ELSE 'plain' END AS kind,
  unnest(list_distinct(list_concat(items, list_concat({text_parts('canonical')}, flatten(list_transform(items, lambda i: {item_parts('i')})))))) AS key FROM sig WHERE {TRUSTED} OR {UNTRUSTED}
), org AS (SELECT session_id, key, min(hop) FILTER (kind = 'trusted') AS trusted_hop, min(hop) FILTER (kind = 'plain') AS plain_hop, arg_min(source, hop) FILTER (kind = 'plain') AS plain_source,
  coalesce(list(hop ORDER BY hop) FILTER (kind = 'designated'), CAST([] AS INTEGER[])) AS named, coalesce(list(source ORDER BY hop) FILTER (kind = 'designated'), CAST([] AS VARCHAR[])) AS named_sources FROM reg GROUP BY 1, 2
), its AS (SELECT session_id, hop, unnest(items) AS item FROM sig
), cand AS (SELECT session_id, hop, item, item AS key, true AS exact FROM its UNION ALL
  SELECT session_id, hop, item, key, false FROM (SELECT *, unnest(list_distinct(list_concat(list_filter({item_parts('item')}, lambda k: length(k) >= 6),
    CASE WHEN regexp_matches(item, '^[A-Za-z0-9]+$') AND length(item) > 6 THEN list_concat(list_transform(range(6, length(item)), lambda n: left(item, n)), list_transform(range(6, length(item)), lambda n: right(item, n))) ELSE CAST([] AS VARCHAR[]) END))) AS key FROM its)
), kn AS (SELECT c.session_id, c.hop, c.item, c.key, c.exact, coalesce(trusted_hop < c.hop, false) AS supplied, CASE WHEN plain_hop < c.hop THEN plain_hop END AS plain_hop,
  CASE WHEN plain_hop < c.hop THEN plain_source END AS plain_source, list_filter(named, lambda h: h < c.hop) AS named, named_sources FROM cand c JOIN org o ON c.session_id = o.session_id AND c.key = o.key)"""

def verdicts(weights: dict = V.WEIGHTS, scores: str | None = None) -> str:
    """``scores`` names a table (session_id, hop, model) in place of the rule detector."""
    model = "1.0 - 0.9 * instruction" if scores is None else f"(SELECT model FROM {scores} s WHERE s.session_id = sig.session_id AND s.hop = sig.hop)"
    return f"""
ks AS (SELECT session_id, hop, list({{'item': item, 'key': key, 'exact': exact, 'supplied': supplied, 'plain': plain_hop, 'named': named}}) AS keys FROM kn WHERE supplied OR plain_hop IS NOT NULL OR len(named) > 0 GROUP BY 1, 2
), st AS (SELECT sig.session_id, sig.hop, role, source || '->' || target AS channel, instruction, drift, behaviour, echo, outbound, coalesce(claims > 0 AND verb_unasked, false) AS unasked,
  (role = 'assistant' AND action_text <> '') OR role = 'memory_write' AS acts, {model} AS model, keys FROM sig LEFT JOIN ks ON sig.session_id = ks.session_id AND sig.hop = ks.hop
), run AS (
  SELECT session_id, 0 AS hop, CAST(NULL AS VARCHAR) AS role, CAST('' AS VARCHAR) AS channel, CAST(NULL AS DOUBLE) AS model_trust, CAST(0 AS DOUBLE) AS instruction, CAST(0 AS DOUBLE) AS drift,
    CAST(0 AS DOUBLE) AS provenance, CAST(0 AS DOUBLE) AS behaviour, CAST(0 AS DOUBLE) AS before, CAST(1 AS DOUBLE) AS trust, false AS shut, CAST([] AS VARCHAR[]) AS matches, CAST([] AS STRUCT("key" VARCHAR, hop INTEGER)[]) AS reused, CAST([] AS VARCHAR[]) AS given,
    CAST(0 AS DOUBLE) AS sens, CAST([] AS VARCHAR[]) AS suspended, CAST([] AS DOUBLE[]) AS risks
  FROM (SELECT DISTINCT session_id FROM ev)
  UNION ALL
  SELECT session_id, hop, role, channel, model_trust, instruction, drift, provenance, behaviour, before, trust, shut, matches, CAST(list_sort(list_distinct(list_transform(hit, lambda k: {{'key': k.key, 'hop': k.origin}}))) AS STRUCT("key" VARCHAR, hop INTEGER)[]), given,
    CASE WHEN trust < {V.PASS_AT} THEN least({V.SENSITIVITY_CAP}, before + {V.SENSITIVITY_STEP}) ELSE before END,
    CASE WHEN trust < {V.QUARANTINE_AT} AND NOT list_contains(suspended, channel) THEN list_append(suspended, channel) ELSE suspended END, list_append(risks, 1.0 - trust)
  FROM (SELECT *, CAST(CASE WHEN anchor THEN 1.0 WHEN shut THEN 0.0 ELSE
      1.0 - least(1.0, (1.0 - model_trust * (1.0 - {weights['instruction']} * instruction) * (1.0 - {weights['drift']} * drift) * (1.0 - {weights['provenance']} * provenance) * (1.0 - {weights['behaviour']} * behaviour)) * (1.0 + before)) END AS DOUBLE) AS trust
    FROM (SELECT *, CAST(CASE WHEN anchor OR shut THEN 0.0 ELSE greatest(
        CASE WHEN len(matches) = 0 THEN 0.0 ELSE (CASE WHEN risky THEN 1.0 WHEN outbound THEN 0.9 ELSE 0.5 END) * (CASE WHEN role = 'memory_write' THEN 0.6 ELSE 1.0 END) END,
        CASE WHEN echo > 0 THEN 0.9 WHEN unasked AND len(list_filter(ts, lambda k: k.exact AND k.ok)) = 0 THEN 0.75 ELSE 0.0 END) END AS DOUBLE) AS provenance
      FROM (SELECT *, list_sort(list_distinct(list_transform(used, lambda k: k.key))) AS matches,
          len(list_filter(used, lambda k: round(risks[k.origin], 3) >= 0.25)) > 0 AS risky
        FROM (SELECT *, list_filter(hit, lambda k: acts AND NOT anchor AND NOT shut) AS used FROM (SELECT *, list_sort(list_distinct(list_transform(list_filter(ts, lambda k: k.exact AND k.ok), lambda k: k.item))) AS given, CASE WHEN len(list_filter(ts, lambda k: k.exact AND NOT k.ok AND k.origin IS NOT NULL)) > 0
              THEN list_filter(ts, lambda k: k.exact AND NOT k.ok AND k.origin IS NOT NULL)
              ELSE list_filter(ts, lambda k: NOT k.exact AND NOT k.ok AND k.origin IS NOT NULL AND NOT list_contains(list_transform(list_filter(ts, lambda x: x.exact AND x.ok), lambda x: x.item), k.item)) END AS hit
          FROM (SELECT st.session_id, st.hop, st.role, st.channel, CAST(CASE WHEN st.role IN ('user', 'system') OR list_contains(run.suspended, st.channel) THEN NULL ELSE st.model END AS DOUBLE) AS model_trust,
              st.instruction, st.drift, st.behaviour, st.echo, st.outbound, st.unasked, st.acts, run.sens AS before, run.suspended, run.risks,
              st.role IN ('user', 'system') AS anchor, st.role NOT IN ('user', 'system') AND list_contains(run.suspended, st.channel) AS shut,
              list_transform(coalesce(st.keys, []), lambda k: {{'item': k.item, 'key': k.key, 'exact': k.exact, 'ok': k.supplied OR len(list_filter(k.named, lambda h: run.risks[h] < 0.25)) > 0,
                'origin': list_min(list_concat(list_filter([k.plain], lambda p: p IS NOT NULL), list_filter(k.named, lambda h: run.risks[h] >= 0.25)))}}) AS ts
            FROM run JOIN st ON st.session_id = run.session_id AND st.hop = run.hop + 1))))))
), ver AS (SELECT *, {tier('trust')} AS tier FROM run WHERE hop > 0)"""
