"""Catalogue queries on records: transcripts, supervised rows, allocation, audits, replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import text as T
from hopwise.operators import datasets as D
from hopwise.operators import evaluate as E
from hopwise.operators import fold
from hopwise.operators import records as X
from hopwise.plans import sql as S
from hopwise.plans.datasets import _PLANTED, SCORED, planted, scored
from hopwise.plans.registry import query, read
from hopwise.plans.sessions import EV, VER, events_hops

_MOD = "CASE WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END"


@query(f"{EV} SELECT session_id, hop, concat_ws(' ', nullif(content, ''), nullif(tool_response, ''), nullif(action_text, '')) AS text FROM ev")
def message_text(spark, d):
    return events_hops(spark, d).select("session_id", "hop", X.message_text(F.col("content"), F.col("tool_response"), F.col("action_text")).alias("text"))


@query(f"""{EV}, l AS (SELECT session_id, hop, role, source, target, coalesce(content, '') || CASE WHEN action_text <> '' THEN ' | CALL ' || action_text ELSE '' END AS s FROM ev
), t AS (SELECT session_id, string_agg('[hop ' || hop || '] ' || role || ' ' || source || ' -> ' || target || ': ' || CASE WHEN length(s) > 60 THEN left(s, 30) || ' [...] ' || right(s, 30) ELSE s END, chr(10) ORDER BY hop) AS t FROM l GROUP BY 1)
SELECT session_id, CASE WHEN length(t) > 2000 THEN left(t, 666) || chr(10) || '[... middle of session omitted ...]' || chr(10) || right(t, 1334) ELSE t END AS transcript FROM t""")
def session_transcript(spark, d):
    return X.transcripts(events_hops(spark, d), 2_000, 60)


@query(f"""WITH p AS ({_PLANTED}), c AS (SELECT *, CAST(unnest(st) AS INTEGER) AS s FROM (SELECT *, CASE WHEN length(t) <= 900 THEN [0] ELSE list_append(range(0, length(t) - 900, 450), length(t) - 900) END AS st FROM p)
), h AS (SELECT id, s, substr(t, CAST(s + 1 AS BIGINT), 900) AS text, CASE WHEN start IS NULL THEN 0.0 ELSE CAST(greatest(0, least(stop, least(s + 900, length(t))) - greatest(start, s)) AS DOUBLE) / (stop - start) END AS share FROM c
), k AS (SELECT id, s, text, CASE WHEN share >= 0.6 THEN 0 WHEN share = 0 THEN 1 END AS label FROM h)
SELECT id, min(label) AS label, count(*) AS n_chunks, sha256(string_agg(text, chr(10) ORDER BY s)) AS texts_sha256 FROM k WHERE label IS NOT NULL GROUP BY 1""")
def supervised_events(spark, d):
    rows = planted(spark, d)
    labels = D.chunk_labels(rows, T.chunk_spans(F.length("t")))
    chunks = labels.join(rows.select("id", "t"), "id").select("id", "chunk", "label", F.substring("t", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("text"))
    return X.supervised_events(chunks).select("id", "label", "n_chunks", F.sha2(F.array_join("texts", "\n"), 256).alias("texts_sha256"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS n_ids, count(*) - count(DISTINCT id) AS duplicates FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT item_id FROM benchmark)")
def merge_report(spark, d):
    ids = read(spark, d, "documents").select(F.col("doc_id").alias("id")).unionAll(read(spark, d, "labels").select("doc_id")).unionAll(read(spark, d, "benchmark").select("item_id"))
    return ids.groupBy("id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_ids")).withColumn("duplicates", F.col("n") - F.col("n_ids"))


@query("SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM labels) WHERE r <= 10")
def sample_picker(spark, d):
    """A few of each class, in order."""
    rows = read(spark, d, "labels").select("doc_id", "toxic")
    return rows.where("toxic = 1").orderBy("doc_id").limit(10).unionByName(rows.where("toxic = 0").orderBy("doc_id").limit(10))


@query("SELECT doc_id, sha256(text) AS clean_sha256 FROM documents WHERE text IS NOT NULL")
def strip_marks(spark, d):
    """Texts that came in marks of either case, once more without them."""
    t = F.concat(F.lit("<INFORMATION>"), F.expr("left(text, 40)"), F.lit("</information>"), F.expr("substring(text, 41)"))
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(X.without_marks(t, "information"), 256).alias("clean_sha256"))


@query("SELECT page_id, 'Visit ' || CASE page_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'work' ELSE 'school' END || ' and ' || CASE page_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'work' ELSE 'school' END AS filled FROM pages")
def fill_placeholders(spark, d):
    return read(spark, d, "pages").select("page_id", X.filled(F.lit("Visit <place> and <place>"), "<place>", ["home", "work", "school"], F.col("page_id")).alias("filled"))


@query(f"SELECT doc_id, unnest(list_filter({S.indicators('text')}, lambda i: contains(i, '@'))) AS address FROM documents")
def addresses(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(X.addresses(F.col("text"))).alias("address"))


_TAXONOMY = {"click": "browse", "view": "browse", "purchase": "commerce", "signup": "identity"}


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse' WHEN 'purchase' THEN 'commerce' WHEN 'signup' THEN 'identity' END AS class, count(*) AS n FROM events GROUP BY 1")
def taxonomy_map(spark, d):
    table = F.create_map(*[F.lit(x) for pair in _TAXONOMY.items() for x in pair])
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", table[F.col("event_type")].alias("class"), "n")


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def unmapped_types(spark, d):
    known = spark.createDataFrame([(k,) for k in _TAXONOMY], "event_type string")
    return read(spark, d, "events").select("event_type").distinct().join(F.broadcast(known), "event_type", "left_anti")


@query("WITH g AS (SELECT source, min(doc_id) % 17 AS g FROM documents GROUP BY 1) SELECT doc_id, g AS \"group\" FROM documents JOIN g USING (source)")
def first_group(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return docs.join(X.first_group(docs, "source", "doc_id"), "source").select("doc_id", "group")


@query("SELECT item_id, doc_id FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY sha256(b.item_id || '|' || d.doc_id)) AS r FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 5)) WHERE r = 1")
def hash_draw(spark, d):
    """For every item one carrier of its source, drawn by hash."""
    items = read(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 5).alias("source"))
    docs = read(spark, d, "documents").select("doc_id", "source")
    return X.drawn(items, docs, ["source"], F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), F.col("doc_id").cast("string")), 256), "item_id").select("item_id", "doc_id")


@query("SELECT doc_id, bool_or(least(s + 900, length(text)) - s > 500) AS alarm FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 900 THEN [0] ELSE list_append(range(0, length(text) - 900, 450), length(text) - 900) END) AS s FROM documents) GROUP BY 1")
def length_alarm(spark, d):
    """An event is flagged if any of its chunks is longer than a limit."""
    rows = read(spark, d, "documents").select("doc_id", F.inline(T.chunk_spans(F.length("text"))))
    return rows.groupBy("doc_id").agg(F.bool_or(F.col("end") - F.col("start") > 500).alias("alarm"))


@query(f"WITH {SCORED} SELECT lang, CAST(n_chars // 1000 AS BIGINT) AS depth, count(*) AS n, round(avg(CAST(trust < 0.5 AS INTEGER)), 4) AS recall FROM sc WHERE label = 0 GROUP BY 1, 2")
def recall_by_depth(spark, d):
    """Recall of attacks by class and depth."""
    rows = scored(spark, d).where("label = 0").groupBy("lang", F.expr("cast(n_chars div 1000 as bigint)").alias("depth"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("trust") < 0.5).cast("int")), 4).alias("recall"))


@query(f"""WITH {SCORED}, v AS (SELECT lang, min(trust) AS threshold FROM sc WHERE doc_id % 2 = 0 AND label = 1 GROUP BY 1), t AS (SELECT sc.lang, coalesce(threshold, 0.5) AS threshold, label, trust FROM sc LEFT JOIN v USING (lang) WHERE doc_id % 2 = 1)
SELECT lang, threshold, count(*) FILTER (label = 0 AND trust < threshold) AS tp, count(*) FILTER (label = 0) AS bad, count(*) FILTER (label = 1 AND trust < threshold) AS fp, count(*) FILTER (label = 1) AS good FROM t GROUP BY 1, 2""")
def transferred_threshold(spark, d):
    """A threshold from one half (the least trust of a safe text), applied to the other."""
    rows = scored(spark, d)
    least = rows.where("doc_id % 2 = 0 and label = 1").groupBy("lang").agg(F.min("trust").alias("threshold"))
    return X.transferred_threshold(least, rows.where("doc_id % 2 = 1"), "lang")


@query(f"""{EV}, s AS (SELECT session_id, list(hop ORDER BY hop) AS hops, session_id % 40 AS g FROM ev GROUP BY 1), a AS (SELECT *, CASE WHEN g % 17 < 12 THEN 'train' WHEN g % 17 < 14 THEN 'validation' ELSE 'test' END AS split FROM s)
SELECT count(*) AS n, bool_and(hops = range(1, len(hops) + 1)) AS numbered, bool_and(split IN ('train', 'validation', 'test')) AS known_splits, count(*) = count(DISTINCT session_id) AS unique_ids, CAST((SELECT count(*) FROM (SELECT g FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS BIGINT) AS leaking_groups FROM a""")
def dataset_audit(spark, d):
    s = events_hops(spark, d).groupBy(F.col("session_id").alias("sample_id")).agg(F.array_sort(F.collect_list("hop")).alias("hops")).withColumn("group", F.col("sample_id") % 40)
    return X.session_audit(s.withColumn("split", D.mod_split(F.col("group"))))


@query(f"""{VER} SELECT ver.session_id, ver.hop, ver.role = 'assistant' AND tier IN ('PASS', 'FLAG') AS executed,
  CASE WHEN tier IN ('PASS', 'FLAG') THEN coalesce(nullif(content, ''), action_text) WHEN ver.role = 'assistant' THEN '[call withheld]' ELSE '[data withheld]' END AS output FROM ver JOIN ev ON ev.session_id = ver.session_id AND ev.hop = ver.hop""")
def held_outputs(spark, d):
    """The gate of a running agent: held calls are not executed, held data is replaced."""
    judged = fold.verdicts(events_hops(spark, d), more=("content", "action_text"))
    return X.replaced(judged).select("session_id", "hop", "executed", "output")


@query(f"{VER} SELECT role, count(*) AS n, count(*) FILTER (tier NOT IN ('PASS', 'FLAG')) AS withheld, round(avg(trust), 6) AS mean_trust FROM ver GROUP BY 1")
def monitor_counters(spark, d):
    judged = fold.verdicts(events_hops(spark, d))
    return judged.groupBy("role").agg(F.count("*").alias("n"), F.count_if(~F.col("delivered")).alias("withheld"), F.round(F.avg("trust"), 6).alias("mean_trust"))


@query(f"{EV} SELECT session_id, round(min(CASE WHEN role IN ('user', 'system') THEN 1.0 ELSE 1.0 - 0.9 * {S.instruction()} END), 6) AS least, min(CASE WHEN role IN ('user', 'system') THEN 1.0 ELSE 1.0 - 0.9 * {S.instruction()} END) < 0.5 AS held FROM ev GROUP BY 1")
def stateless_sessions(spark, d):
    """A session-level system without state: the least trust of any event decides."""
    h = events_hops(spark, d)
    trust = F.when(R.trusted(F.col("role")), 1.0).otherwise(1.0 - 0.9 * R.instruction_risk(F.col("role"), F.col("data_text")))
    return h.groupBy("session_id").agg(F.min(trust).alias("t")).select("session_id", F.round("t", 6).alias("least"), (F.col("t") < 0.5).alias("held"))


@query(f"WITH {SCORED}, m AS (SELECT doc_id, label, trust < 0.5 AS held, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM sc WHERE (trust < 0.5) <> (label = 0)) SELECT doc_id, label, held, n FROM m WHERE r <= 5")
def first_mistakes(spark, d):
    """The first false alarms and misses, and how many there are."""
    return E.first_mistakes(scored(spark, d), F.col("trust") < 0.5, 5).select("doc_id", "label", "held", "n")
