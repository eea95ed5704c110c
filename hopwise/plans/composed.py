"""Catalogue queries that go from sessions to files and back: replay, builders, sinks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.functions import vocabulary as V
from hopwise.operators import datasets as D
from hopwise.operators import evaluate as E
from hopwise.operators import audit, fold, replay, verdict_log
from hopwise.operators import records as X
from hopwise.plans import sql as S
from hopwise.plans.datasets import SCORED, _counts, _rounded, _summary, scored
from hopwise.plans.registry import query, read
from hopwise.plans.sessions import STATIC, events_hops, static_log
from hopwise.sources import datasets as DS
from hopwise.sources.folders import scratch
from hopwise.sources.hops import CLASSES, EV_SQL, KINDS, VECTORS, read_session_documents, read_sessions, session_errors, session_hops

_MOD = "CASE WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END"


@query(f"""WITH {EV_SQL}, {S.PREFIX}, {S.ORIGINS}, lb AS (SELECT session_id, hop, role, source || '->' || target AS channel, CASE WHEN role = 'tool' AND k % 10 IN (1, 2) THEN 1.0 ELSE 0.0 END AS risk FROM ev
), rk AS (SELECT session_id, list(risk ORDER BY hop) AS risks FROM lb GROUP BY 1
), ts AS (SELECT kn.session_id, kn.hop, kn.item, kn.key, kn.exact, supplied OR len(list_filter(named, lambda h: risks[h] < 0.25)) > 0 AS ok,
  list_min(list_concat(list_filter([plain_hop], lambda p: p IS NOT NULL), list_filter(named, lambda h: risks[h] >= 0.25))) AS origin, risks FROM kn JOIN rk ON rk.session_id = kn.session_id
), gv AS (SELECT session_id, hop, list(DISTINCT item ORDER BY item) AS given FROM ts WHERE exact AND ok GROUP BY 1, 2
), wh AS (SELECT session_id, hop, list(DISTINCT key ORDER BY key) AS keys, bool_or(risks[origin] >= 0.25) AS risky FROM ts WHERE exact AND NOT ok AND origin IS NOT NULL GROUP BY 1, 2
), fr AS (SELECT ts.session_id, ts.hop, list(DISTINCT key ORDER BY key) AS keys, bool_or(risks[origin] >= 0.25) AS risky FROM ts LEFT JOIN gv ON gv.session_id = ts.session_id AND gv.hop = ts.hop
  WHERE NOT exact AND NOT ok AND origin IS NOT NULL AND NOT list_contains(coalesce(given, []), item) GROUP BY 1, 2)
SELECT lb.session_id, lb.hop, CAST(round(least({V.SENSITIVITY_CAP}, {V.SENSITIVITY_STEP} * coalesce(sum(CAST(1.0 - risk < {V.PASS_AT} AS INTEGER)) OVER {S.BEFORE.replace('PARTITION BY session_id', 'PARTITION BY lb.session_id').replace('ORDER BY hop', 'ORDER BY lb.hop')}, 0)), 4) AS DOUBLE) AS sensitivity,
  role NOT IN ('user', 'system') AND coalesce(bool_or(1.0 - risk < {V.QUARANTINE_AT}) OVER (PARTITION BY lb.session_id, channel ORDER BY lb.hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS suspended,
  array_to_string(coalesce(wh.keys, fr.keys, []), ',') AS reused, array_to_string(coalesce(given, []), ',') AS given, coalesce(wh.risky, fr.risky, false) AS risky
FROM lb LEFT JOIN wh ON wh.session_id = lb.session_id AND wh.hop = lb.hop LEFT JOIN fr ON fr.session_id = lb.session_id AND fr.hop = lb.hop LEFT JOIN gv ON gv.session_id = lb.session_id AND gv.hop = lb.hop""")
def label_replay(spark, d):
    """Session signals of labelled sessions: data with a note or a claim is malicious, all else safe."""
    hops = events_hops(spark, d)
    hops = hops.withColumn("risk", F.when((F.col("role") == "tool") & (F.col("k") % 10).isin(1, 2), 1.0).otherwise(0.0))
    rows = replay.replayed(hops, "risk")
    return rows.withColumns({"reused": F.array_join("reused", ","), "given": F.array_join("given", ",")})


_EX = f"SELECT {_MOD} AS split, CASE toxic WHEN 1 THEN 'malicious' ELSE 'safe' END AS label, lang FROM documents JOIN labels USING (doc_id)"


@query(f"""WITH e AS ({_EX}), c AS (SELECT 'total' AS field, 'all' AS value, count(*) AS n FROM e UNION ALL SELECT 'split', s, count(split) FROM (SELECT unnest(['train', 'validation', 'test', 'external']) AS s) LEFT JOIN e ON split = s GROUP BY s
  UNION ALL SELECT 'split/label', s || '/' || l, count(split) FROM (SELECT unnest(['train', 'validation', 'test']) AS s) CROSS JOIN (SELECT unnest(['malicious', 'safe']) AS l) LEFT JOIN e ON split = s AND label = l GROUP BY s, l
  UNION ALL SELECT 'split', 'other', 0 UNION ALL SELECT 'split/label', 'other', 0) SELECT field, value, n FROM c""")
def dataset_write(spark, d):
    """Examples written as JSON lines; their statistics, taken in the same pass, as read back."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    rows = docs.select("doc_id", "text", D.mod_split(F.col("doc_id")).alias("split"), F.when(F.col("toxic") == 1, "malicious").otherwise("safe").alias("label"))
    splits = ["train", "validation", "test"]
    path = scratch(spark, "hopwise-dataset")
    DS.write_with_statistics(rows, path, {"split": [*splits, "external"], "split/label": [f"{s}/{x}" for s in splits for x in ("malicious", "safe")]})
    return DS.read_statistics(spark, path)


@query("""WITH c AS (SELECT conv_id, count(*) AS n, conv_id % 16 AS suite FROM conversations GROUP BY conv_id)
SELECT conv_id, n AS n_messages, suite // 5 AS place, 'suite=' || suite AS path FROM c WHERE suite % 5 = 0""")
def selected_sessions(spark, d):
    """Session files below a folder, of which a list of paths is read, in the list's order."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    folder = scratch(spark, "hopwise-sessions")
    turns.withColumn("suite", F.col("conv_id") % 16).write.partitionBy("suite").json(folder)
    wanted = spark.createDataFrame([(i, f"suite={s}") for i, s in enumerate(range(0, 16, 5))], "place int, path string")
    rows = DS.read_selected(spark, folder, "conv_id long, messages array<struct<turn:long,role:string,text:string>>", wanted, "suite")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.col("place").cast("long").alias("place"), "path")


@query("""SELECT page_id, '{"<information>":"' || url || '","a":[{"b":{"c":["' || url || '",' || page_id || ',null]}},"' || url || '"]}' AS clean FROM pages""")
def nested_marks(spark, d):
    """Marks in strings of nested values, half of them no JSON but literals; keys keep theirs."""
    u = F.concat(F.expr("left(url, 5)"), F.lit("<INFORMATION>"), F.expr("substring(url, 6)"), F.lit("</information>"))
    json_text = F.concat(F.lit('{"<information>": "'), u, F.lit('", "a": [{"b": {"c": ["'), u, F.lit('", '), "page_id", F.lit(', null]}}, "'), u, F.lit('"]}'))
    literal = F.concat(F.lit("{'<information>': '"), u, F.lit("', 'a': [{'b': {'c': ['"), u, F.lit("', "), "page_id", F.lit(", None]}}, '"), u, F.lit("']}"))
    rows = read(spark, d, "pages")
    return rows.select("page_id", X.without_nested_marks(F.when(F.col("page_id") % 2 == 0, json_text).otherwise(literal), "information").alias("clean"))


_CASES = "SELECT conv_id, any_value(text) FILTER (turn = 0) AS instruction, any_value(text) FILTER (turn = 1) AS response, CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE any_value(text) FILTER (turn = 2) END AS attack FROM conversations GROUP BY 1"


@query(f"""WITH c AS ({_CASES}), r AS (SELECT *, CASE WHEN instruction IS NULL THEN 'instruction is missing' WHEN response IS NULL THEN 'response is missing' WHEN attack IS NULL THEN 'attack is missing' WHEN trim(attack) = '' THEN 'attack is blank' END AS reason FROM c)
SELECT conv_id, reason, CASE WHEN reason IS NULL THEN sha256('1:user:' || instruction || '|2:tool_response:' || response || '|3:attacker_instruction:' || attack) END AS messages_sha256 FROM r""")
def built_records(spark, d):
    """Wide cases as session records, the others with the reason why they are none."""
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    cases = read(spark, d, "conversations").groupBy("conv_id").agg(turn(0).alias("instruction"), turn(1).alias("response"), turn(2).alias("attack"))
    cases = cases.withColumn("attack", F.when(F.col("conv_id") % 7 == 0, "  ").otherwise(F.col("attack")))
    good, bad = X.built(cases, [("instruction", "user", "user"), ("response", "tool_response", "user_tool"), ("attack", "attacker_instruction", "attacker")], "conv_id")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["hop"].cast("string"), F.lit(":"), m["role"], F.lit(":"), m["content"])), "|")
    good = good.select("conv_id", F.lit(None).cast("string").alias("reason"), F.sha2(text, 256).alias("messages_sha256"))
    return good.unionByName(bad.withColumn("messages_sha256", F.lit(None).cast("string")))


_SPLIT = SCORED.replace("AS trust FROM", f"AS trust, {_MOD.replace('doc_id', 'd.doc_id')} AS split FROM")
_GROUPED = "SELECT split, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS what, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'all' END AS value, threshold, "


@query(f"""WITH {_SPLIT}, va AS (SELECT * FROM sc WHERE split = 'validation'), cd AS (SELECT DISTINCT trust AS t FROM va UNION SELECT 1.0),
cn AS (SELECT t, count(*) FILTER (label = 0 AND trust < t) AS tp, count(*) FILTER (label = 0 AND trust >= t) AS fn, count(*) FILTER (label = 1 AND trust < t) AS fp, count(*) FILTER (label = 1 AND trust >= t) AS tn FROM cd CROSS JOIN va GROUP BY t),
rt AS (SELECT t, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END AS f1 FROM cn WHERE (CASE WHEN fp + tn = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / (fp + tn) END) <= 0.05),
th AS (SELECT coalesce((SELECT t FROM rt ORDER BY round(f1, 12) DESC, t LIMIT 1), 0.5) AS threshold),
{_summary(f"{_GROUPED}{_counts('trust < threshold')} FROM sc CROSS JOIN th WHERE split <> 'validation' GROUP BY GROUPING SETS ((split, threshold), (split, threshold, lang), (split, threshold, source))", 'split, what, value, threshold').replace('SELECT split', 'rp AS (SELECT split', 1)}) SELECT * FROM rp""")
def split_report(spark, d):
    """Quality of every split, language and source at the threshold of the validation split."""
    rows = scored(spark, d).withColumn("split", D.mod_split(F.col("doc_id")))
    found = E.report(rows, F.col("split") == "validation", "lang", "source")
    return _rounded(found)


@query(f"{STATIC} SELECT id, session_id, hop, tier FROM vlog")
def log_append(spark, d):
    """Verdicts added to the log in two batches, as read back."""
    log, path = static_log(spark, d).select("id", "session_id", "hop", "tier"), scratch(spark, "hopwise-log")
    for part in (0, 1):
        verdict_log.append(log.where(F.pmod("session_id", F.lit(2)) == part), path)
    return spark.read.parquet(path).select("id", "session_id", "hop", "tier")


@query(f"{STATIC} SELECT DISTINCT session_id FROM vlog WHERE session_id <> (SELECT min(user_id) FROM events)")
def log_sessions(spark, d):
    """Sessions in the log once the first has been dropped."""
    log = static_log(spark, d)
    return verdict_log.sessions(verdict_log.drop_session(log, log.agg(F.min("session_id")).first()[0]))


def _controls(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    shut = fold.verdicts(hops).where("suspended")
    path = scratch(hops.sparkSession, "hopwise-releases")  # read twice, judged once
    shut.groupBy("session_id", "channel").agg(F.min("hop").alias("hop")).write.parquet(path)
    releases = hops.sparkSession.read.parquet(path)
    return releases, hops.where("session_id % 4 = 0 and hop in (15, 31)").select("session_id", "hop")


@query()
def controlled_verdicts(spark, d):
    """The fold with controls: a channel is released where it first would hold back an event, and
    every fourth session starts afresh at hops 15 and 31."""
    hops = events_hops(spark, d)
    releases, resets = _controls(hops)
    judged = fold.verdicts(hops, releases=releases, resets=resets)
    return judged.select("session_id", "hop", "tier", F.round("trust", 6).alias("trust"), "suspended", "sensitivity")


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS hop, role, sha256(text) AS text_sha256
FROM conversations WHERE conv_id % 4 = 0 OR conv_id % 4 = 3""")
def session_files(spark, d):
    """Runtime hops of the test split from several session files; in one of them another split stands
    for it, and one is missing."""
    m = F.struct(F.col("turn").cast("int").alias("hop"), "role", F.col("role").alias("source"), F.lit("agent").alias("target"), F.col("text").alias("content"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    kind = F.col("conv_id") % 4
    split = F.when(kind == 0, "test").when(kind == 1, "train").when(kind == 2, "test").otherwise("external")
    rows = rows.select(F.col("conv_id").cast("string").alias("sample_id"), split.alias("split"), "messages", (kind < 2).alias("own"))
    folder = scratch(spark, "hopwise-session-files")
    rows.where("own").drop("own").write.json(f"{folder}/own")
    rows.where("not own").drop("own").write.json(f"{folder}/other")
    sessions = read_sessions(spark, [f"{folder}/own", f"{folder}/other", f"{folder}/missing"], "test", elsewhere={f"{folder}/other": "external"})
    return session_hops(sessions).select("session_id", "hop", "role", F.sha2("content", 256).alias("text_sha256"))


_WRITTEN = """SELECT conv_id, list({'role': CASE WHEN conv_id % 9 = 2 AND turn = 1 THEN 'robot' ELSE role END, 'turn': turn} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id"""


@query(f"""WITH w AS ({_WRITTEN}), e AS (
  SELECT conv_id, 'needs at least 3 messages' AS error FROM w WHERE len(ms) < 3
  UNION ALL SELECT conv_id, 'attack_class must be one of {", ".join(CLASSES)}' FROM w WHERE conv_id % 3 = 0 AND conv_id % 5 = 4
  UNION ALL SELECT conv_id, 'benign_kind must be one of {", ".join(KINDS)}' FROM w WHERE conv_id % 3 = 1 AND conv_id % 5 = 4
  UNION ALL SELECT conv_id, 'is_attack must be true or false' FROM w WHERE conv_id % 3 = 2
  UNION ALL SELECT conv_id, 'first message must be the user''s request' FROM w WHERE ms[1].role <> 'user'
  UNION ALL SELECT conv_id, 'message ' || i || ': unknown role' FROM (SELECT conv_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM w) WHERE m.role = 'robot'
  UNION ALL SELECT conv_id, 'message ' || i || ': source and target are required' FROM (SELECT conv_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM w) WHERE m.role = 'system')
SELECT CAST(conv_id AS VARCHAR) AS id, error FROM e""")
def session_documents(spark, d):
    """Sessions as people write them, lists of JSON documents in files, and what they have to mend."""
    some = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("conv_id") % 5).cast("int"))
    role = F.when((F.col("conv_id") % 9 == 2) & (F.col("turn") == 1), "robot").otherwise(F.col("role"))
    m = F.struct("turn", role.alias("role"), F.when(role != "system", role).alias("source"), F.lit("agent").alias("target"), F.col("text").alias("content"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    attack = F.when(F.col("conv_id") % 3 == 0, True).when(F.col("conv_id") % 3 == 1, False)
    doc = F.struct(
        F.col("conv_id").cast("string").alias("id"), attack.alias("is_attack"), some([*CLASSES[:4], "other"]).alias("attack_class"), some(VECTORS).alias("attack_vector"), some([*KINDS, "other"]).alias("benign_kind"), "messages"
    )
    folder = scratch(spark, "hopwise-written")
    files = rows.groupBy((F.col("conv_id") % 64).alias("file")).agg(F.to_json(F.collect_list(doc)).alias("value"))
    files.write.partitionBy("file").text(folder)
    return session_errors(read_session_documents(spark, folder, "*.txt")).select("id", "error")


_RECORDS = f"""SELECT doc_id AS sample_id, CASE WHEN doc_id % 97 = 3 THEN 'other' ELSE {_MOD} END AS split, doc_id % 3 = 0 AS is_attack,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 41 = 0 THEN 'unknown' ELSE '{CLASSES[0]}' END WHEN doc_id % 53 = 1 THEN '{CLASSES[1]}' END AS attack_class,
  lang, source, doc_id % 61 = 5 AS gap, md5(text) AS k0, CASE WHEN length(text) >= 40 THEN left(text, 40) END AS k1 FROM documents"""


@query(f"""WITH RECURSIVE r AS ({_RECORDS}), e AS (SELECT DISTINCT a.sample_id AS a, b.sample_id AS b FROM r a JOIN r b ON a.k0 = b.k0 UNION SELECT DISTINCT a.sample_id, b.sample_id FROM r a JOIN r b ON a.k1 = b.k1),
w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b), g AS (SELECT a AS sample_id, min(b) AS grp FROM w GROUP BY a),
gs AS (SELECT grp FROM (SELECT sample_id, coalesce(grp, sample_id) AS grp, split FROM r LEFT JOIN g USING (sample_id)) GROUP BY grp HAVING count(DISTINCT split) > 1),
x AS (SELECT 'unique_sample_ids' AS rule, sample_id FROM r WHERE false UNION ALL SELECT 'required_fields', sample_id FROM r WHERE lang IS NULL OR source IS NULL OR split IS NULL
  UNION ALL SELECT 'message_structure', sample_id FROM r WHERE gap UNION ALL SELECT 'valid_splits', sample_id FROM r WHERE split = 'other'
  UNION ALL SELECT 'benign_class_null', sample_id FROM r WHERE NOT is_attack AND attack_class IS NOT NULL UNION ALL SELECT 'valid_attack_classes', sample_id FROM r WHERE is_attack AND attack_class = 'unknown'
  UNION ALL SELECT 'no_group_split_leakage', grp FROM gs),
n AS (SELECT unnest(['unique_sample_ids', 'required_fields', 'message_structure', 'valid_splits', 'benign_class_null', 'valid_attack_classes', 'no_group_split_leakage']) AS rule)
SELECT rule, count(sample_id) AS n, min(sample_id) AS example FROM n LEFT JOIN x USING (rule) GROUP BY rule""")
def integrity_audit(spark, d):
    """Every rule on documents as records of two messages; equal texts and equal beginnings join
    records into groups."""
    id = F.col("doc_id")
    split = F.when(id % 97 == 3, "other").otherwise(D.mod_split(id))
    cls = F.when(id % 3 == 0, F.when(id % 41 == 0, "unknown").otherwise(CLASSES[0])).otherwise(F.when(id % 53 == 1, CLASSES[1]))
    message = lambda hop, role: F.struct(hop.alias("hop"), F.lit(role).alias("role"), F.lit(role).alias("source"), F.lit("agent").alias("target"))
    messages = F.array(message(F.lit(1), "user"), message(F.when(id % 61 == 5, 3).otherwise(2), "assistant"))
    rows = read(spark, d, "documents").select(
        id.alias("sample_id"), split.alias("split"), (id % 3 == 0).alias("is_attack"), cls.alias("attack_class"), messages.alias("messages"), "lang", "source",
        F.md5("text").alias("k0"), F.when(F.length("text") >= 40, F.substring("text", 1, 40)).alias("k1"),
    )
    return audit.integrity(rows, ["k0", "k1"], ["lang", "source", "split"], CLASSES)
