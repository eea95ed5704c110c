"""Catalogue queries on labels, scores and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import text as T
from hopwise.operators import datasets as D
from hopwise.operators import evaluate as E
from hopwise.operators import scorers as SC
from hopwise.plans.registry import query, read
from hopwise.plans.sessions import EV, SIG, events_hops, signalled
from hopwise.sources import hops as H

SCORED = "sc AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, 1 - l.toxic AS label, round((d.n_chars % 1000) / 1000.0::DOUBLE, 3) AS trust FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, d) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "text", (1 - F.col("toxic")).alias("label"), F.round((F.col("n_chars") % 1000) / 1000, 3).alias("trust"))


def _counts(flag: str) -> str:
    return f"count(*) FILTER (label = 0 AND ({flag})) AS tp, count(*) FILTER (label = 0 AND NOT ({flag})) AS fn, count(*) FILTER (label = 1 AND ({flag})) AS fp, count(*) FILTER (label = 1 AND NOT ({flag})) AS tn"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"


def _wilson(k: str, n: str, high: bool) -> str:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    z = 1.96
    centre, half = f"(({p} + {z * z} / (2.0 * {n})) / (1 + {z * z} / {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n}))"
    return f"CASE WHEN {n} = 0 THEN {1.0 if high else 0.0} ELSE round({'least(1.0, ' + centre + ' + ' if high else 'greatest(0.0, ' + centre + ' - '}{half}), 4) END"


def _summary(counts: str, by: str = "") -> str:
    keep = f"{by}, " if by else ""
    return f"""SELECT {keep}tp, fn, fp, tn, n, round(CASE WHEN n = 0 THEN 0 ELSE CAST(tp + tn AS DOUBLE) / n END, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(fpr, 6) AS fpr,
      round(CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END, 6) AS f1,
      {_wilson('tp', '(tp + fn)', False)} AS recall_low, {_wilson('tp', '(tp + fn)', True)} AS recall_high, {_wilson('fp', '(fp + tn)', False)} AS fpr_low, {_wilson('fp', '(fp + tn)', True)} AS fpr_high
      FROM (SELECT *, tp + fn + fp + tn AS n, {_rate('tp', '(tp + fp)')} AS "precision", {_rate('tp', '(tp + fn)')} AS recall, {_rate('fp', '(fp + tn)')} AS fpr FROM ({counts}))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "fpr", "f1")})


@query(f"WITH {SCORED} SELECT {_counts('trust < 0.5')} FROM sc")
def confusion(spark, d):
    return scored(spark, d).agg(*[c.alias(n) for n, c in E.confusion(F.col("label"), F.col("trust") < 0.5).items()])


@query(f"WITH {SCORED} {_summary('SELECT ' + _counts('trust < 0.5') + ' FROM sc')}")
def summary(spark, d):
    return _rounded(E.summary(scored(spark, d), F.col("trust") < 0.5))


@query(f"WITH w AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS k FROM events GROUP BY 1) SELECT user_id, {_wilson('k', 'n', False)} AS low, {_wilson('k', 'n', True)} AS high FROM w")
def wilson(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("k"))
    low, high = R.wilson(F.col("k"), F.col("n"))
    return rows.select("user_id", low.alias("low"), high.alias("high"))


def _best(score: str, default: str, max_fpr: float) -> str:
    return f"""ts AS (SELECT DISTINCT CAST({score} AS DOUBLE) AS t FROM sc UNION SELECT 1.0), tc AS (SELECT t, {_counts(score + ' < t')} FROM ts CROSS JOIN sc GROUP BY t
), tm AS (SELECT t, {_rate('tp', '(tp + fp)')} AS p, {_rate('tp', '(tp + fn)')} AS r, {_rate('fp', '(fp + tn)')} AS fpr FROM tc
), tf AS (SELECT t, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM tm WHERE fpr <= {max_fpr})
SELECT coalesce((SELECT t FROM tf ORDER BY f1 DESC, t LIMIT 1), {default}) AS threshold, round(coalesce((SELECT max(f1) FROM tf), -1.0), 6) AS f1"""


@query(f"WITH {SCORED}, {_best('trust', '0.5', 0.05)}")
def best_threshold(spark, d):
    return E.best_threshold(scored(spark, d)).withColumn("f1", F.round("f1", 6))


@query(f"WITH {SCORED.replace('sc AS', 'sc0 AS')}, sc AS (SELECT label, CAST(-n_chars AS DOUBLE) AS trust FROM sc0), {_best('trust', '0.5', 1.0)}")
def length_threshold(spark, d):
    """Long texts flagged: the length rule is the same search on minus the length."""
    rows = scored(spark, d).select("label", (-F.col("n_chars")).cast("double").alias("trust"))
    return E.best_threshold(rows, max_fpr=1.0).withColumn("f1", F.round("f1", 6))


@query(f"""WITH {SCORED}, cs AS (SELECT DISTINCT lang, t FROM (SELECT lang, trust AS t FROM sc UNION ALL SELECT lang, trust + 1e-9 FROM sc UNION ALL SELECT lang, 1.0 FROM sc) WHERE t <= 0.5
), r AS (SELECT cs.lang, t, round(count(*) FILTER (label = 0 AND trust < t) / CAST(greatest(1, count(*) FILTER (label = 0)) AS DOUBLE), 4) AS recall, round(count(*) FILTER (label = 1 AND trust < t) / CAST(greatest(1, count(*) FILTER (label = 1)) AS DOUBLE), 4) AS fpr FROM cs JOIN sc ON sc.lang = cs.lang GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY recall DESC, t) AS p FROM r WHERE fpr <= 0.2) SELECT lang, round(t, 9) AS t, recall, fpr FROM k WHERE p = 1""")
def fpr_budget_threshold(spark, d):
    return E.budget_threshold(scored(spark, d), 0.2, "lang").withColumn("t", F.round("t", 9))


@query("SELECT doc_id, min(round(length(regexp_replace(substr(text, CAST(s + 1 AS BIGINT), 900), '[^a-e]', '', 'g')) / 900.0::DOUBLE, 6)) AS trust, count(*) AS n_chunks, arg_min(i, (round(length(regexp_replace(substr(text, CAST(s + 1 AS BIGINT), 900), '[^a-e]', '', 'g')) / 900.0::DOUBLE, 6), i)) AS worst FROM (SELECT doc_id, text, unnest(st) AS s, CAST(unnest(range(len(st))) AS INTEGER) AS i FROM (SELECT doc_id, text, CASE WHEN length(text) <= 900 THEN [0] ELSE list_append(range(0, length(text) - 900, 450), length(text) - 900) END AS st FROM documents)) GROUP BY doc_id")
def event_min_trust(spark, d):
    """Trust of a text: the least over its chunks, and the first chunk that has it."""
    rows = read(spark, d, "documents").select("doc_id", "text", F.posexplode(T.chunk_spans(F.length("text"))).alias("i", "s"))
    piece = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = rows.select("doc_id", "i", F.round(F.length(F.regexp_replace(piece, "[^a-e]", "")) / 900.0, 6).alias("t"))
    return rows.groupBy("doc_id").agg(F.min("t").alias("trust"), F.count("*").alias("n_chunks"), F.min_by("i", F.struct("t", "i")).alias("worst"))


@query(f"""WITH {SCORED}, s AS (SELECT *, unnest(list_filter(['lang ' || lang, 'source ' || source, CASE WHEN label = 1 AND n_chars > 900 THEN 'long safe' END], lambda x: x IS NOT NULL)) AS slice FROM sc) {_summary('SELECT slice, ' + _counts('trust < 0.5') + ' FROM s GROUP BY slice', 'slice')}""")
def slice_metrics(spark, d):
    long_safe = F.when((F.col("label") == 1) & (F.col("n_chars") > 900), "long safe")
    return _rounded(E.slices(scored(spark, d), F.col("trust") < 0.5, lang=F.concat(F.lit("lang "), "lang"), source=F.concat(F.lit("source "), "source"), kind=long_safe))


@query(f"WITH {SCORED}, f AS (SELECT *, 'family_' || (CAST('0x' || left(sha256(source), 8) AS BIGINT) % 4) AS family FROM sc WHERE label = 0) SELECT family, count(*) AS n, round(avg(CAST(trust < 0.5 AS INTEGER)), 4) AS recall, family = 'family_0' AS held_out FROM f GROUP BY family")
def family_recall(spark, d):
    family = F.concat(F.lit("family_"), D.hash_number(F.col("source")) % 4)
    rows = scored(spark, d).where("label = 0").withColumn("family", family)
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg((F.col("trust") < 0.5).cast("int")), 4).alias("recall"), F.any_value(F.col("family") == "family_0").alias("held_out"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1")
def latency_mean_p95(spark, d):
    rows = read(spark, d, "events")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    high = E.p95(rows, "value", "event_type").withColumnRenamed("event_type", "of")
    return means.join(high, F.col("event_type").eqNullSafe(F.col("of")), "left").drop("of")


@query("WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS runs, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM p GROUP BY 1")
def seed_mean_std(spark, d):
    runs = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return runs.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"))


@query(f"WITH {SCORED}, c AS (SELECT source, lang, label, count(*) AS n, min(doc_id) AS first FROM sc WHERE doc_id % 2 = 0 GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n DESC, first) AS r FROM c) WHERE r = 1) SELECT sc.doc_id, sc.label, coalesce(m.label, 1) AS predicted FROM sc LEFT JOIN m ON m.source = sc.source AND m.lang = sc.lang WHERE sc.doc_id % 2 = 1")
def role_majority(spark, d):
    """Majority label of (source, lang) on even ids, looked up for odd ids; unseen: safe."""
    rows = scored(spark, d)
    counts = rows.where("doc_id % 2 = 0").groupBy("source", "lang", "label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    top = D.keep_preferred(counts, ["source", "lang"], F.desc("n"), F.asc("first")).select("source", "lang", F.col("label").alias("vote"))
    return rows.where("doc_id % 2 = 1").join(top, ["source", "lang"], "left").select("doc_id", "label", F.coalesce("vote", F.lit(1)).alias("predicted"))


@query("SELECT toxic, round(sum(count(*)) OVER () / (2.0::DOUBLE * greatest(count(*), 1)), 6) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, d):
    c = read(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"))
    return c.select("toxic", F.round(F.sum("n").over(Window.partitionBy()) / (2 * F.greatest("n", F.lit(1))), 6).alias("weight"))


@query("SELECT event_type, round(avg(CASE WHEN user_id % 2 = 0 THEN CAST(value > 50 AS INTEGER) END), 4) AS utility, round(avg(CASE WHEN user_id % 2 = 1 THEN CAST(value > 50 AS INTEGER) END), 4) AS utility_under_attack, round(avg(CASE WHEN user_id % 2 = 1 AND value > 10 THEN CAST(value > 90 AS INTEGER) END), 4) AS asr FROM events GROUP BY 1")
def asr_utility(spark, d):
    benign, value = F.col("user_id") % 2 == 0, F.col("value")

    def share(cond, ok):
        return F.round(F.avg(F.when(cond, ok.cast("int"))), 4)

    rows = read(spark, d, "events").groupBy("event_type")
    return rows.agg(share(benign, value > 50).alias("utility"), share(~benign, value > 50).alias("utility_under_attack"), share(~benign & (value > 10), value > 90).alias("asr"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 5")
def hash_subsample(spark, d):
    return D.hash_subsample(read(spark, d, "documents"), F.col("doc_id").cast("string"), 10, "lang", "source").select("doc_id", "lang")


@query("""WITH c AS (SELECT lang || '/' || source AS k, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT *, n * 100 / CAST(sum(n) OVER () AS DOUBLE) AS x FROM c
), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, k DESC) AS p, 100 - sum(floor(x)) OVER () AS free FROM s) SELECT k, n, CAST(floor(x) + CASE WHEN p <= free THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def largest_remainder(spark, d):
    counts = read(spark, d, "documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("k")).agg(F.count("*").alias("n"))
    return D.largest_remainder(counts, 100, "k")


@query("SELECT source, CASE WHEN r <= round_even(0.7 * n, 0) THEN 'train' WHEN r <= round_even(0.7 * n, 0) + round_even(0.15 * n, 0) THEN 'validation' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))")
def group_split(spark, d):
    return D.rank_split(read(spark, d, "documents").select("source").distinct(), "source")


@query("SELECT doc_id, CASE WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END AS split FROM documents")
def mod_split(spark, d):
    return read(spark, d, "documents").select("doc_id", D.mod_split(F.col("doc_id")).alias("split"))


_HASH_SPLIT = "CASE WHEN h % 1000 / 10.0 < 70 THEN 'train' WHEN h % 1000 / 10.0 < 85 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, {_HASH_SPLIT} AS split FROM (SELECT doc_id, CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS h FROM documents)")
def hash_split(spark, d):
    return read(spark, d, "documents").select("doc_id", D.hash_split(F.col("doc_id").cast("string")).alias("split"))


@query(f"""WITH a AS (SELECT lang, source, CASE WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END AS split FROM documents WHERE n_chars > 3000), g AS (SELECT lang, source, min(split) AS s FROM a GROUP BY 1, 2 HAVING count(DISTINCT split) = 1)
SELECT doc_id, coalesce(s, split) AS split FROM (SELECT doc_id, lang, source, {_HASH_SPLIT} AS split FROM (SELECT *, CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS h FROM documents WHERE n_chars <= 3000)) b LEFT JOIN g USING (lang, source)""")
def split_alignment(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    attacks = docs.where("n_chars > 3000").withColumn("split", D.mod_split(F.col("doc_id")))
    benign = docs.where("n_chars <= 3000").withColumn("split", D.hash_split(F.col("doc_id").cast("string")))
    return D.aligned_splits(benign, attacks, "lang", "source").select("doc_id", "split")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_prefer(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return D.keep_preferred(rows, ["key"], F.when(F.col("source") == "src0", 0).otherwise(1), F.col("doc_id")).select("doc_id")


@query("""WITH s AS (SELECT doc_id, text, source, CASE WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END AS split FROM documents), b AS (SELECT text FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT (SELECT count(*) FROM s) AS n, (SELECT count(DISTINCT doc_id) FROM s) AS n_ids, (SELECT count(*) FROM b) AS leaking_groups, (SELECT count(*) FROM s WHERE text IN (SELECT text FROM b)) AS leaking_rows""")
def leakage_audit(spark, d):
    """Groups (equal texts) that stand in more than one split."""
    rows = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("g"), D.mod_split(F.col("doc_id")).alias("split"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("split").alias("s"))
    return groups.agg(F.sum("n").alias("n"), F.sum("ids").alias("n_ids"), F.count_if(F.col("s") > 1).alias("leaking_groups"), F.coalesce(F.sum(F.when(F.col("s") > 1, F.col("n"))), F.lit(0)).alias("leaking_rows"))


_RULES = "CASE WHEN NOT coalesce(lang IN ('en', 'fr', 'de'), false) THEN 'lang' END, CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'n_chars' END, CASE WHEN NOT coalesce(n_chars >= 100, false) THEN 'short' END, CASE WHEN NOT coalesce(regexp_matches(source, '^src[0-9]+$'), false) THEN 'source' END"


@query(f"SELECT doc_id, unnest(list_filter([{_RULES}], lambda r: r IS NOT NULL)) AS rule FROM documents")
def example_validation(spark, d):
    rows = read(spark, d, "documents")
    return D.violations(rows, "doc_id", lang=F.col("lang").isin("en", "fr", "de"), n_chars=F.col("n_chars") == F.length("text"), short=F.col("n_chars") >= 100, source=F.col("source").rlike("^src[0-9]+$"))


@query(f"{EV} SELECT session_id, count(*) AS n, bool_and(hop BETWEEN 1 AND 100000) AS numbered, max(hop) = count(*) AND count(DISTINCT hop) = count(*) AS gapless, bool_and(source IS NOT NULL AND target IS NOT NULL) AS addressed FROM ev GROUP BY 1")
def session_audit(spark, d):
    h = events_hops(spark, d)
    return h.groupBy("session_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("hop").between(1, 100000)).alias("numbered"), ((F.max("hop") == F.count("*")) & (F.count_distinct("hop") == F.count("*"))).alias("gapless"),
        F.bool_and(F.col("source").isNotNull() & F.col("target").isNotNull()).alias("addressed"),
    )


_PLANTED = "SELECT b.doc_id AS id, b.text AS t, CASE WHEN item IS NOT NULL THEN 300 END AS start, CASE WHEN item IS NOT NULL THEN 300 + length(item) END AS stop FROM (SELECT d.doc_id, left(d.text, 300) || coalesce(i.text, '') || substr(d.text, 301) AS text, i.text AS item FROM documents d LEFT JOIN benchmark i ON i.item_id = d.doc_id AND length(d.text) > 300) b"


def planted(spark, d) -> DataFrame:
    """Documents with a benchmark passage put in after 300 characters where an item has their id."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    rows = read(spark, d, "documents").select("doc_id", "text").join(items, "doc_id", "left").withColumn("item", F.when(F.length("text") > 300, F.col("item")))
    t = F.concat(F.substring("text", 1, 300), F.coalesce("item", F.lit("")), F.expr("substring(text, 301)"))
    return rows.select(F.col("doc_id").alias("id"), t.alias("t"), F.when(F.col("item").isNotNull(), 300).alias("start"), (300 + F.length("item")).alias("stop"))


@query(f"""WITH p AS ({_PLANTED}), c AS (SELECT *, CAST(unnest(st) AS INTEGER) AS s, CAST(unnest(range(len(st))) AS INTEGER) AS chunk FROM (SELECT *, CASE WHEN length(t) <= 900 THEN [0] ELSE list_append(range(0, length(t) - 900, 450), length(t) - 900) END AS st FROM p)
), o AS (SELECT *, CAST(least(s + 900, length(t)) AS INTEGER) AS e FROM c), h AS (SELECT *, CASE WHEN start IS NULL THEN 0.0 ELSE CAST(greatest(0, least(stop, e) - greatest(start, s)) AS DOUBLE) / (stop - start) END AS share FROM o)
SELECT id, chunk, s AS span_start, e AS span_end, round(share, 6) AS share, CASE WHEN share >= 0.6 THEN 'malicious' WHEN share = 0 THEN 'safe' ELSE 'unlabeled' END AS label FROM h""")
def chunk_labels(spark, d):
    return D.chunk_labels(planted(spark, d), T.chunk_spans(F.length("t")))


@query(f"WITH p AS ({_PLANTED}) SELECT id, CASE WHEN start IS NULL THEN t ELSE left(t, start) || CASE id % 3 WHEN 0 THEN 'All good.' WHEN 1 THEN 'No change.' ELSE 'See the notes.' END || substr(t, stop + 1) END AS twin FROM p")
def clean_twins(spark, d):
    """The minimal pair of every planted text: its passage replaced by filler."""
    filler = F.when(F.col("id") % 3 == 0, "All good.").when(F.col("id") % 3 == 1, "No change.").otherwise("See the notes.")
    twin = F.concat(F.expr("left(t, start)"), filler, F.expr("substring(t, stop + 1)"))
    return planted(spark, d).select("id", F.when(F.col("start").isNull(), F.col("t")).otherwise(twin).alias("twin"))


@query(f"{SIG} SELECT session_id, hop, CASE WHEN role IN ('user', 'system') THEN 'unlabeled' WHEN session_id % 3 > 0 THEN 'safe' WHEN instruction > 0 THEN 'malicious' WHEN mutating AND len(items) > 0 THEN 'malicious' WHEN role = 'tool' THEN 'safe' ELSE 'unlabeled' END AS label, CASE WHEN role IN ('user', 'system') THEN 'trusted_role' WHEN session_id % 3 > 0 THEN 'benign_session' WHEN instruction > 0 THEN 'carrier' WHEN mutating AND len(items) > 0 THEN 'action' WHEN role = 'tool' THEN 'clean_data' ELSE 'unknown' END AS label_source FROM sig")
def label_policy(spark, d):
    rows = signalled(spark, d, items=True)
    s = D.label_event(F.col("role"), F.col("session_id") % 3 == 0, F.col("instruction") > 0, F.col("mutating") & (F.size("items") > 0))
    return rows.select("session_id", "hop", s["label"].alias("label"), s["source"].alias("label_source"))


@query("WITH e AS (SELECT lang, source, CASE WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END AS split FROM documents) SELECT 'lang' AS what, lang AS v, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'lang/split', lang || '/' || split, count(*) FROM e GROUP BY 2")
def dataset_stats(spark, d):
    e = read(spark, d, "documents").select("lang", "source", D.mod_split(F.col("doc_id")).alias("split"))
    kinds = F.array(*[F.struct(F.lit(w).alias("what"), F.col(w).alias("v")) for w in ("lang", "source", "split")], F.struct(F.lit("lang/split").alias("what"), F.concat_ws("/", "lang", "split").alias("v")))
    return e.select(F.inline(kinds)).groupBy("what", "v").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)password|secret|token') THEN 'credential' WHEN regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9]+') THEN 'contact' WHEN regexp_matches(text, '[0-9]{9,}') THEN 'number' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' ELSE 'other' END AS class FROM documents")
def class_rules(spark, d):
    """The first matching keyword rule names the class."""
    t = F.col("text")
    rules = (("(?i)password|secret|token", "credential"), ("(?i)[a-z0-9._]+@[a-z0-9]+", "contact"), ("[0-9]{9,}", "number"), ("(?i)licen[sc]e", "licence"))
    c = F.when(t.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        c = c.when(t.rlike(pattern), name)
    return read(spark, d, "documents").select("doc_id", c.otherwise("other").alias("class"))


@query(f"{EV} SELECT session_id, hop, CASE WHEN role = 'assistant' AND tool_name = 'send_email' THEN 'exfiltration' WHEN role = 'assistant' AND tool_name = 'transfer_funds' THEN 'fraud' ELSE role END AS class FROM ev WHERE tool_name IS DISTINCT FROM 'get_status'")
def class_remap(spark, d):
    """A key table renames classes, one key is skipped, the rest keep what they were."""
    h = events_hops(spark, d).select("session_id", "hop", "role", "tool_name")
    table = spark.createDataFrame([("assistant", "send_email", "exfiltration"), ("assistant", "transfer_funds", "fraud")], "role string, tool_name string, named string")
    kept = h.where(~F.col("tool_name").eqNullSafe("get_status"))
    return kept.join(F.broadcast(table), ["role", "tool_name"], "left").select("session_id", "hop", F.coalesce("named", "role").alias("class"))


@query("SELECT f || '_' || v AS family, r_name AS region, i AS variant FROM (SELECT unnest(['direct', 'split', 'delayed']) AS f) CROSS JOIN (SELECT unnest(['plain', 'spelled']) AS v) CROSS JOIN (SELECT r_name FROM region) CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS i)")
def family_cross(spark, d):
    """Generator dimensions: family x spelling x region x variant, exploded from small lists."""
    rows = read(spark, d, "region").select("r_name", F.explode(F.array(*map(F.lit, ("direct", "split", "delayed")))).alias("f"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ("plain", "spelled")))).alias("v")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"))
    return rows.select(F.concat("f", F.lit("_"), "v").alias("family"), F.col("r_name").alias("region"), "variant")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '(?s)\\{.*\\}') THEN CASE WHEN regexp_matches(t, '\"attack\": true') THEN 1 ELSE 0 END WHEN regexp_matches(t, '(?i)^(yes|unsafe)') THEN 1 ELSE 0 END AS flagged FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'So: {\"attack\": true} ok' WHEN 1 THEN '{\"attack\": false}' WHEN 2 THEN 'unsafe because' ELSE 'no' END AS t FROM documents)")
def judge_verdicts(spark, d):
    """A judge's free answer: the JSON object in it, else its first word."""
    k = F.col("doc_id") % 4
    t = F.when(k == 0, 'So: {"attack": true} ok').when(k == 1, '{"attack": false}').when(k == 2, "unsafe because").otherwise("no")
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    answer = F.when(found != "", F.coalesce(F.get_json_object(found, "$.attack") == "true", F.lit(False))).otherwise(t.rlike("(?i)^(yes|unsafe)"))
    return read(spark, d, "documents").select("doc_id", answer.cast("int").alias("flagged"))


@query("SELECT event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_by_key(spark, d):
    rows = read(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return H.latest_by_key(rows, "event_type", "o").select("event_type", "ts", "event_id")


_ST = "CASE WHEN length(t) <= 900 THEN [0] ELSE list_append(range(0, length(t) - 900, 450), length(t) - 900) END"
_PIECES = f"pc AS (SELECT *, CAST(least(s + 900, length(t)) AS INTEGER) AS e FROM (SELECT *, CAST(unnest(st) AS INTEGER) AS s, CAST(unnest(range(len(st))) AS INTEGER) AS chunk FROM (SELECT *, {_ST} AS st FROM p)))"
_H12 = "CAST('0x' || left(sha256(id || '|' || chunk), 12) AS BIGINT)"


def _pieces(spark, d) -> DataFrame:
    rows = planted(spark, d).withColumn("_s", T.chunk_spans(F.length("t")))
    return rows.select("id", "start", "stop", F.posexplode("_s").alias("chunk", "s")).select("id", "start", "stop", "chunk", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(f"WITH p AS ({_PLANTED}), {_PIECES}, r AS (SELECT id, chunk, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN chunk = 0 THEN 0 WHEN chunk = last THEN 1 ELSE 2 END, {_H12}, chunk) AS place FROM (SELECT *, max(chunk) OVER (PARTITION BY id) AS last FROM pc) WHERE start IS NULL) SELECT id, chunk, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6")
def chunk_selection(spark, d):
    return D.select_safe_chunks(_pieces(spark, d).where("start is null")).select("id", "chunk", "place")


@query(f"""WITH p AS ({_PLANTED}), {_PIECES}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY least(abs(s - stop), abs(e - start)), chunk) AS near FROM pc WHERE start IS NOT NULL AND (e <= start OR s >= stop)
), f AS (SELECT *, row_number() OVER (PARTITION BY id, near > 2 ORDER BY {_H12}, chunk) AS far FROM n) SELECT id, chunk, CASE WHEN near > 2 THEN 'far' ELSE 'near' END AS kind FROM f WHERE near <= 2 OR far <= 1""")
def near_far_negatives(spark, d):
    return D.select_negatives(_pieces(spark, d)).select("id", "chunk", "kind")


def _window_sql(a: str, b: str, kind: str) -> str:
    return f"{{'a': CAST({a} AS INTEGER), 'b': CAST({b} AS INTEGER), 'kind': '{kind}'}}"


def _lead_sql(lead: str) -> str:
    at = f"greatest(0, least(start - ({lead}), length(t) - 900))"
    return _window_sql(at, f"{at} + 900", "positive")


@query(f"""WITH p AS ({_PLANTED}), w AS (SELECT id, unnest(list_filter([{_lead_sql('0')}, {_lead_sql('floor((900 - least(stop - start, 900)) / 2.0)')}, {_lead_sql('900 - least(stop - start, 900)')},
  CASE WHEN start >= 120 THEN {_window_sql('greatest(0, start - 900)', 'start', 'negative')} END, CASE WHEN length(t) - stop >= 120 THEN {_window_sql('stop', 'least(length(t), stop + 900)', 'negative')} END], lambda x: x IS NOT NULL)) AS w
  FROM p WHERE start IS NOT NULL AND length(t) > 900) SELECT id, w.a AS window_start, w.b AS window_end, w.kind AS kind FROM w""")
def shifted_windows(spark, d):
    rows = planted(spark, d).select("id", F.explode(D.shifted_windows(F.length("t"), F.col("start"), F.col("stop"))).alias("w"))
    return rows.select("id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("w.kind").alias("kind"))


@query(f"WITH p AS ({_PLANTED}) SELECT id, sha256(t) AS clean_sha256, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM p")
def unwrap_spans(spark, d):
    """Texts whose passage comes in marks: the marks go, its place stays."""
    marked = planted(spark, d).withColumn("t", F.when(F.col("start").isNull(), F.col("t")).otherwise(F.concat(F.expr("left(t, start)"), F.lit("<DATA>"), F.expr("substring(t, start + 1, stop - start)"), F.lit("</DATA>"), F.expr("substring(t, stop + 1)"))))
    u = D.unwrapped(F.col("t"), "<DATA>", "</DATA>")
    return marked.select("id", u.alias("u")).select("id", F.sha2("u.text", 256).alias("clean_sha256"), "u.start", "u.stop")


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '((?s:.*?)[.!?]\s+)', 1) AS p FROM documents), l AS (SELECT doc_id, list_transform(p, lambda x: length(x)) AS l FROM s)
SELECT doc_id, len(l) + 1 AS n, CAST(coalesce(list_sum(l), 0) AS BIGINT) AS last, CAST(coalesce(l[1], 0) AS BIGINT) AS second FROM l""")
def sentence_starts(spark, d):
    at = read(spark, d, "documents").where("text is not null").select("doc_id", D.sentence_starts(F.col("text")).alias("at"))
    return at.select("doc_id", F.size("at").cast("long").alias("n"), F.element_at("at", -1).cast("long").alias("last"), F.coalesce(F.get("at", F.lit(1)), F.lit(0)).cast("long").alias("second"))


@query(f"{EV} SELECT session_id, hop, CASE WHEN session_id % 5 = 0 AND hop = 3 THEN 'malicious' WHEN session_id % 5 = 0 AND hop = 4 THEN 'safe' WHEN role IN ('user', 'system') THEN 'unlabeled' ELSE 'safe' END AS label FROM ev")
def label_override(spark, d):
    """Scripted sessions bring labels of their own hops."""
    own = F.when(F.col("session_id") % 5 == 0, F.create_map(F.lit("3"), F.lit("malicious"), F.lit("4"), F.lit("safe")))
    label = D.label_event(F.col("role"), F.lit(False), F.lit(False), F.lit(False))["label"]
    return events_hops(spark, d).select("session_id", "hop", D.overridden(label, own, F.col("hop")).alias("label"))


@query("""WITH e AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 19 = 0 THEN 'external' WHEN doc_id % 17 < 12 THEN 'train' WHEN doc_id % 17 < 14 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT doc_id, CASE WHEN lang = 'fr' THEN CASE WHEN split = 'test' THEN 'test_fr' ELSE split END WHEN doc_id % 13 = 0 THEN 'test_ood' WHEN split = 'external' THEN 'test_external' ELSE split END AS split FROM e""")
def split_routing(spark, d):
    split = F.when(F.col("doc_id") % 19 == 0, "external").otherwise(D.mod_split(F.col("doc_id")))
    return read(spark, d, "documents").select("doc_id", D.routed_split(split, F.col("lang"), F.col("doc_id") % 13 == 0, {"fr": "test_fr"}).alias("split"))


@query(f"""WITH {SCORED}, ep AS ({_summary("SELECT doc_id % 5 AS epoch, " + _counts("trust < 0.3 + (doc_id % 5) / 10.0") + " FROM sc GROUP BY 1", "epoch")}) SELECT epoch, f1, fpr FROM ep ORDER BY f1 - CASE WHEN fpr > 0.5 THEN 1 ELSE 0 END DESC, epoch LIMIT 1""")
def best_epoch(spark, d):
    """Of several runs the first with the best F1, those beyond the false-alarm budget last."""
    rows = scored(spark, d).withColumn("epoch", F.col("doc_id") % 5)
    runs = E.summary(rows, F.col("trust") < 0.3 + F.col("epoch") / 10, "epoch")
    return E.best_run(runs, "epoch", 0.5).select("epoch", F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))


@query()
def lexical_classifier(spark, d):
    """Trained on the train split of labelled documents, scored on the others."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", (1 - F.col("toxic")).alias("label"), D.mod_split(F.col("doc_id")).alias("split"))
    model = SC.fit_lexical(rows.where("split = 'train'").select("text", "label"))
    return SC.score_lexical(model, rows.where("split <> 'train'")).select("doc_id", "split", "label", F.round("trust", 4).alias("trust"))


@query()
def temperature_fit(spark, d):
    """Logits of a model three times too sure of itself (from the labels, by rule)."""
    rows = read(spark, d, "labels").select("toxic", F.sin("doc_id").alias("x"))
    z = 3 * (F.when(F.col("toxic") == 1, 1.0).otherwise(-1.0) + 1.5 * F.col("x"))
    return SC.temperature(rows.select(F.col("toxic").alias("label"), (-z / 2).alias("z0"), (z / 2).alias("z1")))


_MSG = "CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'tool' WHEN 'error' THEN 'annotation' ELSE 'assistant' END"


@query(f"""WITH m AS (SELECT user_id, ts, event_id, event_type, {_MSG} AS role, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events), r AS (SELECT 's' || user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS hop, role,
  CASE WHEN role = 'user' THEN 'Go on' END AS content, CASE WHEN role = 'assistant' THEN 'read' END AS tool_name, CASE WHEN role = 'assistant' THEN '[{{"k":' || k || '}}]' END AS tool_calls, CASE WHEN role = 'tool' THEN 'value ' || k END AS tool_response FROM m WHERE role <> 'annotation')
SELECT session_id, hop, role, CASE WHEN role = 'assistant' THEN 'null_assistant_tool_call' WHEN content IS NULL THEN 'null' ELSE 'text' END AS content_state, coalesce(content, tool_response, '') AS event_text, concat_ws(' ', tool_name, tool_calls) AS action_text,
  coalesce(content, '') || ' ' || coalesce(tool_response, '') || ' ' || concat_ws(' ', tool_name, tool_calls) AS hop_text FROM r""")
def session_messages(spark, d):
    """Session records, as session files hold them, back to runtime hops: other annotations are
    dropped, numbers are made anew, calls and responses stay."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    role = F.when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "error", "annotation").otherwise("assistant")
    none = F.lit(None).cast("string")
    message = F.struct(
        F.lit(0).alias("hop"), role.alias("role"), role.alias("source"), F.lit("agent").alias("target"), F.when(role == "user", "Go on").alias("content"), F.when(role == "assistant", "read").alias("tool_name"),
        none.alias("tool_call"), F.when(role == "assistant", F.concat(F.lit('[{"k":'), k, F.lit("}]"))).alias("tool_calls"), F.when(role == "tool", F.concat(F.lit("value "), k)).alias("tool_response"),
    )
    rows = read(spark, d, "events").select(F.concat(F.lit("s"), "user_id").alias("sample_id"), F.struct("ts", "event_id", message.alias("m")).alias("x"))
    sessions = rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("messages"))
    return H.session_hops(sessions).select("session_id", "hop", "role", "content_state", "event_text", "action_text", "hop_text")
