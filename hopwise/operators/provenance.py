"""Items and where they come from.

A hop makes keys known (its items, their parts, loose fragments) and asks for keys (its items, and
fragments they could be put together from).  Both are rows of one long table; what was known of a
key before a hop are running minima over the rows of (session_id, key), so items are extracted
once, nothing is joined and no pair of hops is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwise.functions import risk as R
from hopwise.functions import text as T
from hopwise.functions import vocabulary as V
from hopwise.sources.hops import dealt


def with_items(hops: DataFrame) -> DataFrame:
    """Add the canonical text (with Unicode forms and account groups undone), its items, and the keys
    ``known`` by them."""
    # one column after the other, as each is used more than once
    text, plain, hard = F.col("hop_text"), F.col("_plain"), F.col("_hard")
    rows = hops.withColumn("_plain", T.unbracketed(text)).withColumn("_hard", T.is_hard(text, plain))
    rows = rows.withColumn("canonical", T.finished(text, plain, hard)).drop("_plain", "_hard")
    return rows.withColumn("items", T.indicators(F.col("canonical"))).withColumn("known", _known_keys())


def _known_keys() -> Column:
    """Everything that a hop with ``canonical`` and ``items`` makes known."""
    return F.array_distinct(F.concat("items", T.text_parts(F.col("canonical")), F.flatten(F.transform("items", T.item_parts))))


def _kind() -> Column:
    return F.when(R.trusted(F.col("role")), "trusted").when(R.untrusted(F.col("role")), F.when(F.col("designated"), "designated").otherwise("plain"))


def registered(hops: DataFrame) -> DataFrame:
    """(session_id, key, hop, source, kind) of everything a hop makes known.  ``kind``: trusted,
    designated or plain (untrusted)."""
    return hops.select("session_id", F.explode("known").alias("key"), "hop", "source", _kind().alias("kind")).where("kind is not null")


def origins(reg: DataFrame) -> DataFrame:
    """One row per (session_id, key): first trusted hop, first plain untrusted hop and its source,
    first designated hop and its source."""
    hop, at = F.col("hop"), F.struct("hop", "source")
    firsts = {"trusted": ("trusted_hop", hop), "plain": ("plain", at), "designated": ("designated", at)}
    return reg.groupBy("session_id", "key").agg(*[F.min(F.when(F.col("kind") == kind, x)).alias(name) for kind, (name, x) in firsts.items()])


def fragments(item: Column, sizes: Column) -> Column:
    """Keys of six or more characters that an item could be put together from: its parts, and for
    items of letters and digits every proper prefix and suffix of one of the ``sizes``."""
    plain = item.rlike("^[A-Za-z0-9]+$")
    own = F.filter(sizes, lambda n: (n >= 6) & (n < F.length(item)))
    ends = F.flatten(F.transform(own, lambda n: F.array(F.substring(item, F.lit(1), n), F.substring(item, F.length(item) - n + 1, n))))
    return F.array_distinct(F.filter(F.concat(T.item_parts(item), F.when(plain, ends).otherwise(F.array().cast("array<string>"))), lambda k: F.length(k) >= 6))


#: Columns of a key's row.
KEYED = ("key", "item", "exact", "supplied", "plain")


def with_entries(hops: DataFrame, itself: bool = False) -> DataFrame:
    """Rows of ``hops`` for every key that one makes known (item null) or asks for, with key, item and
    exact beside its columns; with ``itself`` also one without a key for the hop.

    An item's prefixes and suffixes are asked for only in the lengths that some key of the session
    has, which are few however long the item is.  Columns of ``hops`` that are called like those of
    a key get an underscore behind their names.
    """

    def entry(key, item=None, exact=None):
        return F.struct(key.alias("key"), (F.lit(None).cast("string") if item is None else item).alias("item"), F.lit(exact).cast("boolean").alias("exact"))

    rows = hops.withColumnsRenamed({c: f"{c}_" for c in KEYED}).withColumn("_kind", _kind()).withColumn("_known", F.when(F.col("_kind").isNotNull(), F.col("known")).otherwise(F.array()))
    lengths = F.array_distinct(F.transform(F.filter("_known", lambda k: k.rlike("^[A-Za-z0-9]+$")), lambda k: F.length(k)))
    session = Window.partitionBy("session_id").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sizes", F.array_distinct(F.flatten(F.collect_set(lengths).over(session))))
    asks = F.flatten(F.transform("items", lambda i: F.concat(F.array(entry(i, i, True)), F.transform(fragments(i, F.col("_sizes")), lambda k: entry(k, i, False)))))
    own = [F.array(entry(F.lit(None).cast("string")))] if itself else []
    return rows.withColumn("_e", F.explode(F.concat(*own, F.transform("_known", lambda k: entry(k)), asks))).select("*", "_e.*").drop("_e", "_known", "_sizes")


def with_known(entries: DataFrame) -> DataFrame:
    """Add what was known of each entry's key before its hop: ``supplied``, whether a user or system
    hop had it, and ``plain`` and ``designated``, the first such (hop, source)."""
    before = Window.partitionBy("session_id", "key").orderBy("hop").rangeBetween(Window.unboundedPreceding, -1)

    def first(of, what):
        return F.min(F.when(F.col("item").isNull() & (F.col("_kind") == of), what)).over(before)

    at = F.struct("hop", "source")
    return entries.withColumns({"supplied": first("trusted", F.col("hop")).isNotNull(), "plain": first("plain", at), "designated": first("designated", at)}).drop("_kind")


_MET = "item is not null and (supplied or plain is not null or designated is not null)"


def known(hops: DataFrame) -> DataFrame:
    """(session_id, hop, item, key, exact, supplied, plain, designated): the keys that a hop's items
    ask for, with what was known of them before it.  Keys never seen before are left out."""
    narrow = hops.select("session_id", "hop", "source", "role", "designated", "known", "items")
    return with_known(with_entries(narrow)).where(_MET).select("session_id", "hop", "item", "key", "exact", "supplied", "plain", "designated")


def tainted_items(hops: DataFrame) -> DataFrame:
    """(session_id, hop, item, origin_hop, origin_source): items first seen in untrusted data and
    never supplied by a user or system hop (designation aside)."""
    rows = known(hops).where("exact and not supplied")
    first = F.least("plain", "designated")
    return rows.select("session_id", "hop", "item", first["hop"].alias("origin_hop"), first["source"].alias("origin_source"))


def fragment_items(hops: DataFrame) -> DataFrame:
    """(session_id, hop, item, key): of hops without a tainted item, the items met only through a
    fragment; items that a user or system hop had supplied are not."""
    mine, item = Window.partitionBy("session_id", "hop"), Window.partitionBy("session_id", "hop", "item")
    rows = known(hops).select("*", F.max(F.col("exact") & ~F.col("supplied")).over(mine).alias("_whole"), F.max(F.col("exact") & F.col("supplied")).over(item).alias("_given"))
    return rows.where("not (exact or supplied or _whole or _given)").select("session_id", "hop", "item", "key").distinct()


def _paths(rows: DataFrame, last: int | None = None) -> DataFrame:
    """(session_id, hop, item, at, kind) of the rows with ``_mark``: the hops from ``origin_hop`` on whose
    rows have ``_use``, then the marked hop itself; with ``last`` only those of so many hops before it.

    An item's uses are gathered once in a session, as hop numbers, and a mark takes those that come
    before it, so only what a path says becomes a row.
    """
    before = Window.partitionBy("session_id", "item").orderBy("hop").rangeBetween(Window.unboundedPreceding, -1)
    used = F.when(F.col("_use"), F.col("hop"))
    mark = F.when(F.col("_mark"), F.struct("hop", "origin_hop", "_before"))
    one = rows.withColumn("_before", F.count(used).over(before).cast("int")).groupBy("session_id", "item")
    marks = one.agg(F.sort_array(F.collect_list(used)).alias("_uses"), F.collect_list(mark).alias("_marks")).select("session_id", "item", "_uses", F.inline("_marks"))
    hop, origin, at = F.col("hop"), F.col("origin_hop"), F.col("at")
    least = origin if last is None else F.greatest(origin, hop - last)
    since = F.filter(F.slice("_uses", F.lit(1), F.col("_before")), lambda u: u >= least)
    kind = F.when(at == hop, "action").when(at == origin, "origin").otherwise("relay")
    return marks.select("session_id", "hop", "item", "origin_hop", F.explode(F.concat(since, F.array(hop))).alias("at")).select("session_id", "hop", "item", "at", kind.alias("kind"))


def carriers(hops: DataFrame, marked: DataFrame, last: int | None = V.WINDOW_HOPS) -> DataFrame:
    """The path of each marked (session_id, hop, item, origin_hop): every hop that carried the item
    from its origin on, then the action itself.  Of these ``last`` keeps the hops that a session's
    memory still holds; None stands for all.

    Uses and marks are rows of one table, and nothing is joined.
    """
    uses = hops.select("session_id", "hop", F.explode("items").alias("item"), F.lit(True).alias("_use"))
    marks = marked.select("session_id", "hop", "item", "origin_hop", F.lit(True).alias("_mark"))
    return _paths(dealt(uses.unionByName(marks, allowMissingColumns=True), hops), last)


def tainted_paths(hops: DataFrame, role: str) -> DataFrame:
    """``carriers``, whole, for the tainted items of all hops of a role: the rows that ask for an item
    are its uses, so hops are gone through once."""
    narrow = hops.select("session_id", "hop", "source", "role", "designated", "known", "items")
    rows = with_known(with_entries(narrow)).where("exact").withColumn("origin_hop", F.least("plain", "designated")["hop"])
    mark = (F.col("role") == role) & ~F.col("supplied") & F.col("origin_hop").isNotNull()
    return _paths(rows.select("session_id", "hop", "item", "origin_hop", F.lit(True).alias("_use"), mark.alias("_mark")))
