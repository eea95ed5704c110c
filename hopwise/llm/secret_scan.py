"""Secret scan by assignment-aware lexing.

Fixed base patterns find the plain cases.  The lexer then reads every text as source or
configuration: it parses ``name op value`` statements (Python, shell, JSON, YAML, INI,
JavaScript...) into pairs of a name and the literals its value is made of, carries
constants through names (``part = "..."; password = part + "..."``), and scores each
literal by how sensitive the name is that it ends up in and how random it looks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map

KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a part of a name is; a name counts as its most sensitive part or pair.
_NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "apikey": 1.0, "authorization": 0.8, "auth": 0.6,
}
_KEY_QUALIFIERS = frozenset("api access private secret signing encryption master service client auth account storage shared session".split())
_NAME_STEMS = tuple(_NAME_WEIGHT) + ("key",)

# a name and what assigns to it, with a type between the two skipped (``name: str = ``)
_TARGET = re.compile(
    r"""(?a)(?<![\w$.-])([A-Za-z_$][\w$.-]*+)["']?\]?[ \t]*+"""
    r"""(?:\??:[ \t]*+[A-Za-z_$][\w$.]*+(?:\[[^\[\]\n]*+\]|<[^<>\n]*+>)?(?:[ \t]*+\|[ \t]*+[\w$.]++)*+(?:[ \t]++=(?![=>])|=(?=["'`]))|:=|=>|\?=|\|\|=|\+=|[:=](?![:=]))[ \t]*+"""
)
_QUOTED = re.compile(r"""(?a)[bBrRuUfF]{0,2}("{3}|'{3}|["'`])""")
# what follows the opening quote up to the closing one that no backslash escapes; one-character
# quotes end in their line
_REST = {q: re.compile(rf"(?:[^{q}\\\n]++|\\[^\n])*+{q}") for q in "\"'`"} | {
    q * 3: re.compile(rf"(?s)(?:[^{q}\\]++|\\.|{q}(?!{q}{q}))*+{q * 3}") for q in "\"'"
}
_NAME = re.compile(r"(?a)[A-Za-z_$][\w$.]*+(?![\w(\[/+=:@-])")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]+""")
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|\\\n)?[ \t]*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|changeme|change_me|placeholder|redacted|todo|test)$")
_PLACEHOLDER_HEAD = re.compile(r"(?i)your[_-]|example|\$\{|\$\(|<|%\(|\{\{")
#: Characters of a value that are kept to recognise placeholders; no whole-word one is as long.
_HEAD = 32


def name_score(name: str) -> float:
    """0 to 1: how likely a variable or setting of this name holds a secret.

    Names are split at case and punctuation; parts written together (``dbpassword``,
    ``accesskey``) count by the stem that they end in.
    """
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = 0.0
    for before, part in zip(["", *parts], parts):
        best = max(best, _NAME_WEIGHT.get(part, 0.0), *(w for stem, w in _NAME_WEIGHT.items() if len(stem) > 4 and part.endswith(stem)), 0.0)
        stem = part.removesuffix("s").removesuffix("key")
        if stem != part.removesuffix("s") and (stem or before) in _KEY_QUALIFIERS:
            best = 1.0
    return best


class _Value:
    """What an expression evaluates to: literals and earlier values, in order.

    A value refers to those it is made of instead of copying their literals, and carries the
    character counts of its whole text, so long chains of constants stay linear.
    """

    __slots__ = ("parts", "counts", "head")

    def __init__(self, text: str, parts: list):
        self.parts, self.counts, self.head = parts, Counter(), ""
        for p in parts:
            if isinstance(p, _Value):
                self.counts.update(p.counts)
                more = p.head
            else:
                self.counts.update(text[p[0] : p[1]])
                more = text[p[0] : min(p[1], p[0] + _HEAD)]
            self.head = (self.head + more)[:_HEAD]

    def literals(self, done: set) -> list[tuple[int, int]]:
        """All literals below that are in no value of ``done``, which grows by those visited."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if id(v) not in done:
                done.add(id(v))
                for p in v.parts:
                    (todo if isinstance(p, _Value) else out).append(p)
        return out

    def score(self) -> float:
        return _score(self.counts, self.head)


def _score(counts: Counter, head: str) -> float:
    n = sum(counts.values())
    if n < 6 or any(c.isspace() for c in counts) or _PLACEHOLDER_HEAD.match(head):
        return 0.0
    if _PLACEHOLDER.match(head) if n <= _HEAD else len({c.lower() for c in counts}) == 1 and head[0] in "xX*.":
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n > 0)
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit)) + (not all(map(str.isalnum, counts)))
    return (1.0 if n >= 12 else n / 12) * min(1.0, entropy / 3.0) * (0.6 + 0.2 * min(2, kinds - 1))


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a generated or chosen secret."""
    return _score(Counter(value), value[:_HEAD])


def _value(text: str, at: int, known: dict[str, _Value]) -> tuple[list, int]:
    """What the expression at ``at`` is made of (literals as (start, end), values of names) and its
    end."""
    parts: list = []
    while True:
        if m := _QUOTED.match(text, at):
            rest = _REST[m[1]].match(text, m.end())
            if rest is None:
                return parts, m.end()
            parts.append((m.end(), rest.end() - len(m[1])))
            at = rest.end()
        elif m := _NAME.match(text, at):
            if m[0] in known:
                parts.append(known[m[0]])
                at = m.end()
            elif parts:
                return parts, m.end()
            else:
                b = _BARE.match(text, at)
                span = b.span() if b and b.end() > m.end() else m.span()
                return [span], span[1]
        elif not parts and (m := _BARE.match(text, at)):
            return [m.span()], m.end()
        else:
            return parts, at
        j = _JOIN.match(text, at)
        after = text[j.end() : j.end() + 1]
        if "+" not in j[0] and ".." not in j[0] and "\\" not in j[0] and after not in ('"', "'"):
            return parts, at
        at = j.end()


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name with at least ``threshold``."""
    low = text.lower()
    if not any(s in low for s in _NAME_STEMS):
        return []
    known: dict[str, _Value] = {}
    found: set = set()
    done: set = set()
    kept: list = []  # values in ``done`` live as long as their ids are looked up
    at = 0
    while m := _TARGET.search(text, at):
        parts, end = _value(text, m.end(), known)
        at = max(end, m.end()) if parts else m.end()
        if not parts:
            continue
        known[m[1]] = value = _Value(text, parts)
        kept.append(value)
        weight = name_score(m[1])
        if weight and weight * value.score() >= threshold:
            found.update(value.literals(done))
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ``kind`` an index of KINDS."""
    out = []
    low = text.lower()
    if any(s in low for s in _ASSIGN_STEMS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, threshold: float = 0.5) -> tuple[list, list]:
    """Base spans, and base plus those lexed spans that no base span holds already."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    more = []
    for s, e in lexed_spans(text, threshold):
        i = bisect_right(starts, s)
        if not i or reach[i - 1] < e:
            more.append((s, 3, e))
    return base, sorted(base + more)


def scan_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (kind, start, end).

    Offsets are code points, ends exclusive, kinds assign, access, hex (the base patterns,
    leftmost non-overlapping per kind) and lexed (literals found by assignment).  A null
    or empty text has no spans; rows with null or repeated ids are scanned like any other;
    other columns are ignored.  No shuffle: each text is read once, whole.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        spans = []
        for text in batch.column(1).to_pylist():
            spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(text or "", threshold)[1]])
        return {"doc_id": batch.column(0), "spans": spans}

    return arrow_map(docs.select("doc_id", "text"), fn, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "lexed")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("lexed"),
    )
