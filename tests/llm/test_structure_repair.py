import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from hopwise.llm.structure_repair import Repairs, count_illegal, op12_structure_repair, repair
from hopwise.llm.turns import joined_sha256

BLANK = " \t\n\x0b\x0c\r"


def classified(rows):
    """Faults of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """Dijkstra over (cost, audit) with every partial audit kept: (cost, audit, repaired)."""
    faults = classified(rows)
    heap, best, done = [(0, "", 0, "", ())], None, set()
    found = []
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        if (audit, i, roles, out) in done:
            continue
        done.add((audit, i, roles, out))
        if i == len(rows) and (roles == "" or roles[-1] == "a" and roles != "s"):
            best = cost
            found.append((audit, out))

        def allowed(c):
            return c == "s" and roles == "" or c == "u" and (roles == "" or roles[-1] in "sa") or c == "a" and roles[-1:] == "u"

        for name in ("user", "assistant"):
            if allowed(name[0]) and cost + 3 <= 4 * len(rows):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + name[0], (*out, name + ":")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if faults[i] in ("ok", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] and allowed(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if allowed(name[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + name[0], (*out, f"{name}:{text}")))
    audit, out = min(found)
    return best, audit, "\n".join(out)


def slow_table(table):
    convs, want = {}, {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, code = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        role = "user" if code == 4 else role
        rows += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        numbers = [r[0] for r in rows if r[0] is not None]
        pairs = [(r, t) for _, r, t in rows]
        faults = classified(pairs)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = slow_repair(pairs)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        want[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return want


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conv(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_every_short_sequence(n):
    kinds = [("system", "x."), ("user", "x."), ("assistant", "x."), ("tool", "x."), ("user", "x"), ("assistant", ""), ("system", "x")]
    automaton = Repairs()
    for rows in itertools.product(kinds, repeat=n):
        rows = [(r, f"{i}{t}" if t else t) for i, (r, t) in enumerate(rows)]
        codes = {"ok": 0, "blank": 1, "truncated": 3}
        symbols = "".join(chr(65 + 4 * codes[f] + ("suat".index(r[0]))) for f, (r, _) in zip(classified(rows), rows))
        assert automaton.repair(symbols) == slow_repair(rows)[:2], rows
    assert len(automaton.vectors) < 60


def test_longer_sequences():
    draw, automaton = random.Random(5), Repairs()
    for _ in range(60):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), draw.choice([f"{i}.", f"{i}", "", f"{i % 3}!"])) for i in range(draw.randint(5, 8))]
        codes = {"ok": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        symbols = "".join(chr(65 + 4 * codes[f] + ("suat".index(r[0]))) for f, (r, _) in zip(classified(rows), rows))
        assert automaton.repair(symbols) == slow_repair(rows)[:2], rows


def test_long_conversation_is_linear():
    cost, audit = Repairs().repair("BC" * 300_000 + "B")
    assert (cost, len(audit)) == (3, 600_002)
    assert count_illegal("BCB" + "D") == 1


def test_table(spark):
    d = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_conv(op12_structure_repair(spark, d)) == slow_table(table)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "hello?"), (1, None, None, "hello?"), (1, 5, "user", None), (1, 7, "", "x."), (1, 7, "", "x."), (1, 7, "assistant", "y\n:."), (1, 9, "assistant", "é " * 50_000)]
    rows += [(-3, t, r, "same.") for t, r in enumerate(["user", "assistant"] * 6)] + [(2**62, -(2**62), "user", "a."), (2**62, 2**62 - 2**61, "assistant", "b.")]
    # every row of conversation 70 is dropped, all but deleted in 71
    rows += [(c, t, "user", "x.") for c in range(60, 120) for t in range(400) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:8]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema + ", p int, digest string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_conv(op12_structure_repair(spark, str(tmp_path))) == slow_table(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert op12_structure_repair(spark, f"{tmp_path}/empty").collect() == []


def test_one_long_conversation_over_many_ranges(spark):
    rows = [(c, t, ["user", "assistant"][(t + t // 17) % 2], f"text {t % 501}.") for c, n in ((1, 3000), (2, 3), (3, 5)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, pieces = repair(df)
        digests = {r.conv_id: r.sha256 for r in joined_sha256(pieces, ["conv_id"], "seq", "piece", b"\n").collect()}
        found = {r.conv_id: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    automaton = Repairs()
    for conv in (1, 2, 3):
        kept = []
        for _, t, role, text in (r for r in rows if r[0] == conv):
            code = zlib.crc32(f"{conv}:{t}".encode()) % 20
            role, text = "user" if code == 4 else role, "" if code == 1 else text.replace(".", "") if code == 2 else text
            kept += [(role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        codes = {"ok": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        symbols = "".join(chr(65 + 4 * codes[f] + "sua".index(r[0])) for f, (r, _) in zip(classified(kept), kept))
        cost, audit = automaton.repair(symbols)
        assert (found[conv].cost, found[conv].audit) == (cost, audit)
        out, i, n = [], 0, sum(x != "D" for x in audit)
        for x in audit:
            name = "user" if (len(out) + 1 - n) % 2 else "assistant"
            if x != "D":
                out.append(f"{name if x in 'IR' else kept[i][0]}:{'' if x == 'I' else kept[i][1]}")
            i += x != "I"
        assert digests.get(conv) == (hashlib.sha256("\n".join(out).encode()).hexdigest() if out else None)
