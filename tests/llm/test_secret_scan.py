import hashlib
import re
import time

import pytest

from hopwise.llm.secret_scan import all_spans, lexed_spans, op1_secret_scan, scan_secrets


def slow_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(out)]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op1_secret_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | set()
        assert r.n_assign + r.n_access + r.n_hex == len(base)


def literals(text):
    return [text[s:e] for s, e in lexed_spans(text)]


def test_lexer():
    assert literals('db_pwd = "hunter2-Zx81kk"') == ["hunter2-Zx81kk"]
    assert literals("part = 'Zk83hf0skQ'\nx = 1\nclientSecret = part") == ["Zk83hf0skQ"]
    assert literals('a = "Zk83hf"\nDB_PASSPHRASE = a + "0skQ99"') == ["Zk83hf", "0skQ99"]
    assert literals('{"private_key": "MIIEv-92jf83hQ"}') == ["MIIEv-92jf83hQ"]
    assert literals("AUTH_TOKEN=${TOKEN}\npassword: changeme\nkey = 'abcdefgh12'") == []
    assert literals("signing-key: q8Z!kd92#\n") == ["q8Z!kd92"]
    assert literals("the key of this: nothing") == []


def test_types_and_joined_names():
    assert literals('password: str = "Zx81kfPq22mmA"') == ["Zx81kfPq22mmA"]
    assert literals('apiKey: string = "Zx81kfPq22mmA"') == ["Zx81kfPq22mmA"]
    assert literals('secretkey = "Zx81kfPq22mmA"\nprivatekey=Qm92kfPq22mmB\ndbpassword: "h7Kq02mmA9"') == ["Zx81kfPq22mmA", "Qm92kfPq22mmB", "h7Kq02mmA9"]
    assert literals("token: Zx81kfPq22mm=\n") == ["Zx81kfPq22mm="]
    assert literals('monkey = "Zx81kfPq22mmA"') == []


def test_constants_and_literals_of_any_length():
    names = [f"p{i}" for i in range(70)]
    text = "".join(f'{n} = "a1B2c3D4-{n}"\n' for n in names)
    direct = "password = " + " + ".join(f'"a1B2c3D4-{n}"' for n in names)
    assert len(literals(direct)) == 70
    assert literals(text + "c = " + " + ".join(names) + "\npassword = c\n") == literals(direct)
    # the line ends long after the literal's first 4,096 characters, and before its quote
    assert literals('password = "' + "aB1-" * 1250 + "\n" + "q" * 5000 + '"') == []
    assert literals('password = "' + "aB1-" * 2500 + '"') == ["aB1-" * 2500]
    # escapes and chains of constants take time in proportion to the text
    assert literals('password = "' + '\\"' * 200_000) == []
    assert len(literals("secret = 'xY1-k'\n" + "secret = secret + 'xY1-k'\n" * 10_000)) > 9_990


def test_odd_rows(spark):
    long = "a" * 300_000 + " password=" + "b" * 100_000 + "'" * 1000
    turkish = "İ paſſword=abcdefgh TOKEN:'AbC123_x' password:token:abcdefg"
    rows = [(1, None, 1), (2, "", 1), (None, turkish, 1), (3, long, 1), (3, long, 1), (4, "token=" * 5000, 1), (5, '"' * 5000 + "secret='" * 3000, 1)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert len(got) == len(rows)
    for r, (d, t, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        assert r.doc_id == d
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "lexed"] == slow_base(t or "")
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("unit", ["a:b<", "a:b[", "token:b<x,", "secret|b:", "a = b + ", "key?:x|"])
def test_one_long_line_is_linear(unit):
    began = time.process_time()
    all_spans(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 10
