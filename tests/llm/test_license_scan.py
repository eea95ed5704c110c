import math
from collections import Counter

from hopwise.llm.license_scan import IDENTIFIERS, LEAST_COSINE, TEMPLATES, _terms, barred_terms, needed_terms, op2_license_scan, scan_licences, with_paths


def slow(rows):
    """rows: (id, path, text); every line against every template, every directory in turn."""
    texts = [set(_terms(t or "")) for _, _, t in rows]
    vocabulary = {w for _, t in (*TEMPLATES, *IDENTIFIERS) for w in _terms(t)}
    idf = {w: 1 + math.log((1 + len(rows)) / (1 + sum(w in t for t in texts))) for w in vocabulary}

    def vector(line):
        c = Counter(w if w in vocabulary else "" for w in _terms(line))
        v = {w: n * idf.get(w, 1.0) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    templates = [(vector(t), name, needed_terms(name, t), barred_terms(name, t)) for name, t in TEMPLATES]

    def fits(line, needed, barred):
        return needed <= set(_terms(line)) and barred.isdisjoint(_terms(line))

    own = {}
    for i, _, text in rows:
        best = max((sum(x * t.get(w, 0) for w, x in vector(line).items()), name) for line in (text or "").split("\n") for t, name, *words in templates if not any(words) or fits(line, *words))
        own[i] = best if best[0] >= LEAST_COSINE else None
    of = {}
    for i, p, _ in rows:
        if p and own[i] and p.split("/")[-1].upper().startswith(("LICENSE", "COPYING")):
            d = p.rpartition("/")[0]
            of[d] = max(of.get(d, (0, "")), own[i])
    out = {}
    for i, p, _ in rows:
        out[i] = (own[i][1], "own") if own[i] else (None, "none")
        d = (p or "").rpartition("/")[0]
        while not own[i] and p is not None:
            if d in of:
                out[i] = (of[d][1], "inherited")
                break
            if not d:
                break
            d = d.rpartition("/")[0]
    return out


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.path, r.text) for r in with_paths(spark.read.parquet(f"{d}/documents.parquet")).collect()]
    got = {r.doc_id: (r.licence, r.via) for r in op2_license_scan(spark, d).collect()}
    assert got == slow(rows)
    assert Counter(v for _, v in got.values())["own"] > 10


def test_inheritance_and_odd_rows(spark):
    mit, apache = "Released under the MIT License.", "x y\nLicensed under the Apache License, Version 2.0\nz"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", apache), (4, "a/y.py", None), (5, "z.py", ""), (6, "q/r.py", "w " * 200_000),
        (7, "a/b/own.py", mit), (8, None, "text"), (8, None, "text"), (9, "a/b/licensed.py", "not a licence file"), (None, "a/n.py", "n"),
    ]
    files = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, path string, text string, near int")
    got = scan_licences(files).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.licence, r.via) for r in got}
    assert by == slow(rows) and by[2] == ("Apache-2.0", "inherited") and by[4] == ("MIT", "inherited")
    root = scan_licences(spark.createDataFrame([(1, "LICENSE", mit, 0), (2, "a/b", "x", 0)], "doc_id long, path string, text string, near int"))
    assert {r.doc_id: r.via for r in root.collect()} == {1: "own", 2: "inherited"}
    assert scan_licences(files.limit(0)).count() == 0
