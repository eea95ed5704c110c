"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from directories.

Cosine cannot see the one word or number in which licences of a family differ, so templates also
need their telling terms and bar those of their neighbours.

Candidates are every line of every text, every run of as many words as a template has (so
that notices wrapped over lines or set in a paragraph are met), and a licence file as a whole;
they and each template (whole licence texts, titles, headers, identifier lines) are sparse
TF-IDF vectors over the templates' vocabulary plus one term for all other words.  Document
frequencies are counted over all texts.  A file without a notice of its own takes the licence
of the nearest directory above it that holds a licence file, found by joining the ancestors of
each directory with the licensed ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map, checkpointed

#: (licence, notice): fixed values, in the licences' own public words.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    # titles of the licence files, and the notices that they ask for
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Distributed under the MIT license"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-ND-4.0", "Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    )
#: Words that tell licences of one family apart, where cosine cannot: a candidate has those of the
#: template, and none of the others that a neighbouring licence would have there.
TELLING = (
    frozenset("affero lesser".split()),
    frozenset("sa nc nd sharealike noncommercial noderivatives".split()),
    frozenset("endorse".split()),
    frozenset("appear".split()),
)
_FAMILIES = (("GPL", 0), ("LGPL", 0), ("AGPL", 0), ("CC-", 1), ("BSD-", 2), ("ISC", 3), ("0BSD", 3))
_VERSIONED = ("GPL", "LGPL", "AGPL", "CC", "MPL", "Apache", "EPL", "BSL")
_VERSION = re.compile(r"v?[0-9](?:\.[0-9])?")
#: Words around a run that may bar it, and words from which a template is a licence's own text
#: and not a title or notice.
MARGIN, WHOLE_TEXT = 4, 60
#: Identifier lines as headers; such a template also needs all terms of its identifier, as the
#: other words are the same for every licence.
IDENTIFIERS = tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in TEMPLATES}))
LEAST_COSINE = 0.85
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_LICENCE_FILE = "(?i)^(licen[sc]e|copying|notice)([-._].*)?$"
_OTHER = ""
# an expression of identifiers, on the line of a tag or a setting
_EXPRESSION = re.compile(r"""(?i)(?:SPDX-License-Identifier:|\blicen[sc]e["']?\s*[=:])\s*["']?([\w.+() -]+)""")
_OPERATOR = re.compile(r"\s+(OR|AND)\s+")


def _terms(line: str) -> list[str]:
    return _TOKEN.findall(line.lower())


def needed_terms(name: str, template: str) -> frozenset[str]:
    """Terms without which nothing is a candidate for the template."""
    terms = _terms(template)
    if len(terms) <= 4:
        return frozenset(terms)
    own = {w for words in TELLING for w in words}.intersection(terms)
    versions = {w for w in terms if _VERSION.fullmatch(w)} if name.startswith(_VERSIONED) else set()
    return frozenset(own | versions)


def barred_terms(name: str, template: str) -> frozenset[str]:
    """Terms that a candidate for the template must not have: a neighbour's telling words."""
    words = {w for start, family in _FAMILIES if name.startswith(start) for w in TELLING[family]}
    short = name.startswith("BSD-3") and len(_terms(template)) < WHOLE_TEXT  # the first lines alone may go on so
    return frozenset() if short else frozenset(words.difference(_terms(template)))


def identifier_operands(line: str) -> tuple[list[str], list[str]]:
    """The identifiers of an expression such as ``MIT OR (GPL-2.0-only AND Zlib)``, and what stands
    between them; nothing if the line has no expression of several."""
    m = _EXPRESSION.search(line)
    found = _OPERATOR.split(m[1].replace("(", " ").replace(")", " ").strip()) if m else []
    operands = [re.sub(r"(?i)(-only|-or-later|\+)?(\s+WITH\s.*)?$", "", o.strip()) for o in found[::2]]
    return (operands, found[1::2]) if len(operands) > 1 else ([], [])


def document_frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many of them each vocabulary term stands."""

    def count(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            seen.update(vocabulary.intersection(_terms(text or "")))
        seen[_OTHER] = batch.num_rows
        return {"term": list(seen), "n": list(seen.values())}

    rows = arrow_map(docs.select("text"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in rows}  # one row a vocabulary term
    return by.pop(_OTHER, 0), by


class Matcher:
    """Cosines of lines and runs of words to all templates."""

    def __init__(self, n_docs: int, frequencies: dict[str, int], templates=TEMPLATES, identifiers=IDENTIFIERS, least: float = LEAST_COSINE):
        self.needed = [needed_terms(*t) for t in templates] + [frozenset(_terms(name)) for name, _ in identifiers]
        self.barred = [barred_terms(*t) for t in templates] + [frozenset()] * len(identifiers)
        self.tags = {name.lower(): name for name, _ in identifiers}
        templates = (*templates, *identifiers)
        self.least, self.names = least, [name for name, _ in templates]
        counts = [Counter(_terms(t)) for _, t in templates]
        self.idf = {w: 1 + math.log((1 + n_docs) / (1 + frequencies.get(w, 0))) for c in counts for w in c}
        self.vectors, self.sizes, self.own_telling = [], [sum(c.values()) for c in counts], []
        for c in counts:
            v = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({w: x / norm for w, x in v.items()})
            # a line without any of a template's heaviest terms cannot reach the least cosine
            left, telling = 1.0, set()
            for w, x in sorted(self.vectors[-1].items(), key=lambda i: (-i[1], i[0])):
                if left < least * least:
                    break
                telling.add(w)
                left -= x * x
            self.own_telling.append(frozenset(telling))
        self.telling = frozenset().union(*self.own_telling)
        self.places = {w: i for i, w in enumerate(self.idf, 1)}  # 0: all other words
        self.squares = np.array([1.0, *(x * x for x in self.idf.values())])
        self.gains = [np.array([0.0, *(v.get(w, 0.0) * x for w, x in self.idf.items())]) for v in self.vectors]

    def best_of_text(self, text: str, whole: bool = False) -> tuple[float, str] | None:
        """The best of a text's lines and runs of words, and of itself if it is to count ``whole``.
        A licence's own text goes before titles and notices, which others may share with it."""
        terms = _terms(text)
        if self.telling.isdisjoint(terms):
            return None
        found = self._runs(terms)
        if whole and (b := self._score(terms)):
            found.append(b)
        found += [b for line in text.split("\n") if (b := self._line(line))]
        return max(found, default=(None, None))[1]

    def best(self, line: str) -> tuple[float, str] | None:
        """The best template for a line, or all licences of an expression of identifiers."""
        found = self._line(line)
        return found and found[1]

    def _line(self, line: str) -> tuple[bool, tuple[float, str]] | None:
        names, operators = identifier_operands(line)
        known = [(self.tags[n.lower()], op) for n, op in zip(names, ["", *operators]) if n.lower() in self.tags]
        if len(known) > 1:
            return True, (1.0, "".join(f" {op} {name}" if i else name for i, (name, op) in enumerate(known)))
        return self._score(_terms(line))

    def _fits(self, k: int, terms: set[str]) -> bool:
        return self.needed[k] <= terms and self.barred[k].isdisjoint(terms)

    def _runs(self, terms: list[str]) -> list[tuple[bool, tuple[float, str]]]:
        """For each template the best run of as many words as it has, if it reaches the least cosine."""
        at = np.array([self.places.get(w, 0) for w in terms])
        present, found = set(terms), []
        squares = np.concatenate(([0.0], np.cumsum(self.squares[at])))
        for k, size in enumerate(self.sizes):
            if self.own_telling[k].isdisjoint(present) or not self.needed[k] <= present:
                continue
            m = min(size, len(terms))
            gains = np.concatenate(([0.0], np.cumsum(self.gains[k][at])))
            dots = gains[m:] - gains[:-m]
            # repeats only make a run's norm longer than the root of its words' squares
            may = np.flatnonzero(dots >= self.least * np.sqrt(squares[m:] - squares[:-m]) - 1e-9)
            best = 0.0
            for s in may.tolist():
                if not self.needed[k] <= set(terms[s : s + m]) or not self.barred[k].isdisjoint(terms[max(0, s - MARGIN) : s + m + MARGIN]):
                    continue
                n = np.bincount(at[s : s + m], minlength=len(self.squares))
                best = max(best, float(dots[s] / math.sqrt((n * n * self.squares).sum())))
            if best >= self.least:
                found.append((size >= WHOLE_TEXT, (min(1.0, best), self.names[k])))
        return found

    def _score(self, terms: list[str]) -> tuple[bool, tuple[float, str]] | None:
        if self.telling.isdisjoint(terms):
            return None
        counts = Counter(w if w in self.idf else _OTHER for w in terms)
        v = {w: n * self.idf.get(w, 1.0) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        fit = [k for k in range(len(self.names)) if self._fits(k, counts.keys())]
        found = [(sum(x * v.get(w, 0.0) for w, x in self.vectors[k].items()) / norm, self.names[k], k) for k in fit]
        score, name, k = max(found, default=(0.0, "", 0))
        return (self.sizes[k] >= WHOLE_TEXT, (min(1.0, score), name)) if score >= self.least else None


def own_licences(files: DataFrame, matcher: Matcher, *carried: str) -> DataFrame:
    """(*carried, licence, cosine): the best notice of each text, null if none will do.  Texts
    with ``whole`` set are candidates as a whole, too."""

    def fn(batch: pa.RecordBatch) -> dict:
        licence, cosine = [], []
        for text, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            score, name = matcher.best_of_text(text or "", bool(whole)) or (None, None)
            licence.append(name)
            cosine.append(score)
        return {c: batch.column(i + 2) for i, c in enumerate(carried)} | {"licence": licence, "cosine": cosine}

    kinds = ", ".join(f"{c} {t}" for c, t in files.select(*carried).dtypes)
    return arrow_map(files.select("text", "whole", *carried), fn, f"{kinds}, licence string, cosine double")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, id_col: str = "doc_id", templates=TEMPLATES, identifiers=IDENTIFIERS, least: float = LEAST_COSINE) -> DataFrame:
    """One row per input row: id, path, licence, cosine, via, from_dir.

    ``files`` has an id, path and text.  ``via`` is ``own`` (a notice in the text itself),
    ``inherited`` (from the licence file of ``from_dir``) or ``none``.  Of several licence
    files in a directory the best cosine counts, then the licence's name.  Null or empty texts
    have no notice, null paths no directory; whole texts are read; other columns are ignored;
    an empty table gives no rows.
    """
    vocabulary = frozenset(w for _, t in (*templates, *identifiers) for w in _terms(t))
    matcher = Matcher(*document_frequencies(files, vocabulary), templates, identifiers, least)
    name = F.element_at(F.split("path", "/"), -1)
    base = files.select(F.col(id_col).alias("id"), "path", "text", name.rlike(_LICENCE_FILE).alias("whole"))
    # ids, paths and verdicts: texts are read once for the frequencies and once here
    own = checkpointed(own_licences(base, matcher, "id", "path")).withColumn("dir", _directory(F.col("path")))
    licensed = own.where(F.col("licence").isNotNull() & name.rlike(_LICENCE_FILE))
    licensed = licensed.groupBy(F.col("dir").alias("from_dir")).agg(F.max(F.struct("cosine", "licence")).alias("found"))
    # every directory once, with itself and all above it, the root as ''
    parts = F.split("dir", "/")
    dirs = own.where("licence is null").select("dir").distinct().where("dir is not null")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("steps", "from_dir"))
    nearest = above.join(licensed, "from_dir").groupBy("dir").agg(F.min(F.struct("steps", "from_dir", "found")).alias("near"))
    joined = own.join(nearest.select("dir", "near"), "dir", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("licence", "near.found.licence").alias("licence"),
        F.coalesce("cosine", "near.found.cosine").alias("cosine"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~mine, F.col("near.from_dir")).alias("from_dir"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents laid out as a tree: source / five hundreds / fifties, every tenth a licence file
    of the level that its id names."""
    block, shelf = F.concat(F.lit("b"), F.expr("doc_id div 500")), F.concat(F.lit("c"), F.expr("doc_id div 50"))
    tens = F.col("doc_id") % 30
    path = (
        F.when(tens == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), "doc_id")))
        .when(tens == 10, F.concat_ws("/", "source", block, F.lit("COPYING")))
        .when(tens == 20, F.concat_ws("/", "source", block, shelf, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", block, shelf, F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))))
    )
    return docs.withColumn("path", path)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(with_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("cosine", F.round("cosine", 6))
