import math
import random
from collections import Counter

import pytest

from hopwise.llm.license_scan import IDENTIFIERS, LEAST_COSINE, MARGIN, TEMPLATES, Matcher, _terms, barred_terms, needed_terms, scan_licences

MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc."""
GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
INSIDE = "This is a small tool of ours. Released under the MIT License. It reads many files and writes only a few of them."
APACHE_HEADER = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
BSD_FILE = """Copyright (c) 2019, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
PROSE = "The permission of the owner is asked for in general, and the work is public under no version of a rule."


@pytest.mark.parametrize("text, name", [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (GPL_FILE, "GPL-3.0"), (GPL_HEADER, "GPL-3.0"), (APACHE, "Apache-2.0"), (INSIDE, "MIT"), (PROSE, None),
    (APACHE_HEADER, "Apache-2.0"), (BSD_FILE, "BSD-3-Clause"), ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("# SPDX-License-Identifier: Beerware", None)])
def test_wrapped_and_embedded_notices(text, name):
    for n in (0, 100, 900):  # no use of the terms elsewhere, some, nearly all texts
        df = {w: n for _, t in (*TEMPLATES, *IDENTIFIERS) for w in _terms(t)}
        found = Matcher(1000, df).best_of_text(text)
        assert (found and found[1]) == name


def test_wrapped_licence_files_license_what_is_below(spark):
    rows = [(1, "a/LICENSE", MIT), (2, "a/x/code.py", "nothing here"), (3, "b/COPYING", GPL_FILE), (4, "b/y.py", "nothing"), (5, "c/z.py", "none")]
    got = {r.doc_id: (r.licence, r.via) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: (None, "none")}


GNU = """This {what} is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details."""
FULL = {name: max((t for n, t in TEMPLATES if n == name), key=len) for name, _ in TEMPLATES}
GOLDEN = [
    (GNU.format(what="program", a=":", b=",", kind="Affero ", v=3), "AGPL-3.0"),
    (GNU.format(what="program", a=":", b=",", kind="", v=3), "GPL-3.0"),
    (GNU.format(what="program", a=";", b=";", kind="", v=2), "GPL-2.0"),
    (GNU.format(what="library", a=";", b=";", kind="Lesser ", v="2.1"), "LGPL-2.1"),
    (GNU.format(what="library", a=":", b=",", kind="Lesser ", v=3), "LGPL-3.0"),
    (GNU.format(what="file", a=":", b=",", kind="Affero ", v=3), "AGPL-3.0"),
    ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007", "AGPL-3.0"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999", "LGPL-2.1"),
    ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "LGPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "GPL-2.0"),
    ("Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS", "Apache-2.0"),
    ("Attribution 4.0 International\n\n=====\n\nCreative Commons Corporation is not a law firm", "CC-BY-4.0"),
    ("Attribution-ShareAlike 4.0 International\n\n=====", "CC-BY-SA-4.0"),
    ("Attribution-NonCommercial 4.0 International\n\n=====", "CC-BY-NC-4.0"),
    ("Attribution-NonCommercial-NoDerivatives 4.0 International\n\n=====", "CC-BY-NC-ND-4.0"),
    ("The text is shared under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM", "CC0-1.0"),
    ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED", "EPL-2.0"),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted", "BSL-1.0"),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file)", "BSL-1.0"),
    ("zlib License\n\n(C) 2020 A. Person\n\n" + FULL["Zlib"], "Zlib"),
    ("Copyright (c) 2020 A. Person\n\n" + FULL["BSD-2-Clause"], "BSD-2-Clause"),
    ("Copyright (c) 2020 A. Person\n\n" + FULL["BSD-3-Clause"], "BSD-3-Clause"),
    ("Copyright (c) 2020 A. Person\n\n" + FULL["ISC"], "ISC"),
    ("Copyright (c) 2020 A. Person\n\n" + FULL["0BSD"], "0BSD"),
    ("It may be copied. Distributed under the MIT license. See LICENSE for more.", "MIT"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ('license = "MIT OR Apache-2.0"', "MIT OR Apache-2.0"),
    ("# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND MIT) OR BSD-3-Clause", "GPL-2.0 AND MIT OR BSD-3-Clause"),
    ("SPDX-License-Identifier: MIT OR Beerware", "MIT"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("Attribution of the 4 figures is international, and the version 2.0 is under no license.", None),
]


@pytest.mark.parametrize("text, name", GOLDEN)
def test_public_notices(text, name):
    for n in (0, 100, 900):
        found = Matcher(1000, {w: n for _, t in (*TEMPLATES, *IDENTIFIERS) for w in _terms(t)}).best_of_text(text, True)
        assert (found and found[1]) == name


@pytest.mark.parametrize("name", sorted(FULL))
def test_every_template_is_its_own(name):
    matcher = Matcher(1000, {})
    for n, t in (*TEMPLATES, *IDENTIFIERS):
        if n == name and not (n == "BSD-3-Clause" and len(_terms(t)) < 60):
            assert matcher.best_of_text(f"some words before it\n{t}\nand after", True)[1] == name


def test_runs_against_every_window():
    draw, matcher = random.Random(7), Matcher(1000, {"license": 400, "the": 900})
    templates = [(*t, needed_terms(*t), barred_terms(*t)) for t in TEMPLATES] + [(n, t, frozenset(_terms(n)), frozenset()) for n, t in IDENTIFIERS]
    for _ in range(25):
        words = []
        for _ in range(draw.randint(1, 4)):
            _, t = draw.choice(TEMPLATES)
            words += [w for w in _terms(t)[:90] if draw.random() > 0.04] + draw.choices(["other", "version", "license", "affero", "3", "mit"], k=draw.randint(0, 6))
        want = []
        for name, t, needed, barred in templates:
            own, m, best = Counter(_terms(t)), min(len(_terms(t)), len(words)), 0.0
            for s in range(len(words) - m + 1):
                run = Counter(words[s : s + m])
                if needed <= run.keys() and barred.isdisjoint(words[max(0, s - MARGIN) : s + m + MARGIN]):
                    known = Counter({w: n for w, n in run.items() if w in matcher.idf})
                    other = sum(run.values()) - sum(known.values())
                    x = {w: n * matcher.idf[w] for w, n in known.items()}
                    y = {w: n * matcher.idf[w] for w, n in own.items()}
                    norms = math.sqrt(sum(v * v for v in x.values()) + other**2) * math.sqrt(sum(v * v for v in y.values()))
                    best = max(best, sum(v * y.get(w, 0) for w, v in x.items()) / norms)
            if best >= LEAST_COSINE:
                want.append((round(min(1.0, best), 9), name))
        assert sorted((round(c, 9), n) for _, (c, n) in matcher._runs(words)) == sorted(want)
