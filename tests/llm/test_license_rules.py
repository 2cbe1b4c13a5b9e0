"""License rules: keywords and the gate against every text that a rule matches."""

import re
from itertools import product
from re import _parser

import pytest

from weftgraph.llm import license_scan


def texts(tree):
    """Texts of a parsed pattern: each alternative, each optional part in and out, each character of a class."""
    parts = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            chars = [range(a[0], a[1] + 1) if str(o) == "RANGE" else [a] for o, a in arg]
            parts.append([chr(c) for r in chars for c in (r if len(r) < 5 else r[:1])])
        elif op == "BRANCH":
            parts.append([t for branch in arg[1] for t in texts(branch)])
        elif op == "SUBPATTERN":
            parts.append(texts(arg[-1]))
        else:
            assert op == "MAX_REPEAT" and arg[:2] == (0, 1), op
            parts.append(["", *texts(arg[2])])
    return ["".join(p) for p in product(*parts)]


def test_every_match_holds_its_keyword_and_a_gate_word():
    missed = []
    for r in license_scan.rules():
        for t in texts(_parser.parse(r["rx"])):
            assert re.fullmatch(r["rx"], t)
            if r["kw"] not in t or not any(g in f" {t} " for g in license_scan.GATE):
                missed.append((r["label"], r["kw"], t))
    assert not missed, missed[:5]


@pytest.mark.parametrize("label,name", [("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nc", "Attribution-NonCommercial"), ("cc-by-nd", "Attribution-NoDerivatives")])
def test_label_does_not_depend_on_other_words(spark, label, name):
    text = f"Licensed under the Creative Commons {name} license."
    rows = spark.createDataFrame([(1, text), (2, f"{text} According to whom?")], "doc_id long, text string")
    assert [(r.labels, r.score) for r in license_scan.scan(rows).collect()] == [(label, 0.9)] * 2


FSF = "as published by the Free Software Foundation"
GRANTS = [
    ("gpl-2.0", f"under the terms of the GNU General Public License {FSF}; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", f"under the terms of the GNU General Public License {FSF}, either version 3 of the License, or"),
    ("gpl-2.0", f"under the terms of the GNU General Public License version 2 {FSF}."),
    ("lgpl-2.1", f"the GNU Lesser General Public License {FSF}; either version 2.1 of the License"),
    ("lgpl-3.0", f"the GNU Lesser General Public License {FSF}, either version 3 of the License"),
    ("agpl-3.0", f"the GNU Affero General Public License {FSF}, either version 3 of the License"),
    ("fdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("epl-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("cddl", "subject to the terms of the Common Development and Distribution License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("mit", "Use of this source code is governed by an MIT-style license"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee"),
    ("zlib", "Altered source versions must be plainly marked as such"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("artistic", "you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("cc0", "has waived all copyright and related or neighboring rights"),
]


def test_spdx_tags_and_grants_as_written(spark):
    tags = [(label, tag) for label, tag in license_scan.SPDX]
    tags += [(label, tag + end) for label, tag in tags if "GPL" in tag or "GFDL" in tag for end in ("-only", "-or-later", "+")]
    want = [(label, f"// SPDX-License-Identifier: {tag}\nint x;", 1.0) for label, tag in tags] + [(label, text, 0.9) for label, text in GRANTS]
    rows = spark.createDataFrame([(i, w[1]) for i, w in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: (r.labels.split(","), r.score) for r in license_scan.scan(rows).collect()}
    wrong = [(w, got[i]) for i, w in enumerate(want) if w[0] not in got[i][0] or got[i][1] != w[2] or (w[2] == 1.0 and {*got[i][0]} - {"cc-by"} != {w[0]})]  # cc-by is a base phrase, whose label stays
    assert not wrong, wrong[:8]
