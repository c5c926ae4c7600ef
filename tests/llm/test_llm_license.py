"""Sentence-rule licence scan: wrapped sentences, ordered rules, and the SQL on the whole table."""

import os

import pytest
from llm_fixtures import documents, odd_texts

from cohortforge.llm import license_scan
from cohortforge.llm.license_scan import RULES, SENTENCES, Recogniser

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def found(spark, *texts):
    rows = license_scan.scan(documents(spark, list(texts), clashes=True)).orderBy("doc_id").collect()
    return [(r.sentence_ids, r.licenses, r.license_group) for r in rows]


def test_wrapped_sentences_and_longer_rules_first(spark):
    assert found(spark, "Intro text.\n" + MIT, "Licensed under the MIT License.", "x licensed under the MIT license. y") == [
        ("mit-grant,mit-notice", "MIT", "permissive"),
        ("mit-ref", "MIT", "permissive"),
        ("", "", "none"),
    ]


def test_the_strictest_group_of_several(spark):
    text = "Released under the MIT License. All rights reserved. This work is licensed under the GNU General Public License version 3.\n"
    assert found(spark, text) == [("mit-ref,all-rights,gpl3-ref", "MIT,proprietary,GPL-3.0", "restricted")]


def test_order_matters():
    rec = Recogniser(SENTENCES, RULES)
    assert rec.licences(["apache2-ref", "apache2-comply"]) == [("Apache-2.0", "permissive")]
    assert rec.licences(["apache2-comply", "apache2-ref"]) == [("Apache-2.0", "permissive")]
    assert rec.licences(["mit-notice", "apache2-comply"]) == []
    assert rec.licences(["mit-grant", "gpl3-ref", "mit-notice"]) == [("MIT", "permissive"), ("GPL-3.0", "copyleft")]


def test_odd_texts_and_own_rules(spark):
    rows = odd_texts()
    got = license_scan.scan(documents(spark, rows, clashes=True)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert {r.license_group for r in got} == {"none"}
    assert license_scan.scan(documents(spark, [])).collect() == []
    own = license_scan.scan(documents(spark, ["Free for all. Ask first."]), {"free for all": "a", "ask first": "b"}, [(("a", "b"), "Z", "copyleft")]).collect()
    assert (own[0].licenses, own[0].license_group) == ("Z", "copyleft")
    assert license_scan.scan(documents(spark, ["All rights reserved."]), {}, []).collect()[0].n_sentences == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_equals_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(duckdb.sql(license_scan.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()) == want
    assert any(w[1] for w in want)


BSD3 = """Copyright (c) 2020, X. All rights reserved.
Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
   conditions and the following disclaimer in the documentation and/or other materials
   provided with the distribution.
"""
ENDORSE = """3. Neither the name of X nor the names of its contributors may be used to endorse or
   promote products derived from this software without specific prior written permission."""


@pytest.mark.parametrize(
    "text, licences, group",
    [
        ("This project is licensed under the MIT License.", "MIT", "permissive"),
        ("Licensed under the MIT License, see LICENSE", "MIT", "permissive"),
        ("Copyright 2020 X, all rights reserved", "proprietary", "restricted"),
        ("It is unlicensed under the MIT License", "", "none"),
        (BSD3 + ENDORSE, "BSD-3-Clause", "permissive"),
        (BSD3, "BSD-2-Clause", "permissive"),
        ("you can redistribute it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later", "copyleft"),
        ("We are covered by the GNU Affero General Public License v3.", "AGPL-3.0", "copyleft"),
        ("This is subject to the terms of the Mozilla Public License, v. 2.0; docs: CC0", "MPL-2.0", "copyleft"),
        ("License: ISC. Parts are released under the EPL 2.0 and under the Unlicense.", "ISC,EPL-2.0", "copyleft"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC0-1.0\nx", "MIT,Apache-2.0,CC0-1.0", "permissive"),
        ("\n".join(MIT.split()), "MIT", "permissive"),
    ],
)
def test_clauses_inside_sentences(text, licences, group):
    rec = Recogniser(license_scan.CATALOGUE, license_scan.ORDERED, inside=True)
    got = rec.licences(rec.identifiers(text))
    assert ",".join(x for x, _ in got) == licences
    assert next((g for g in license_scan._ORDER if any(x == g for _, x in got)), "none") == group


def test_a_sentence_of_any_number_of_pieces():
    assert Recogniser(SENTENCES, RULES).identifiers("\n".join(MIT.split())) == ["mit-grant", "mit-notice"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_sql(spark):
    from cohortforge.llm.queries import op9_license_scan

    duckdb.sql(f"create or replace view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(tuple(r) for r in op9_license_scan(spark, SF).collect()) == sorted(duckdb.sql(license_scan.ORACLE_SQL).fetchall())


def plain_identifiers(text):
    """Identifiers by brute force: at each word of the text the longest clause of the catalogue that its words spell out."""
    import re

    clauses = {tuple(c.split()): name for c, name in license_scan.CATALOGUE.items()}
    longest = max(map(len, clauses))
    words = re.findall("[a-z0-9]+", text.lower())
    out, i = [], 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            if tuple(words[i : i + n]) in clauses:
                out.append(clauses[tuple(words[i : i + n])])
                i += n
                break
        else:
            i += 1
    return out


def plain_licences(ids):
    out, i = [], 0
    while i < len(ids):
        rule = next((r for r in license_scan.ORDERED if tuple(ids[i : i + len(r[0])]) == r[0]), None)
        if rule:
            out.append(rule[1])
        i += len(rule[0]) if rule else 1
    return out


def planted_licences(seed=4):
    """Texts with a reference to every known licence or whole licence texts, wrapped at odd widths behind comment marks, in other prose."""
    import random
    import textwrap

    from llm_fixtures import prose

    rng = random.Random(seed)
    out = []
    for _, licence, _, names in license_scan._NAMES:
        lead = rng.choice(["licensed under", "released under", "distributed under", "made available under"])
        notice = f"This project is {lead} {rng.choice(['', 'the '])}{rng.choice(names).title()}."
        out.append((licence, notice))
    out += [("MIT", MIT), ("BSD-3-Clause", BSD3 + ENDORSE), ("BSD-2-Clause", BSD3)]
    texts = []
    for licence, notice in out:
        mark = rng.choice(["", "# ", " * ", "// "])
        lines = textwrap.wrap(" ".join(notice.split()), rng.choice([18, 30, 72]), break_long_words=False, break_on_hyphens=False)
        texts.append((licence, prose(rng, 40) + "\n" + "\n".join(mark + x for x in lines) + "\n" + prose(rng, 40)))
    return texts


def test_equals_brute_force_and_finds_planted_licences(spark):
    """Sequences, wrapped clauses and several licences in one text; of the planted licences at least nine in ten are found by name."""
    planted = planted_licences()
    texts = [t for _, t in planted] + [planted[i][1] + planted[-i][1] for i in range(1, 12)]
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)] + [(0, texts[0])]
    got = sorted(((r.doc_id, r.sentence_ids, r.licenses) for r in license_scan.scan(documents(spark, rows, clashes=True), license_scan.CATALOGUE, license_scan.ORDERED, inside=True).collect()), key=str)
    want = sorted(((i, ",".join(plain_identifiers(t)), ",".join(plain_licences(plain_identifiers(t)))) for i, t in rows), key=str)
    assert got == want
    hits = [licence in plain_licences(plain_identifiers(t)) for licence, t in planted]
    assert sum(hits) / len(hits) >= 0.9
    assert max(len(i.split(",")) for _, i, _ in got) >= 4
