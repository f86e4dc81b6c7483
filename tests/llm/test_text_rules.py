"""Licence sentences, line rules and fingerprints against plain versions."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from llm_rows import ODD, words
from pyspark.sql import functions as F

from trophos.llm import fingerprints as P
from trophos.llm import licenses as L
from trophos.llm import line_quality as R
from trophos.llm import queries
from trophos.llm.oracle import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, folder, name):
    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.execute(f"create view {name_of} as select * from '{folder}/{name_of}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    frame = queries.QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(frame.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)


def _scan(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["identifiers"], r["licences"]) for r in L.scan_documents(rows).orderBy("doc_id").collect()]


def test_licence_rules_are_ordered(spark):
    s = L.SENTENCES
    mit = [s["mit-grant"] + ":", s["mit-notice"].capitalize() + ".", s["as-is"].upper() + ".", s["no-liability"] + "."]
    found = _scan(
        spark,
        "\n\n".join(mit),
        "Prose. " + " ".join(mit) + " More prose. Licensed under CC BY-NC 4.0.",
        "\n\n".join(mit[::-1]),
        mit[0].replace(" of this software", "\nof this software") + "\n" + "\n".join(mit[1:]),
        "prose without a mark\nReleased under the MIT License.\nmore",
        "MIT License of nothing. Released under the MITT License.",
    )
    assert found[0] == ("mit-grant mit-notice as-is no-liability", "MIT")
    assert found[1] == ("mit-grant mit-notice as-is no-liability notice:CC-BY-NC-4.0", "CC-BY-NC-4.0 MIT")
    assert found[2] == ("no-liability as-is mit-notice mit-grant", "")
    assert found[3] == found[0]
    assert found[4] == ("notice:MIT", "MIT") and found[5] == ("", "")


def test_longer_rule_wins(spark):
    s = L.SENTENCES
    names = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")
    (found,) = _scan(spark, ".\n".join(s[n] for n in names))
    assert found[1] == "BSD-3-Clause"


GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program{c}"""
NOTICE_TEXTS = {
    "GPL-2.0-or-later": GPL.format(a=";", b=";", kind="", version="2", c="; if not, write to the Free Software\nFoundation, Inc."),
    "GPL-3.0-or-later": GPL.format(a=":", b=",", kind="", version="3", c=".  If not, see <https://www.gnu.org/licenses/>."),
    "AGPL-3.0-or-later": GPL.format(a=":", b=",", kind="Affero ", version="3", c=".  If not, see <https://www.gnu.org/licenses/>."),
    "LGPL-2.1-or-later": GPL.format(a=";", b=";", kind="Lesser ", version="2.1", c="; if not, write").replace(" program", " library"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy",
}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{m}Redistributions of source code must retain the above copyright notice,
  this list of conditions and the following disclaimer.
{m}Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{clause}
THIS SOFTWARE IS PROVIDED BY {by} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL {by} BE LIABLE FOR ANY DIRECT DAMAGES."""
NAMES_CLAUSE = """{m}Neither the name of {who} nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""
HOLDERS = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ONLY = GPL.replace("either version {version} of the License, or\n(at your option) any later version.", "version {version} of the License.")


def _bsd(mark="* ", who=None, by=HOLDERS, clause=""):
    return BSD.format(m=mark, by=by, clause=NAMES_CLAUSE.format(m=mark, who=who) if who else clause)


#: Real notices, as they are found in files, and what they are.
EXPECTED = [
    (_bsd(), "BSD-2-Clause"),
    (_bsd("1. ", by="THE REGENTS"), "BSD-2-Clause"),
    (_bsd("", by="JANE DOE"), "BSD-2-Clause"),
    (_bsd(who="the copyright holder"), "BSD-3-Clause"),
    (_bsd(who="Google Inc."), "BSD-3-Clause"),
    (_bsd("   - ", who="the University of California, Berkeley"), "BSD-3-Clause"),
    (_bsd("3. ", who="the <organization>", by="<COPYRIGHT HOLDER>"), "BSD-3-Clause"),
    (_bsd(clause="* The name of the author must be spelled in the permission notice of each copy of the work.\n"), ""),
    (_bsd(clause="* Neither the name of A nor anyone may distribute this software on weekdays.\n"), ""),
    (MIT, "MIT"),
    ("Copyright (c) 2020 Someone\n\n" + MIT + " IN NO EVENT", "MIT"),
    (MIT.replace("substantial portions of the Software.", "portions. Permission to sell copies is withheld."), ""),
    (ONLY.format(a=";", b=";", kind="", version="2", c="."), "GPL-2.0-only"),
    (ONLY.format(a=":", b=",", kind="", version="3", c="."), "GPL-3.0-only"),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation.\n\nThis program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE.",
        "GPL-2.0-only",
    ),
    (GPL.format(a=":", b=",", kind="Lesser ", version="3", c=".").replace(" program", " library"), "LGPL-3.0-or-later"),
    (
        "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held "
        "liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this "
        "software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to "
        "the following restrictions:\n\n1. The origin of this software must not be misrepresented;",
        "Zlib",
    ),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("Licensed under Creative Commons Attribution-ShareAlike 3.0 Unported.", "CC-BY-SA-3.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("// SPDX-License-Identifier: Apache-2.0\n#include <x>", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only"),
    ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: Made-Up-1.0", ""),
    (
        "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 "
        "which is available at\nhttps://www.eclipse.org/legal/epl-2.0.",
        "EPL-2.0",
    ),
    ("This file is released under the zlib License.", "Zlib"),
    ("This project is available under the ISC license.", "ISC"),
    ("Copyright 2001 A. Person. All rights reserved.", ""),
]


def test_notices_with_names_and_clauses(spark):
    found = _scan(spark, *[text for text, _ in EXPECTED])
    assert [(i, *f) for i, (f, (_, name)) in enumerate(zip(found, EXPECTED)) if f[1] != name] == []


def test_standard_notices(spark):
    texts = list(NOTICE_TEXTS.values())
    commented = ["\n".join(f" * {line}".rstrip() for line in t.split("\n")) for t in texts]
    names = list(NOTICE_TEXTS)
    assert [x[1] for x in _scan(spark, *texts, *commented)] == names * 2
    other = [t.replace("version 2", "version 7").replace("version 3", "version 7").replace("v. 2.0", "v. 1.1") for t in texts[:5]]
    assert {x[1] for x in _scan(spark, *other)} == {""}


def test_gnu_rules_in_all_their_forms(spark):
    """Each mark before the version and before "without even", each subject."""
    texts, names = [], []
    for name, kind, version in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"),
        ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
    ):
        for mark in ";,":
            for last in ";,":
                for subject in ("program", "library"):
                    text = GPL.format(a=";", b=mark, kind=kind, version=version, c=".").replace("WARRANTY;", "WARRANTY" + last)
                    texts.append(text.replace(" program", " " + subject))
                    names.append(f"{name}-or-later")
    assert [x[1] for x in _scan(spark, *texts)] == names
    own = [name for name, ids in L.RULES if name in L.GNU_GRANTS and name.endswith("or-later") and ids[0][:7] != "notice:"]
    assert len(texts) == len(own)


def test_odd_rows_of_the_scan(odd, empty):
    rows = L.scan_documents(odd).collect()
    assert len(rows) == len(ODD) and {r["n_found"] for r in rows} == {0}
    assert L.scan_documents(empty).count() == 0


# --- line rules ---------------------------------------------------------------


def _plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 2 * len(covered) > len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_of_odd_rows(odd, empty):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    rows = sorted((key(tuple(r)[:7]) for r in R.judge(odd).collect()))
    assert rows == sorted(key((i, *_plain(t))) for i, t in ODD)
    assert R.judge(empty).count() == 0


def test_line_rules(spark):
    good = "This is a sentence of eight words or more."
    lines = {
        good: True,
        "home | products | about | contact": False,
        "a heading": True,
        "Accept all cookies": False,
        "the### cat&&& sat*** on%%% it.": False,
        "WHO!! SHOUTS!! LIKE!! THIS.": False,
        "eight words without any mark at the end": False,
        "x" + "y" * 5000 + ".": True,
        " ": False,
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["text"]: r["ok"] for r in rows.select("text", R.line_passes(rows["text"]).alias("ok")).collect()}
    assert {x: ok for x, ok in got.items() if x.strip()} == {x: ok for x, ok in lines.items() if x.strip()}
    text = "\n".join([good, "", "home | products | about | contact", good])
    (row,) = R.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["clean_text"] == "\n".join([good, "", good])


def test_too_much_lost(spark):
    keep = " ".join(f"word{i}" for i in range(60)) + "."
    lose = " | ".join(f"item{i}" for i in range(80))
    rows = spark.createDataFrame([(1, keep), (2, keep + "\n" + lose)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in R.judge(rows).collect()} == {1: True, 2: False}


# --- fingerprints ---------------------------------------------------------------


def _chain(*parts):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64(part.encode(), seed).intdigest()
    return seed


def _plain_fingerprint(text, size=5):
    w = words(text)
    if not w:
        return ""
    shingles = [w[i : i + size] for i in range(len(w) - size + 1)] or [w]
    bins = {}
    for s in shingles:
        h = _chain(*s)
        signed = h - (1 << 64) if h >> 63 else h
        b = (signed >> 57) + 64
        bins[b] = min(bins.get(b, h), h)
    tries, out = P._tries(), ""
    for b in range(P.BINS):
        found = [b, *tries[b * P.TRIES : (b + 1) * P.TRIES]]
        own = next((bins[t] for t in found if t in bins), None)
        if own is None:
            rank = {j: _rank(b, j) for j in bins}
            own = bins[min(rank, key=rank.get)]
        out += f"{own & 15:x}"
    return out


def _rank(b, j):
    h = xxhash.xxh64(j.to_bytes(4, "little"), xxhash.xxh64(b.to_bytes(4, "little"), 42).intdigest()).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints_of_odd_rows(odd, empty):
    rows = P.fingerprint(odd).collect()
    key = lambda x: (x[0] or -1, *x[1:])
    assert sorted(map(key, rows)) == sorted(key((i, len(t or ""), _plain_fingerprint(t))) for i, t in ODD)
    assert P.fingerprint(empty).count() == 0 and P.beside_next(empty).count() == 0


def test_next_document_and_edit(spark, odd, documents):
    for frame in (odd, documents, odd.where("doc_id = 7"), odd.where("doc_id is null")):
        pairs = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        pairs.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
        expected = []
        for i, (doc, text) in enumerate(pairs):
            after, third = pairs[(i + 1) % len(pairs)][1], len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            expected.append((doc or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), text == after))
        rows = P.beside_next(frame).collect()
        got = [(r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in rows]
        assert sorted(got) == sorted(e[:3] for e in expected)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


@pytest.mark.parametrize("kind", ["outlier", "cluster", "one id", "null ids"])
def test_parts_are_balanced(spark, kind):
    """Parts follow the rows: with an outlying id, a narrow cluster among wide ids, and rows of one id or none."""
    n = 6_000
    ids = {
        "outlier": "if(id = 0, 1000000000000, id)",
        "cluster": "if(id < 3000, 7000000 + id, id * 100000000)",
        "one id": "if(id < 3000, 7, id)",
        "null ids": "if(id < 3000, null, id)",
    }[kind]
    rows = spark.range(n).select(F.expr(ids).alias("doc_id"), F.concat(F.xxhash64("id").cast("string"), F.lit(" a b")).alias("text"))
    sizes = [r["count"] for r in P._dealt(rows).where("not _guest").groupBy("_part").count().collect()]
    parts = P.PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == n and len(sizes) > parts / 2 and max(sizes) < 4 * n / parts
    assert P._dealt(rows).where("_guest").count() == len(sizes)
    ordered = rows.orderBy(F.desc_nulls_last("doc_id"), "text").toPandas()["text"].tolist()
    third = [len(t) // 3 for t in ordered]
    expected = [t[: len(t) - k] + ordered[(i + 1) % n][:k] for i, (t, k) in enumerate(zip(ordered, third))]
    got = P.beside_next(rows).select("edited_sha256").toPandas()["edited_sha256"]
    assert sorted(got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in expected)


def test_likeness_is_unbiased(documents):
    pairs = [(r["doc_id"], r["text"] or "") for r in documents.orderBy("doc_id", ascending=False).collect()]
    near = {r["doc_id"]: r["near_edited"] for r in P.beside_next(documents).collect()}
    errors = []
    for i, (doc, text) in enumerate(pairs):
        after, third = pairs[(i + 1) % len(pairs)][1], len(text) // 3
        a, b = (set(zip(*[words(t)[k:] for k in range(5)])) for t in (text, text[: len(text) - third] + after[:third]))
        if len(a) > 20:
            errors.append(near[doc] - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06
