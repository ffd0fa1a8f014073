"""Operator 8: notices and whole licence texts, rows without ids, inheritance, and sizes of the corpus."""

import re

from readsift.llm import licenses

MIT = next(t for k, kind, t in licenses.TEMPLATES if k == "MIT" and kind == "text")
BSD = next(t for k, kind, t in licenses.TEMPLATES if k == "BSD-2-Clause" and kind == "text")
SCHEMA = "id long, path string, text string, license string, dir string, words string, line string"


def scan(spark, rows):
    d = spark.createDataFrame([(*x, "y", "z", "w", "l") for x in rows], SCHEMA)
    return licenses.scan_licenses(d).collect()


def wrapped(text, width=9):
    w = text.split()
    return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses(spark):
    f = [
        (1, "LICENSE", "Released under the MIT License."), (2, "src/a.txt", "hello world\nsome words here"), (3, "src/b.txt", "code\n# Licensed under the Apache License, Version 2.0.\nmore and more words of text to follow"),
        (4, "src/deep/COPYING", "This work is licensed under the GNU General Public License, version 3.\nand a long text of other words that has nothing to do with it at all"), (5, "src/deep/er/d.txt", None),
        (6, "x.txt", ""), (7, None, "the license of the work is under this"), (8, "src/deep/g.txt", "word " * 5000 + "\nreleased under the mit license"),
        (9, "lib/LICENSE", wrapped("Copyright (c) 2020 Some One\n" + MIT)), (10, "lib/in/x.c", "int main"), (11, "bsd/LICENSE.txt", wrapped("Copyright 1999 The Authors. All rights reserved.\n" + BSD)), (12, "bsd/a/b/c.py", None),
    ]
    r = {x.id: x for x in scan(spark, f)}
    assert {k: v.license for k, v in r.items()} == {1: "MIT", 2: None, 3: "Apache-2.0", 4: "GPL-3.0", 5: None, 6: None, 7: None, 8: "MIT", 9: "MIT", 10: None, 11: "BSD-2-Clause", 12: None}
    assert {k: v.effective_license for k, v in r.items() if v.license is None} == {2: "MIT", 5: "GPL-3.0", 6: "MIT", 7: "MIT", 10: "MIT", 12: "BSD-2-Clause"}
    assert r[5].inherited_from == "src/deep" and r[2].inherited_from == "" and r[8].line == 1 and r[2].line == -1
    # Full texts are found as wholes: none of their lines is a notice.
    assert r[9].line == licenses.WHOLE and r[9].cosine > 0.9 and r[9].licence_file and r[10].inherited_from == "lib" and r[12].inherited_from == "bsd"
    assert scan(spark, []) == []


def test_neighbours_are_told_apart(spark):
    """A word or number that changes a licence decides, whatever the cosine."""
    lines = {
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 3.0 International License": None,
        "Use of this source code is governed by a GPL-style license.": None,
        "Use of this source code is governed by a BSD-style license.": "BSD-3-Clause",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 9.": None,
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.0": "GPL-3.0",
        "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This is not released under the MIT License.": None,
        "1. Released under the MIT License.": "MIT",
        "Released under the ISC License.": "ISC",
        "Licensed under CC BY-SA 4.0.": None,
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    rows = [(i, f"d{i}/x.txt", t) for i, t in enumerate(lines)] + [(100 + i, f"e/{i}", "some other words of no weight here") for i in range(30)]
    r = {x.id: x.license for x in scan(spark, rows) if x.id < 100}
    assert {t: r[i] for i, t in enumerate(lines)} == lines


def test_rows_without_ids_and_repeats(spark):
    rows = [(None, "a/x.txt", "Released under the MIT License."), (None, "b/x.txt", "plain words"), (1, "c/x.txt", "Released under the MIT License."), (1, "c/y.txt", "Licensed under CC BY-NC 4.0."), (1, "c/y.txt", "Licensed under CC BY-NC 4.0."), (None, None, None)]
    got = sorted((r.path or "", r.license or "", r.effective_license or "") for r in scan(spark, rows))
    assert got == [("", "", ""), ("a/x.txt", "MIT", "MIT"), ("b/x.txt", "", ""), ("c/x.txt", "MIT", "MIT"), ("c/y.txt", "CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("c/y.txt", "CC-BY-NC-4.0", "CC-BY-NC-4.0")]


def test_common_words_weigh_little_in_any_corpus(spark):
    """A notice with words that all files have is found in a small corpus and in one 50 times larger."""
    header = (0, "a/h.txt", "this file by the authors: Released under the MIT License")
    for n in (40, 2000):
        rows = [header, *((i, f"b/{i}.txt", "this file by the authors has other words") for i in range(1, n))]
        assert {r.id: r.license for r in scan(spark, rows) if r.license} == {0: "MIT"}


def test_no_python_runs(spark):
    d = spark.createDataFrame([(1, "a/b", "text")], "id long, path string, text string")
    terms = licenses.template_terms(spark)
    f = d.select(licenses.row_key("id", "path", "text").alias("rid"), "text")
    for p in (licenses.document_frequencies(f), licenses.scan_units(f, terms), licenses.scan_licenses(d)):
        assert not re.search("Python|Pandas|Arrow|MapIn", p._jdf.queryExecution().executedPlan().toString())
