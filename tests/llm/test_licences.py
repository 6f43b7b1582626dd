import os
import textwrap

import duckdb
import pandas as pd
import pytest

from ordermart.llm import licences

COLUMNS = ["doc_id", "digest", "licence", "notices", "n_notice_lines"]


def rows():
    mit, bsd = licences.TEXTS["MIT"][1], licences.TEXTS["BSD-3-Clause"][0]
    out = [
        (1, mit),
        (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("\n", "\r\n\r\n") + "  "),
        (3, "// © 1999 A. N. Other, all rights reserved\n" + bsd.replace("copyright holder nor", "COPYRIGHT holder  nor")),
        (4, mit + " and more"),
        (5, licences.TEXTS["Zlib"][0].replace("acknowledgment", "acknowledgement")),
        (6, "some prose\nLicensed under CC BY-NC 4.0.\nmore\n  * released under the MIT licence\nLicensed under CC BY-NC 4.0.\nin a line: Released under the MIT License."),
        (7, None),
        (8, ""),
        (9, "...\n!!"),
        (10, "licence licence licence programme programme é ß"),
        (6, "some prose\nLicensed under CC BY-NC 4.0."),
        (1, mit),
        (None, "SPDX-License-Identifier: Apache-2.0"),
        (11, "word " * 60_000 + "\nReleased under the MIT License."),
        (13, "Copyright (c) 2020 Some One " + mit.split("\n", 1)[1] + "\n(c) You must keep it\n(c) Some One\n© in any case"),
        (14, "MIT License - Copyright A, B permission\nis granted\ncopyright notice kept\n  ## COPYRIGHT 2020 and others; licensed\nunder it"),
        (15, "copyright\x01notice\x02 (c)\x01 you\ncopyright\x02 x\n\x01copyright law\n© permission to\ncopyrights x\n(c)permission is"),
        (16, licences.TEXTS["ISC"][0].replace("copyright notice", "\ncopyright notice")),
        (17, "## Unlicence\n" + licences.UNSIGNED_TEXTS["Unlicense"][0]),
        (18, "\n".join("/* " + x for x in licences.UNSIGNED_TEXTS["BSL-1.0"][1].split("\n"))),
        (12, "a copyright b\nx\u0085(c) y\ncopyright\n(c)\nAll Rights Reserved.\nz"),
    ]
    return out


def test_equals_sql(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "'x' as digest", "'y' as licence", "0 as n")
    got = [tuple(r) for r in licences.scan(df).select(COLUMNS).collect()]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    expected = [tuple(r) for r in con.execute(licences.oracle()).fetchall()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(expected, key=key)
    by = {(r[0], r[3]): r for r in got}
    assert [by[k, ""][2] for k in (1, 2, 3, 4, 5)] == ["MIT", "MIT", "BSD-3-Clause", None, "Zlib"]
    assert sorted(k for k in by if k[0] and k[0] >= 13) == [(k, "") for k in range(13, 19)]
    assert [by[k, ""][2] for k in (16, 17, 18)] == ["ISC", None, "BSL-1.0"]
    assert by[6, "CC-BY-NC-4.0,MIT"][4] == 3
    assert by[7, ""][1] is None and by[9, ""][1] is None
    assert by[None, "Apache-2.0"][4] == 1


def test_wrapping_and_notices_on_the_line(spark):
    rows, notice = [], "Copyright (c) 2020, Some One"
    for name, many in licences.TEXTS.items():
        for k, text in enumerate(many):
            forms = [textwrap.fill(text, w) for w in (20, 27, 33, 50, 61, 72, 100, 100_000)]
            forms += [f"{notice}\n{x}" for x in forms]
            title = text.split("\n")[0] if k else ""
            body = text[len(title) :].strip()
            for said in (notice, "© 2019 X", "Copyright Some One and others", notice + ". All rights reserved."):
                forms.append(" ".join(f"{title} {said} {body}".split()))
                forms.append(f"{title}\n\n{said}\n\n{body}")
            rows += [(name, x) for x in forms]
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [(n, got[k], x[:60]) for k, (n, x) in enumerate(rows) if got[k] != n] == []


def test_prose_stays(spark):
    prose = ["copyright notice kept", "COPYRIGHT HOLDERS BE LIABLE", "copyrighted works", "(c) You must retain"]
    gone = ["copyright", "(c)", "# Copyright 2020 X", "Copyright The Authors", "(c) Some One"]
    df = spark.createDataFrame(list(enumerate(prose + gone)), "doc_id long, text string")
    got = {r.doc_id: r.digest is not None for r in licences.scan(df).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(prose) + [False] * len(gone)


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PUBLISHED = "/usr/share/common-licenses"  # where Debian keeps the official texts


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no official texts here")
def test_long_licences(spark):
    """Official texts, rewrapped or filled in, are known; changed ones are not."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for name, file in names.items():
        path = f"{PUBLISHED}/{file}"
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as f:
            text = f.read()
        indented = "\n".join("   # " + x for x in text.split("\n"))
        rows += [(name, x) for x in (text, text.upper(), text.replace("\n", "\r\n"), indented, text.replace("http:", "https:"))]
        rows += [(name, "Copyright 2020 Some One\n\n" + text), (None, text + " more"), (None, text.replace("not", "", 1))]
        if name == "Apache-2.0":
            rows += [(name, text.replace("[yyyy] [name of copyright owner]", "2020 Some One")), (name, text.split("   APPENDIX:")[0])]
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [(n, got[k], k) for k, (n, _) in enumerate(rows) if got[k] != n] == []


def test_wrapping_of_unsigned_texts(spark):
    rows = [(n, textwrap.fill(t, w, break_long_words=False)) for n, many in licences.UNSIGNED_TEXTS.items() for t in many for w in (20, 33, 50, 72, 100_000)]
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [(n, got[k], x[:60]) for k, (n, x) in enumerate(rows) if got[k] != n] == []


def test_tables_of_ones_own(spark):
    own = licences.digested(spark.createDataFrame([("B", "Own terms."), ("A", "own  TERMS"), ("C", "..."), ("D", None)], "licence string, text string"))
    assert [(r.licence) for r in own.collect()] == ["A"]
    df = spark.createDataFrame([(1, "OWN\nterms!"), (2, licences.TEXTS["MIT"][0])], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(df, texts=own).collect()} == {1: "A", 2: None}
