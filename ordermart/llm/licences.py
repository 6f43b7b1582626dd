"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings levelled), digested, and hash-joined to the digests of
known licence texts; so is each of its lines, to those of one-line notices. A
match is a match of the entire unit, never of a part. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RIGHTS_LINE = r"^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: First words of a grant, perhaps over two lines.
GRANT = r"\b(?:permission[^a-z0-9]+(?:is|to)|redistribution[^a-z0-9]+and[^a-z0-9]+use|this[^a-z0-9]+(?:software|project|work)[^a-z0-9]+is|(?:licensed|released)[^a-z0-9]+under)\b"
TITLE = r"(?:the )?(?:mit|isc|zlib|bsd (?:zero|[0-9])[ -]clause) license(?: \(mit\))?|zero-clause bsd"
#: Words after "copyright" or "(c)" at the start of a line that show it is prose (or an item of a list).
PROSE = r"(?:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|rights?|treat(?:y|ies)|protection|infringement|act|and|or|in|to|is)\b"
ITEM = r"(?:you|your|any|all|each|every|if|in|to|for|no|not|such|it|that|this|must|may)\b"
#: A copyright notice at the start of a line, after any marks of a comment and a
#: licence's title (kept, as group 1): to the end of the line or the first words of a grant.
COPYRIGHT_NOTICE = rf"^([^a-z0-9\n]*(?:(?:{TITLE})[^a-z0-9\n]+)?)(?:copyright(?![a-z]|[^a-z0-9\n]*{PROSE})|\(c\)(?![^a-z0-9\n]*{ITEM})|©)(?:(?!{GRANT})[^\n])*"

#: Spellings that licence texts treat as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: One-line notices by licence.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
}

_MIT_TERMS = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC_NOTICE = ", provided that the above\ncopyright notice and this permission notice appear in all copies."

_BSD_START = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB_TERMS = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Entire licence texts, with the titles they usually carry.
TEXTS = {
    "MIT": [_MIT_TERMS, "MIT License\n" + _MIT_TERMS, "The MIT License\n" + _MIT_TERMS, "The MIT License (MIT)\n" + _MIT_TERMS],
    "ISC": [x + _ISC_GRANT + _ISC_NOTICE + "\n" + _ISC_DISCLAIMER for x in ("", "ISC License\n")],
    "0BSD": [x + _ISC_GRANT + ".\n" + _ISC_DISCLAIMER for x in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")],
    "BSD-2-Clause": [x + _BSD_START + _BSD_DISCLAIMER for x in ("", "BSD 2-Clause License\n")],
    "BSD-3-Clause": [x + _BSD_START + _BSD_NAME + _BSD_DISCLAIMER for x in ("", "BSD 3-Clause License\n")],
    "Zlib": [x + _ZLIB_TERMS for x in ("", "zlib License\n")],
}

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

#: Entire texts that carry no notice of their own, or before their title.
UNSIGNED_TEXTS = {
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>\n"],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST],
}

#: Digests of the canonical official texts of long licences, as
#: published and, where the text ends in advice on its use, without that.
DIGESTS = {
    "Apache-2.0": [
        "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
        "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    ],
    "Artistic-1.0-Perl": [
        "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    ],
    "CC-BY-SA-4.0": [
        "50a2b6974b5ae60c8ced20f4a8bbabc686064dc29aa45d6330ca3b75eb445a34",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    ],
    "GFDL-1.3": [
        "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    ],
    "GPL-1.0": [
        "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    ],
    "GPL-2.0": [
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75",
        "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c",
    ],
    "GPL-3.0": [
        "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329",
        "ad4a8c0f86b40eeaec03087f95684ff7965ffea480d1a58d4d7d9cb5ea929725",
        "607c705f9768e313af3bc7846c6815e61bce971f831a5fd61344a150e8f32b08",
        "69a19fa00710a84d83ec8e9bb9b15c7f42c9598b02028ac43f385e2eb740206b",
    ],
    "LGPL-2.0": [
        "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    ],
    "LGPL-2.1": [
        "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    ],
    "MPL-2.0": [
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    ],
    "NCSA": [
        "bb6c44416437f5ab412ca9d762d4bdae1dc4e6a9c5afc9ac0965eb5e57b4e055",
    ],
    "OFL-1.1": [
        "a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a",
    ],
    "Unicode-3.0": [
        "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8",
    ],
}


def canonical_lines(text: Column) -> Column:
    """The canonical lines, as one text: words of letters and digits in lower
    case, without copyright notices, each line between single blanks. Lines of
    prose that begin with the word "copyright" stay, however they are wrapped."""
    low = F.translate(text, UPPER, LOWER)
    low = F.regexp_replace(F.regexp_replace(low, "(?md)" + COPYRIGHT_NOTICE, "$1"), "(?md)" + RIGHTS_LINE, "")
    # Two blanks between words: a spelling and its neighbours share none.
    low = F.concat(F.lit(" "), F.replace(F.regexp_replace(low, PUNCTUATION, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        low = F.replace(low, F.lit(f" {old} "), F.lit(f" {new} "))
    return low


def whole_digest(lines: Column) -> Column:
    """Digest of a whole text from its canonical lines; null if it has no word."""
    flat = F.btrim(F.regexp_replace(lines, r"[ \n]+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def line_digests(lines: Column) -> Column:
    words = F.transform(F.split(lines, "\n"), lambda x: F.btrim(F.replace(x, F.lit("  "), F.lit(" "))))
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.sha2(x, 256))


def known(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """``digest, licence``: a few rows, spelled out by Spark itself."""
    rows = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(t).alias("text")) for k, many in texts.items() for t in many))
    return digested(spark.range(1).select(F.inline(rows)))


def digested(texts: DataFrame) -> DataFrame:
    """``digest, licence`` of a table of any size with ``licence, text``: what
    ``scan`` takes as ``texts`` or ``notices``. Of licences with one canonical
    text the first by name counts; texts without a word have no row."""
    some = texts.select(whole_digest(canonical_lines(F.col("text"))).alias("digest"), "licence").where("digest is not null")
    return some.groupBy("digest").agg(F.min("licence").alias("licence"))


def known_texts(spark: SparkSession) -> DataFrame:
    """``digest, licence`` of all built-in entire texts."""
    rows = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(k).alias("licence")) for k, many in DIGESTS.items() for d in many))
    return known(spark, TEXTS | UNSIGNED_TEXTS).unionByName(spark.range(1).select(F.inline(rows)))


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: DataFrame | None = None,
    notices: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, digest, licence, notices, n_notice_lines`` of every row.

    ``digest`` is the whole text's canonical SHA-256 (null without a word, so
    for null and empty texts) and ``licence`` the known licence whose entire
    text it is, else null. ``notices`` lists the licences named by lines that
    are entirely a known notice, by name, comma-joined (empty: none). Repeated
    rows are judged each. ``texts`` and ``notices`` replace the built-in
    tables (``digest, licence``; unique digests, see ``digested``) and may be
    of any size.
    """
    spark = df.sparkSession
    texts = known_texts(spark) if texts is None else texts
    notices = known(spark, NOTICES) if notices is None else notices
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    docs = written(docs.select("doc_id", whole_digest(F.col("lines")).alias("digest"), line_digests(F.col("lines")).alias("each")))
    named = docs.select("doc_id", F.col("digest").alias("of"), F.posexplode("each").alias("pos", "digest")).join(notices, "digest")
    # Rows equal in id and digest are interchangeable; a position counts once.
    lists = named.groupBy("doc_id", "of").agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"), F.size(F.collect_set("pos")).alias("n"))
    whole = docs.select("doc_id", "digest").join(texts, "digest", "left")
    joined = whole.join(lists.withColumnRenamed("doc_id", "n_id"), F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("digest") == F.col("of")), "left")
    return joined.select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL. Its patterns have no lookahead: character 1 marks
    the start of a grant, character 2 a word or sign that prose goes on after."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    gap = r"[^a-z0-9\n]*"
    stop = r"[^\n\x01]*"
    notice = (
        rf"(?m)^({gap}(?:(?:{TITLE})[^a-z0-9\n]+)?)"
        rf"(?:copyright(?:[^a-z\n\x01\x02]{stop}|$|\x01)|\(c\)(?:[^\n\x01\x02]{stop}|$|\x01)|©{stop})"
    )

    def lines(text: str) -> str:
        low = f"translate({text}, '{UPPER}' || chr(1) || chr(2), '{LOWER}' || chr(3) || chr(3))"
        low = f"regexp_replace({low}, {quoted('(' + GRANT + ')')}, chr(1) || '\\1', 'g')"
        for word, after in (("copyright", PROSE), (r"\(c\)", ITEM)):
            low = f"regexp_replace({low}, {quoted(f'({word})({gap}{after})')}, '\\1' || chr(2) || '\\2', 'g')"
        low = f"translate(regexp_replace({low}, {quoted(notice)}, '\\1', 'g'), chr(1) || chr(2), '')"
        low = f"regexp_replace({low}, {quoted('(?m)' + RIGHTS_LINE)}, '', 'g')"
        low = f"' ' || replace(regexp_replace({low}, {quoted(PUNCTUATION)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
        for old, new in SPELLINGS.items():
            low = f"replace({low}, ' {old} ', ' {new} ')"
        return low

    def values(texts: dict[str, list[str]]) -> str:
        return ", ".join(f"({quoted(k)}, {quoted(t)})" for k, many in texts.items() for t in many)

    listed = ", ".join(f"('{d}', {quoted(k)})" for k, many in DIGESTS.items() for d in many)
    flat = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS lines FROM {table}),
whole AS (SELECT r, doc_id, CASE WHEN {flat} <> '' THEN sha256({flat}) END AS digest FROM docs),
texts AS (
    SELECT sha256({flat}) AS digest, min(licence) AS licence
    FROM (SELECT licence, {lines("text")} AS lines FROM (VALUES {values(TEXTS | UNSIGNED_TEXTS)}) v(licence, text)) GROUP BY 1
    UNION ALL SELECT * FROM (VALUES {listed}) w(digest, licence)
),
notices AS (
    SELECT {flat} AS line, min(licence) AS licence
    FROM (SELECT licence, {lines("text")} AS lines FROM (VALUES {values(NOTICES)}) v(licence, text)) GROUP BY 1
),
each AS (SELECT r, trim(replace(unnest(string_split(lines, chr(10))), '  ', ' '), ' ') AS line FROM docs),
named AS (
    SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n
    FROM each JOIN notices USING (line) GROUP BY r
)
SELECT w.doc_id, w.digest, t.licence, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notice_lines
FROM whole w LEFT JOIN texts t USING (digest) LEFT JOIN named n USING (r)
"""
