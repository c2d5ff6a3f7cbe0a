"""Licence scan by canonical digests.

A text and each of its lines is brought to a canonical form (case, punctuation,
white space, copyright lines, equivalent spellings) and its digest is looked up
among the digests of known licence texts and notices.  Only entire texts or
entire lines match; nothing is searched inside them.

Nulls and edges: a null or empty text, and a line without letters or digits, has
no digest.  A repeated row or line is reported each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.plans.joins import lookup_join

# Pairs of equivalent spellings, applied in this order.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("copyright holder", "copyright owner"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("http://", "https://"),
    ("&", " and "),
]

# Licence identifiers and the names under which notices cite them.
NAMES = [
    ("MIT", ["MIT License", "MIT license"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU General Public License v2", "GPL v2"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License v3", "GPL v3"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "LGPL v3"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPL v3"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "BSD License"]),
    ("ISC", ["ISC License"]),
    ("Unlicense", ["Unlicense"]),
    ("CC0-1.0", ["CC0 1.0", "CC0", "Creative Commons Zero v1.0"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
]

# Wording of notices; {} stands for the cited name.
NOTICES = [
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "Available under the {}.",
    "This work is licensed under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This project is licensed under the {}.",
    "This software is released under the {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
]

# Whole licence texts.
TEXTS = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
]

_SCHEMA = "license string, text string"
_GAP = r"[ \t\n\x0b\f\r]+"
#: Patterns and what becomes of them, in this order; {1} is the first group.  A
#: copyright statement has a mark, a year or a name after the word, and ends with its
#: line or where a known text begins; "copyright holders", "owner" or "notice" is text.
#: Text is marked first, so that no pattern looks ahead and any engine can run them.
CLEANING = [
    (rf"copyright({_GAP}(?:holder|owner|notice|law|license|licence|(?:and|or|in|to)\b))", "copyright0text{1}"),
    (r"(permission is hereby|permission to use|redistribution and use)", "\x1e{1}"),
    (r"(?m)^[ \t*#/;-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n\x1e]*", ""),
    (r"copyright0text", "copyright"),
]


def canonical_lines(text: Column) -> Column:
    """Canonical form of every line of a text; lines without content are ''."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in CLEANING:
        out = F.regexp_replace(out, pattern.replace("(?m)", "(?md)"), new.replace("{1}", "$1"))
    for seen, kept in SPELLINGS:
        out = F.replace(out, F.lit(seen), F.lit(kept))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def whole(lines: Column) -> Column:
    out = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    for seen, kept in SPELLINGS:  # those of two words may be broken between lines
        if " " in seen:
            out = F.replace(out, F.lit(seen), F.lit(kept))
    return out


def known_digests(texts: DataFrame) -> DataFrame:
    """digest, license of a table (license, text).  Of several licences with one
    canonical text the smallest name stands."""
    return (
        texts.select("license", digest(whole(canonical_lines(F.col("text")))).alias("digest"))
        .where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("license").alias("license"))
    )


def builtin_rows() -> list[tuple[str, str]]:
    """The notices and texts above, the texts also with their title: a few hundred rows."""
    notices = [(k, n.format(name)) for k, names in NAMES for name in [k, *names] for n in NOTICES]
    names = dict(NAMES)
    titled = [(k, f"{the}{name}\n\n{t}") for k, t in TEXTS for name in [k, *names[k]] for the in ("", "The ")]
    return [*notices, *TEXTS, *titled]


def builtin_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(builtin_rows(), _SCHEMA)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row for every whole text and every line with a known digest:
    doc_id, line (-1 for the whole text), license, digest.

    A text of a single line is reported as a whole text only.  ``known`` is
    broadcast if its checked size allows it.
    """
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = F.when(
        F.size(F.filter("lines", lambda x: x != "")) > 1,
        F.transform("lines", lambda x, i: F.struct(i.alias("line"), digest(x).alias("digest"))),
    ).otherwise(F.expr("array()"))
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), digest(whole(F.col("lines"))).alias("digest"))), rows)
    exploded = lines.select("doc_id", F.inline(units)).where("digest IS NOT NULL")
    return lookup_join(exploded, known, ["digest"], "doc_id").select("doc_id", "line", "license", "digest")
