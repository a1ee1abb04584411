"""License scan: word-bigram Dice coefficient of text windows against templates, in SQL functions only."""

from __future__ import annotations

import json
from collections import Counter
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: License notices and paragraphs by SPDX name, as they stand in files and pages. Normalised like the scanned text.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
        "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
    ),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions:",
    ),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Proprietary", "All rights reserved."),
]
#: Least Dice coefficient, in hundredths.
LEAST = 80
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_CHAR, _GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: Words whose bigrams the screen takes last. They decide its speed only.
_COMMON = frozenset("the of and to in a is for this that under by or any with be as at all it on not you we are from an its no other may".split())


def _words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, cur = [], ""
    for c in low:
        if c.isascii() and not c.isalnum():
            out, cur = (out + [cur] if cur else out), ""
        else:
            cur += c
    return out + [cur] if cur else out


def _sizes(n: int, least: int) -> tuple[int, int]:
    """Bigram counts m for which Dice 2*min(m, n) / (m + n) can reach ``least`` hundredths."""
    share = Fraction(least, 100)
    low = -(-(share * n) // (2 - share))
    return int(max(1, low)), int((2 - share) * n // share)


def template_rows(templates=None, least: int = LEAST) -> list[dict]:
    """One row per distinct bigram of a template: template, license, pair, times (its count there), n, high and need.

    ``high`` is the largest window that can match, ``need`` the fewest bigrams that a matching window shares.
    """
    out = []
    for i, (name, text) in enumerate(TEMPLATES if templates is None else templates):
        words = _words(text)
        pairs = Counter(" ".join(p) for p in zip(words, words[1:], strict=False))
        n = sum(pairs.values())
        low, high = _sizes(n, least)
        need = int(-(-Fraction(least, 200) * (low + n) // 1))
        out += [{"template": i, "license": name, "pair": p, "times": k, "n": n, "high": high, "need": need} for p, k in pairs.items()]
    return out


def screen(templates=None, least: int = LEAST) -> str:
    """A pattern that every text with a match holds.

    A match lacks at most n - need bigrams of its template, so it holds one of any n - need + 1 of them: those of the least common and
    longest words are asked for. Patterns share their beginnings, so a place in the text is tried against few of them.
    """
    by_template: dict[int, list[dict]] = {}
    for r in template_rows(templates, least):
        by_template.setdefault(r["template"], []).append(r)
    chosen: dict[str, set[str]] = {}
    for rows in by_template.values():
        left = rows[0]["n"] - rows[0]["need"] + 1
        for r in sorted(rows, key=lambda r: (sum(w in _COMMON for w in r["pair"].split()), -len(r["pair"]), r["pair"])):
            if left > 0:
                a, b = r["pair"].split()
                chosen.setdefault(a, set()).add(b)
                left -= r["times"]
    by_first: dict[str, list[str]] = {}
    for a in sorted(chosen):
        by_first.setdefault(a[0], []).append(f"{a[1:]}{_GAP}(?:{'|'.join(sorted(chosen[a]))})")
    words = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_first.items())
    return rf"(?i)(?<!{_WORD_CHAR})(?:{words})(?!{_WORD_CHAR})" if chosen else "(?!)"


def _template_table(spark: SparkSession, templates, least: int) -> DataFrame:
    """The rows of ``template_rows`` as a table that a broadcast may hold: a list fixed in the code or given by the caller."""
    kind = "array<struct<template:int,license:string,pair:string,times:int,n:int,high:int,need:int>>"
    text = json.dumps(template_rows(templates, least))
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), kind))))


def _best_of_islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each run of overlapping windows of ``by`` the best: largest Dice, most shared bigrams, first template, first place."""
    order = Window.partitionBy(*by).orderBy("first", "last", "template")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = rows.withColumn("fresh", F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)).cast("int"))
    new = new.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = Window.partitionBy(*by, "island").orderBy(F.desc("dice"), F.desc("common"), "template", "first")
    return new.withColumn("at", F.row_number().over(rank)).where("at = 1").drop("fresh", "island", "at")


def scan(docs: DataFrame, least: int = LEAST, templates=None) -> DataFrame:
    """License notices in ``docs`` (doc_id, text): windows of the text's words whose bigrams match a template.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, so line breaks and comment signs do not count.
    A window runs from one bigram shared with the template to another; its multiset Dice coefficient 2 * common / (m + n) over word bigrams must
    reach ``least`` hundredths (compared in integers). All windows of all sizes that can match are scored: per start the best end, then per
    template the best of overlapping windows, then the best of overlapping templates (ties: more in common, first in the list).

    Texts that cannot hold a match (``screen``) are passed over after one read. Size bounds prune: windows longer than a template's ``high`` are not
    looked at, nor a text's templates of which no window of that size shares ``need`` bigrams. One shuffle, of shared bigrams, by
    text; the templates are a broadcast list.

    Returns doc_id, first (place of the first word, 0-based), n_words, license, template, dice (double), common. Null, empty and one-word texts give no
    rows. Repeated rows repeat results. Other columns are ignored. Texts may be of any length. An empty table gives no rows.
    """
    known = _template_table(docs.sparkSession, templates, least)
    text = F.col("text")
    words = F.filter(F.split(ascii_lower(text), SPLIT, -1), lambda w: w != "")
    rows = docs.where(text.rlike(screen(templates, least))).select(F.monotonically_increasing_id().alias("rid"), "doc_id", words.alias("w"))
    size = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), size), F.slice("w", F.lit(2), size), lambda a, b: F.concat(a, F.lit(" "), b))
    hits = rows.select("rid", "doc_id", F.posexplode(pairs).alias("pos", "pair")).join(known, "pair").repartition("rid")

    # ``back``: the hit as many occurrences of its bigram back as the template has; a window from behind it on counts this hit.
    same = Window.partitionBy("rid", "template", "pair").orderBy("pos")
    counts = sorted({r["times"] for r in template_rows(templates, least)}) or [1]
    back = F.coalesce(*[F.when(F.col("times") == k, F.lag("pos", k).over(same)) for k in counts], F.lit(-1))
    # Places scaled by the largest window, so that one frame fits every template.
    ahead = Window.partitionBy("rid", "template").orderBy("scaled").rangeBetween(0, 1)
    whole = Window.partitionBy("rid", "template")
    near = hits.withColumn("back", back).withColumn("scaled", F.col("pos") / F.col("high"))
    near = near.withColumn("many", F.count("*").over(ahead) >= F.col("need")).where("n > 0")
    near = near.withColumn("open", F.max("many").over(whole)).where("open")
    found = near.withColumn("ahead", F.collect_list(F.struct("pos", "back")).over(ahead)).where("many")
    counted = F.filter("ahead", lambda q: (q["pos"] - F.col("pos") < F.col("high")) & (q["back"] < F.col("pos")))
    ends = F.transform(
        counted,
        lambda q, i: F.struct(
            ((2 * (i + 1)).cast("double") / (q["pos"] - F.col("pos") + 1 + F.col("n"))).alias("dice"), (i + 1).alias("common"), q["pos"].alias("last")
        ),
    )
    best = found.select("rid", "doc_id", "template", "license", "n", F.col("pos").alias("first"), F.array_max(ends).alias("e"))
    best = best.select("rid", "doc_id", "template", "license", "n", "first", "e.last", "e.dice", "e.common")
    best = best.where(200 * F.col("common") >= least * (F.col("last") - F.col("first") + 1 + F.col("n")))
    kept = _best_of_islands(_best_of_islands(best, ["rid", "template"]), ["rid"])
    return kept.select("doc_id", "first", (F.col("last") - F.col("first") + 2).alias("n_words"), "license", "template", "dice", "common", "rid")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents with license notices: doc_id, n_notices, licenses (their names, sorted, comma-joined), best_dice. One row per row of documents."""
    hits = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = hits.groupBy("rid", "doc_id").agg(
        F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("best_dice")
    )
    return out.drop("rid")


def _sql(least: int = LEAST) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({r['template']}, {quote(r['license'])}, {quote(r['pair'])}, {r['times']}, {r['n']}, {r['high']})" for r in template_rows(least=least))
    return rf"""
WITH g(template, license, pair, times, n, high) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPLIT}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(w))) AS pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS pair FROM d),
h AS MATERIALIZED (SELECT *, coalesce(lag(pos, times) OVER (PARTITION BY rid, template, pair ORDER BY pos), 0) AS back FROM p JOIN g USING (pair)),
q AS (SELECT a.rid, a.doc_id, a.template, a.license, a.n, a.pos AS first, b.pos AS last,
  row_number() OVER (PARTITION BY a.rid, a.template, a.pos ORDER BY b.pos) AS common
  FROM h a JOIN h b ON a.rid = b.rid AND a.template = b.template AND b.pos >= a.pos AND b.pos < a.pos + a.high AND b.back < a.pos),
m AS (SELECT *, (2 * common)::DOUBLE / (last - first + 1 + n) AS dice FROM q WHERE 200 * common >= {least} * (last - first + 1 + n)),
s AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY rid, template, first ORDER BY dice DESC, common DESC) = 1),
i AS (SELECT *, coalesce(first > max(last) OVER (PARTITION BY rid, template ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INT AS fresh FROM s),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY first, last) AS island FROM i),
t AS (SELECT * EXCLUDE (fresh, island) FROM j QUALIFY row_number() OVER (PARTITION BY rid, template, island ORDER BY dice DESC, common DESC, first) = 1),
k AS (SELECT *, coalesce(first > max(last) OVER (PARTITION BY rid ORDER BY first, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INT AS fresh FROM t),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY first, last, template) AS island FROM k),
z AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY rid, island ORDER BY dice DESC, common DESC, template, first) = 1)
SELECT doc_id, count(*)::BIGINT AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice FROM z GROUP BY rid, doc_id
"""


SQL = _sql()
