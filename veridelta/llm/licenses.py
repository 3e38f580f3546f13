"""License scans: sparse TF-IDF cosine of lines, headers and whole texts to license templates, then inheritance from the
nearest ancestor directory.

Everything is a DataFrame expression. A page's visible text is scored in units: its lines, its blocks of several lines
(what stands between empty lines: notices that wrap, file headers), and, where it can be a license's full text, all of it
(license files). Only units that can reach COSINE go on, so what is scored is a small part of the corpus, and equal units of the
corpus are scored once, under their MD5. A page takes the license of its best unit if
the cosine is at least COSINE; headers and texts go before notices, as a text may begin with another license's notice. A directory's license is that of most of its pages with one (ties: the smaller SPDX id); a
page without its own inherits from the nearest ancestor directory that has one: its ancestor paths join the directories'
table, the longest match wins.

There are two kinds of templates, each with weights of its own: notices, and headers and texts of LONG words or more.
Lines and blocks with one of KEYS meet the notices: every unit that reaches COSINE with a notice holds a key. Lines
and blocks that share with a header or text words of so much weight as COSINE takes (NEEDED) meet these, whichever words
they are; so do whole pages, if it is a full text (one with TEXT_ANCHORS) or they have TEXT_ANCHORS themselves. The SQL is narrower:
there such a unit needs one of ANCHORS, a whole page one of TEXT_ANCHORS, so that a text without them has no license.
Weights are (1 + ln count) * IDF; IDF is over the kind's templates, which are fixed; a word outside them adds to a unit's
length as a word in one template would.

Defined cases: null or empty html has no units; a null url has no directory and inherits nothing; rows keep their
page_id, null or repeated, one result row each; ties in cosine go to the smaller SPDX id; other columns are ignored;
empty tables give no rows; a very long page is words by count, like others.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Notices, file headers and full texts by SPDX id.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (f"{_CONDITIONS} {_DISCLAIMER}",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        f"{_CONDITIONS} {_NAMES} {_DISCLAIMER}",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Of the SQL: one of these is in every template of LONG words or more; those of full texts make a page's whole text a unit.
ANCHORS, TEXT_ANCHORS = ("apache", "gnu", "mozilla", "unencumbered", "merchantability"), ("merchantability", "unencumbered")
LONG = 25
COSINE = 0.8


def _tokens(text: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


#: Each template's words; templates are numbered by SPDX id, then in order.
_COUNTS = {(k, i): Counter(_tokens(t)) for k, texts in sorted(TEMPLATES.items()) for i, t in enumerate(texts)}
#: 0: a notice, 1: a header or text.
_KIND = {k: int(sum(c.values()) >= LONG) for k, c in _COUNTS.items()}
_N = Counter(_KIND.values())
_DF = Counter((_KIND[k], w) for k, c in _COUNTS.items() for w in c)
#: By kind and word: log((1 + templates) / (1 + df)) + 1
IDF = {(f, w): math.log((1 + _N[f]) / (1 + n)) + 1 for (f, w), n in _DF.items()}
OTHER = [math.log((1 + _N[f]) / 2) + 1 for f in (0, 1)]
_WEIGHT = {k: {w: (1 + math.log(n)) * IDF[_KIND[k], w] for w, n in c.items()} for k, c in _COUNTS.items()}
_NORM = {k: math.sqrt(sum(x**2 for x in c.values())) for k, c in _WEIGHT.items()}
#: Words that ordinary lines have too.
COMMON = {"0", "2", "3", "a", "all", "and", "are", "binary", "by", "code", "conditions", "extent", "following", "for", "form", "general", "has", "in", "is", "law", "met", "of", "or", "public", "related", "rights", "subject", "terms", "that", "the", "this", "to", "under", "use", "version", "with", "without", "work"}
_FUNCTION = {"0", "2", "3", "a", "all", "and", "are", "by", "for", "has", "in", "is", "of", "or", "that", "the", "this", "to", "with"}
#: A unit that reaches COSINE with a notice shares one of these with it: each notice's weightiest words (uncommon ones
#: first), until the others alone can't reach it.
KEYS = set()
for _k, _c in _WEIGHT.items():
    if _KIND[_k]:
        if not any(w in _c for w in ANCHORS):
            raise ValueError(f"no anchor in {_k}")
        continue
    _left, _words = _NORM[_k] ** 2, sorted(_c, key=lambda w, c=_c: (w in _FUNCTION, w in COMMON, -c[w], w))
    for _w in _words:
        if math.sqrt(max(_left, 0)) / _NORM[_k] < COSINE:
            break
        KEYS.add(_w)
        _left -= _c[_w] ** 2
_KEYS = sorted(KEYS)


def _needed(weight: dict[str, float]) -> tuple[dict[str, float], int, float]:
    """The squared weights of a template's words but the function words, and how many of these words, and what sum, a unit
    that reaches COSINE has at least: by Cauchy and Schwarz the words it shares weigh COSINE of the norm."""
    own = {w: x**2 for w, x in weight.items() if w not in _FUNCTION}
    least = (COSINE - 1e-9) ** 2 * sum(x**2 for x in weight.values()) - sum(weight[w] ** 2 for w in weight if w in _FUNCTION) - 1e-9
    total, n = 0.0, 0
    for x in sorted(own.values(), reverse=True):
        if total >= least:
            break
        total, n = total + x, n + 1
    return own, n, least


#: Of each header and text.
NEEDED = [_needed(c) for k, c in _WEIGHT.items() if _KIND[k]]
_LEAST = min(n for _, n, _ in NEEDED)


def visible_text(html: Column) -> Column:
    """The visible text of html: comments, scripts and styles go, and block tags end a line."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|tr|table|title|article|section|header|footer|nav|body|head|html|pre)\b[^>]*>", "\n")
    return F.regexp_replace(lines, r"<[^>]*>", "")


def _has(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in words])


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, wherever f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _can_be_long(low: Column, whole: bool = False) -> Column:
    """Whether the words that a unit shares with some header or text weigh as much as COSINE takes; a whole page, with some
    full text."""
    words = lambda own: F.split(F.lit(" ".join(sorted(own))), " ")
    weight = lambda own: F.expr("map(" + ", ".join(f"'{w}', {x!r}D" for w, x in sorted(own.items())) + ")")
    sums = lambda x, own: F.aggregate(F.array_intersect(x, words(own)), F.lit(0.0), lambda s, w: s + F.element_at(weight(own), w))
    enough = lambda x, of: reduce(lambda a, b: a | b, [(F.size(F.array_intersect(x, words(own))) >= n) & (sums(x, own) >= least) for own, n, least in NEEDED if {*own} & {*of}])
    kind = lambda x: _has(low, TEXT_ANCHORS) & enough(x, ANCHORS) | enough(x, TEXT_ANCHORS) if whole else enough(x, ANCHORS)
    every = {w for own, _, _ in NEEDED for w in own}
    return _with(F.array_intersect(F.split(low, r"[^a-z0-9]+"), words(every)), lambda x: (F.size(x) >= _LEAST) & kind(x))


def units_of(text: Column) -> Column:
    """(kind, text) of what is scored: lines, blocks of several lines and, for full texts, the whole of a visible text."""

    def units(t: Column) -> Column:
        blocks = F.transform(F.split(t, r"\n[ \t\r\f]*\n"), lambda b: F.regexp_replace(b, r"^[ \n\t\r\f]+|[ \n\t\r\f]+$", ""))
        parts = F.array_distinct(F.concat(F.split(t, r"\n"), F.filter(blocks, lambda b: b.contains("\n"))))
        of = lambda units, kind, ok: F.transform(F.filter(units, lambda x: _with(F.lower(x), lambda low: ok(low))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
        # a unit's words are words of the whole
        every = lambda p: F.array_distinct(F.concat(of(p, 1, _can_be_long), of(F.array(t), 1, lambda low: _can_be_long(low, whole=True))))
        long = lambda p: F.when(_with(F.lower(t), lambda low: _can_be_long(low)), every(p)).otherwise(_no_units())
        return _with(parts, lambda p: F.concat(of(p, 0, lambda low: _has(low, _KEYS)), long(p)))

    return _with(text, units)


def _no_units() -> Column:
    return F.array().cast("array<struct<kind: int, text: string>>")


def unit_licenses(units: DataFrame) -> DataFrame:
    """(unit, cosine, own_license) of distinct units(unit, kind, text): the best template of those that reach COSINE. The
    templates' weights are a table of fixed size; only a unit's words that it holds meet a template."""
    spark = units.sparkSession
    weights = spark.createDataFrame([(_KIND[k, i], k, i, w, x) for (k, i), c in _WEIGHT.items() for w, x in sorted(c.items())], "kind int, id string, template int, w string, weight double")
    idf = spark.createDataFrame([(f, w, x) for (f, w), x in sorted(IDF.items())], "kind int, w string, idf double")
    norms = spark.createDataFrame([(k, i, n) for (k, i), n in _NORM.items()], "id string, template int, template_norm double")
    words = units.select("unit", "kind", F.explode(F.split(F.lower("text"), r"[^a-z0-9]+")).alias("w")).where("w <> ''").groupBy("unit", "kind", "w").count()
    other = F.when(F.col("kind") == 0, OTHER[0]).otherwise(OTHER[1])
    weighed = words.join(F.broadcast(idf), ["kind", "w"], "left").select("unit", "kind", "w", ((1 + F.log(F.col("count").cast("double"))) * F.coalesce("idf", other)).alias("x"))
    length = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights), ["kind", "w"]).groupBy("unit", "id", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosines = dots.join(length, "unit").join(F.broadcast(norms), ["id", "template"]).withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 9)).where(F.col("cosine") >= COSINE)
    return cosines.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("k"), "id")).alias("m")).select("unit", (-F.col("m.k")).alias("cosine"), F.col("m.id").alias("own_license"))


def directories(url: Column) -> Column:
    """The ancestor directories of a url, host first, without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    parts = F.split(F.regexp_replace(path, r"/+$", ""), "/+")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def license_scan(pages: DataFrame) -> DataFrame:
    """(page_id, own_license, cosine, license, inherited_from) of pages(page_id, url, html)."""
    units = units_of(visible_text(F.coalesce("html", F.lit(""))))
    dirs = F.when(F.col("url").isNotNull(), directories(F.col("url")))
    # written once, so that the rows' numbers hold
    rows = stored(pages.select(F.monotonically_increasing_id().alias("p"), "page_id", dirs.alias("dirs"), units.alias("units")), "pages")
    rows = rows.withColumn("dir", F.element_at("dirs", -1))
    each = rows.select("p", F.explode("units").alias("u")).select("p", "u.*").withColumn("unit", F.concat(F.col("kind").cast("string"), F.md5("text")))
    found = each.select("p", "unit", "kind").join(unit_licenses(each.groupBy("unit", "kind").agg(F.first("text").alias("text"))), "unit").groupBy("p").agg(F.min(F.struct((-F.col("kind")).alias("f"), (-F.col("cosine")).alias("k"), "own_license")).alias("m"))
    own = rows.drop("units").join(found.select("p", F.col("m.own_license").alias("own_license"), (-F.col("m.k")).alias("cosine")), "p", "left")
    counts = own.where("own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    of_dir = counts.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("k"), "own_license")).alias("m")).select(F.col("dir").alias("licensed"), F.col("m.own_license").alias("dir_license"))
    # one row for each distinct directory without its own license, not for each page
    asked = own.where("own_license IS NULL AND dir IS NOT NULL").select("dir", "dirs").groupBy("dir").agg(F.first("dirs").alias("dirs"))
    above = asked.select("dir", F.posexplode("dirs").alias("depth", "licensed")).join(of_dir, "licensed")
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "licensed", "dir_license")).alias("m")).select(F.col("dir").alias("of"), F.col("m.licensed").alias("inherited_from"), F.col("m.dir_license").alias("dir_license"))
    joined = own.join(nearest, (own["dir"] == nearest["of"]) & own["own_license"].isNull(), "left")
    return joined.select("page_id", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"), "inherited_from")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    rows = ", ".join(f"({_KIND[k, i]}, '{k}', {i}, '{w}', {x!r}, {IDF[_KIND[k, i], w]!r}, {_NORM[k, i]!r})" for (k, i), c in _WEIGHT.items() for w, x in sorted(c.items()))
    return rf"""
WITH templates(kind, id, template, w, weight, idf, norm) AS (VALUES {rows}),
idf AS (SELECT DISTINCT kind, w, idf FROM templates),
norms AS (SELECT DISTINCT id, template, norm FROM templates),
page AS (SELECT row_number() OVER () AS p, page_id, url, html FROM pages),
visible AS (SELECT p, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'),
  '</?(?:p|br|div|h[1-6]|li|ul|ol|tr|table|title|article|section|header|footer|nav|body|head|html|pre)\b[^>]*>', chr(10), 'gi'),
  '<[^>]*>', '', 'g') AS t FROM page),
part AS (
  SELECT p, unnest(string_split(t, chr(10))) AS t FROM visible
  UNION ALL SELECT p, t FROM (SELECT p, regexp_replace(unnest(string_split_regex(t, '\n[ \t\r\f]*\n')), '^[ \n\t\r\f]+|[ \n\t\r\f]+$', '', 'g') AS t FROM visible) WHERE contains(t, chr(10))),
unit AS (SELECT p, kind, t, row_number() OVER () AS i FROM (
  SELECT p, 0 AS kind, t FROM part WHERE regexp_matches(lower(t), '{"|".join(_KEYS)}') UNION ALL SELECT p, 1, t FROM part WHERE regexp_matches(lower(t), '{"|".join(ANCHORS)}')
  UNION ALL SELECT p, 1, t FROM visible WHERE regexp_matches(lower(t), '{"|".join(TEXT_ANCHORS)}'))),
word AS (SELECT p, i, kind, w, count(*) AS n FROM (SELECT p, i, kind, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) AS w FROM unit) WHERE w <> '' GROUP BY ALL),
weighted AS (SELECT p, i, kind, word.w, (1 + ln(n)) * coalesce(idf, CASE WHEN kind = 0 THEN {OTHER[0]!r} ELSE {OTHER[1]!r} END) AS x FROM word LEFT JOIN idf USING (kind, w)),
length AS (SELECT p, i, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY ALL),
dot AS (SELECT p, i, id, template, sum(x * weight) AS d FROM weighted JOIN templates USING (kind, w) GROUP BY ALL),
cos AS (SELECT p, kind, id, round(d / (length.norm * norms.norm), 9) AS cosine FROM dot JOIN length USING (p, i) JOIN norms USING (id, template) JOIN (SELECT i, kind FROM unit) USING (i)),
best AS (SELECT * FROM (SELECT p, id, cosine, row_number() OVER (PARTITION BY p ORDER BY kind DESC, cosine DESC, id) AS r FROM cos WHERE cosine >= {COSINE}) WHERE r = 1),
own AS (SELECT p, page_id, id AS own_license, cosine, string_split_regex(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '/+$', ''), '/+') AS parts FROM page LEFT JOIN best USING (p)),
placed AS (SELECT *, array_to_string(parts[1:greatest(len(parts) - 1, 1)], '/') AS dir FROM own),
of_dir AS (SELECT dir AS licensed, own_license AS dir_license FROM (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, own_license) AS r FROM placed WHERE own_license IS NOT NULL AND dir IS NOT NULL GROUP BY dir, own_license) WHERE r = 1),
above AS (SELECT p, n, array_to_string(parts[1:n], '/') AS licensed FROM (SELECT p, parts, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS n FROM placed WHERE own_license IS NULL)),
nearest AS (SELECT p, licensed AS inherited_from, dir_license FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC) AS r FROM above JOIN of_dir USING (licensed)) WHERE r = 1)
SELECT page_id, own_license, cosine, coalesce(own_license, dir_license) AS license, inherited_from FROM placed LEFT JOIN nearest USING (p)
"""
