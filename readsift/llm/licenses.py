"""License scans by sparse TF-IDF cosine and directory inheritance (operator 8, DataFrame functions only).

Every line of every file is a possible header and is compared to the notices among the templates;
every file is a possible licence file and is compared, whole, to the licence texts among them. Both
sides are vectors of term frequency times idf, with idf = ln((1 + N) / (1 + df)) + 1 and df counted
for every word over all files. A file's license is the one with the highest cosine among its lines
and itself, if at least ``min_cosine``.

Before words are exploded, lines and files that cannot reach ``min_cosine`` are left out; no match is
lost. By Cauchy-Schwarz the squared weights of a template's words that a match has sum to
``min_cosine``^2 or more. Files are held to that sum. Lines are held to having one of a template's
weightiest words, those left when the lightest that sum to less are taken away.

Neighbouring licences differ in a word or a number, which a cosine hardly sees. So a line and its template
must have the same limiting words (``BARS``, such as NonCommercial, Lesser, not), and the line all names
(``NAMES``) and version numbers of the template; a whole file must have the same ``TEXT_BARS``. A licence without a
template is therefore none, not its neighbour.

A file is a licence file if it is named like one, or if it is matched whole or by lines that hold
half of its words. Its license holds for its directory. Files without a license of their own
inherit from the nearest ancestor directory that has one: ancestors are resolved once for each
distinct directory by a join on path prefixes, then joined to files, hot directories by broadcast.

Rows are told apart by 128 bits of a hash of id, path and text, so ids may be null or repeated.
Defined results: a null or empty text has no license of its own but inherits; a null path lies in
the root; equal cosines are settled by license, then line; rows that repeat id, path and text are
returned each, with equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, even_lookup, materialise, table

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (license, kind, text): usual notices, and licence texts (of long licences the notice for source files). Fixed values.
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "This work has been dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "notice", "GNU General Public License, version 2, June 1991"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "notice", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "notice", "Released under the ISC License."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("0BSD", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("AGPL-3.0", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
     "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "text", _BSD + _BSD_END),
    ("BSD-3-Clause", "text", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("GPL-2.0", "text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
     "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
     "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
     "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_NAME = "(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: Words that limit or deny a licence, the short forms' long ones, and names that a template's line must have (fixed values).
BARS = ("affero", "lesser", "library", "no", "noncommercial", "noderivatives", "not", "sharealike")
SHORT = {"nc": "noncommercial", "nd": "noderivatives", "noderivs": "noderivatives", "sa": "sharealike"}
NAMES = ("apache", "bsd", "cc0", "isc", "mit", "mozilla")
TEXT_BARS = ("affero", "lesser", "noncommercial", "noderivatives", "sharealike")
#: A version number: one digit, with further ones after points.
VERSION = "^v?[0-9]([.][0-9])*$"
#: The place of a file that is compared whole, in the column of lines.
WHOLE = -1


@dataclass(frozen=True)
class Scan:
    min_cosine: float = 0.6
    licence_file_share: float = 0.5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def tells(words: Column, whole: Column) -> Column:
    """(bars, must) of a line's or, where ``whole``, a file's tokens: see the module's text."""
    parts = F.array_distinct(F.flatten(F.transform(words, lambda x: F.split(x, "-"))))
    long = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    named = F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(long, x), x)))
    bars = F.array_join(F.sort_array(F.array_intersect(named, F.when(whole, F.array(*map(F.lit, TEXT_BARS))).otherwise(F.array(*map(F.lit, BARS))))), " ")
    versions = F.transform(F.filter(words, lambda x: x.rlike(VERSION)), lambda x: F.regexp_replace(x, "^v|([.]0)+$", ""))
    must = F.when(whole, F.array().cast("array<string>")).otherwise(F.array_union(F.array_intersect(parts, F.array(*map(F.lit, NAMES))), versions))
    return F.struct(bars.alias("bars"), must.alias("must"))


def template_terms(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(t, license, kind, told, term, tf): bounded by the templates given."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "t int, license string, kind string, text string")
    rows = rows.withColumn("told", tells(tokens(F.col("text")), F.col("kind") == "text"))
    return rows.select("t", "license", "kind", "told", F.explode(tokens(F.col("text"))).alias("term")).groupBy("t", "license", "kind", "told", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, df) of every word of all files; the empty term counts the files."""
    return files.select(F.explode(F.array_append(F.array_distinct(tokens(F.col("text"))), F.lit(""))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def unit_vectors(terms: DataFrame, df: DataFrame) -> DataFrame:
    """(t, license, kind, told, term, u) of the templates, of length one each."""
    n = df.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    x = terms.join(df, "term", "left").crossJoin(F.broadcast(n))  # one row
    x = x.withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1))
    return x.select("t", "license", "kind", "told", "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("t")))).alias("u"))


def units(files: DataFrame, unit: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """(rid, line, n_words, file_words, tells, term, tf) of the lines and whole files that can match."""
    least = scan.min_cosine**2 - 1e-9
    rising = Window.partitionBy("t").orderBy("u", "term").rowsBetween(Window.unboundedPreceding, 0)
    weighty = unit.where("kind = 'notice'").withColumn("c", F.sum(F.col("u") * F.col("u")).over(rising)).where(F.col("c") >= least)
    of = unit.where("kind = 'text'").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("u") * F.col("u")))).alias("m"))
    texts = of.agg(F.collect_list(F.struct("m", F.map_keys("m").alias("terms"))).alias("texts"), F.array_distinct(F.flatten(F.collect_list(F.map_keys("m")))).alias("vocabulary"))
    probe = weighty.agg(F.collect_set("term").alias("probe")).crossJoin(texts)  # one row of the templates' words
    d = files.where("text is not null").crossJoin(F.broadcast(probe))
    d = materialise(d, words=tokens(F.col("text")))
    d = materialise(d, common=F.array_intersect("words", "vocabulary"))
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), tokens(x).alias("w"))),
        lambda x: F.arrays_overlap(x["w"], F.col("probe")),
    )
    weight = lambda x: F.aggregate(F.array_intersect("common", x["terms"]), F.lit(0.0), lambda s, w: s + x["m"][w])
    fits = (F.size("common") > 0) & F.exists("texts", lambda x: weight(x) >= least)
    whole = F.when(fits, F.array(F.struct(F.lit(WHOLE).alias("line"), F.col("words").alias("w")))).otherwise(F.array().cast("array<struct<line: int, w: array<string>>>"))
    found = d.select("rid", F.size("words").alias("file_words"), F.inline(F.concat(lines, whole)))
    found = materialise(found, tells=tells(F.col("w"), F.col("line") == WHOLE))
    t = found.select("rid", "line", F.size("w").alias("n_words"), "file_words", "tells", F.explode("w").alias("term"))
    return t.groupBy("rid", "line", "n_words", "file_words", "tells", "term").agg(F.count(F.lit(1)).alias("tf"))


def scan_units(files: DataFrame, terms: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """(rid, line, n_words, file_words, license, cosine): the best template of each line, and of the whole file."""
    df = cut(document_frequencies(files), "df")
    unit = cut(unit_vectors(terms, df), "templates")
    tf = cut(units(files, unit, scan), "units")
    n = df.where("term = ''").select(F.col("df").alias("n"))
    idf = df.where("term <> ''").crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = even_lookup(tf, idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    x = cut(x.withColumn("kind", F.when(F.col("line") == WHOLE, "text").otherwise("notice")), "weighed")
    at = ["rid", "line", "n_words", "file_words"]
    # Pairs that the telling words part are left out before they are summed.
    fits = (F.col("told.bars") == F.col("tells.bars")) & (F.size(F.array_except("told.must", "tells.must")) == 0)
    dot = x.join(F.broadcast(unit), ["kind", "term"]).where(fits).groupBy(*at, "t", "license").agg(F.sum(F.col("x") * F.col("u")).alias("dot"))
    norm = x.groupBy("rid", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    cos = dot.join(norm, ["rid", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= scan.min_cosine)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license")))
    return cos.groupBy(*at).agg(best.alias("b")).select(*at, F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), "^(.*)/[^/]*$", 1)


def ancestors(d: Column) -> Column:
    """The directory itself and those above it, the root being the empty name."""
    parts = F.filter(F.split(d, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by ``columns``, nulls included."""
    c = [x for n in columns for x in (F.col(n).isNull(), F.col(n))]
    return F.struct(F.xxhash64(F.lit(1), *c).alias("a"), F.xxhash64(F.lit(2), *c).alias("b"))


def scan_licenses(files: DataFrame, id: str = "id", path: str = "path", text: str = "text", templates=TEMPLATES, scan: Scan = Scan()) -> DataFrame:
    """id, path, license, cosine, line (its own; -1 for the whole file or none), licence_file, inherited, inherited_from, effective_license."""
    f = files.select(F.col(id).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"))
    f = f.select(row_key("id", "path", "text").alias("rid"), "id", "path", "text")
    found = scan_units(f.select("rid", "text"), template_terms(files.sparkSession, templates), scan)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license", "line"))
    own = found.groupBy("rid").agg(best.alias("b"), F.sum("n_words").alias("matched"), F.max("file_words").alias("words"))
    own = own.select("rid", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), F.col("b.line").cast("long").alias("line"), "matched", "words")
    named = F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False))
    all_ = f.select("rid", "id", "path", directory(F.col("path")).alias("dir")).join(own, "rid", "left")
    all_ = all_.withColumn("licence_file", F.col("license").isNotNull() & (named | (F.col("matched") >= scan.licence_file_share * F.col("words"))))
    all_ = cut(all_.drop("rid", "matched", "words"), "scanned")
    holds = all_.where("licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    holds = holds.select(F.col("dir").alias("ancestor"), F.col("b.license").alias("held"))
    up = all_.select("dir").distinct().select("dir", F.inline(ancestors(F.col("dir"))))
    nearest = up.join(holds, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "held")).alias("n"))
    nearest = cut(nearest.select("dir", F.col("n.held").alias("inherited"), F.col("n.ancestor").alias("inherited_from")), "nearest")
    out = even_lookup(all_, nearest, "dir")
    return out.select(F.col("id").alias(id), F.col("path"), "license", "cosine", F.coalesce("line", F.lit(-1)).alias("line"), "licence_file", "inherited", "inherited_from", F.coalesce("license", "inherited").alias("effective_license"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return scan_licenses(files, "doc_id")


def _sql(scan: Scan = Scan()) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(map(quoted, x))})" for i, x in enumerate(TEMPLATES))
    among = lambda names: f"[{', '.join(map(quoted, names))}]"
    parts = "flatten(list_transform(w, lambda x: string_split(x, '-')))"
    long = f"list_transform({parts}, lambda x: CASE x {' '.join(f'WHEN {quoted(a)} THEN {quoted(b)}' for a, b in SHORT.items())} ELSE x END)"
    bars = f"list_sort(list_distinct(list_filter({long}, lambda x: list_contains(CASE kind WHEN 'text' THEN {among(TEXT_BARS)} ELSE {among(BARS)} END, x))))"
    versions = f"list_transform(list_filter(w, lambda x: regexp_matches(x, '{VERSION}')), lambda x: regexp_replace(x, '^v|([.]0)+$', '', 'g'))"
    must = f"CASE kind WHEN 'text' THEN [] ELSE list_concat(list_filter({parts}, lambda x: list_contains({among(NAMES)}, x)), {versions}) END"
    return f"""
WITH tpl(t, license, kind, text) AS (VALUES {values}),
f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, text FROM documents),
terms AS (
  SELECT t, license, kind, term, count(*) AS tf FROM (SELECT t, license, kind, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM tpl) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')) AS term FROM documents),
df AS (SELECT term, count(*) AS df FROM words GROUP BY term),
x AS (SELECT t, license, kind, term, tf * (ln((1 + n) / (1 + coalesce(df, 0))::DOUBLE) + 1) AS x FROM terms LEFT JOIN df USING (term), n),
unit AS (SELECT t, license, kind, term, x / sqrt(sum(x * x) OVER (PARTITION BY t)) AS u FROM x),
ln_ AS (SELECT doc_id, unnest(range(0, len(a))) AS line, unnest(a) AS l, 'notice' AS kind FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
        UNION ALL SELECT doc_id, -1, text, 'text' FROM documents WHERE text IS NOT NULL),
lt AS (SELECT doc_id, line, kind, regexp_extract_all(lower(l), '{TOKEN}') AS w FROM ln_),
told AS (SELECT t, {bars} AS bars, {must} AS must FROM (SELECT t, kind, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM tpl)),
tells AS (SELECT doc_id, line, {bars} AS bars, {must} AS must FROM lt),
tf AS (SELECT doc_id, line, kind, n_words, term, count(*) AS tf FROM (SELECT doc_id, line, kind, len(w) AS n_words, unnest(w) AS term FROM lt) GROUP BY ALL),
tw AS (SELECT tf.*, tf.tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN df USING (term), n),
norm AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm FROM tw GROUP BY ALL),
dot AS (SELECT doc_id, line, n_words, t, license, sum(x * u) AS dot FROM tw JOIN unit USING (kind, term) GROUP BY ALL),
cos AS (SELECT doc_id, line, n_words, license, round(dot / norm, 9) AS c
        FROM dot JOIN norm USING (doc_id, line) JOIN told USING (t) JOIN tells USING (doc_id, line)
        WHERE told.bars = tells.bars AND list_has_all(tells.must, told.must) AND round(dot / norm, 9) >= {scan.min_cosine}),
best AS (SELECT doc_id, line, n_words, license, c FROM cos QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY c DESC, license) = 1),
own AS (
  SELECT doc_id, license, c, line, sum(n_words) OVER (PARTITION BY doc_id) AS matched FROM best
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, license, line) = 1),
a AS (
  SELECT f.doc_id, f.path, own.license, own.c AS cosine, own.line::BIGINT AS line, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir,
         own.license IS NOT NULL AND (regexp_matches(f.path, '{LICENCE_NAME}') OR matched >= {scan.licence_file_share} * len(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}'))) AS licence_file
  FROM f LEFT JOIN own USING (doc_id)),
holds AS (SELECT dir AS ancestor, license AS held FROM a WHERE licence_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
dirs AS (SELECT DISTINCT dir FROM a),
up AS (SELECT dir, d AS depth, array_to_string(list_filter(string_split(dir, '/'), lambda x: x <> '')[1:d], '/') AS ancestor
       FROM (SELECT dir, unnest(range(0, len(list_filter(string_split(dir, '/'), lambda x: x <> '')) + 1)) AS d FROM dirs)),
near AS (SELECT dir, held AS inherited, ancestor AS inherited_from FROM up JOIN holds USING (ancestor) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, license, cosine, coalesce(line, -1) AS line, licence_file, inherited, inherited_from, coalesce(license, inherited) AS effective_license
FROM a LEFT JOIN near USING (dir)
"""


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES = {"op8_license_scan": _sql()}
