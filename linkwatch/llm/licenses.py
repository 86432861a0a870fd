"""License scan: texts against licence templates by Dice similarity of word bigrams.

Each document offers its lines, its paragraphs, its whole text and, for a licence
that none of these holds, its runs of words: notices over several paragraphs, inside
a longer text, or at the end of a line. A span and a template are normalised alike; their Dice coefficient
``2 * common / (a + b)`` can only reach the threshold ``t`` if the sizes keep
``t / (2 - t) <= a / b <= (2 - t) / t``. The permitted sizes of the templates are
the key of an equi-join, so a span meets only the templates it could match.
Before that, texts without any of the ``telling_words`` are passed by: they
can't reach the threshold with any template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwatch.llm.common import fenced, written

#: Share of bigrams in common from which a span counts as the licence.
THRESHOLD = 0.8
#: Bits of the table that tells known bigrams; a wrong "known" costs time only.
TABLE_BITS = 1 << 20

#: Texts by which the rarest words are chosen.
SAMPLE = 1000

# Usual notices and grants of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)

# The usual notices of the licences that have one line above.
_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
NOTICES = (
    ("GPL-2.0", _GNU.format(what="program", name="General Public License", v="2")),
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser General Public License", v="3")),
    ("BSD-2-Clause", _BSD[0] + _BSD[2]),
    ("BSD-3-Clause", "".join(_BSD)),
)

#: Normalised text: lower case, only letters and digits of ASCII, one space between words.
_OTHER = "[^a-z0-9]+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _OTHER, " "))


def bigrams(norm: Column) -> Column:
    """Distinct word bigrams of a normalised text; a single word counts as one."""
    w = F.split(norm, " ")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(norm == "", F.array().cast("array<string>")).when(F.size(w) == 1, w).otherwise(F.array_distinct(pairs))


def template_table(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(template_id, license, grams, n, places, size): a row for each size a span may have.

    ``places`` counts the bigrams with their repeats.

    ``templates`` is an argument given by the caller (a few texts), which bounds
    this table.
    """
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template_id int, license string, body string")
    norm = normalised(F.col("body"))
    t = t.select("template_id", "license", bigrams(norm).alias("grams"), F.greatest(F.size(F.split(norm, " ")) - 1, F.lit(1)).alias("places"))
    t = t.withColumn("n", F.size("grams"))
    ratio = threshold / (2 - threshold)
    least, most = F.ceil(F.col("n") * ratio - 1e-9), F.floor(F.col("n") / ratio + 1e-9)
    return t.withColumn("size", F.explode(F.sequence(least.cast("int"), most.cast("int"))))


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How many of SAMPLE texts (any of them) hold each word of the templates.

    It only decides which words ``telling_words`` takes, not what is found.
    """
    own = sorted({w for _, text in templates for g in _plain_bigrams(text) for w in g.split(" ")})
    words = F.array_distinct(F.split(normalised(F.col("text")), " "))
    rows = docs.select("text").limit(SAMPLE).select(F.explode(F.array_intersect(words, F.array(*map(F.lit, own)))).alias("w"))
    # At most a row for each word of the templates.
    return {r["w"]: r["count"] for r in rows.groupBy("w").count().collect()}


def telling_words(templates=TEMPLATES, threshold: float = THRESHOLD, frequency: dict[str, int] | None = None) -> list[str]:
    """Words of which every matching span holds at least one.

    A span that reaches the threshold ``t`` holds at least ``t / (2 - t)`` of the
    template's bigrams. So if more than the rest of them touch a few words, the
    span holds one of these. The words that the fewest texts hold are taken, by
    ``frequency``, then the longest.
    """
    texts = frequency or {}
    out: set[str] = set()
    for _, text in templates:
        grams = {tuple(g.split(" ")) for g in _plain_bigrams(text)}
        need = (1 - threshold / (2 - threshold)) * len(grams) + 1e-9
        touched: set[tuple[str, ...]] = set()
        for w in sorted({w for g in grams for w in g}, key=lambda w: (texts.get(w, 0), -len(w), w)):
            touched |= {g for g in grams if w in g}
            out.add(w)
            if len(touched) > need:
                break
    return sorted(out)


def telling_documents(docs: DataFrame, words: list[str]) -> DataFrame:
    """(row, doc_id, norm): rows whose text holds one of ``words``, normalised but for line ends."""
    norm = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9\n]+", " ")
    rows = fenced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")))
    rows = rows.where(_some(_whole(), words))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _whole() -> Column:
    return F.trim(F.translate("norm", "\n", " "))


def _some(body: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(body, " "), F.array(*map(F.lit, words)))


def candidate_spans(rows: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, span_kind, span_no, norm): spans of ``telling_documents`` that hold one of ``words``.

    The whole text; its paragraphs, parted by lines without a letter or digit,
    and its lines, where there are several.
    """
    parts = lambda cut, kind: F.filter(
        F.transform(F.split("norm", cut), lambda p, i: F.struct(F.lit(kind).alias("span_kind"), i.alias("span_no"), F.trim(F.translate(p, "\n", " ")).alias("norm"))),
        lambda s: _some(s["norm"], words),
    )
    several = lambda cut, kind: F.when(F.size(F.split("norm", cut)) > 1, parts(cut, kind))
    whole = F.array(F.struct(F.lit("document").alias("span_kind"), F.lit(0).alias("span_no"), F.regexp_replace(_whole(), " +", " ").alias("norm")))
    found = F.flatten(F.array_compact(F.array(whole, several("\n[ \n]*\n", "paragraph"), several("\n", "line"))))
    rows = fenced(rows.select("doc_id", found.alias("found")))
    return rows.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")


def word_runs(rows: DataFrame, t: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, license, dice, span_no): the best run of words of each text of ``telling_documents`` for each licence not in ``held``.

    A run that begins or ends with a bigram the template lacks is bettered by
    one without it. So the runs from one common bigram to another are compared,
    all of them: up to the words in which the template, grown to the largest size
    a match may have, could stand. A text needs the common bigrams of the least
    match, the runs from a place too.
    """
    ratio = threshold / (2 - threshold)
    t = t.select("template_id", "license", "n", "places", F.explode("grams").alias("gram"))
    grams = t.select("template_id", "license", "n", F.ceil(F.col("n") * ratio - 1e-9).cast("int").alias("need"), F.floor(F.col("places") / ratio + 1e-9).cast("int").alias("reach"), F.xxhash64("gram").alias("g"))
    hashes = {r["g"] for r in grams.select("g").distinct().collect()}  # the caller's templates, see template_table
    bits = [0] * (TABLE_BITS // 64)
    for h in hashes:
        bits[(h & TABLE_BITS - 1) >> 6] |= 1 << (h & 63)
    # One literal, which Spark folds to an array.
    table = F.split(F.lit(",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)), ",").cast("array<bigint>")
    least = grams.agg(F.min("need")).first()[0] or 1
    w = F.split(F.regexp_replace(_whole(), " +", " "), " ")
    pair = lambda i: F.xxhash64(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    texts = fenced(rows.select("row", "doc_id", w.alias("w")).where(F.size("w") > 1))
    texts = fenced(texts.select("row", "doc_id", F.transform(F.sequence(F.lit(0), F.size("w") - 2), pair).alias("all")))

    def is_known(i: Column) -> Column:
        at = F.get("all", i).bitwiseAND(F.lit(TABLE_BITS - 1)).cast("int")
        return F.getbit(F.get(table, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    texts = fenced(texts.withColumn("maybe", F.filter(F.sequence(F.lit(0), F.size("all") - 1), is_known)))
    texts = fenced(texts.where(F.size("maybe") >= least).withColumn("met", F.array_distinct(F.transform("maybe", lambda i: F.get("all", i)))))
    # Texts with the common bigrams of the least match of a template.
    own = grams.groupBy("template_id", "need").agg(F.collect_set("g").alias("g")).collect()
    enough = F.lit(False)
    for r in own:
        enough = enough | (F.size(F.array_intersect("met", F.split(F.lit(",".join(map(str, r["g"]))), ",").cast("array<bigint>"))) >= r["need"])
    texts = written(texts.where(F.size("met") >= least).where(enough).drop("met"), "license-runs")
    places = texts.select("row", "doc_id", F.explode(F.transform("maybe", lambda i: F.struct(i.alias("i"), F.get("all", i).alias("g")))).alias("p"))
    hits = places.select("row", "doc_id", "p.*").join(F.broadcast(grams), "g")
    known = [hits["doc_id"].eqNullSafe(held["doc_id"]), hits["license"] == held["license"]]
    hits = hits.join(held, known, "left_anti")
    hits = hits.groupBy("row", "template_id", "license", "n", "need", "reach").agg(F.sort_array(F.collect_list(F.struct("i", "g"))).alias("at"))
    hits = hits.where(F.size(F.array_distinct("at.g")) >= F.col("need"))
    hits = hits.withColumns({"at": F.col("at.i"), "common": F.col("at.g")})

    def run(a: Column, b: Column) -> Column:
        first, last = F.get("at", a), F.get("at", b)
        size = F.size(F.array_distinct(F.slice("all", first + 1, last - first + 1)))
        common = F.size(F.array_distinct(F.slice("common", a + 1, b - a + 1)))
        return F.struct((2.0 * common / (size + F.col("n"))).alias("dice"), (-first).alias("back"))

    def runs(a: Column) -> Column:
        near = lambda b: F.get("at", b) - F.get("at", a) < F.col("reach")
        last = F.least(F.size("at") - 1, a + F.col("reach") - 1)
        ends = F.filter(F.sequence(a + F.col("need") - 1, F.greatest(last, a + F.col("need") - 1)), near)
        return F.array_max(F.transform(ends, lambda b: run(a, b)))

    # Places with enough common bigrams within reach, then their runs.
    begins = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda a: F.get("at", a + F.col("need") - 1) - F.get("at", a) < F.col("reach"))
    hits = fenced(hits.withColumn("begins", begins)).where(F.size("begins") > 0)
    best = fenced(hits.join(texts.select("row", "doc_id", "all"), "row").withColumn("best", F.array_max(F.transform("begins", runs))))
    return best.select("doc_id", "license", F.col("best.dice").alias("dice"), (-F.col("best.back")).alias("span_no")).where(F.col("dice") >= threshold)


def scan_licenses(docs: DataFrame, templates=TEMPLATES + NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, span_kind, span_no): each licence of each document, with its best span.

    Of spans with equal Dice the order is document, paragraph, line, then the
    first. A licence that none of these holds is looked for in the runs of words
    (span_kind ``words``, span_no the place of the first word of the best run).
    Templates of one word are only met by spans of it. Null, empty and wordless
    texts match nothing; rows that repeat a doc_id count as one document; a null
    doc_id is kept as a document of its own. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    t = template_table(spark, templates, threshold)
    words = telling_words(templates, threshold, word_frequencies(docs, templates))
    rows = written(telling_documents(docs, words), "license-texts")
    spans = candidate_spans(rows, words)
    spans = spans.select("doc_id", "span_kind", "span_no", bigrams(F.regexp_replace("norm", " +", " ")).alias("found"))
    spans = spans.withColumn("size", F.size("found"))
    pairs = spans.join(F.broadcast(t), "size")  # the caller's templates, see template_table
    common = F.size(F.array_intersect("found", "grams"))
    pairs = pairs.withColumn("dice", 2.0 * common / (F.col("size") + F.col("n"))).where(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", F.when(F.col("span_kind") == "document", 2).when(F.col("span_kind") == "paragraph", 1).otherwise(0).alias("k"), (-F.col("span_no")).alias("p"), "span_kind")).alias("b")
    columns = ["doc_id", "license", F.col("b.dice").alias("dice"), F.col("b.span_kind").alias("span_kind"), (-F.col("b.p")).alias("span_no")]
    found = written(pairs.groupBy("doc_id", "license").agg(best).select(*columns), "license-spans")
    runs = word_runs(rows, t.dropDuplicates(["template_id"]), found.select("doc_id", "license"), threshold)
    best = F.max(F.struct("dice", (-F.col("span_no")).alias("p"), F.lit("words").alias("span_kind"))).alias("b")
    return found.unionByName(runs.groupBy("doc_id", "license").agg(best).select(*columns))


def _plain_bigrams(text: str) -> list[str]:
    w = re.sub(_OTHER, " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])] or w


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB: every span against every template, without size bounds."""
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    grams = lambda norm: f"""CASE WHEN {norm} = '' THEN [] WHEN len(string_split({norm}, ' ')) = 1 THEN string_split({norm}, ' ')
      ELSE list_distinct(list_transform(range(1, len(string_split({norm}, ' '))),
           lambda i: string_split({norm}, ' ')[i] || ' ' || string_split({norm}, ' ')[i + 1])) END"""  # noqa: E731
    return f"""
WITH t AS (
  SELECT license, {grams("norm")} AS g
  FROM (SELECT license, trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')) AS norm
        FROM (VALUES {rows}) v(i, license, body))
), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
para AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g'), '\\n[ \\n]*\\n') AS x FROM d),
line AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM d),
spans AS (
  SELECT doc_id, 2 AS k, 'document' AS span_kind, 0 AS span_no, text AS body FROM d
  UNION ALL SELECT doc_id, 1, 'paragraph', generate_subscripts(x, 1) - 1, unnest(x) FROM para WHERE len(x) > 1
  UNION ALL SELECT doc_id, 0, 'line', generate_subscripts(x, 1) - 1, unnest(x) FROM line WHERE len(x) > 1
), s AS (
  SELECT * EXCLUDE (norm, body), {grams("norm")} AS f
  FROM (SELECT *, trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')) AS norm FROM spans)
), m AS (
  SELECT doc_id, license, k, span_kind, span_no,
         2.0::DOUBLE * len(list_intersect(f, g)) / (len(f) + len(g)) AS dice
  FROM s, t WHERE len(f) > 0
)
SELECT doc_id, license, max(dice) AS dice,
       max_by(span_kind, struct_pack(a := dice, b := k, c := -span_no)) AS span_kind,
       max_by(span_no, struct_pack(a := dice, b := k, c := -span_no))::INTEGER AS span_no
FROM m WHERE dice >= {threshold} GROUP BY doc_id, license
"""


#: Of TEMPLATES in documents, paragraphs and lines; it has no runs of words and no NOTICES.
ORACLE_SQL = oracle_sql()
