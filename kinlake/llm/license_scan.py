"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A document is looked at line by line, by paragraph, by runs of consecutive paragraphs, and as a whole: a notice is a
line, a licence's text a paragraph, a run of them or a file. Dice = 2 |A n B| / (|A| + |B|) reaches a threshold t only if the smaller set has at least
t / (2 - t) of the larger one's bigrams; these bounds choose the few templates that a unit is compared with, and
drop most units before any bigram is made. No shuffle, and JVM operators only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.llm.common import documents

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."

#: Fixed values: (licence, template). Texts of public licences and the notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, by the same rules as `bigrams`."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of at least two words."""
    n = F.size(words)
    return F.array_distinct(F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def paragraphs_of(text: Column) -> Column:
    return F.split(text, r"\n[ \t\r]*\n\s*")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit ('line', 'paragraph' or 'document'), number (from 0), text: what templates are compared with. A
    paragraph is a run of two or more lines between empty ones; the whole text of two or more lines is one unit
    'document'. Null and blank texts have none."""
    text = F.coalesce("text", F.lit(""))
    lines, paragraphs = F.split(text, "\n"), paragraphs_of(text)
    of = lambda parts, kind: F.transform(parts, lambda t, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), t.alias("text")))
    several = lambda units: F.filter(units, lambda u: F.instr(F.trim(u["text"]), "\n") > 0)
    parts = F.when(F.size(paragraphs) > 1, of(paragraphs, "paragraph")).otherwise(F.slice(of(paragraphs, "paragraph"), 1, 0))
    every = F.concat(of(lines, "line"), several(parts), several(of(F.array(text), "document")))
    return docs.select(F.col("doc_id").cast("bigint"), F.inline(every))


def runs(docs: DataFrame, table: list[tuple[int, str, list[str]]], threshold: float) -> DataFrame:
    """doc_id, unit ('run'), number (its first paragraph, from 0), k, dice: runs of two or more consecutive paragraphs, but
    for the whole text, that match a template of `table` (k, licence, bigrams). Of runs and single paragraphs that overlap
    the one with the greatest Dice counts, the shorter among equals, then the earlier; first for each template, then over all.

    A run matches only if the text has threshold / (2 - threshold) of the template's bigrams, which few texts have. Then
    every paragraph that has one of them starts a run, which ends once its own bigrams are too many for a match: a run
    that starts elsewhere is no better than the same without its first paragraph.
    """
    reach = threshold / (2 - threshold)
    every = list(dict.fromkeys(g for _, _, grams in table for g in grams))
    none = F.array().cast("array<string>")
    grams_of = lambda words: F.when(F.size(words) > 1, bigrams(words)).otherwise(none)
    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(r"\n[ \t\r]*\n"))
    # Each step's value is bound by a lambda, so that it is made once for a text.
    known = lambda words: F.transform(F.array(words), lambda w: F.array_intersect(grams_of(w), _words(every)))[0]
    text = text.withColumn("known", F.transform(F.array(words_of(F.col("text"))), known)[0])
    near = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("known", _words(grams))) >= len(grams) * reach, F.struct(F.lit(k).alias("k"), _words(grams).alias("grams"))) for k, _, grams in table]))
    text = text.filter(F.size("known") >= min(len(g) for _, _, g in table) * reach).withColumn("near", near).filter(F.size("near") > 0)
    text = text.withColumn("parts", F.transform(paragraphs_of(F.col("text")), lambda p: F.filter(words_of(p), lambda w: w != ""))).drop("text", "known")

    state = "struct<words:array<string>,grams:array<string>,over:boolean,found:array<struct<dice:double,short:int,early:int,rank:int,first:int,last:int>>>"

    def from_start(parts: Column, first: Column, k: Column, grams: Column) -> Column:
        size = F.size(grams)

        def add(at: Column, i: Column) -> Column:
            def scored(words: Column, have: Column) -> Column:
                n = F.size(have)
                dice = 2.0 * F.size(F.array_intersect(have, grams)) / (n + size)
                hit = F.struct(dice.alias("dice"), (first - i).alias("short"), (-first).alias("early"), (-k).alias("rank"), first.alias("first"), i.alias("last"))
                found = F.when(dice >= threshold, F.concat(at["found"], F.array(hit))).otherwise(at["found"])
                return F.struct(F.slice(words, F.greatest(F.size(words), F.lit(1)), 1).alias("words"), have.alias("grams"), (n > size / reach).alias("over"), found.alias("found")).cast(state)

            more = lambda words: F.transform(F.array(F.array_union(at["grams"], grams_of(words))), lambda have: scored(words, have))[0]
            return F.when(at["over"], at).otherwise(F.transform(F.array(F.concat(at["words"], F.element_at(parts, i + 1))), more)[0])

        start = F.struct(none.alias("words"), none.alias("grams"), F.lit(False).alias("over"), F.array().alias("found")).cast(state)
        return F.aggregate(F.sequence(first, F.size(parts) - 1), start, add, lambda at: at["found"])

    def best(found: Column) -> Column:
        """Those that no better one overlaps, the best first."""
        free = lambda chosen, c: ~F.exists(chosen, lambda o: (o["first"] <= c["last"]) & (c["first"] <= o["last"]))
        return F.aggregate(F.sort_array(found, asc=False), F.slice(found, 1, 0), lambda chosen, c: F.when(free(chosen, c), F.concat(chosen, F.array(c))).otherwise(chosen))

    def of_template(t: Column) -> Column:
        parts, count = F.col("parts"), F.size("parts")
        # The next word after a paragraph may end one of its bigrams.
        after = lambda i: F.slice(F.flatten(F.slice(parts, i + 2, count)), 1, 1)
        useful = lambda i: F.arrays_overlap(grams_of(F.concat(F.element_at(parts, i + 1), after(i))), t["grams"])
        starts = F.filter(F.sequence(F.lit(0), count - 1), useful)
        found = F.flatten(F.transform(starts, lambda i: from_start(parts, i, t["k"], t["grams"])))
        return F.filter(best(found), lambda r: (r["last"] > r["first"]) & (r["last"] - r["first"] < count - 1))

    found = text.select("doc_id", F.inline(best(F.flatten(F.transform("near", of_template)))))
    return found.select("doc_id", F.lit("run").alias("unit"), F.col("first").alias("number"), F.col("rank").alias("k"), "dice")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, number, license, template (its number), dice: each unit's best template at `threshold` or more.

    Ties go to the template listed first. Repeated rows give repeated results; documents without a match, null and
    empty texts give none. Templates are a parameter, so their bigrams are plan literals of a known size.
    """
    table = [(k, name, grams) for k, (name, text) in enumerate(templates) if (grams := bigrams_of(text))]
    if not table:
        raise ValueError("no template has two words")
    reach = threshold / (2 - threshold)
    sizes = [len(g) for _, _, g in table]
    found = units(docs).filter(F.length("text") >= int(min(sizes) * reach) * 2 + 1)  # words have a letter and a blank

    def best(grams_: Column) -> Column:
        n = F.size(grams_)
        dice = lambda grams, size: 2.0 * F.size(F.array_intersect(grams_, _words(grams))) / (n + size)
        candidates = F.array(*[
            F.when((n >= size * reach) & (n <= size / reach), F.struct(dice(grams, size).alias("dice"), F.lit(-k).alias("k")))
            for (k, _, grams), size in zip(table, sizes, strict=True)
        ])
        return F.when((n >= min(sizes) * reach) & (n <= max(sizes) / reach), F.array_max(F.array_compact(candidates)))

    # Lambdas bind each step's value, so that words and bigrams are made once per unit.
    enough = F.filter(F.array(words_of(F.col("text"))), lambda w: F.size(w) > min(sizes) * reach)
    scored = F.transform(F.transform(enough, bigrams), best)
    found = found.select("doc_id", "unit", "number", F.inline(F.filter(scored, lambda b: b["dice"] >= threshold)))
    found = found.select("doc_id", "unit", "number", "k", "dice").unionByName(runs(docs, table, threshold))
    names = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), 1 - F.col("k"))
    return found.select("doc_id", "unit", F.col("number").cast("bigint").alias("number"), names.alias("license"), (-F.col("k")).cast("bigint").alias("template"), "dice")


def _words(grams: list[str]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f'"{g}"' for g in grams) + "]"), "array<string>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every unit of a document that matches a licence; see `scan`."""
    return scan(documents(spark, sf_dir))


def oracle(threshold: float = THRESHOLD) -> str:
    """The SQL of lines, paragraphs and whole documents; runs, whose choice is a sequence of steps, have tests instead."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({k}, {quote(name)}, [{', '.join(map(quote, bigrams_of(text)))}])" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH t(k, license, grams) AS (VALUES {rows}),
u AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS number, string_split(coalesce(text, ''), chr(10))[i] AS text
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(i)
  UNION ALL
  SELECT doc_id, 'document', 0, text FROM documents WHERE contains(trim(text), chr(10))
  UNION ALL
  SELECT doc_id, 'paragraph', i - 1, p[i]
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n\\s*') AS p FROM documents), range(1, len(p) + 1) AS r(i)
  WHERE len(p) > 1 AND contains(trim(p[i]), chr(10))
),
w AS (SELECT doc_id, unit, number, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u),
b AS (SELECT doc_id, unit, number, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) >= 2),
d AS (
  SELECT doc_id, unit, number, license, k, 2.0::DOUBLE * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice
  FROM b JOIN t ON len(b.grams) BETWEEN len(t.grams) * {threshold / (2 - threshold)} AND len(t.grams) / {threshold / (2 - threshold)}
)
SELECT doc_id, unit, number, license, k AS template, dice FROM d WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, k) = 1
"""
