"""License scans for whole licence texts, file headers and notices anywhere in a text, with DataFrame expressions only.

Texts are compared with templates as in ``licenses``, by the Dice coefficient over distinct word bigrams (here by their 64-bit hashes). Units
are the lines, the paragraphs (parted by lines without words), the text as a whole, and every run of as many words as the template
has that begins with one of its bigrams: so a template is found when it is wrapped over lines or stands within a longer line or text.

A coefficient of t needs t / (2 - t) of the template's bigrams, so one at least of any n - ceil(n t / (2 - t)) + 1 of them: texts without any of
those are dropped, with no loss. Only what passes meets its templates.

Null and empty texts match nothing; null ids stay null; rows of one id are one document. Templates of one word never match.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import NOTICES, words

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, {1}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
#: Headers as files of a project begin with.
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-2.0": [_GNU.format("", "either version 2 of the License, or (at your option) any later version"), _GNU.format("", "version 2 of the License")],
    "GPL-3.0": [_GNU.format("", "either version 3 of the License, or (at your option) any later version")],
    "LGPL-2.1": [_GNU.format("Lesser ", "either version 2.1 of the License, or (at your option) any later version")],
    "LGPL-3.0": [_GNU.format("Lesser ", "either version 3 of the License, or (at your option) any later version")],
    "AGPL-3.0": [_GNU.format("Affero ", "either version 3 of the License, or (at your option) any later version")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}


def texts() -> dict[str, list[str]]:
    """Notices, headers and whole texts by licence."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    out = {k: list(v) for k, v in NOTICES.items()}
    for k, v in HEADERS.items():
        out.setdefault(k, []).extend(v)
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out.setdefault(name.removesuffix(".txt"), []).append(f.read())
    return out


def _pairs(w: Column) -> Column:
    """Hashes of the word bigrams, in their order."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def license_passages(docs: DataFrame, notices: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, n_templates, best_dice``: licences of each document, how many of their templates it holds, and how well the best fits."""
    share = least / (2 - least)
    known = notices.withColumn("w", words(F.col("template_text"))).withColumn("p", _pairs(F.col("w")))
    # The longest pairs of words are taken for the rarest.
    longest = F.array_distinct(F.transform(F.array_sort(F.zip_with(F.transform("w", F.length), F.col("p"), lambda n, p: F.struct((-n).alias("n"), p.alias("p")))), lambda x: x.p))
    longest = F.filter(longest, lambda x: x.isNotNull())
    held = [r for r in known.select("license", F.size("w").alias("n_w"), longest.alias("b")).collect() if r.b]  # the templates alone
    if not held:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0).cast("bigint").alias("n_templates"), F.lit(0.0).alias("best_dice")).where("false")
    rows = [(k, r.license, r.n_w, r.b, max(1, math.ceil(len(r.b) * share - 1e-9))) for k, r in enumerate(held)]
    firsts = [b[: len(b) - need + 1] for _, _, _, b, need in rows]
    known = docs.sparkSession.createDataFrame(rows, "k int, license string, n_w int, b array<bigint>, need int")
    one_of = ",".join(f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)" for x in sorted({x for f in firsts for x in f}))
    each = ",".join(f"array({','.join(f'{x}L' for x in f)})" for f in firsts)

    units = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("p", _pairs(words(F.col("text"))))
    units = units.withColumn("hits", F.expr(f"filter(p, x -> x IN ({one_of}))"))
    met = F.expr(f"CASE WHEN size(hits) = 0 THEN CAST(array() AS array<int>) ELSE filter(sequence(0, {len(rows) - 1}), k -> arrays_overlap(hits, array({each})[k])) END")
    units = units.select("doc_id", "text", "p", F.explode(met).alias("k")).join(F.broadcast(known), "k")
    units = units.where(F.size(F.array_intersect("p", "b")) >= F.col("need"))
    b, n_w, need = F.col("b"), F.col("n_w"), F.col("need")
    dice = lambda p: 2 * F.size(F.array_intersect(p, b)) / (F.size(F.array_distinct(p)) + F.size(b))
    parts = lambda by: F.array_max(F.transform(F.split("text", by), lambda t: dice(_pairs(words(t)))))
    at = F.filter(F.transform("p", lambda x, i: F.when(F.array_contains(b, x), i)), lambda i: i.isNotNull())
    units = units.withColumn("at", at)
    # Of a run, so many places at least must be the template's.
    enough = F.filter("at", lambda i, k: F.get("at", k + need - 1) <= i + n_w - 2)
    runs = F.array_max(F.transform(enough, lambda i: dice(F.slice("p", i + 1, n_w - 1))))
    found = units.select("doc_id", "license", "k", F.greatest(dice(F.col("p")), parts("\n"), parts("\n\\s*\n"), runs).alias("dice")).where(F.col("dice") >= least)
    return found.groupBy("doc_id", "license").agg(F.count_distinct("k").alias("n_templates"), F.max("dice").alias("best_dice"))
