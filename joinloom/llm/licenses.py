"""License scans with DataFrame expressions only.

Units of a text are its lines and, if it has several, the text as a whole. A unit is normalised (lower
case; every run of characters that are no letters or digits becomes one space) and compared with licence
templates by the Dice coefficient over the sets of its word bigrams: 2 |A and B| / (|A| + |B|).

A coefficient of t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t. Units whose number of distinct words is
beyond the bound of all templates are dropped before any bigram is built; the rest meets only templates of
fitting sizes, by an equality join on the number of bigrams.

Null and empty texts match nothing; null ids stay null; rows of one id are one document; an empty table
gives an empty one. Other columns of the input are left out. Templates of one word have no bigrams and never match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices as they stand in files; fixed values.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved."],
}


def templates(spark: SparkSession, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``license, template, template_text``, a row for each notice."""
    rows = [(k, i, t) for k, texts in (NOTICES if notices is None else notices).items() for i, t in enumerate(texts)]
    if not rows:
        return spark.sql("SELECT '' AS license, 0L AS template, '' AS template_text WHERE false")
    row = lambda k, i, t: F.struct(F.lit(k).alias("license"), F.lit(i).cast("bigint").alias("template"), F.lit(t).alias("template_text"))
    return spark.range(1).select(F.inline(F.array(*(row(*r) for r in rows))))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct word bigrams; empty for fewer than two words."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def license_scan(docs: DataFrame, notices: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, n_units, best_dice``: licences of each document, how many of its units match, and how well the best does."""
    known = notices.withColumn("b", bigrams(words(F.col("template_text")))).withColumn("n_b", F.size("b")).where("n_b > 0")
    low, high = known.agg(F.min("n_b"), F.max("n_b")).first()
    if low is None:
        low, high = 1, 0
    fewest, most = math.ceil(low * least / (2 - least) - 1e-9), math.floor(high * (2 - least) / least + 1e-9)
    reach = F.sequence(F.ceil(F.col("n_b") * (least / (2 - least)) - 1e-9).cast("int"), F.floor(F.col("n_b") * ((2 - least) / least) + 1e-9).cast("int"))
    known = known.select("license", "b", "n_b", F.explode(reach).alias("n_a"))
    # Each line is split into words once. A text of several lines is a unit as well, unless a line alone has too many words for any template.
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), words)
    units = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).withColumn("n", F.transform("lines", lambda w: F.size(F.array_distinct(w))))
    small = F.filter("lines", lambda w, i: (F.size(w) > fewest) & (F.get("n", i) <= most + 1))
    whole = F.when((F.size("lines") > 1) & (F.array_max("n") <= most + 1), F.array(F.flatten("lines"))).otherwise(F.array().cast("array<array<string>>"))
    units = units.select("doc_id", F.explode(F.concat(small, whole)).alias("w")).where((F.size("w") > fewest) & (F.size(F.array_distinct("w")) <= most + 1))
    units = units.select("doc_id", bigrams(F.col("w")).alias("a")).withColumn("n_a", F.size("a")).where(F.col("n_a").between(fewest, most))
    dice = 2 * F.size(F.array_intersect("a", "b")) / (F.col("n_a") + F.col("n_b"))
    found = units.join(known, "n_a").select("doc_id", "license", "a", dice.alias("dice")).where(F.col("dice") >= least)
    # Notices of one licence can match the same unit: it counts once, so count units by the best notice first.
    found = found.withColumn("unit", F.xxhash64("a"))
    return found.groupBy("doc_id", "license").agg(F.count_distinct("unit").alias("n_units"), F.max("dice").alias("best_dice"))
