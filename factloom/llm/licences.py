"""Licence scan: blocks of a text against licence templates by the Dice coefficient over word bigrams.

A document's blocks are its lines, its paragraphs (divided by lines without words) and its whole text. Texts are
normalised to words of a-z and 0-9. Of bags of n and m bigrams the coefficient can only
reach the threshold if n and m are close enough; each template is entered under every size it can
meet, and a block is joined by its size, so most blocks meet no template and are
never cut into bigrams. All of it is expressions on rows; only what was found is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import join_rows, text_key

#: hundredths of the Dice coefficient
PERCENT = 80
#: Notices by which works state their licence.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                   "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
            "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def words(text: Column) -> Column:
    """The normalised words of a text, in either case yet."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def blocks(text: Column) -> Column:
    """The words of each line, of each paragraph where there are several, and of the whole text where it has several lines."""
    none = F.array().cast("array<array<string>>")
    lines = F.transform(F.split(text, "\n"), words)
    paragraphs = F.transform(F.split(text, "\n[^A-Za-z0-9\n]*\n"), words)
    return F.concat(lines, F.when(F.size(paragraphs) > 1, paragraphs).otherwise(none), F.when(F.size(lines) > 1, F.array(words(text))).otherwise(none))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bag(words: Column) -> Column:
    """Hashes of the word bigrams, the second and later of equal ones made distinct by their number."""
    pairs = lambda w: F.array_sort(F.zip_with(
        F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(F.lower(a), F.lower(b))))
    return _let(words, lambda w: _let(pairs(w), lambda p: F.transform(p, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(p, h)))))


def templates(spark, pairs: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(licence, text) as a frame of literals."""
    rows = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in pairs))
    return spark.range(1).select(F.inline(rows))


def matches(docs: DataFrame, licences: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, licence, dice) of every block of ``docs`` and template of ``licences`` (licence, text) similar enough."""
    known = (
        licences.select("licence", words(F.col("text")).alias("w")).where("size(w) > 1")
        .select("licence", bag(F.col("w")).alias("t")).withColumn("m", F.size("t"))
        # 2 min(n, m) / (n + m) reaches the threshold only between these sizes
        .withColumn("n", F.explode(F.sequence(
            F.ceil(F.col("m") * percent / (200 - percent)).cast("int"), F.floor(F.col("m") * (200 - percent) / percent).cast("int"))))
        .groupBy("n").agg(F.collect_list(F.struct("licence", "m", "t")).alias("known")))
    sized = (
        docs.select("doc_id", text_key().alias("text_key"), F.explode(blocks(F.col("text"))).alias("words"))
        .withColumn("n", F.size("words") - 1)
        .where("n > 0").join(known, "n"))
    compared = _let(bag(F.col("words")), lambda b: F.transform("known", lambda k: F.struct(
        k["licence"].alias("licence"), k["m"].alias("m"), F.size(F.array_intersect(b, k["t"])).alias("common"))))
    alike = F.filter(compared, lambda c: 200 * c["common"] >= percent * (F.col("n") + c["m"]))
    return sized.select("doc_id", "text_key", "n", F.explode(alike).alias("c")).select(
        "doc_id", "text_key", "c.licence", (2 * F.col("c.common") / (F.col("n") + F.col("c.m"))).alias("dice"))


def scan(docs: DataFrame, licences: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, licences, best_licence, best_dice.

    ``licences`` are the licences found, sorted and comma-joined ('' if none); the best has the highest coefficient, the first by name
    among equals (null and 0.0 if none). A null or empty text, or one without two words, has none. Templates of fewer than
    two words match nothing. Repeated rows get the same result each; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    licences = templates(docs.sparkSession) if licences is None else licences
    found = matches(docs.where("text is not null"), licences, percent).groupBy("doc_id", "text_key", "licence").agg(F.max("dice").alias("dice")).groupBy(
        "doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("dice")).alias("order"), "licence"))).alias("found"))
    rows = docs.select("doc_id", text_key().alias("text_key"))
    return join_rows(rows, found, ["doc_id", "text_key"]).select(
        "doc_id", "text_key", F.coalesce(F.array_join(F.sort_array("found.licence"), ","), F.lit("")).alias("licences"),
        F.get("found.licence", F.lit(0)).alias("best_licence"), F.coalesce(-F.get("found.order", F.lit(0)), F.lit(0.0)).alias("best_dice"))
