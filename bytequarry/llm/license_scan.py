"""License scan with DataFrame functions only.

Templates and texts become shingles of five words. Texts are read in overlapping windows, sized for each class
of template lengths so that any passage as long as a template of the class lies whole in some window. MinHash bands of one row over
a window's shingles retrieve templates. A class has so many bands that a window which would be accepted meets its template in one
of them with a chance above 1 - ``MISS``, whatever else the window holds. The share of the template's shingles in the window is then computed
exactly, and ``LEAST`` of them is a match.

Only windows with an *anchor* are built: a few of a template's longest words, chosen so that a text without any of them lacks more than
1 - ``LEAST`` of the template's shingles. Leaving out the other windows so loses nothing, and spares all but a few texts the hashing.

The windows of a text are built where it is read; only those that meet a template in a band go on, so a hot source or a very long
text costs its reading, and the last grouping by (document, license) is partially aggregated.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, LEAST, MISS = 5, 0.8, 1e-6
#: Up to so many words of templates their index is broadcast; beyond, the joins shuffle.
BROADCAST_WORDS = 200_000
#: (longest template, window, stride) in words; window - stride is at least the longest template. Longer templates come in passages.
CLASSES = ((8, 12, 4), (16, 24, 8), (32, 48, 16), (64, 96, 32))

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
#: Fixed values: (license, text) of notices and of the telling passages of license texts, as the licenses word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Distributed under the terms of the MIT License"),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD", _BSD),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"),
)


def _words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _hashes(first: str, last: str) -> str:
    """SQL: hashes of the five-word shingles of ``w`` that begin at the words from first to last."""
    return f"transform(sequence({first}, {last}), i -> xxhash64({', '.join(f'w[i + {k}]' for k in range(SHINGLE))}))"


def words_of(text: str) -> list[str]:
    """The same words as of a text column."""
    return re.findall("[a-z0-9]+", text.lower())


def passages(texts) -> list[tuple[str, list[str]]]:
    """(license, words) of (license, text) pairs; a text too long for any class comes in passages of about equal length. One of under five words is an error."""
    out = []
    for k, (name, text) in enumerate(texts):
        w = words_of(text)
        if len(w) < SHINGLE:
            raise ValueError(f"template {k} has fewer than {SHINGLE} words")
        parts = -(-len(w) // CLASSES[-1][0])
        cuts = [len(w) * i // parts for i in range(parts + 1)]
        out += [(name, w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def class_of(n_words: int) -> int:
    return next(k for k, (longest, _, _) in enumerate(CLASSES) if n_words <= longest)


def _needed(words: list[str], least: float) -> tuple[int, int]:
    """A template's distinct shingles, and how many of them a match holds."""
    n = len({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
    return n, max(1, math.ceil(least * n - 1e-9))


def anchors(words: list[str], least: float = LEAST) -> set[str]:
    """The longest words of a template, so many that without all of them fewer than ``least`` of its shingles are left."""
    sh = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    n, need = _needed(words, least)
    out: set[str] = set()
    for w in sorted(set(words), key=lambda x: (-len(x), x)):
        if n - sum(any(x in out for x in s) for s in sh) < need:
            break
        out.add(w)
    return out


def bands_of(temps: list[tuple[str, list[str]]], least: float = LEAST) -> list[int]:
    """Bands of each class: with s the least similarity that an accepted window of the class can have to its template, (1 - s) ** bands is at most MISS."""
    out = []
    for k, (_, window, _) in enumerate(CLASSES):
        worst = 1.0
        for _, w in temps:
            if class_of(len(w)) == k:
                n, need = _needed(w, least)
                worst = min(worst, need / (window - SHINGLE + 1 + n - need))
        out.append(1 if worst >= 1 else math.ceil(math.log(MISS) / math.log(1 - worst)))
    return out


def templates(spark: SparkSession, temps: list[tuple[str, list[str]]]) -> DataFrame:
    """template, license, class, sh (distinct shingles)."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(class_of(len(w))).alias("class"), F.array(*map(F.lit, w)).alias("w")) for k, (name, w) in enumerate(temps)))
    return spark.range(1).select(F.inline(rows)).select("template", "license", "class", F.array_distinct(F.expr(_hashes("0", f"size(w) - {SHINGLE}"))).alias("sh"))


def _bands(sh: str, n: list[int]) -> Column:
    """The least hash of the shingles under each hash function of the class, with the function's number."""
    count = "case class " + " ".join(f"when {k} then {x}" for k, x in enumerate(n)) + " end"
    return F.expr(f"transform(sequence(1, {count}), b -> xxhash64(b, array_min(transform({sh}, x -> xxhash64(x, b)))))")


def _quoted(words: set[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def windows(docs: DataFrame, temps: list[tuple[str, list[str]]], least: float = LEAST) -> DataFrame:
    """doc, class, win, start, sh: the shingles of every window that holds an anchor of its class. docs: doc, w (words)."""
    by_class = [set().union(*(anchors(w, least) for _, w in temps if class_of(len(w)) == k)) for k in range(len(CLASSES))]
    lists = []
    for k, (_, window, stride) in enumerate(CLASSES):
        if by_class[k]:
            own = f"filter(hits, i -> w[i] in ({_quoted(by_class[k])}))"
            wins = f"array_distinct(flatten(transform({own}, i -> sequence(greatest(0, int(ceil((i - {window - 1}) / {stride}))), i div {stride}))))"
            lists.append(f"transform({wins}, v -> named_struct('class', {k}, 'win', int(v), 'start', int(v) * {stride}, 'stop', least(int(v) * {stride} + {window - SHINGLE}, size(w) - {SHINGLE})))")
    # no filter on words or hits here: Catalyst would push it below them, and split a text once for each of its words
    hits = docs.withColumn("hits", F.expr(f"if(size(w) >= {SHINGLE}, filter(sequence(0, size(w) - 1), i -> w[i] in ({_quoted(set().union(*by_class))})), cast(array() as array<int>))"))
    placed = hits.select("doc", "w", F.explode(F.expr(f"flatten(array({', '.join(lists)}))")).alias("v")).select("doc", "w", "v.*").filter("start <= stop")
    return placed.select("doc", "class", "win", "start", F.expr(_hashes("start", "stop")).alias("sh"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document and license found: id, license, containment (best), n_windows (over its templates), first_word, last_word.

    Of templates of different licenses that share half of their shingles, such as two versions of one notice, a
    document keeps those with the best containment, and all of them in a tie.
    ``containment`` is the share of a template's shingles that one window holds; the words count from 0 and bound the template's
    shingles in the matching windows. Whole texts are scanned, of any length. Null, empty and short texts match nothing, and an empty
    table gives no rows; rows that repeat an id, or have a null one, are windows of one document, and equal windows at one place of it
    count once. Other columns are ignored, whatever their names.
    """
    spark, temps = df.sparkSession, passages(texts)
    if not temps:
        return spark.createDataFrame([], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, license string, containment double, n_windows long, first_word long, last_word long")
    known, n_bands = templates(spark, temps), bands_of(temps, least)
    put = F.broadcast if sum(len(w) for _, w in temps) <= BROADCAST_WORDS else (lambda x: x)
    docs = df.select(F.col(id_col).alias("doc"), _words(F.col(text_col)).alias("w"))
    keyed = windows(docs, temps, least).select("doc", "class", "win", "start", "sh", F.explode(_bands("sh", n_bands)).alias("band"))
    index = known.select("template", "class", F.explode(_bands("sh", n_bands)).alias("band")).distinct()
    met = keyed.join(put(index), ["class", "band"]).groupBy("doc", "class", "win", "start", "template", F.xxhash64("sh").alias("content")).agg(F.first("sh").alias("sh"))
    both = met.join(put(known.select("template", "license", F.col("sh").alias("t"))), "template").withColumn("n", F.size(F.array_intersect("sh", "t")))
    at = F.expr("filter(sequence(0, size(sh) - 1), i -> array_contains(t, sh[i]))")
    checked = both.withColumn("containment", F.col("n") / F.size("t")).filter(F.col("containment") >= least).withColumn("at", at)
    ends = checked.select("doc", "template", "license", "containment", (F.col("start") + F.array_min("at")).alias("a"), (F.col("start") + F.array_max("at")).alias("b"))
    best = ends.groupBy("doc", "template", "license").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("a").alias("a"), F.max("b").alias("b"))
    lists = _rivals(known).groupBy("template").agg(F.collect_list("rival").alias("rivals"))
    keyed = best.join(put(lists), "template", "left").withColumn("key", F.explode(F.concat(F.array("template"), F.coalesce("rivals", F.array().cast("array<int>")))))
    own = F.col("key") == F.col("template")
    told = keyed.groupBy("doc", "key").agg(*(F.max(F.when(own, F.col(c))).alias(c) for c in ("license", "containment", "n_windows", "a", "b")), F.max(F.when(~own, F.col("containment"))).alias("other"))
    kept = told.filter("containment is not null and (other is null or other <= containment)")
    return kept.groupBy("doc", "license").agg(F.max("containment").alias("containment"), F.sum("n_windows").alias("n_windows"), F.min("a").cast("long").alias("first_word"), (F.max("b") + SHINGLE - 1).cast("long").alias("last_word")).withColumnRenamed("doc", id_col)


def _rivals(temps: DataFrame) -> DataFrame:
    """(template, rival): pairs of different licenses that share at least half of the smaller one's shingles."""
    own = temps.select("template", "license", F.size("sh").alias("n"), F.explode("sh").alias("sh"))
    other = own.select(F.col("template").alias("rival"), F.col("license").alias("rival_license"), F.col("n").alias("m"), "sh")
    both = own.join(other, "sh").filter("license <> rival_license").groupBy("template", "rival", "n", "m").count()
    return both.filter("2 * count >= least(n, m)").select("template", "rival")
