"""License scans: phrases, and diagonal voting against license notices.

All rolling word k-grams of a text are joined to their positions in the notices. A hit at
word d of the text and word p of a notice lies on the diagonal d - p; a notice that stands
in the text puts its hits on one diagonal, or on neighbouring ones where words were added
or left out. Hits are gathered by diagonal and neighbouring diagonals are merged. What is
merged is cut where hits are far apart, and a span is verified by its length and by the
share of the notice's words that its k-grams cover in their order.

Scale: the notices are a fixed table of a few hundred k-grams, so the join is a broadcast
join in the scan's stage and only hits are shuffled, by document, notice and diagonal. A
passage that many documents share is as many small groups, never one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Words of public license notices, and the labels they give.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
    Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
    substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
    permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
    ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU General Public License for more details."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
    software."""),
)


@dataclass(frozen=True)
class Voting:
    """k-gram length; how far apart diagonals are merged, and how many words may stand
    between the k-grams of a span; the share of a notice's words that must be covered in
    order. A span is longer than its notice by at most the rest's share, and `slack` words."""

    k: int = 3
    slack: int = 3
    share: float = 0.8
    notices: tuple[tuple[str, str], ...] = NOTICES


def words_of(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN, -1), "")


def _grams(words: Column, k: int) -> Column:
    """Hash of each rolling k-gram, in order."""
    at = lambda i, j: F.element_at(words, i + j)
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*[at(i, j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def _notice_grams(spark: SparkSession, rule: Voting) -> DataFrame:
    """(notice, label, n_words, p, gram) for each k-gram of each notice."""
    rows = F.array(*[F.struct(F.lit(i).alias("notice"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(rule.notices)])
    table = spark.range(1).select(F.explode(rows).alias("r")).select("r.*").withColumn("words", words_of(F.col("text")))
    return table.select("notice", "label", F.size("words").alias("n_words"), F.posexplode(_grams(F.col("words"), rule.k)).alias("p", "gram"))


def votes(spark: SparkSession, keyed: DataFrame, rule: Voting) -> DataFrame:
    """keyed (key columns doc_id and text_hash, words): a row for each verified span with
    label, share (of the notice's words), first and last word."""
    key = ["doc_id", "text_hash"]
    grams = keyed.select(*key, F.posexplode(_grams(F.col("words"), rule.k)).alias("d", "gram"))
    # Rows that repeat a document bring their few hits again: one of each is enough.
    hits = grams.join(F.broadcast(_notice_grams(spark, rule)), "gram").drop("gram").distinct()
    lines = hits.groupBy(*key, "notice", "label", "n_words", (F.col("d") - F.col("p")).alias("diagonal")).agg(F.collect_list("d").alias("ds"))
    order = Window.partitionBy(*key, "notice").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > rule.slack, F.lit(True))
    islands = lines.withColumn("_new", apart.cast("int")).withColumn("island", F.sum("_new").over(order))
    # An island of scattered hits is cut where the text or the diagonal jumps.
    placed = islands.select(*key, "notice", "label", "n_words", "island", "diagonal", F.explode("ds").alias("d"))
    along = Window.partitionBy(*key, "notice", "island").orderBy("d", "diagonal")
    jump = (F.col("d") - F.lag("d").over(along) > rule.k + rule.slack) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > rule.slack)
    cut = placed.withColumn("_new", F.coalesce(jump, F.lit(True)).cast("int")).withColumn("span", F.sum("_new").over(along))
    spans = cut.groupBy(*key, "notice", "label", "n_words", "island", "span").agg(
        F.array_sort(F.collect_list(F.struct("d", (F.col("d") - F.col("diagonal")).alias("p")))).alias("hs"), F.min("d").alias("first"), (F.max("d") + rule.k - 1).alias("last")
    )
    return spans.withColumn("share", _in_order("hs", rule.k) / F.col("n_words")).where(
        (F.col("share") >= rule.share) & (F.col("last") - F.col("first") + 1 <= F.col("n_words") * (2 - rule.share) + rule.slack)
    ).select(*key, "label", "share", "first", "last")


def _in_order(hits: str, k: int) -> Column:
    """Words of the notice that hits (in the order of the text) cover going forward."""

    def step(acc: Column, h: Column) -> Column:
        new = h["p"] + k - F.greatest(h["p"], acc["end"])
        ahead = h["p"] > acc["last"]
        return F.struct(F.when(ahead, h["p"]).otherwise(acc["last"]).alias("last"), F.when(ahead, h["p"] + k).otherwise(acc["end"]).alias("end"), (acc["n"] + F.when(ahead, new).otherwise(0)).alias("n"))

    return F.aggregate(hits, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _phrase(norm: Column, n_words: Column, phrase: str) -> Column:
    """Count, first and last place of a phrase in words joined by single spaces."""
    first, *rest = phrase.split(" ")
    pattern = f" {first}(?={''.join(' ' + w for w in rest)} )"
    parts = F.split(norm, pattern, -1)
    places = F.struct((F.size(parts) - 1).cast("long").alias("n"), _spaces(F.element_at(parts, 1)).alias("first"), (n_words - _spaces(F.element_at(parts, -1))).alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), places).otherwise(none)


def scan(docs: DataFrame, rule: Voting = Voting()) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (array of label, share, first, last) for each row.

    score is the largest share of a notice's words that a verified span covers, and 1 where
    a phrase stands. Null and empty texts have no words, no labels and score 0. Rows that
    agree in doc_id and text are scanned alike, and each keeps its row; a null doc_id is a
    value like others. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    spans = votes(spark, keyed, rule)
    found = spans.groupBy("doc_id", "text_hash").agg(F.max("share").alias("share"), F.sort_array(F.collect_list(F.struct("label", "share", "first", "last"))).alias("spans"))

    norm = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    base = keyed.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), norm.alias("norm"))
    base = base.select("doc_id", "text_hash", "n_words", *[_phrase(F.col("norm"), F.col("n_words"), p).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)])
    p = [F.col(f"_p{i}") for i in range(len(PHRASES))]
    own = F.filter(F.array(*[F.when(x["n"] > 0, F.lit(label)) for x, (_, label) in zip(p, PHRASES)]), lambda x: x.isNotNull())
    base = base.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_words", sum((x["n"] for x in p[1:]), p[0]["n"]).alias("n_base"),
        F.least(*[x["first"] for x in p]).alias("first_word"), F.greatest(*[x["last"] for x in p]).alias("last_word"), F.array_sort(F.array_distinct(own)).alias("_own"),
    )
    joined = base.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("_own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_own", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("spans", F.array().cast("array<struct<label:string,share:double,first:int,last:int>>")).alias("spans"),
    )
