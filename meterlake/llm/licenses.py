"""Licence scans by diagonal voting: word k-grams of all texts joined with those of notice templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import materialize
from meterlake.llm.quality import let

#: Words: runs of anything but ASCII signs and controls, after lower-casing A-Z.
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever their words stand in a row: (words, label).
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))

# Notices of common licences, as their publishers word them, lower-cased and without signs.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "under the bsd 3 clause license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
    # whole texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
)
#: Words of a k-gram, share of a template's words that must be found, widest step between merged diagonals.
GRAM, COVERAGE, DRIFT = 3, 0.85, 2
#: Words of a stretch by which overlapping spans meet.
STRETCH = 64


def words_of(text: Column) -> Column:
    """The words of a text that isn't null. ``lower`` also changes other letters, but of those only the Kelvin sign
    becomes an ASCII letter, so it is put out of the way."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ᴷ"))), SIGNS), "")


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Starts (from 0) of all places where the words of ``phrase`` stand in a row."""

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == word)
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here)
    return F.when((F.size(words) >= len(phrase)) & F.array_contains(words, phrase[-1]), found).otherwise(F.array().cast("array<int>"))


def phrase_places(docs: DataFrame) -> DataFrame:
    """(_id, _hash, doc_id, n_words, n_base, first_word, last_word, base) of every row; ``base``: distinct labels in order."""

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), *(_places(words, phrase).alias(f"p{k}") for k, (phrase, _) in enumerate(PHRASES)))

    found = docs.select("_id", "_hash", "doc_id", let(words_of(F.col("text")), of).alias("f"))
    every = F.concat(*(F.col(f"f.p{k}") for k in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"f.p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES))))
    return found.select(
        "_id", "_hash", "doc_id", "f.n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.sort_array(labels).alias("base"),
    )


def template_grams(docs: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(hash, gram, template, label, at, size): k-grams of the templates with their positions; a constant table."""
    rows = [(f"{t:03d}", label, text.split(" ")) for t, (label, text) in enumerate(templates)]
    grams = [(" ".join(words[i : i + k]), t, label, i, len(words)) for t, label, words in rows for i in range(len(words) - k + 1)]
    return docs.sparkSession.createDataFrame(grams, "gram string, template string, label string, at int, size int").withColumn("hash", F.xxhash64("gram"))


def diagonal_votes(docs: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(_id, _hash, template, label, size, diagonal, votes, ats): hits of each document and template by diagonal.

    A hit is an equal k-gram: joined by hash, with the words compared. The diagonal is its place in the text minus its
    place in the template; ``ats`` are the distinct template places that vote. The templates are broadcast (constant).
    """
    grams = let(words_of(F.col("text")), lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))))
    exploded = docs.select("_id", "_hash", F.posexplode(grams).alias("place", "gram")).withColumn("hash", F.xxhash64("gram"))
    hits = exploded.join(F.broadcast(template_grams(docs, templates, k).withColumnRenamed("gram", "own")), "hash").where("gram = own")
    return hits.groupBy("_id", "_hash", "template", "label", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_set("at")).alias("ats")).withColumn("votes", F.size("ats"))


def best_of_overlapping(spans: DataFrame) -> DataFrame:
    """The spans that no better one overlaps in a document: of a greater share, or equal and longer, or of a label before it.

    Spans meet by stretches of STRETCH words, so a document with many notices compares each with its neighbours only.
    """
    stretch = F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("last") / STRETCH))
    cut = spans.withColumn("stretch", F.explode(stretch))
    same = (F.col("a._id") == F.col("b._id")) & (F.col("a._hash") == F.col("b._hash")) & (F.col("a.stretch") == F.col("b.stretch"))
    over = (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    rank = lambda s: F.struct(-F.col(f"{s}.share"), -F.col(f"{s}.size"), F.col(f"{s}.label"), F.col(f"{s}.first"))
    keys = ["_id", "_hash", "label", "size", "first", "last"]
    beaten = cut.alias("a").join(cut.alias("b"), same & over & (rank("b") < rank("a"))).select(*(F.col(f"a.{k}") for k in keys)).distinct()
    return spans.join(beaten, keys, "left_anti")


def verified_spans(votes: DataFrame, k: int = GRAM, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """(_id, _hash, label, size, share, first, last): template occurrences whose words are found to a share of ``coverage``.

    Diagonals of a document and template that lie at most ``drift`` apart are merged (a word put in or left out moves
    the rest to the next diagonal). The span runs from the first to the last hit and must not be longer than the
    template by more than the drift for each merged diagonal; ``share`` is that of template words under a hit.
    """
    order = Window.partitionBy("_id", "_hash", "template").orderBy("diagonal")
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(0))
    groups = votes.withColumn("new", begins).withColumn("group", F.sum("new").over(order))
    merged = groups.groupBy("_id", "_hash", "template", "label", "size", "group").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"),
        F.min(F.col("diagonal") + F.get("ats", F.lit(0))).alias("first"),
        F.max(F.col("diagonal") + F.array_max("ats") + k).alias("end"),
        F.count(F.lit(1)).alias("merged"),
    )
    under = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1)))))
    share = under / F.col("size")
    fits = F.col("end") - F.col("first") <= F.col("size") + drift * F.col("merged")
    return merged.withColumn("share", share).where((F.col("share") >= coverage) & fits).select("_id", "_hash", "label", "size", "share", "first", (F.col("end") - 1).alias("last"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs`` (doc_id, text).

    ``score``: 1 where a base phrase stands, else the best verified share of a template, else 0. Null and empty texts:
    no words and empty labels; null ids are kept; rows of equal id and text get equal results; an empty table gives no
    rows; other columns are ignored. The texts are read twice and never shuffled; what is shuffled are hits and one
    small row a document.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64("doc_id", "text").alias("_hash"))
    spans = best_of_overlapping(materialize(verified_spans(diagonal_votes(own)), "licence-spans"))
    found = materialize(spans.groupBy("_id", "_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "licences")
    base = materialize(phrase_places(own), "licence-phrases")
    both = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return base.join(found, ["_id", "_hash"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
