"""License scans by diagonal voting.

All rolling k-grams of a text's words are joined, as hashes, to the places where the license templates hold them. A
match of text place p and template place t votes for the diagonal p - t; votes are counted by document, template and
diagonal, neighbouring diagonals (words left out or put in) are merged, merged spans are cut where CUT words in a row
match nothing, and each piece is verified: enough of a short notice, or a long enough and dense enough passage of a long
text, must be covered by matching k-grams. The templates are a fixed list, so their side of the join is broadcast
whatever the corpus. Votes are counted by text (its digest) instead of by doc_id: copies fold into one before any
shuffle, and no row can get what another one's text holds.

Base places, where the words of a known phrase stand one after another, are counted beside the method and keep their
labels.

Defined results: null and empty texts have no words and no labels; rows that share a doc_id (or lack one) are scanned
each for itself, rows with equal texts get equal labels; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.text import appended, flat, hashes, lower, mix, release, runs, slices, through

K = 3
GAP, CUT = 3, 10
SHORT_COVER, LONG_WORDS, DENSE = 0.8, 12, 0.8
SHORT_TEMPLATE = 16

#: Phrases of base places and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and license texts by label, as published; paragraphs that licenses share aren't among them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("boost", "any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

BASE = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
]


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, A-Z in lower case, and each text's offsets in them."""
    data, offsets = flat(col)
    data = lower(data)
    starts, ends = runs(_WORD[data], offsets)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets)


def rolled(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, none across texts, and the word that each begins with."""
    n = max(0, len(h) - k + 1)
    g = h[:n].copy()
    for i in range(1, k):
        g = mix(g) + h[i : i + n]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.flatnonzero(doc[:n] == doc[k - 1 :]) if n else np.zeros(0, np.int64)
    return mix(g[place]), place


def _hashes_of(text: str) -> np.ndarray:
    return word_hashes(pa.array([text]))[0]


def base(documents: DataFrame, keep: list[str]) -> DataFrame:
    """documents[keep] with the counts and labels of base places."""
    phrases = [(_hashes_of(p), label) for p, label in PHRASES]

    def work(cols: list[pa.Array]) -> list:
        h, at = word_hashes(cols[0])
        n = len(at) - 1
        doc = np.repeat(np.arange(n), np.diff(at))
        count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        for words, label in phrases:
            k, m = len(words), max(0, len(h) - len(words) + 1)
            hit = np.ones(m, bool)
            for i, w in enumerate(words):
                hit &= h[i : i + m] == w
            hit &= doc[:m] == doc[k - 1 :] if m else False
            place = np.flatnonzero(hit)
            own = doc[place]
            np.add.at(count, own, 1)
            np.minimum.at(first, own, place - at[own])
            np.maximum.at(last, own, place - at[own])
            for d in np.unique(own).tolist():
                labels[d].add(label)
        none = count == 0
        return [np.diff(at), count, pa.array(first, mask=none), pa.array(last, mask=none), [",".join(sorted(x)) for x in labels]]

    return appended(documents, ["text"], BASE, work, keep)


def keyed(documents: DataFrame) -> DataFrame:
    """documents with `key`, the digest of the text (null without one)."""
    return documents.withColumn("key", F.unhex(F.md5("text")))


def places(texts: DataFrame, k: int = K) -> DataFrame:
    """key, place and gram: every rolling k-gram of every text of texts (key, text)."""
    schema = T.StructType([texts.schema["key"], T.StructField("place", T.IntegerType()), T.StructField("gram", T.LongType())])

    def run(batches):
        for batch in batches:
            for start, size in slices(batch, 1):
                part = batch.slice(start, size)
                h, at = word_hashes(part.column(1))
                g, place = rolled(h, at, k)
                doc = np.searchsorted(at, place, "right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array((place - at[doc]).astype(np.int32)), pa.array(g.view(np.int64))], names=["key", "place", "gram"])
        release()

    return through(texts.select("key", "text"), run, schema)


def template_places(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """gram, template and t_place: where the templates hold each k-gram."""
    rows = []
    for i, (_, text) in enumerate(templates):
        h = _hashes_of(text)
        g, place = rolled(h, np.array([0, len(h)]), k)
        rows += [(int(x), i, int(p)) for x, p in zip(g.view(np.int64), place, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, t_place int")


def spans(texts: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans of texts (key, text): key, template, label, start and end (words, end exclusive), covered (template words), cover, votes."""
    spark = texts.sparkSession
    hits = places(texts.where("text is not null"), k).join(F.broadcast(template_places(spark, templates, k)), "gram")
    own = ["key", "template"]
    diagonals = hits.groupBy(*own, (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.collect_set("t_place").alias("t_places"))
    by = Window.partitionBy(*own).orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > GAP, F.lit(True)).cast("int")
    merged = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    votes = merged.select(*own, "span", "diagonal", F.explode("t_places").alias("t_place")).withColumn("place", F.col("diagonal") + F.col("t_place"))
    along = Window.partitionBy(*own, "span").orderBy("place", "t_place")
    cut = F.coalesce(F.col("place") - F.lag("place").over(along) >= k + CUT, F.lit(True)).cast("int")
    pieces = votes.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # a template's words that any k-gram covers; at most as many as the template has
    found = pieces.groupBy(*own, "span", "piece").agg(F.min("place").alias("start"), (F.max("place") + k).alias("end"), F.count(F.lit(1)).alias("votes"), F.collect_set("t_place").alias("t_places"))
    words = F.array_distinct(F.flatten(F.transform("t_places", lambda t: F.sequence(t, t + (k - 1)))))
    found = found.withColumn("covered", F.size(words)).withColumn("reach", F.array_max("t_places") - F.array_min("t_places") + k)
    about = spark.createDataFrame([(i, label, len(_hashes_of(text))) for i, (label, text) in enumerate(templates)], "template int, label string, length int")
    found = found.join(F.broadcast(about), "template").withColumn("cover", F.col("covered") / F.col("length"))
    dense = F.col("covered") >= DENSE * F.greatest("reach", F.col("end") - F.col("start"))
    short = (F.col("length") <= SHORT_TEMPLATE) & (F.col("cover") >= SHORT_COVER)
    long = (F.col("length") > SHORT_TEMPLATE) & (F.col("covered") >= LONG_WORDS)
    return found.where(dense & (short | long)).select("key", "template", "label", "start", "end", "covered", "cover", "votes")


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id with the base counts, labels (base and verified ones, sorted) and score (the best cover; 0.5 at least with a base place)."""
    documents = keyed(documents.select("doc_id", "text"))
    own = spans(documents).groupBy(F.col("key").alias("of")).agg(F.collect_set("label").alias("found"), F.max("cover").alias("best"))
    b = base(documents, ["doc_id", "key"])
    out = b.join(own, b["key"] == own["of"], "left")
    nothing = F.array().cast("array<string>")
    known = F.when(F.col("base_labels") == "", nothing).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.array_sort(F.array_union(known, F.coalesce("found", nothing))), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", *(f.name for f in BASE), labels.alias("labels"), score.alias("score"))
