"""Licence paragraphs by a trained classifier, in DataFrame functions and the JVM's own learner.

A paragraph is what stands between blank lines. Windows of its words around KEYS, the terms of which every template has
one, are what is classified, and so are all others that a template could confirm, which have one of anchors(): each
distinct window becomes its words and word pairs, as far as the templates have them, and a sparse multinomial logistic
regression over these gives a family or the unknown class. The bar for a family is calibrated on all windows around KEYS
that are like no template. A family stands when its template confirms it: the window has enough of the template's words
and pairs, those that few templates have counting most.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import SPACE, written

# Paragraphs of common licences and notices, by family, and prose about licences that grants none.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license, see LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC license.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site.",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "boost": ("Distributed under the Boost Software License, Version 1.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain under CC0.",),
    "proprietary": (
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
PROSE = (
    "The driver has no licence to drive on public roads in winter.", "With permission of the author we print a general letter from last year.", "She asked for permission to leave the hall early.",
    "Copyright law was debated in parliament for three days.", "A fishing license costs twenty dollars in this state.", "The seats by the pond were reserved and the rights of way were drawn.",
    "The town council granted a license for the sale of plants.", "Dogs are permitted on the beach after six.", "Proprietary methods of the factory were kept from visitors.", "He bought a reserved ticket for the last train.",
    "The teacher gave permission for the trip.", "Mozilla and other makers of browsers met in the city.", "A warranty of two years comes with the machine.", "The domain of the function is the set of real numbers.",
    "The pilot lost her licence after the hearing.", "Creative people came to the commons every summer.", "The software was free for students and the public library had copies.", "The public domain of the castle was open on Sundays.",
    "Confidential letters were found in the general's desk.", "The Apache people lived in the south west.",
)
KEYS = ("licen", "copyright", "reserved", "redistribut", "permi", "proprietary", "domain", "mozilla", "spdx", "prohibited", "warrant")
#: Words of everyday prose, by which a template is looked for last.
COMMON = frozenset(
    "a above all along an and any are as at be but by can do either else for found free from general has have if in into is it its later made may met mit more must name names neither no nor not "
    "of on one or other out part see such than that the their this to under use version was were with without work you your 0 1 2 3 4".split()
)
#: Words of a window and words between windows: a stretch of up to three quarters of a width lies within one of its windows.
WINDOWS = ((16, 4), (48, 12), (112, 28))
#: Windows of the corpus, at most, that train the unknown class.
NEGATIVES = 4000
#: Share of a template's weight that confirms a family, and share up to which a window is like no template.
CONFIRM, UNLIKE = 0.6, 0.3
#: Share of the windows that are like no template that may pass the bar.
FALSE_RATE = 0.005


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), f"[{SPACE}]+"), "")


def ngrams_of(words: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.contains(" "))))


def _key(text: Column) -> Column:
    found = text.contains(KEYS[0])
    for word in KEYS[1:]:
        found = found | text.contains(word)
    return found


@cache
def anchors() -> tuple[str, ...]:
    """Words one of which is in whatever a template confirms: without them, and the pairs that they are in, less than CONFIRM of each template is left."""
    grams = []
    for line in (line for lines in TEMPLATES.values() for line in lines):
        words = re.sub(r"[^a-z0-9]+", " ", line.lower()).split()
        grams.append(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))
    have: dict[str, int] = {}
    for own in grams:
        for g in own:
            have[g] = have.get(g, 0) + 1
    found: set[str] = set()
    for own in grams:
        total = sum(1 / have[g] for g in own)
        for word in sorted((g for g in own if " " not in g), key=lambda w: (w not in found, w in COMMON, have[w], w)):
            left = sum(1 / have[g] for g in own if found.isdisjoint(g.split()))
            if left < (CONFIRM - 1e-6) * total:
                break
            found.add(word)
    return tuple(sorted(found))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, place, words) of every paragraph that has one of KEYS or of anchors(); words of wrapped lines follow each other."""
    some = F.array(*map(F.lit, anchors()))
    has = lambda text: _key(F.lower(text)) | F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), some)
    parts = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("place", "paragraph")).where(has(F.col("paragraph")))
    return parts.select("doc_id", "place", words_of(F.col("paragraph")).alias("words"))


def windows(found: DataFrame, around: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, place, window) of the windows around each of KEYS and each word of ``around``: all words of a paragraph no longer than a width, else stretches from a grid."""
    n = F.size("words")
    mark = lambda w: _key(w) | w.isin(*around) if around else _key(w)
    at = F.filter(F.transform("words", lambda w, i: F.when(mark(w), i)), lambda i: i.isNotNull())
    starts = []
    for width, step in WINDOWS:
        grid = lambda k, width=width, step=step: F.transform("at", lambda i: F.struct(F.greatest(F.floor(i / step) * step - k * step, F.lit(0)).cast("int").alias("start"), F.lit(width).alias("width")))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(width).alias("width")))
        starts.append(F.when(n <= width, F.when(F.size("at") > 0, whole).otherwise(F.slice(whole, 1, 0))).otherwise(F.concat(*(grid(k) for k in range(width // step)))))
    cuts = found.withColumn("at", at).select("doc_id", "place", "words", F.explode(F.array_distinct(F.concat(*starts))).alias("w"))
    return cuts.select("doc_id", "place", F.slice("words", F.col("w.start") + 1, F.col("w.width")).alias("window"))


def _templates(spark: SparkSession) -> DataFrame:
    """(template, family, words): a row a paragraph."""
    rows = [F.struct(F.lit(family).alias("family"), F.lit(line).alias("line")) for family, lines in TEMPLATES.items() for line in lines]
    return spark.range(1).select(F.posexplode(F.array(*rows)).alias("template", "r")).select("template", "r.family", words_of(F.col("r.line")).alias("words"))


def index(spark: SparkSession) -> DataFrame:
    """(gram, template, family, share): what part of each template's weight a word or pair is. A gram weighs one over the templates that have it."""
    grams = _templates(spark).select("template", "family", F.explode(ngrams_of(F.col("words"))).alias("gram"))
    weighed = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram").withColumn("weight", 1.0 / F.col("n"))
    total = weighed.groupBy("template").agg(F.sum("weight").alias("total"))
    return weighed.join(total, "template").select("gram", "template", "family", (F.col("weight") / F.col("total")).alias("share"))


def likeness(some: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, family, like): the largest share of one of a family's templates that a window (key, grams) has; families without any are left out."""
    met = some.select("key", F.explode("grams").alias("gram")).join(F.broadcast(templates), "gram").groupBy("key", "template", "family").agg(F.sum("share").alias("like"))
    return met.groupBy("key", "family").agg(F.max("like").alias("like"))


def train(spark: SparkSession, unlike: DataFrame) -> tuple[DataFrame, list[str], list[float]]:
    """(weights (gram, w: one number a family, the unknown one last), families, intercepts) of the classifier.

    Positives are the templates whole, with every seventh or ninth word left out, and by their first and second halves;
    the unknown class is PROSE and ``unlike`` (grams), windows of the corpus, NEGATIVES at most.
    """
    families = [*TEMPLATES, "unknown"]
    words, skip = F.col("words"), F.col("skip")
    some = _templates(spark).withColumn("skip", F.explode(F.array(*(F.lit(k) for k in (0, 7, 9, -1, -2)))))
    half = (F.size(words) / 2).cast("int")
    left_out = F.filter(words, lambda w, i: (skip <= 0) | ((i + 1) % F.greatest(skip, F.lit(1)) != 0))
    part = F.when(skip == -1, F.slice(words, F.lit(1), F.greatest(half, F.lit(4)))).when(skip == -2, F.slice(words, F.least(half, F.greatest(F.size(words) - 3, F.lit(0))) + 1, F.size(words))).otherwise(left_out)
    label = F.lit(len(TEMPLATES))
    for k, family in enumerate(TEMPLATES):
        label = F.when(F.col("family") == family, F.lit(k)).otherwise(label)
    positive = some.select(ngrams_of(part).alias("grams"), label.cast("double").alias("label"), F.lit(8.0).alias("weight"))
    prose = spark.range(1).select(F.explode(F.array(*map(F.lit, PROSE))).alias("line")).select(ngrams_of(words_of(F.col("line"))).alias("grams"), F.lit(20.0).alias("weight"))
    none = prose.unionByName(unlike.select("grams", F.lit(1.0).alias("weight"))).withColumn("label", F.lit(float(len(TEMPLATES))))
    rows = written(positive.unionByName(none).coalesce(2))
    bags = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 14).fit(positive)  # the templates' grams alone
    model = LogisticRegression(regParam=1e-3, elasticNetParam=0.3, family="multinomial", weightCol="weight", maxIter=40).fit(bags.transform(rows))
    matrix = model.coefficientMatrix.toArray()
    kept = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(bags.vocabulary) if matrix[:, i].any()]  # bounded by the templates
    table = F.array(*(F.struct(F.lit(g).alias("gram"), F.array(*map(F.lit, w)).alias("w")) for g, w in kept))
    return spark.range(1).select(F.explode(table).alias("r")).select("r.*"), families, [float(x) for x in model.interceptVector.toArray()]


def scored(some: DataFrame, weights: DataFrame, families: list[str], intercepts: list[float]) -> DataFrame:
    """(key, family, p): the likeliest family of each window (key, grams) but the unknown one, and its probability beside that one's."""
    k = len(families)
    grams = some.select("key", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    sums = grams.groupBy("key").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)))
    z = F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) + intercepts[i] for i in range(k)))
    judged = some.select("key").join(sums, "key", "left").withColumn("z", z).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    best = F.array_max(F.slice("z", 1, k - 1))
    family = F.get(F.array(*map(F.lit, families)), F.array_position(F.slice("z", 1, k - 1), best).cast("int") - 1)
    return judged.select("key", family.alias("family"), (F.exp(best - F.col("top")) / total).alias("p"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_licences, families (sorted, joined by commas) and best (the highest probability) of every document.

    Candidates are paragraphs with one of KEYS or with a window that a template confirms; licences are those in which a family is predicted and confirmed, and a
    paragraph may have several. Documents without candidates have none, and null as best. Null and empty texts have no
    paragraphs, a very long one as many windows as terms. Rows that repeat an id are one document, and so are those
    without one. Of equally likely families the first by TEMPLATES is meant. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    cut = windows(paragraphs(docs), anchors()).withColumn("key", F.sha2(F.array_join("window", " "), 256))
    cut = written(cut.groupBy("doc_id", "place", "key").agg(F.first("window").alias("window"), F.count("*").alias("n")))
    every = written(cut.groupBy("key").agg(F.first("window").alias("window")).select("key", F.exists("window", _key).alias("keyed"), ngrams_of(F.col("window")).alias("grams")))
    templates = index(spark)
    like = written(likeness(every, templates))
    # a window without any of KEYS counts where a template confirms it, and can name nothing elsewhere
    sound = like.where(F.col("like") >= CONFIRM).select("key").distinct()
    some = written(every.where("keyed").unionByName(every.where("not keyed").join(sound, "key", "left_semi")))
    unlike = some.join(like.where(F.col("like") > UNLIKE).select("key").distinct(), "key", "left_anti")
    n = unlike.count()
    share = min(1.0, NEGATIVES / 2 / max(n, 1))
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    weights, families, intercepts = train(spark, unlike.where(hashed < int(share * (1 << 20))).select("grams").limit(NEGATIVES))
    judged = written(scored(some, weights, families, intercepts))
    # calibrated on what it has to refuse: all windows around KEYS that are like no template
    high = judged.join(unlike.select("key"), "key", "left_semi").agg(F.percentile_approx("p", F.lit(1 - FALSE_RATE), F.lit(10_000)).alias("p")).first()["p"]
    bar = max(0.5, float(high or 0))
    sure = judged.where(F.col("p") > bar).join(like.where(F.col("like") >= CONFIRM), ["key", "family"]).select("key", "family")
    named = cut.select("doc_id", "place", "key").join(judged.select("key", "p"), "key").join(sure, "key", "left")
    parts = named.groupBy("doc_id", "place").agg(F.collect_set("family").alias("names"), F.max("p").alias("p"))
    by_doc = parts.groupBy("doc_id").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.size("names") > 0).alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))), ",").alias("families"), F.round(F.max("p"), 6).alias("best"),
    )
    ids = docs.select("doc_id").distinct()
    out = ids.join(by_doc, ids["doc_id"].eqNullSafe(by_doc["doc_id"]), "left").drop(by_doc["doc_id"])
    return out.select(
        "doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.lit("")).alias("families"), "best",
    )
