import math
import re

import pytest
from pyspark.sql import functions as F

from netloom.llm import licences as L

PROSE = "In the spring the garden club met again and the members talked about the weather, the new fence, the price of seed and who would water the beds in July while others were away"
#: Wordings that no template has, each with what it grants.
HELD_OUT = [
    ("mit", "This tool is released under the MIT License."),
    ("mit", "The code in this repository is released under the terms of the MIT license, see the file LICENSE for details."),
    ("apache", "licensed under the APACHE license, version 2.0"),
    ("apache", "Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this product except in compliance with the License. A copy of the License is at the web site."),
    ("gpl", "This work is licensed under GNU General Public License version 3"),
    ("gpl", "This file is free software; you can redistribute it or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 or any later version of the license."),
    ("lgpl", "It is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("bsd", "Redistribution and use of this work in source and binary forms, with or without changes, are permitted provided that these following conditions are met"),
    ("bsd", "1. Redistributions of source code must retain the copyright notice above, this list of conditions and the disclaimer."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "The photographs are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All Rights Reserved"),
]
NONE = [
    "The driver had his licence taken away on public roads last week.", "with kind permission of the author we print a letter from 2004", PROSE + ", and a licence for the sale of plants was read out. " + PROSE,
    PROSE + ". All the seats by the pond were reserved, and rights of way were drawn with permission of the town. " + PROSE, "Copyright was a matter of dispute between the two houses.", "The license plate of the car was from another state.",
]
FULL = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in\nthe Software without restriction, including without limitation the rights to\nuse, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of\nthe Software, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = [(i, f"First line {i}.\n\n{line}\n\nlast line") for i, (_, line) in enumerate(HELD_OUT)]
    docs += [(100 + i, f"First line {i}.\n{line}\nlast line") for i, line in enumerate(NONE)]
    docs += [(200 + i, f"plain text number {i} of the version is here\nand more words {i * 7} by permission of the members {i}") for i in range(60)]
    docs += [(300, None), (301, ""), (302, "x " * 20000 + "\n\nReleased under the MIT License.\n\n" + "All rights reserved.\n\n" * 3), (303, "a"), (303, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (None, "b")]
    docs += [(400 + i, f"{PROSE}.\n{text}\n{PROSE}.") for i, text in enumerate(FULL.values())]
    docs += [(500, f"{PROSE}. The planner is released under the MIT License. {PROSE}.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' as line", "1 as window", "text as words", "2 as n")
    return {r["doc_id"]: r for r in L.scan(frame).collect()}


def test_recall_on_held_out_wording(found):
    got = [found[i]["families"].split(",")[0] == family for i, (family, _) in enumerate(HELD_OUT)]
    assert sum(got) >= 0.8 * len(got), [x for x, ok in zip(HELD_OUT, got, strict=True) if not ok]


def test_prose_with_the_same_terms(found):
    assert [found[100 + i]["families"] for i in range(len(NONE))] == [""] * len(NONE)
    assert all(not found[200 + i]["families"] for i in range(60))


def test_wrapped_paragraphs_within_prose(found):
    assert [found[400 + i]["families"] for i in range(len(FULL))] == list(FULL) and found[500]["families"] == "mit"


def test_edges(found):
    assert (found[300]["n_candidates"], found[301]["n_licences"], found[301]["best"]) == (0, 0, None)
    assert (found[302]["families"], found[302]["n_licences"]) == ("mit,proprietary", 4)
    assert found[303]["families"] == "cc-by-nc" and found[None]["families"] == "mit" and len(found) == len(HELD_OUT) + len(NONE) + 60 + 5 + len(FULL) + 1


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_grams(text):
    words = [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split(" ") if w]
    return words, list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def test_scores_and_likeness_against_plain_sums(spark):
    lines = [line for _, line in HELD_OUT] + NONE[:2] + ["nothing at all", ""]
    rows = spark.createDataFrame([(str(i), plain_grams(t)[1]) for i, t in enumerate(lines)], "key string, grams array<string>")
    weights, families, intercepts = L.train(spark, rows.limit(0))
    table = {r["gram"]: r["w"] for r in weights.collect()}
    got = {r["key"]: r for r in L.scored(rows, weights, families, intercepts).collect()}
    for i, t in enumerate(lines):
        z = [b + sum(table[g][k] for g in plain_grams(t)[1] if g in table) for k, b in enumerate(intercepts)]
        best = max(range(len(z) - 1), key=lambda k: z[k])
        p = math.exp(z[best] - max(z)) / sum(math.exp(v - max(z)) for v in z)
        assert got[str(i)]["family"] == families[best] and abs(got[str(i)]["p"] - p) < 1e-9
    templates = [(f, plain_grams(t)[1]) for f, ts in L.TEMPLATES.items() for t in ts]
    have = {g: sum(g in own for _, own in templates) for _, own in templates for g in own}
    like = {(r["key"], r["family"]): r["like"] for r in L.likeness(rows, L.index(spark)).collect()}
    for i, t in enumerate(lines):
        mine = set(plain_grams(t)[1])
        for family in L.TEMPLATES:
            want = max(sum(1 / have[g] for g in own if g in mine) / sum(1 / have[g] for g in own) for f, own in templates if f == family)
            assert abs(like.get((str(i), family), 0) - want) < 1e-9


def test_windows_hold_every_stretch_around_a_key(spark):
    text = " ".join(f"w{i}" for i in range(300))
    for at in (0, 3, 57, 150, 296):
        words = text.split()
        words[at : at + 1] = ["released", "under", "this", "license"]
        rows = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        cut = [r["window"] for r in L.windows(L.paragraphs(rows)).collect()]
        wanted = words[max(0, at - 4) : at + 8]
        assert any(wanted == w[k : k + len(wanted)] for w in cut for k in range(len(w)))
        assert all("license" in w for w in cut) and len(cut) <= 12


def test_every_template_has_a_key(spark):
    assert L._templates(spark).where(~F.exists("words", L._key)).count() == 0


def test_anchors_leave_too_little_of_a_template_to_confirm_it(spark):
    words, templates = set(L.anchors()), [plain_grams(t)[1] for ts in L.TEMPLATES.values() for t in ts]
    have = {g: sum(g in own for own in templates) for own in templates for g in own}
    for own in templates:
        left = [g for g in own if words.isdisjoint(g.split(" "))]
        assert sum(1 / have[g] for g in left) < L.CONFIRM * sum(1 / have[g] for g in own)


def test_licences_without_a_key_term(spark):
    texts = [
        "This is free and unencumbered software released into the open. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        f"All rights kept. {PROSE}. {PROSE}. {PROSE}. Distributed under the Boost Software Licence, Version 1.0. {PROSE}.".replace("Licence", "Lizence"),
        "These tools were distributed by a software version of the same firm.",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, f"words number {i} by permission") for i in range(20)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert [found[i]["families"] for i in range(3)] == ["unlicense", "boost", ""] and [found[i]["n_candidates"] for i in range(3)] == [1, 1, 0]
