import random
import time

import numpy as np
import pytest

from netloom.llm import toxicity as T

INSULTS = ["blockhead", "numpty", "scallywag"]


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choices(["ta", "ri", "mo", "len", "su", "ka", "ped"], k=r.randint(1, 4))) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            for w in r.sample(INSULTS, 2):
                words[r.randrange(40)] = w
        out.append((i, " ".join(words) + ".", toxic))
    return out


@pytest.fixture(scope="module")
def machine():
    data = rows(400, 1)
    return T.train([t for _, t, _ in data], [y for *_, y in data])


def plain_sentences(text):
    """Sentences as lists of words, by the definition, a character at a time."""
    out, text = [[""]], text.lower() + "\n"
    for c, after in zip(text, text[1:] + "\n", strict=True):
        end = c in "\n\r\v\f\u2028\u2029\u3002\uff01\uff1f" or (c in ".!?" and (after.isspace() or after in ".!?\u3002\uff01\uff1f"))
        if end:
            out.append([""])
        elif c.isspace():
            out[-1].append("")
        elif c.isalpha():
            out[-1][-1] += c
    found = []
    for sentence in out:
        words, run = [], []
        for w in [*filter(None, sentence), None]:
            if w is not None and len(w) == 1:
                run.append(w)
                continue
            words += ["".join(run)] if len(run) > 2 else run
            run = []
            words += [] if w is None else [w]
        words = [p for w in words for p in ([w] if len(w) <= T.LONGEST else [w[i : i + T.LONGEST // 2] for i in range(0, len(w), T.LONGEST // 2)])]
        if words:
            found.append(words)
    return found


def brute_kernel(words, weights):
    """The decision of a stretch by all subsequences of three characters."""
    code = lambda c: T.SPACE if c == " " else ord(c) - 96 if "a" <= c <= "z" else 28 + ord(c) % 36
    codes, total = [code(c) for c in " " + " ".join(words) + " "], 0.0
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            for k in range(j + 1, min(len(codes), i + T.SPAN)):
                total += T.DECAY ** (k - i + 1) * weights[(codes[i] * T.LETTERS + codes[j]) * T.LETTERS + codes[k]]
    return total / T.norm(np.array([len(codes) - 2]))[0]


def brute_score(text, machine):
    spans, at = [], 0
    for sentence in plain_sentences(text):
        for i in range(len(sentence)):
            for j in range(i + 1, min(len(sentence), i + T.WIDEST) + 1):
                spans.append((brute_kernel(sentence[i:j], machine.weights) + machine.bias, at + i, at + j))
        at += len(sentence)
    best, top = max(spans, default=(-np.inf, 0, 0)), [-np.inf, -np.inf]
    top[0] = best[0]
    top[1] = max((v for v, a, b in spans if (b <= best[1] or a >= best[2]) and v < best[0] - 1e-4), default=-np.inf)
    return 1 / (1 + np.exp(-(T.evidence(np.maximum([top], -T.CLIP)) @ machine.slopes)[0]))


ODD = ["", "...", "a", "Élan blockhead. Tari-mo?! nu3mpty", "n u m p t y you. b.l.o.c.k.head", "x y z\nw v", "日本語" * 20, "tari" * 20 + " numxpty", "　a b c d e f", "﻿한국 numpty!"]


def test_scores_against_all_stretches_and_subsequences(machine):
    texts = ODD + [" ".join(t.split()[:12]) for _, t, _ in rows(25, 9)]
    assert np.allclose(machine.scores(texts), [brute_score(t, machine) for t in texts], atol=1e-4)


def test_long_texts_in_parts(machine, monkeypatch):
    texts = [" ".join(t for _, t, _ in rows(40, 5)) + " the numptyy", "a" * 3000, "ta " * 2000]
    whole = machine.scores(texts)
    monkeypatch.setattr(T, "SLICE", 700)
    assert np.allclose(machine.scores(texts), whole, atol=0.02)


def test_many_words_take_linear_time(machine):
    began = time.perf_counter()
    machine.scores(["日本 " * 20_000, "\n" * 20_000, "a " * 20_000])
    assert time.perf_counter() - began < 3


def test_an_insult_of_plain_words(spark):
    """Neighbours are in the kernel: neither word is toxic, the two together are."""
    r, data = random.Random(8), []
    for i in range(400):
        words = r.choices(["tari", "mo", "lensu", "kaped", "sumo", "river", "bones"], k=30)
        words = " ".join(words).replace("river bones", "river mo").split()
        if i % 4 == 0:
            words[7:7] = ["river", "bones"]
        data.append((i, " ".join(words), int(i % 4 == 0)))
    machine = T.train([t for _, t, _ in data[:300]], [y for *_, y in data[:300]])
    got = machine.scores([t for _, t, _ in data[300:]]) >= T.THRESHOLD
    truth = np.array([("river bones" in t) for _, t, _ in data[300:]])
    assert (got == truth).mean() > 0.9


def test_held_out_rows(spark, machine):
    data = rows(200, 2)
    odd = [(1000, None, 0), (1001, "", 0), (1002, "b.l.o.c.k.h.e.a.d tari numxpty", 1), (1003, "tari n u m p t y mo blockheadd", 1), (1004, "su scallxywag ka nuumpty " + "ta " * 20000, 1), (1005, "\n\t", 0)]
    frame = spark.createDataFrame([(*r, 0.5) for r in data + odd], "doc_id long, text string, toxic int, score double")
    out = {r["doc_id"]: r for r in T.score(frame, machine).collect()}
    wrong = [i for i, _, y in data + odd if out[i]["predicted"] != y]
    assert len(wrong) <= 4 and not set(wrong) & {1000, 1001, 1002, 1003, 1005}, [(i, out[i]['score']) for i in wrong]
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_fit_leaves_held_out_rows_alone(spark, machine):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows(60, 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows(60, 3)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    assert T.fit(docs, labels) is not None
    assert T.fit(docs, labels.where(T.held_out())) is None
    assert T.fit(docs, labels.limit(0)) is None
    assert [r["score"] for r in T.score(docs.limit(2), None).collect()] == [0.0, 0.0]
    assert T.score(docs.limit(0), machine).count() == 0


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    data = rows(60, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(0, "copy")] * 500 + [(4, None), (4, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as size", "2 as total")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(T, "train", lambda texts, toxic: seen.append((texts, toxic)))
    monkeypatch.setattr(T, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(T, "CLEAN_SAMPLE", 5)
    T.fit(docs, labels)
    texts, toxic = seen[0]
    assert toxic.count(0) <= 5 and all(sum(len(t) for t, y in zip(texts, toxic, strict=True) if y == f) <= 4000 for f in (0, 1)) and 1 in toxic


def test_null_ids_and_clashing_columns(spark, machine):
    frame = spark.createDataFrame([(None, "a numpty b", "p"), (None, None, "q"), (1, "numpty", "r"), (1, "numpty", "r")], "doc_id long, text string, predicted string").selectExpr("*", "1 as size", "text as words")
    out = T.score(frame, machine).withColumn("held_out", T.held_out()).collect()
    assert len(out) == 4 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1


def test_the_driver_does_not_train(spark, monkeypatch):
    """Its memory has no room for it: in the driver's process train() leaves no more than the machine."""
    texts, toxic = [t for _, t, _ in rows(60, 3)], [y for *_, y in rows(60, 3)]
    here, pids = T.trained(texts, toxic), []
    real = T.words_of
    monkeypatch.setattr(T, "words_of", lambda texts: pids.append(1) or real(texts))
    there = T.train(texts, toxic)
    assert not pids and np.allclose(there.weights, here.weights, atol=1e-4) and abs(there.bias - here.bias) < 1e-3
