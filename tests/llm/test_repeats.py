import hashlib
import random

import numpy as np
import pytest

from netloom.llm import repeats

LENGTH = 50


def brute(docs, length):
    first = {}
    for i, text in docs:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            first[s] = min(first.get(s, 1 << 62), (1 << 62) - 1 if i is None else i)
    out = []
    for i, text in docs:
        data, gone = (text or "").encode(), set()
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < (1 << 62 if i is None else i):
                gone.update(range(k, k + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        out.append((i, len(data), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abé日 ", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(5)]
    docs = []
    for i in range(80):
        text = " ".join(r.choice(passages) if r.random() < 0.3 else word() for _ in range(r.choice([0, 3, 20, 60])))
        docs.append((i * 7 % 80 + 10, text))
    docs += [(i + 200, docs[r.randrange(80)][1]) for i in range(20)]
    docs += [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 300 + "y"), (6, "ab" * 200), (7, "ba" * 200), (8, "z\0" * 60), (9, "z\0" * 61), (300, "long " * 9000), (301, "long " * 9001), (4, "x" * 60), (None, "x" * 70)]
    return docs


def run(spark, docs, parts=3):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "1 as block", "text", "'k' as kept").coalesce(parts)
    return sorted((tuple(x) for x in repeats.digests(repeats.find_repeats(frame)).collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 12 << 20), (2, 2000), (3, 100)])
def test_against_all_strings(spark, monkeypatch, seed, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    docs = made(seed)
    assert run(spark, docs) == brute(docs, LENGTH)


def test_runs_cut_by_slices_with_rows_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 97)
    docs = made(7)
    random.Random(1).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = sorted((tuple(x) for x in repeats.digests(repeats.find_repeats(frame)).collect()), key=str)
    assert out == brute(docs, LENGTH)


def test_rows_out_of_a_shuffle_and_empty_table(spark):
    docs = made(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    out = sorted((tuple(x) for x in repeats.digests(repeats.find_repeats(frame)).collect()), key=str)
    assert out == brute(docs, LENGTH)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(40))
def test_smallest_owner(seed):
    r = random.Random(seed)
    length = r.choice([32, 50])
    letters = r.choice([b"a", b"ab", b"abc\x00\xfe"])
    base = bytes(r.choices(letters, k=400))
    runs = list({base[(a := r.randrange(300)) : a + length + r.randint(0, 40)] if r.random() < 0.7 else bytes(r.choices(letters, k=length + r.randint(0, 9))) for _ in range(30)})
    owners = np.array([r.randrange(100) for _ in runs])
    first = {}
    for run_, o in zip(runs, owners.tolist(), strict=True):
        for k in range(len(run_) - length + 1):
            s = run_[k : k + length]
            first[s] = min(first.get(s, 1000), o)
    got = repeats.smallest_owner(runs, owners, length)
    for run_, g in zip(runs, got, strict=True):
        assert g.tolist() == [first[run_[k : k + length]] for k in range(len(run_) - length + 1)]


def test_least():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for w in (1, 2, 3, 8, 27):
        assert (repeats.least(x, w) == [x[i : i + w].min() for i in range(200 - w + 1)]).all()
