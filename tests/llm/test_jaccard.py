import random
import re

import pytest

from netloom.llm import jaccard


def brute(docs, width, threshold):
    sets = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                parent[b] = a
    return sorted((docs[i][0], len(sets[i]), docs[find(i)][0]) for i in range(len(docs)))


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 3)))
    bases = [[word() for _ in range(r.choice([2, 9, 30, 80, 200]))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = list(r.choice(bases)) if r.random() < 0.8 else [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            if words:
                words[r.randrange(len(words))] = word()
        docs.append((i * 7 % n + 1000, r.choice([" ", "  \n"]).join(words)))
    return docs + [(1, None), (2, ""), (3, " \n"), (4, "Solo"), (5, "solo"), (6, "sol é"), (7, "a b " * 3000), (8, "A b " * 3001)]


@pytest.mark.parametrize(("seed", "width", "threshold"), [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_against_all_pairs(spark, seed, width, threshold):
    docs = made(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as rep", "1 as n", "'x' as key").repartition(3)
    out = jaccard.similar(frame, width, threshold)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == brute(docs, width, threshold)


def test_large_groups_are_met_chunk_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "STAR", 4)
    docs = made(9, 90)
    out = jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string"), 2, 60)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == brute(docs, 2, 60)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (9, "x")]
    out = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(3, 3), (7, 3), (7, 3), (9, 9)]
