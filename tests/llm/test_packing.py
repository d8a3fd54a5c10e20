import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netloom.llm.packing import Tightest, Words, pack_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string"


TOKENIZER = Tokenizer.from_file(PATH)


def reference_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for doc_id, text in docs:
        ids = reference_ids(text)
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == capacity * r["piece"] and 1 <= r["length"] <= capacity
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_pieces_and_bins(spark, capacity):
    odd = [None, "", "   \n\t", "Hello, World.", "don't I'LL It's. x.. 3.14 A1.", "naïve É. Ως ΣΑΣ. İ ﬁ", "a b\x1cc d", "<|endoftext|> <|startoftext|>x", "é ́a", "日本語。テスト.", "🙂🙂. !!", "x" * 5000, "the of and " * 3000]
    docs = [(i, t) for i, t in enumerate(odd)]
    docs += [(i + 100, " ".join(random.Random(i).choices(["the", "Of", "nd,", "ea.", "lich!"], k=i % 90))) for i in range(300)]
    rows = pack_documents(spark.createDataFrame([(a, b, "x") for a, b in docs], SCHEMA), capacity=capacity).collect()
    check(rows, docs, capacity)


def test_empty_table_and_repeated_rows(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = pack_documents(spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (None, "c", "")], SCHEMA)).collect()
    assert sorted((r["length"], r["offset"]) for r in rows) and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_words_as_the_tokenizer_gives_them():
    r = random.Random(3)
    letters = [*"aZéÉßΣσİıǅ.,!'’#<|>_-07²Ⅷ½٣日本ªº\u0301\u1e9b\ufb01\x7f\x01\xa0\u200b🙂", "<|endoftext|>", "<|startoftext|>", "<|end"]
    words = Words(PATH)
    for _ in range(20000):
        text = "".join(r.choices(letters, k=r.randint(1, 7)))
        assert words[text.encode()] == b"".join(x.to_bytes(4, "little") for x in reference_ids(text)[:-1]), text


def brute(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= length]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.choice([1, 50, 400]))]
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    moves = plan(counts, capacity)
    used = defaultdict(list)
    for length, own in moves.items():
        for k, (rank, first, per, at) in enumerate(own):
            end = own[k + 1][0] if k + 1 < len(own) else counts[length]
            for i in range(end - rank):
                used[first + i // per].append((at + i % per * length, length))
    left = []
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        left.append(capacity - at)
    assert sorted(left) == brute(lengths, capacity)


def test_tightest():
    tree = Tightest(10)
    for x in (3, 7, 10):
        tree.add(x, 1)
    assert [tree.find(n) for n in range(11)] == [3, 3, 3, 3, 7, 7, 7, 7, 10, 10, 10]
    tree.add(10, -1)
    assert tree.find(8) is None
