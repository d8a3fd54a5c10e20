import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from netloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WHOLE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "it's we'll 'tis", "x  y  z", "a\x1cb \x1c c", "\u0085 a \u0085",
    "日本語 の テスト", "🙂 🙂🙂  x", "<|endoftext|> a", "1234 56 7a", "!!! ...  ??", "é é ́", "tab\tx \t y", "word " * 5000, "a" * 3000, "\r\n \r\n a", "​ ​", "ß" * 50,
]


def expected(doc_id, text):
    ids = WHOLE.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def run(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as block", "text as word")
    one = sorted(tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)).collect())
    assert one == sorted(tuple(r) for r in bpe.digests(bpe.round_trip(frame, RANKS, public_tokenizers.PATTERN)).collect())
    return one


@pytest.mark.parametrize("block", [3, 10**9])
def test_as_the_library_encodes(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", block)
    r = random.Random(5)
    docs = list(enumerate(ODD))
    docs += [(i + 100, "".join(r.choices(["a", " ", "\n", "the", "'s", "é", "7", "!", " ", "日"], k=40))) for i in range(200)]
    docs += [(5, "a"), (5, "a"), (100, docs[30][1])]
    assert run(spark, docs) == sorted(expected(*d) for d in docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_rows_out_of_a_shuffle(spark):
    docs = [(i, f"w{i} of the {i}") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    out = bpe.digests(bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)).collect()
    assert sorted(tuple(r) for r in out) == sorted(expected(*d) for d in docs)


def test_squeeze():
    for n in (0, 1, 1000):
        x = np.arange(n, dtype=np.int32) * 77 - 3
        assert (bpe.unsqueeze(bpe.squeeze(x)) == x).all()


def test_decoding_joins_the_table(spark):
    frame = spark.createDataFrame([(1, [5, 5, 300]), (None, []), (2, None), (1, [0])], "doc_id long, ids array<int>")
    table = {rank: token for token, rank in bpe.read_ranks(RANKS).items()}
    out = sorted(((r["doc_id"], r["decoded"], r["ids"]) for r in bpe.decode(frame, RANKS).collect()), key=str)
    assert out == sorted([(1, table[5] * 2 + table[300], [5, 5, 300]), (None, b"", []), (2, b"", []), (1, table[0], [0])], key=str)
    assert "BroadcastHashJoin" in bpe.decode(frame, RANKS)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bad", [-1, 10**6])
def test_ids_outside_the_table(spark, bad):
    with pytest.raises(Exception, match="the table has 0 to"):
        bpe.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), RANKS).collect()


def test_null_ids_and_clashing_columns(spark):
    docs = [(None, "a b"), (None, "a b"), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as block", "text as codes", "3 as n")
    out = bpe.digests(bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(str(expected(*d)) for d in docs)
