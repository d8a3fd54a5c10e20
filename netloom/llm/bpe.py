"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Documents are read in blocks of bounded size. A block names each distinct pre-token once and keeps, for every
document, its pre-tokens in order as the block's own numbers: that is the exploded (word, position) relation with a
block's repeats already grouped, so a word that makes up a third of all text is one row a block. Words are dealt by
their bytes over the cluster, each distinct one is encoded once, its ids go back to the blocks that asked, and the
documents are put together by position.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import ship, tune, written

ship(__name__)

#: A block ends after so many words between spaces, or so many distinct ones.
BLOCK_WORDS, BLOCK_STRETCHES = 1_600_000, 240_000
#: Rows of a token-byte table.
MOST_TOKENS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of "base64 rank" lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Numbers(dict):
    """Strings by the order in which they were met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Numbers the pre-tokens of one block of documents.

    Text is cut at single spaces between other characters. No match of the pattern crosses the place before such a
    space, so the block's distinct stretches are split once, all at a time as they follow each other behind spaces; a
    document with other white space beside a space is split as a whole.
    """

    def __init__(self, pattern):
        self.find, self.known, self.words = pattern.findall, Numbers(), Numbers()
        self.ids, self.texts, self.parts, self.size = [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        _, *parts = text.split(" ")
        self.parts.append(np.fromiter(map(self.known.__getitem__, parts), np.int32, len(parts)))
        self.ids.append(doc_id)
        self.texts.append(text)
        self.size += 1 + len(parts)

    def full(self) -> bool:
        return self.size >= BLOCK_WORDS or len(self.known) >= BLOCK_STRETCHES

    def codes(self):
        """The numbers of each document's pre-tokens, in turn; ``words`` has them all when the last one is read."""
        sound = np.fromiter((p != "" and not p[0].isspace() and not p[-1].isspace() for p in self.known), bool, len(self.known))
        tokens = self.find(" " + " ".join([p for p, ok in zip(self.known, sound.tolist(), strict=True) if ok])) if sound.any() else []
        number = self.words.__getitem__
        flat = np.fromiter(map(number, tokens), np.int32, len(tokens))
        first = np.nonzero(np.fromiter((t[0] == " " for t in tokens), bool, len(tokens)))[0]
        if len(first) != sound.sum():
            raise ValueError("the pattern matches across a single space")
        start, size = np.zeros(len(sound), np.int64), np.full(len(sound), -1, np.int64)
        start[sound], size[sound] = first, np.diff(np.append(first, len(flat)))
        for text, at in zip(self.texts, self.parts, strict=True):
            head = text.partition(" ")[0]
            sizes = size[at]
            if len(at) and head and not head[-1].isspace() and sizes.min() >= 0:
                ends = np.cumsum(sizes)
                rest = flat[np.repeat(start[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
                yield np.concatenate([np.fromiter(map(number, self.find(head)), np.int32), rest])
            else:
                yield np.fromiter(map(number, self.find(text)), np.int32)


def squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _blocks(pattern: str, buckets: int | None):
    """Cuts a partition into blocks. With ``buckets`` it gives each block's distinct words, dealt by their bytes; else its documents."""

    def rows(names, types, *columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def words_of(at, block):
        import zstandard

        for _ in block.codes():
            pass
        squeezer, dealt = zstandard.ZstdCompressor(level=3), defaultdict(list)
        words = [w.encode() for w in block.words]
        for code, word in enumerate(words):
            dealt[zlib.crc32(word) % buckets].append(code)
        check = zlib.crc32(b"\xff".join(words))
        for own in batched(dealt.items(), 256):
            yield rows(
                ["block", "bucket", "check", "codes", "words"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()],
                [at] * len(own), [b for b, _ in own], [check] * len(own),
                [squeeze(np.diff(np.array(c, np.int32), prepend=0)) for _, c in own],
                [squeezer.compress(b"\xff".join([words[x] for x in c])) for _, c in own],
            )

    def documents_of(at, block):
        """The documents, and last a row with the words' checksum."""
        for own in batched(zip(block.ids, block.codes(), strict=True), 1000):
            yield documents(at, [i for i, _ in own], [squeeze(c) for _, c in own], None)
        yield documents(at, [None], [None], zlib.crc32(b"\xff".join([w.encode() for w in block.words])))

    def documents(at, ids, codes, check):
        return rows(["block", "doc_id", "check", "codes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], [at] * len(ids), ids, [check] * len(ids), codes)

    def cut(batches):
        import regex
        from pyspark import TaskContext

        compiled, at = regex.compile(pattern), TaskContext.get().partitionId() << 32
        give = words_of if buckets else documents_of
        block = Block(compiled)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, text or "")
                if block.full():
                    yield from give(at, block)
                    block, at = Block(compiled), at + 1
        yield from give(at, block)

    return cut


def _encoder(ranks_path: str, pattern: str):
    def encode(asked: pa.Table) -> pa.Table:
        import tiktoken
        import zstandard

        piece = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})._encode_single_piece
        unpack, known, ids, sizes = zstandard.ZstdDecompressor(), {}, [], []
        for packed in asked.column("words").to_pylist():
            out = []
            for word in unpack.decompress(packed).split(b"\xff"):
                found = known.get(word)
                if found is None:
                    found = known[word] = piece(word)
                out.append(found)
            ids.append(squeeze(np.fromiter(chain.from_iterable(out), np.int32)))
            sizes.append(squeeze(np.fromiter(map(len, out), np.int32, len(out))))
        return pa.table({"block": asked.column("block"), "check": asked.column("check"), "codes": asked.column("codes"), "ids": pa.array(ids, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    return encode


def _lists(parts: list[bytes], of) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int32, len(parts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32), of))


def _assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    checks = {x for t in (docs, words) for x in t.column("check").to_pylist() if x is not None}
    if len(checks) > 1:
        raise RuntimeError("the input gave other rows when it was read again; give a written table")
    ids = {}
    for codes, found, sizes in zip(*(words.column(c).to_pylist() for c in ("codes", "ids", "sizes")), strict=True):
        found, at = unsqueeze(found).tobytes(), 0
        for code, size in zip(np.cumsum(unsqueeze(codes)).tolist(), unsqueeze(sizes).tolist(), strict=True):
            ids[code] = found[at : at + 4 * size]
            at += 4 * size
    kept = [(d, c) for d, c in zip(docs.column("doc_id").to_pylist(), docs.column("codes").to_pylist(), strict=True) if c is not None]
    parts = [b"".join([ids[c] for c in unsqueeze(codes).tolist()]) for _, codes in kept]
    return pa.table({"doc_id": pa.array([d for d, _ in kept], pa.int64()), "ids": _lists(parts, pa.int32())})


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text: each match of ``pattern`` merged by the ranks, without special tokens.

    Null and empty texts have no ids. Repeated rows, those without an id too, come out as often as they went in; an empty
    table gives an empty one. Only doc_id and text are read. A very long text ends its block, and is held whole with its
    codes by one worker. The rank file is opened by its path on every worker: it comes with the installed package, or
    lies where all of them see it.
    The input is read twice and has to give the same rows in the same order, as files do; what comes out of a shuffle
    is written first.
    """
    return _encoded(docs, ranks_path, pattern).applyInArrow(_assemble, "doc_id long, ids array<int>")


def _encoded(docs: DataFrame, ranks_path: str, pattern: str):
    """Blocks of documents beside the ids of their words, to be put together."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs)
    buckets = max(4 * docs.rdd.getNumPartitions(), 64)
    asked = docs.mapInArrow(_blocks(pattern, buckets), "block long, bucket int, check long, codes binary, words binary")
    kind = "block long, check long, codes binary, ids binary, sizes binary"
    answered = asked.groupBy("bucket").applyInArrow(_encoder(ranks_path, pattern), kind)
    bodies = docs.mapInArrow(_blocks(pattern, None), "block long, doc_id long, check long, codes binary")
    return bodies.groupBy("block").cogroup(answered.groupBy("block"))


HEADS = "n long, id int, docs array<long>, sizes array<int>, codes binary"


def _heads(top: int):
    """Documents as a head (ids, lengths, codes of their tokens) and behind it a row for each distinct token, numbered ``n``."""
    kinds = {"n": pa.int64(), "id": pa.int32(), "docs": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary()}

    def ask(documents: pa.Table) -> pa.Table:
        lists = documents.column("ids").combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False)
        if len(values) and not 0 <= values.min() <= values.max() <= top:
            raise ValueError(f"ids run from {values.min()} to {values.max()}; the table has 0 to {top}")
        place = np.zeros(top + 1, np.int32)
        place[values] = 1
        distinct = np.nonzero(place)[0].astype(np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        sizes = lists.value_lengths().fill_null(0).to_pylist()
        head = [[0], [None], [documents.column("doc_id").to_pylist()], [sizes], [place[values].astype(np.int32).tobytes()]]
        rows = [np.arange(1, 1 + len(distinct)), distinct, *[pa.nulls(len(distinct), t) for t in [*kinds.values()][2:]]]
        return pa.concat_tables(pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(some, kinds.values(), strict=True)], names=[*kinds]) for some in (head, rows))

    return ask


def _answered(batches):
    """Puts the documents of each head together from the token rows behind it."""

    def documents(docs, sizes, codes, ids, tokens):
        if any(t is None for t in tokens):
            raise ValueError(f"the table has no token {ids[tokens.index(None)]}")
        codes = np.frombuffer(codes, np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
        places = codes.tolist()
        out = [b"".join([tokens[x] for x in places[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.array(ids, np.int32)[codes] if ids else codes, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    head, ids, tokens, due = None, [], [], 0
    for batch in batches:
        for n, id_, docs, sizes, codes, token in zip(*(batch.column(c).to_pylist() for c in ("n", "id", "docs", "sizes", "codes", "token")), strict=True):
            if n not in (due, 0) or (n == 0) != (id_ is None):
                raise RuntimeError("the join changed the order of its rows")
            due = n + 1
            if id_ is None:
                if head:
                    yield documents(*head, ids, tokens)
                head, ids, tokens = (docs, sizes, codes), [], []
            else:
                ids.append(id_)
                tokens.append(token)
    if head:
        yield documents(*head, ids, tokens)


def _joined(heads: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    spark = heads.sparkSession
    tokens = spark.createDataFrame(pa.table({"id": pa.array([*ranks.values()], pa.int32()), "token": pa.array([*ranks], pa.binary())}))
    return heads.join(F.broadcast(tokens), "id", "left").mapInArrow(_answered, "doc_id long, ids array<int>, decoded binary")


def _table(ranks_path: str) -> dict[bytes, int]:
    ranks = read_ranks(ranks_path)
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"a table of {len(ranks)} tokens is no vocabulary")
    return ranks


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for, as column ``decoded``.

    A batch of documents names each of its distinct ids once, these rows are joined with the token-byte table, and the
    documents are put together again behind the join. The table is the vocabulary, of MOST_TOKENS rows at most whatever
    the input's size, and so is broadcast: a streamed side keeps its order, which is checked. Null ids are no tokens; an
    id without a row in the table is an error.
    """
    ranks = _table(ranks_path)
    heads = _heads(max(ranks.values(), default=0))

    def ask(batches):
        for batch in batches:
            yield from heads(pa.Table.from_batches([batch])).to_batches()

    return _joined(encoded.select("doc_id", "ids").mapInArrow(ask, HEADS), ranks)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): decode(encode(docs)), the documents of a block asking for their tokens where they are put together."""
    ranks = _table(ranks_path)
    heads = _heads(max(ranks.values(), default=0))
    return _joined(_encoded(docs, ranks_path, pattern).applyInArrow(lambda d, words: heads(_assemble(d, words)), HEADS), ranks)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by single spaces and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
