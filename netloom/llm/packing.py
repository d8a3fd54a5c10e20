"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing looks only at lengths, and there are at most ``capacity`` of them. The plan is therefore made
from the histogram of lengths: documents of one length and open bins of one remaining capacity are handled as runs,
and a segment tree over remaining capacities finds the tightest run in logarithmic time. The plan's size depends on
the capacity alone, never on the number of documents; ranks within a length then say where each piece goes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import partitions, ship, tune, written

ship(__name__)

CAPACITY = 2048
#: Distinct words that one worker remembers; beyond it the memory starts anew, results are the same.
REMEMBERED = 400_000


#: A vocabulary's character for each byte: itself where it can be seen, else the next free one from 256 on.
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {b: chr(b) for b in SEEN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in SEEN)}
ASCII_RUN = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: Letters whose lower case depends on their place or is longer than one letter.
ODD_CASE = frozenset("\u03a3\u0130")


class Words(dict):
    """Little-endian ids of each word met, a word being what stands between ASCII white space.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words in turn. Words
    that are sure to be one run of letters, digits or marks go to the merges at once, and are kept in lower case; all
    others go through the whole tokenizer, and so does every word with ``<``, which begins the strings that the
    vocabulary names as special: none of them holds white space, so none reaches over a word's end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        odd = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if "<" not in t.content or t.content.split() != [t.content] or t.normalized or t.single_word]
        if odd:
            raise ValueError(f"words can't be encoded each for itself by a vocabulary with the special strings {odd}")
        self.merges = self.tokenizer.model.tokenize

    def run(self, text: str) -> bytes:
        return b"".join([x.id.to_bytes(4, "little") for x in self.merges("".join([BYTE[b] for b in text.encode()]))])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        if "<" in text:
            ids = b"".join([x.to_bytes(4, "little") for x in self.tokenizer.encode(text, add_special_tokens=False).ids])
        elif text.isascii() and text.isprintable() and "'" not in text:
            low = text.lower()
            runs = ASCII_RUN.findall(low)
            if len(runs) > 1:
                ids = b"".join([self[x.encode()] for x in runs])
            else:
                ids = self.run(low) if low == text else self[low.encode()]
        elif len(text) > 1 and text[-1] in ".,!" and text[-2].isalnum() and text[-2] not in ODD_CASE:
            ids = self[text[:-1].encode()] + self[text[-1].encode()]
        elif text.isalpha() and unicodedata.is_normalized("NFC", text) and ODD_CASE.isdisjoint(text):
            low = text.lower()
            ids = self.run(low) if low == text else self[low.encode()]
        else:
            ids = b"".join([x.to_bytes(4, "little") for x in self.tokenizer.encode(text, add_special_tokens=False).ids])
        self[word] = ids
        return ids


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of every document, longer ones cut at ``capacity``.

    A null or empty text is the closing id alone. Repeated rows are documents of their own.
    """

    def encode(batches):
        words = Words(vocabulary)
        end = closing.to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                data = text.as_py()
                ids = memoryview(b"".join([words[w] for w in data.split()]) + end if data else end)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), bytes(part) if keep_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out[: 5 + keep_ids], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids],
            )

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, kind)


class Tightest:
    """A segment tree over remaining capacities 0..n: counts of open runs, and the least capacity of at least ``need`` that has one."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, at: int, by: int) -> None:
        at += self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def find(self, need: int) -> int | None:
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:  # the nearest subtree to the right that has an open run
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Moves of best-fit decreasing by length: (first rank, first bin, pieces a bin takes in this move, offset in the bin).

    A move holds for ranks up to the next one's first; its k-th piece goes to bin ``first + k // per``.
    """
    tree, open_runs = Tightest(capacity), defaultdict(list)
    moves, bins = defaultdict(list), 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs[remaining].append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_runs[room].pop()
                tree.add(room, -1)
            per = room // length
            placed = min(left, n * per)
            moves[length].append((rank, first, per, capacity - room))
            full, rest = divmod(placed, per)
            put(room - per * length, first, full)
            put(room - rest * length, first + full, 1 if rest else 0)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return dict(moves)


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """items with sequence_id and offset, packed by their column ``length`` (1 to ``capacity``) into as few sequences as best-fit decreasing finds.

    ``items`` is read more than once: give a written table. Equal items may change places.
    """
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths run from {min(counts)} to {max(counts)}; 1 to {capacity} can be packed")
    moves = plan(counts, capacity)
    # the rank within a length: by a hash bucket first, so that a common length is ranked by many tasks
    many = 4 * partitions(items.sparkSession)
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(many)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(inner)).join(base, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row") - 1).drop("_bucket", "_base", "_row")

    def place(batches):
        starts = {length: [m[0] for m in of] for length, of in moves.items()}
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist(), strict=True):
                first_rank, first, per, at = moves[length][bisect_right(starts[length], rank) - 1]
                turn, within = divmod(rank - first_rank, per)
                sequence.append(first + turn)
                offset.append(at + within * length)
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    return ranked.mapInArrow(place, kind).select(*(c for c in items.columns), "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, closing: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if kept), sequence_id, offset.

    Only documents longer than ``capacity`` tokens, the closing id included, are cut; a very long text is encoded word by
    word and its ids, four bytes each, are held by one worker. Null and empty texts are pieces of one token; an empty
    table gives no rows; repeated rows are packed each for itself, null ids too; other columns are not read. Strings of
    special tokens in a text become those tokens, as the tokenizer has it. The vocabulary is opened by its path on every
    worker: it comes with the installed package, or lies where all of them see it. Equal lengths are packed in the order
    of id, piece and checksum.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tune(docs.sparkSession)
    return pack(written(pieces(docs, vocabulary, capacity, closing, keep_ids)), capacity)
