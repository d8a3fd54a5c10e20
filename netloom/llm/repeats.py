"""Removal of byte strings that repeat across documents, by suffix sorting in two stages.

Every string of ``length`` bytes belongs to its minimiser, the least hash among its 24-byte parts, so equal strings meet
wherever strings are dealt by minimiser. Blocks of documents publish sketches of their minimisers; those that two
documents share come back, and only the stretches of text under them are sent on, once for each block. A task then
suffix-sorts its stretches in two stages: suffixes smaller than their successors are sorted directly, the others are
induced by scanning the buckets of first bytes in order; common prefixes of adjacent suffixes give the strings that
are equal, and the smallest document that has each. That goes back to the blocks, which cut their documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import ship, tune, written

ship(__name__)

#: A block ends after so many bytes of text; hashes are taken over so many positions at a time.
BLOCK_BYTES, SLICE = 3 << 20, 1 << 18
PART = 24
NO_ID = np.iinfo(np.int64).max


def hashes(data: np.ndarray) -> np.ndarray:
    """40-bit hashes of all 24-byte parts."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    h = data.astype(np.uint64) + np.uint64(1)
    width, by = 1, {}
    while width < 16:
        h = h[:-width] * power(width) + h[width:]
        width *= 2
        by[width] = h
    h = by[16][:-8] * power(8) + by[8][16:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(24)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: have - width], values[width - have :])


class Text:
    """The documents of a block in one buffer, 0xFF between them, and the runs of strings that share a minimiser."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = b"\xff".join([*texts, b""])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        at = np.frombuffer(self.data, np.uint8)
        whole = np.zeros(len(at) + 1, np.int32)
        long = sizes >= length
        np.add.at(whole, self.starts[long], 1)
        np.add.at(whole, (self.starts + sizes - length + 1)[long], -1)
        whole = np.cumsum(whole[:-1]).astype(bool)  # positions where a string begins
        starts, ends, values = [], [], []
        for a in range(0, len(at) - length + 1, SLICE):
            part = at[a : a + SLICE + length - 1]
            low, ok = least(hashes(part), length - PART + 1), whole[a : a + len(part) - length + 1]
            edge = np.ones(len(low), bool)
            edge[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
            first = np.nonzero(edge)[0]
            last = np.concatenate([first[1:], [len(low)]])
            keep = ok[first]
            starts.append(first[keep] + a)
            ends.append(last[keep] + a)
            values.append(low[first[keep]])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.first, self.last, self.value = cat(starts, np.int64), cat(ends, np.int64), cat(values, np.uint64)
        self.owner = np.searchsorted(self.starts, self.first, side="right") - 1

    def run(self, i: int, length: int) -> bytes:
        return self.data[self.first[i] : self.last[i] + length - 1]


def prefix_order(keys: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Positions ``at`` in the order of the ``length`` bytes there; keys: big-endian 8 bytes at every position."""
    if not len(at):
        return at
    key = keys[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    edge = np.ones(len(at), bool)
    edge[1:] = key[1:] != key[:-1]
    for offset in [*range(8, length - 8, 8), length - 8]:
        tied = ~(edge & np.append(edge[1:], True))
        if not tied.any():
            break
        group, sub = np.cumsum(edge)[tied], at[tied]
        key = keys[sub + offset].astype(np.uint64)
        order = np.lexsort((key, group))
        at[tied], key, group = sub[order], key[order], group[order]
        new = np.ones(len(group), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        edge[tied] = new
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Positions of ``wanted`` in the order of the ``length`` bytes there, sorted in two stages.

    text: stretches that each end in 0xFF, 0xFF first, padded at the end. wanted has, with a position that is larger
    than its successor, that successor as well.
    """
    n = len(text)
    edge = np.append(np.nonzero(text[1:] != text[:-1])[0], n - 1)
    falls = np.append(text[edge[:-1]] > text[edge[:-1] + 1], False)
    larger = np.repeat(falls, np.diff(np.concatenate([[-1], edge])))  # than the successor: equal bytes go by the end of their run
    keys = np.ndarray((n - 7,), ">u8", buffer=text.tobytes(), strides=(1,))
    direct = prefix_order(keys, np.nonzero(wanted & ~larger)[0], length)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced, waiting, out = wanted & larger, defaultdict(list), []
    for byte in range(256):
        found = waiting.pop(byte, [])
        turn = np.concatenate(found) if found else np.zeros(0, np.int64)
        parts = []
        while len(turn):  # predecessors by the same byte follow in rounds
            parts.append(turn)
            turn = turn[induced[turn - 1] & (text[turn - 1] == byte)] - 1
        bucket = np.concatenate([*parts, direct[bounds[byte] : bounds[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[induced[before] & (text[before] > byte)]
        if len(before):
            heads = text[before]
            order = np.argsort(heads, kind="stable")
            before, heads = before[order], heads[order]
            cuts = np.nonzero(heads[1:] != heads[:-1])[0] + 1
            for part in np.split(before, cuts):
                waiting[int(text[part[0]])].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def smallest_owner(stretches: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch, by the place of its strings, the smallest owner among all stretches that have the string."""
    if not stretches:
        return []
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    text = np.frombuffer(b"\xff" + b"\xff".join(stretches) + b"\xff" * (length + 8), np.uint8)
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    count = sizes - length + 1
    first = np.cumsum(count) - count
    whole = np.repeat(starts - first, count) + np.arange(count.sum())  # positions of all strings
    owner_at = np.repeat(owners, count)
    wanted = np.zeros(len(text), bool)
    wanted[whole] = True
    tail = starts + count  # what follows a stretch's last string is needed while it only falls
    going = text[tail - 1] >= text[tail]
    while going.any():
        tail = tail[going]
        wanted[tail] = True
        tail = tail + 1
        going = (text[tail - 1] >= text[tail]) & (text[tail - 1] != 255)
    order = suffix_order(text, wanted, length)
    rank = np.full(len(text), -1, np.int64)
    rank[whole] = np.arange(len(whole))
    order = order[rank[order] >= 0]
    keys = np.ndarray((len(text) - 7,), ">u8", buffer=text.tobytes(), strides=(1,))
    same = np.ones(len(order) - 1, bool)  # adjacent suffixes with a common prefix of ``length`` bytes
    for offset in [*range(0, length - 8, 8), length - 8]:
        key = keys[order + offset]
        same &= key[1:] == key[:-1]
    heads = np.nonzero(np.concatenate([[True], ~same]))[0]
    low = np.minimum.reduceat(owner_at[rank[order]], heads)
    out = np.empty(len(whole), np.int64)
    out[rank[order]] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return np.split(out, first[1:])


def _row_blocks(text: int):
    """Gives each row of a partition its block, by the bytes before it."""

    def number(batches):
        from pyspark import TaskContext

        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text).cast(pa.binary())], np.int64)
            before = seen + np.concatenate([[0], np.cumsum(sizes)])
            seen = int(before[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + before[:-1] // BLOCK_BYTES, pa.int64())], names=[*batch.schema.names, "_block"])

    return number


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _check_set(ids: np.ndarray, texts: list[bytes]) -> int:
    """A checksum of a block's rows in any order."""
    return sum(zlib.crc32(len(t).to_bytes(8, "little"), int(i) & 0xFFFFFFFF) for i, t in zip(ids.tolist(), texts, strict=True)) & (1 << 62) - 1


def _sketches(length: int, buckets: int):
    def sketch(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress

        def rows(block, ids, texts):
            own = Text(texts, length)
            order = np.lexsort((ids[own.owner], own.value))
            value, doc = own.value[order], ids[own.owner][order]
            head = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
            starts = np.nonzero(head)[0]
            many = np.logical_or.reduceat(np.concatenate([[False], ~head[1:] & (doc[1:] != doc[:-1])]), starts) if len(starts) else head
            value, check = value[starts], _check_set(ids, texts)
            bucket = (value * np.uint64(buckets)) >> np.uint64(40)
            used, cuts = np.unique(bucket, return_index=True)
            cuts = np.append(cuts, len(bucket)).tolist()
            for at in range(0, len(used), 512):
                some = used[at : at + 512]
                spans = list(zip(cuts[at : at + len(some)], cuts[at + 1 : at + len(some) + 1], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array([check] * len(some), pa.int64()),
                    pa.array([pack(np.diff(value[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()) for a, b in spans], pa.binary()),
                    pa.array([np.packbits(many[a:b]).tobytes() for a, b in spans], pa.binary()),
                ], names=["block", "bucket", "check", "parts", "many"])

        block, ids, texts = None, [], []
        for batch in _row_blocks(1)(batches):  # in one worker with what follows, as a worker's memory counts twice over
            new, doc, data = batch.column("_block").to_numpy(), _ids(batch.column("doc_id")), _texts(batch.column("text"))
            for b in np.unique(new):
                if b != block:
                    if texts:
                        yield from rows(block, np.concatenate(ids), texts)
                    block, ids, texts = int(b), [], []
                of = np.nonzero(new == b)[0]
                ids.append(doc[of])
                texts += [data[i] for i in of]
        if texts:
            yield from rows(block, np.concatenate(ids), texts)

    return sketch


def _values(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(5, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :5] = planes.T
    return np.cumsum(wide.view("<u8").reshape(-1))


def _common(asked: pa.Table) -> pa.Table:
    """For every sketch, which of its minimisers another document has."""
    values = [_values(x) for x in asked.column("parts").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(v)).astype(bool) for m, v in zip(asked.column("many").to_pylist(), values, strict=True)]
    whole = np.sort(np.concatenate(values))
    twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
    found = []
    for v, m in zip(values, many, strict=True):
        at = np.minimum(np.searchsorted(twice, v), max(len(twice) - 1, 0))
        found.append(v[m | (twice[at] == v) if len(twice) else m].tobytes())
    return pa.table({"block": asked.column("block"), "check": asked.column("check"), "values": pa.array(found, pa.binary())})


def _agree(check: int, *tables: pa.Table) -> None:
    if {check} < {check, *(x for t in tables for x in t.column("check").to_pylist())}:
        raise RuntimeError("the input gave other rows when it was read again; give a written table")


def _order(ids: np.ndarray, texts: list[bytes]) -> list[int]:
    """One order of a block's rows, which come out of a shuffle in any; the places of runs hang on it."""
    numbers = ids.tolist()
    return sorted(range(len(texts)), key=lambda i: (numbers[i], texts[i]))


def _stretches(length: int, buckets: int):
    def cut(docs: pa.Table, shared: pa.Table) -> pa.Table:
        import zstandard

        pa.default_memory_pool().release_unused()

        names = ["block", "bucket", "check", "stretches", "low", "high"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        ids, texts = _ids(docs.column("doc_id")), _texts(docs.column("text"))
        if not texts or not shared.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        order = _order(ids, texts)
        check = _check_set(ids, texts)
        _agree(check, shared)
        ids, texts = ids[order], [texts[i] for i in order]
        own = Text(texts, length)
        known = np.sort(np.concatenate([np.frombuffer(v, np.uint64) for v in shared.column("values").to_pylist()]))
        at = np.minimum(np.searchsorted(known, own.value), max(len(known) - 1, 0))
        chosen = np.nonzero(known[at] == own.value)[0] if len(known) else []
        dealt: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        doc = ids[own.owner].tolist()
        bucket = ((own.value * np.uint64(buckets)) >> np.uint64(40)).tolist()
        for i in chosen:
            of, run, d = dealt[bucket[i]], own.run(i, length), doc[i]
            have = of.get(run)
            if have is None:
                of[run] = [d, d]
            elif d < have[0]:
                have[0] = d
            elif d > have[1]:
                have[1] = d
        pack, block = zstandard.ZstdCompressor(level=3).compress, docs.column("_block")[0].as_py()
        ends = {b: np.array(list(of.values()), np.int64) for b, of in dealt.items()}
        return pa.table([pa.array(c, t) for c, t in zip((
            [block] * len(dealt), list(dealt), [check] * len(dealt), [pack(b"\xff".join(of)) for of in dealt.values()],
            [pack(e[:, 0].tobytes()) for e in ends.values()], [pack(e[:, 1].tobytes()) for e in ends.values()],
        ), types, strict=True)], names=names)

    return cut


def _matched(length: int):
    def match(asked: pa.Table) -> pa.Table:
        import xxhash
        import zstandard

        pa.default_memory_pool().release_unused()

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        runs = [unpack(x).split(b"\xff") for x in asked.column("stretches").to_pylist()]
        low, high = ([np.frombuffer(unpack(x), np.int64) for x in asked.column(c).to_pylist()] for c in ("low", "high"))
        distinct: dict[bytes, int] = {}
        for own, ids in zip(runs, low, strict=True):
            for run, i in zip(own, ids.tolist(), strict=True):
                have = distinct.get(run)
                if have is None or i < have:
                    distinct[run] = i
        owner = dict(zip(distinct, smallest_owner(list(distinct), np.array(list(distinct.values()), np.int64), length), strict=True))
        keys, firsts = [], []
        for own, ids in zip(runs, high, strict=True):
            kept = [r for r, i in zip(own, ids.tolist(), strict=True) if owner[r].min() < i]  # some document of the block loses something
            keys.append(np.fromiter((xxhash.xxh3_64_intdigest(r) for r in kept), np.uint64, len(kept)).tobytes())
            firsts.append(pack(np.concatenate([np.zeros(0, np.int64), *(owner[r] for r in kept)]).tobytes()))
        return pa.table({"block": asked.column("block"), "check": asked.column("check"), "keys": pa.array(keys, pa.binary()), "firsts": pa.array(firsts, pa.binary())})

    return match


def _cut(length: int):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        import xxhash
        import zstandard

        pa.default_memory_pool().release_unused()

        ids, texts = _ids(docs.column("doc_id")), _texts(docs.column("text"))
        if texts:
            _agree(_check_set(ids, texts), answers)
            order = _order(ids, texts)
            docs, ids, texts = docs.take(order), ids[order], [texts[i] for i in order]
        own, unpack, where, firsts, base = Text(texts, length), zstandard.ZstdDecompressor().decompress, {}, [], 0
        keys = [np.frombuffer(k, np.uint64).tolist() for k in answers.column("keys").to_pylist()]
        hit = np.zeros(len(own.data) + 1, np.int32)
        if any(keys):
            sizes = (own.last - own.first).tolist()
            names = [xxhash.xxh3_64_intdigest(own.run(i, length)) for i in range(len(sizes))]
            size_of = dict(zip(names, sizes, strict=True))
            for some, packed in zip(keys, answers.column("firsts").to_pylist(), strict=True):
                firsts.append(np.frombuffer(unpack(packed), np.int64))
                for k in some:
                    where[k] = base
                    base += size_of[k]
            firsts = np.concatenate(firsts)
            at = np.array([i for i, k in enumerate(names) if k in where], np.int64)
            size = (own.last - own.first)[at]
            flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            low = firsts[np.repeat(np.array([where[names[i]] for i in at], np.int64), size) + flat]
            place = (np.repeat(own.first[at], size) + flat)[low < np.repeat(ids[own.owner[at]], size)]
            np.add.at(hit, place, 1)
            np.add.at(hit, place + length, -1)
        gone = np.cumsum(hit[:-1]) > 0
        spans, kept = [], []
        data = np.frombuffer(own.data, np.uint8)
        for start, text in zip(own.starts.tolist(), texts, strict=True):
            part = gone[start : start + len(text)]
            if part.any():
                edge = np.nonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]])))[0]
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(data[start : start + len(text)][~part].tobytes())
            else:
                spans.append([])
                kept.append(text)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = docs.drop_columns(["_block"])
        return out.append_column("n_bytes", pa.array(list(map(len, texts)), pa.int64())).append_column("spans", pa.array(spans, kind)).append_column("kept", pa.array(kept, pa.binary()))

    return cut


def find_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with n_bytes, spans (start and end of every maximal run of bytes to remove) and kept (the other bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id.
    Matches never cross documents, and are judged on the input. Null and empty texts have no bytes. Rows of one id
    leave each other alone; a null id counts as larger than all others. An empty table gives an empty one.
    Strings are compared byte by byte, by suffix order; answers go back to their blocks by 64-bit hashes of positions.
    A very long text is cut where blocks need it and comes back whole.
    The input is read twice and has to give the same rows in the same order, as files do; what comes out of a shuffle
    is written first.
    """
    if length < PART + 8:
        raise ValueError(f"strings of {PART + 8} bytes or more can be matched")
    spark = docs.sparkSession
    tune(spark)
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs)
    docs = docs.drop("n_bytes", "spans", "kept", "_block")
    size = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    buckets = min(max(64, docs.rdd.getNumPartitions() * max(16, size >> 20)), 1 << 24)  # hashes have 40 bits
    plain = lambda fields: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = docs.mapInArrow(_row_blocks(docs.columns.index("text")), plain(docs.schema.fields) + ", _block long")
    sketches = docs.select("doc_id", "text").mapInArrow(_sketches(length, buckets), "block long, bucket int, check long, parts binary, many binary")
    shared = sketches.groupBy("bucket").applyInArrow(_common, "block long, check long, values binary")
    grouped = rows.groupBy("_block")
    cut = grouped.cogroup(shared.groupBy("block")).applyInArrow(_stretches(length, buckets), "block long, bucket int, check long, stretches binary, low binary, high binary")
    answers = cut.groupBy("bucket").applyInArrow(_matched(length), "block long, check long, keys binary, firsts binary")
    kind = plain(docs.schema.fields) + ", n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(_cut(length), kind)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def whole_characters(text: str, kept: str):
    """The bytes that stay as text, characters of which a part went left out; where nothing went, the text itself."""
    whole = F.regexp_replace(F.make_valid_utf8(F.col(kept).cast("string")), "\ufffd", "")
    return F.when(F.size("spans") > 0, whole).otherwise(F.col(text))
