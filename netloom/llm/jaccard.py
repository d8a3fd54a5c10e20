"""Jaccard self-join of word-shingle sets by adaptive multi-match prefixes.

Shingles are put in one global order, rarest first, by counts over all documents. Two sets that are similar enough
share at least l of the first |x| - ceil(t|x|) + l shingles of either, for every l; each document picks the l that its
shingle counts make cheapest and publishes that prefix. Documents of equal sets are one class, by a digest, and only the
class's smallest id goes on. Prefix shingles are first matched with the smallest id that publishes them, which ties
groups of near copies together by a star and not by all their pairs; then every pair of *different* components that
shares enough prefix shingles, and whose sizes and parity signs allow it, is verified, which is exact, as pairs within a component can't change it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import components, partitions, ship, spread_join, tune, written

ship(__name__)

#: Shingle counts are kept for so many hash slots, whatever the input's size; they only put shingles in order.
SLOTS, CHUNKS = 1 << 20, 16
REMEMBERED = 500_000
#: Longest extension of a prefix, and how many shingles' scan one verification costs.
MOST_MATCHES, VERIFY_COST = 4, 6.0
SIGN_BITS = 1024
#: Documents of one prefix shingle that one task compares; more are compared chunk by chunk in as many tasks as it takes.
CHUNK = 4096
#: Documents verified against one other in a task.
STAR = 200


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(data: bytes | None, hashes: Hashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words than ``width`` are one shingle, none are none."""
    words = data.lower().split() if data else ()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        out ^= own[k : len(own) - width + 1 + k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sign(own: np.ndarray) -> bytes:
    """Parity of the set's members by slot: two sets differ in as many members at least as their signs in bits."""
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) % SIGN_BITS, minlength=SIGN_BITS).astype(np.uint8) & 1).tobytes()


def needed(n: int, threshold: int) -> int:
    """Least overlap of a set of n with any set similar to it."""
    return -(-threshold * n // 100)


def _profiles(width: int):
    def scan(batches):
        import zstandard

        hashes, total = Hashes(), np.zeros(SLOTS, np.int64)
        names, types = ["doc_id", "n", "key", "sign", "chunk", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        rows = lambda *c: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types, strict=True)], names=names)
        for batch in batches:
            sets = [shingles(x.as_py(), hashes, width) for x in batch.column(1).cast(pa.binary())]
            if sets:
                total += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            none = [None] * len(sets)
            yield rows(batch.column(0).to_pylist(), [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [sign(s) for s in sets], none, none)
        pack = zstandard.ZstdCompressor().compress
        parts = [pack(part.tobytes()) for part in np.split(total, CHUNKS)]
        none = [None] * CHUNKS
        yield rows(none, none, none, none, list(range(CHUNKS)), parts)

    return scan


def _summed(parts: pa.Table) -> pa.Table:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    total = sum(np.frombuffer(unpack(p), np.int64) for p in parts.column("counts").to_pylist())
    return pa.table({"chunk": parts.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def matches(counts: np.ndarray, n: int, threshold: int) -> int:
    """The l whose prefix is cheapest: its shingles' counts are the scan, and fewer documents share l of them than share one."""
    best, out, base = None, 1, n - needed(n, threshold)
    for many in range(1, min(MOST_MATCHES, needed(n, threshold)) + 1):
        scan = float(counts[: base + many].sum())
        cost = scan + VERIFY_COST * scan / many**2
        if best is None or cost < best:
            best, out = cost, many
    return out


def _prefixes(width: int, threshold: int, counts):
    def scan(batches):
        hashes, of = Hashes(), counts.value
        for batch in batches:
            ids, many, sizes, tokens = [], [], [], []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = shingles(x.as_py(), hashes, width)
                if len(own):
                    count = of[(own % np.uint64(SLOTS)).astype(np.int64)]
                    order = np.lexsort((own, count))
                    m = matches(count[order], len(own), threshold)
                    ids.append(doc_id)
                    many.append(m)
                    sizes.append(len(own))
                    tokens.append(own[order[: len(own) - needed(len(own), threshold) + m]].view(np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(many, pa.int32()), lists], names=["rep", "n", "many", "tokens"])

    return scan


def _shared(batches):
    """Of rows sorted by token and rep, those whose token has two reps or more, with the first one of the token."""
    held = None  # the last row of the batch before, if its token has no other row so far
    last, lead = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, rep, n, many = (batch.column(i).to_numpy() for i in range(4))
        if held is not None:
            token, rep, n, many = (np.concatenate([[h], c]) for h, c in zip(held, (token, rep, n, many), strict=True))
        first = np.concatenate([[token[0] != last], token[1:] != token[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(token)), -1))
        head = np.where(start >= 0, start, 0)
        lead_rep, lead_n, lead_many = rep[head], n[head], many[head]
        if start[0] < 0:  # the token goes on from the batch before
            on = start < 0
            lead_rep, lead_n, lead_many = (np.where(on, h, c) for h, c in zip(lead, (lead_rep, lead_n, lead_many), strict=True))
        alone = first & np.concatenate([first[1:], [True]])
        held = tuple(c[-1] for c in (token, rep, n, many)) if first[-1] else None
        keep = ~alone
        if held is None:
            last, lead = token[-1], (lead_rep[-1], lead_n[-1], lead_many[-1])
        else:
            last, lead, keep[-1] = None, None, False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (token, rep, n, many, lead_rep, lead_n, lead_many)], names=["token", "rep", "n", "many", "lead", "lead_n", "lead_many"])


def _meetings(threshold: int):
    """Of rows sorted by token and part, the pairs of different components that size and sign let be similar."""

    def meet(batches):
        held: list[pa.RecordBatch] = []

        def pairs(table):
            token, low, high, side, rep, n, many, label = (table.column(c).to_numpy() for c in ("token", "low", "high", "side", "rep", "n", "many", "label"))
            signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint64).reshape(len(token), -1)
            for lag in range(1, len(token)):
                a = np.nonzero((token[lag:] == token[:-lag]) & (low[lag:] == low[:-lag]) & (high[lag:] == high[:-lag]))[0]
                if not len(a):
                    break
                b = a + lag
                size = n[a] + n[b]
                ok = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])) & ((low[a] == high[a]) | (side[a] != side[b]))
                a, b, size = a[ok], b[ok], size[ok]
                unlike = np.bitwise_count(signs[a] ^ signs[b]).sum(axis=1, dtype=np.int64)
                ok = (100 + threshold) * unlike <= (100 - threshold) * size
                a, b = a[ok], b[ok]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b])), pa.array(np.minimum(many[a], many[b]))], names=["a", "b", "many"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("token", "low", "high")]
            edge = np.nonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))[0]
            last = [h.column(c)[-1].as_py() for h in held[-1:] for c in ("token", "low", "high")]
            if held and last != [k[0] for k in key]:
                yield from pairs(pa.Table.from_batches(held).combine_chunks())
                held = []
            if len(edge):
                held.append(batch.slice(0, edge[-1] + 1))
                yield from pairs(pa.Table.from_batches(held).combine_chunks())
                held = []
                batch = batch.slice(edge[-1] + 1)
            held.append(batch)
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return meet


def _verified(width: int, threshold: int):
    def check(group: pa.Table) -> pa.Table:
        hashes, sets = Hashes(), defaultdict(list)
        center = group.column("center")[0].as_py()
        for i, text in zip(group.column("id").to_pylist(), group.column("text"), strict=True):
            sets[i].append(shingles(text.cast(pa.binary()).as_py(), hashes, width))
        own, out = sets.pop(center), []
        for i, found in sets.items():
            for x, y in product(own, found):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= threshold * (len(x) + len(y) - both):
                    out.append(i)
                    break
        return pa.table({"a": pa.array(out, pa.int64()), "b": pa.array([center] * len(out), pa.int64())})

    return check


def _links(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of pairs (a, b) that are similar. Stars of many pairs are dealt out, the centre going to each part."""
    sizes = pairs.groupBy("b").agg(F.count("*").alias("k")).select("b", F.ceil(F.col("k") / STAR).cast("int").alias("parts"))
    ends = pairs.join(sizes, "b").select(F.col("a").alias("id"), F.col("b").alias("center"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    own = sizes.select(F.col("b").alias("id"), F.col("b").alias("center"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = ends.unionByName(own)
    texts = asked.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return texts.groupBy("center", "part").applyInArrow(_verified(width, threshold), "a long, b long")


def similar(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of docs.

    A-Z are lower-cased; words are what stands between ASCII white space; a document's set has the distinct shingles
    of ``width`` words, and two documents link when 100 * |intersection| >= threshold * |union|. class_id is the
    smallest id with the same set, component_id the smallest id reachable by links. Null, empty and blank texts have
    an empty set and link with nothing: they are classes of their own. An id that
    stands in rows of several texts links with what any of them links with. Rows without an id are copies of whatever
    has their set, and otherwise link with nothing and have no component. Ties at the threshold link. A very long text
    is one row of hashes. An empty table gives an empty one. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = written(docs.mapInArrow(_profiles(width), "doc_id long, n long, key binary, sign binary, chunk int, counts binary"))
    total = np.zeros(SLOTS, np.int64)  # SLOTS numbers, however many documents there are
    for row in seen.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary").collect():
        total[row["chunk"] * (SLOTS // CHUNKS) : (row["chunk"] + 1) * (SLOTS // CHUNKS)] = np.frombuffer(row["counts"], np.int64)
    rows = seen.where("chunk is null").select("doc_id", "n", "key")
    signs = seen.where("chunk is null and n > 0")
    classes = written(signs.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("sign").alias("sign"), F.count("*").alias("copies")))
    spread = spark.sparkContext.broadcast(total)
    prefixes = docs.mapInArrow(_prefixes(width, threshold, spread), "rep long, n long, many int, tokens array<long>")
    tokens = prefixes.join(classes.select("rep"), "rep", "left_semi").select(F.explode("tokens").alias("token"), "rep", "n", "many")
    shared = written(
        tokens.repartition(partitions(spark), "token").sortWithinPartitions("token", "rep")
        .mapInArrow(_shared, "token long, rep long, n long, many int, lead long, lead_n long, lead_many int")
    )

    def alike(x, y):
        return 100 * F.least(x, y) >= threshold * F.greatest(x, y)

    one_text = docs.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    stars = shared.where("rep <> lead").where(alike(F.col("n"), F.col("lead_n"))).groupBy(F.col("rep").alias("a"), F.col("lead").alias("b"))
    stars = written(stars.agg(F.count("*").alias("k"), F.min(F.least("many", "lead_many")).alias("many")).where("k >= many").select("a", "b"))
    first = written(_links(stars, one_text, width, threshold))
    near = components(first)

    named = shared.select("token", "rep", "n", "many").join(near.withColumnRenamed("id", "rep"), "rep", "left")
    named = written(named.select("token", "rep", "n", "many", F.coalesce("component", "rep").alias("label")))
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("f")).where("lo < hi")
    parts = F.ceil(F.col("f") / CHUNK).cast("int")
    mixed = named.join(mixed.select("token", parts.alias("parts")), "token").join(classes.select("rep", "sign"), "rep")
    mixed = mixed.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mixed = mixed.select("token", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "n", "many", "label", "sign")
    pairs = mixed.repartition(partitions(spark), "token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(_meetings(threshold), "a long, b long, many int")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("many").alias("many")).where("k >= many").select("a", "b")
    # what the stars have compared need not be compared again
    pairs = pairs.join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    second = _links(written(pairs), one_text, width, threshold)
    final = components(first.unionByName(second))

    classed = spread_join(rows.where("n > 0"), classes.drop("sign"), "key").select("doc_id", "n", F.col("rep").alias("class_id"))
    classed = classed.join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = classed.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)
