"""Near duplicates among embeddings by navigable small-world graphs, one for each shard.

Equal vectors are one class with a number of its own. A shard's classes are linked into a hierarchy of graphs: every
vector is on the ground level, one in BRANCH on the next, and so on; inserts and searches run for many vectors at a
time. Every vector is looked up in every shard's graph (two shards once, from one side). A search whose beam is full of
matches goes on along the links of the matches. An audit compares sampled look-ups, and probes made at the very
threshold, with all vectors of the shard, and beams widen until it passes. Pairs are verified by cosine in double
precision where they are found; what leaves a task is a sum of links for each vector and one link to its group's first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import components, ship, spread_join, tune, written

ship(__name__)

#: Vectors of a shard at most, on the average; all pairs of shards meet, so shuffled bytes grow with rows * rows / SHARD.
SHARD = 16_384
LINKS, KEEP, BUILD_BEAM, BEAM, BRANCH, BATCH = 24, 12, 48, 48, 16, 512
#: Look-ups and probes that an audit compares with the whole shard, and the recall that it asks for.
AUDIT, RECALL = 128, 0.99
SLACK = 1e-3  # of single-precision similarities
BLOCK = 1024  # rows of a bit matrix that are unpacked at a time


def search(vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``beam`` best vectors that each query finds from its entry, best first; -1 fills up."""
    m = len(queries)
    ids, sims = np.full((m, beam), -1, np.int32), np.full((m, beam), -2.0, np.float32)
    ids[:, 0], sims[:, 0] = entry, np.einsum("md,md->m", vectors[entry], queries)
    open_, seen, live = np.zeros((m, beam), bool), np.zeros((m, len(vectors)), bool), np.arange(m)
    open_[:, 0] = True
    seen[live, entry] = True
    while len(live):
        choice = np.argsort(np.where(open_[live], -sims[live], 3), axis=1, kind="stable")[:, :at_once]
        rows = live[:, None]
        ok = open_[rows, choice]
        open_[rows, choice] = False
        near = np.where(ok[:, :, None], links[np.where(ok, ids[rows, choice], 0)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        who, col = np.nonzero(fresh)
        seen[live[who], near[who, col]] = True
        new = np.full(near.shape, -2.0, np.float32)
        new[who, col] = np.einsum("nd,nd->n", vectors[near[who, col]], queries[live[who]])
        all_sims, all_ids = np.hstack([sims[live], new]), np.hstack([ids[live], np.where(fresh, near, -1)])
        all_open = np.hstack([open_[live], fresh])
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[live], ids[live] = np.take_along_axis(all_sims, best, 1), np.take_along_axis(all_ids, best, 1)
        open_[live] = np.take_along_axis(all_open, best, 1) & (ids[live] >= 0)
        live = live[open_[live].any(axis=1)]
    return ids, sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are nearer to the row than to any chosen before; then the best others."""
    m, k = ids.shape
    chosen, count = np.zeros((m, k), bool), np.zeros(m, int)
    own = vectors[np.maximum(ids, 0)]
    for j in range(k):
        close = np.einsum("mkd,md->mk", own[:, :j], own[:, j]) if j else np.zeros((m, 0))
        ok = (ids[:, j] >= 0) & (count < keep) & ~((close > sims[:, j : j + 1]) & chosen[:, :j]).any(axis=1)
        chosen[:, j] = ok
        count += ok
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """Levels of (members, links): links of level 0 are by vector, those above by the member's place on the level."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, n = vectors, len(vectors)
        sizes = [n]
        while sizes[-1] > 4 * BRANCH:
            sizes.append(sizes[-1] // BRANCH)
        self.sizes = sizes  # vectors come in random order: a level has the first ones
        self.links = [None] * len(sizes)
        for level in range(len(sizes) - 1, -1, -1):
            self.links[level] = self.linked(level, sizes[level])

    def entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Where to enter a level: the best that the levels above find."""
        top = len(self.sizes) - 1
        if level == top:
            return np.zeros(len(queries), np.int64)
        at = np.argmax(queries @ self.vectors[: self.sizes[top]].T, axis=1)
        for between in range(top - 1, level, -1):
            at = search(self.vectors[: self.sizes[between]], self.links[between], at, queries, 8)[0][:, 0]
        return at

    def linked(self, level: int, n: int) -> np.ndarray:
        vectors = self.vectors[:n]
        links, weights = np.full((n, LINKS), -1, np.int32), np.full((n, LINKS), -2.0, np.float32)
        done = 0
        while done < n:
            size = min(n - done, max(64, min(BATCH, done)))
            new = np.arange(done, done + size)
            inner = vectors[new] @ vectors[new].T
            np.fill_diagonal(inner, -2)
            first = np.argsort(-inner, axis=1)[:, : min(KEEP, size - 1)]
            ids, sims = [new[first].astype(np.int32)], [np.take_along_axis(inner, first, 1)]
            if done:
                entry = np.minimum(self.entries(vectors[new], level), done - 1)
                found = search(vectors[:done], links[:done], entry, vectors[new], BUILD_BEAM)
                ids.append(found[0])
                sims.append(found[1])
            ids, sims = np.hstack(ids), np.hstack(sims)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            chosen = diverse(vectors, ids, sims, KEEP)
            width = chosen.shape[1]
            links[new, :width] = chosen
            weights[new, :width] = np.where(chosen >= 0, np.einsum("mkd,md->mk", vectors[np.maximum(chosen, 0)], vectors[new]), -2)
            for a, row in zip(new.tolist(), chosen.tolist(), strict=True):  # links back, the weakest giving way
                for b in row:
                    if b >= 0 and a not in links[b]:
                        worst = int(np.argmin(weights[b]))
                        sim = float(vectors[a] @ vectors[b])
                        if sim > weights[b, worst]:
                            links[b, worst], weights[b, worst] = a, sim
            done += size
        return links

    def find(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return search(self.vectors, self.links[0], self.entries(queries, 0), queries, min(beam, len(self.vectors)))


def probes(graph: Graph, least: float, many: int) -> np.ndarray:
    """Vectors of the shard turned away from themselves as far as a match may be."""
    r = np.random.default_rng(11)
    own = graph.vectors[np.linspace(0, len(graph.vectors) - 1, min(many, len(graph.vectors))).astype(int)]
    away = r.normal(size=own.shape)
    away -= np.einsum("md,md->m", away, own)[:, None] * own
    size = np.linalg.norm(away, axis=1, keepdims=True)
    near = np.minimum(least + 2 * SLACK, 1.0)
    return (near * own + np.sqrt(1 - near**2) * np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0)).astype(np.float32)


def flooded(graph: Graph, query: np.ndarray, hits: np.ndarray, least: float) -> np.ndarray:
    """hits and whatever matches lie behind them by links between matches."""
    seen = np.zeros(len(graph.vectors), bool)
    seen[hits] = True
    out = [hits]
    while len(hits):
        near = np.unique(graph.links[0][hits])
        near = near[near >= 0]
        near = near[~seen[near]]
        seen[near] = True
        hits = near[graph.vectors[near] @ query >= least]
        out.append(hits)
    return np.concatenate(out)


def found(graph: Graph, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """For each query, the places of the vectors at least so similar that a beam, and links from a full one, come upon."""
    out = []
    for at in range(0, len(queries), BATCH):
        part = queries[at : at + BATCH]
        ids, sims = graph.find(part, beam)
        for query, row, ok in zip(part, ids, sims >= least, strict=True):
            out.append(flooded(graph, query, row, least) if ok.all() and len(row) < len(graph.vectors) else row[ok])
    return out


def passes(graph: Graph, asked: np.ndarray, hits: list[np.ndarray], least: float) -> bool:
    """Whether the look-ups have RECALL of what a scan of the shard has, by pair and by look-up."""
    truth = [np.nonzero(row >= least)[0] for row in asked @ graph.vectors.T]
    got = [(np.isin(t, h).sum(), len(t)) for t, h in zip(truth, hits, strict=True) if len(t)]
    return not got or (sum(g for g, _ in got) >= RECALL * sum(n for _, n in got) and sum(g / n for g, n in got) >= RECALL * len(got))


def beam_for(graph: Graph, queries: np.ndarray, least: float, beam: int = BEAM) -> int:
    """The narrowest beam, from ``beam`` on by doubling, whose audit passes; 0 if none does that is narrower than the shard.

    The audit has look-ups spread over the queries, those of them with a full beam again by links, and probes, which
    have a match at the threshold however rare matches are.
    """
    sample = queries[np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)] if len(queries) else queries
    asked = np.vstack([sample, probes(graph, least, AUDIT)])
    while not passes(graph, asked, found(graph, asked, least, beam), least):
        if beam >= len(graph.vectors):
            return 0
        beam *= 2
    return beam


def lookup(graph: Graph, queries: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query, the places of the vectors at least so similar, by single precision.

    Only a graph that fails its audit with a beam as wide as the shard, so one that isn't connected, is passed over.
    """
    beam = beam_for(graph, queries, least)
    if beam:
        return found(graph, queries, least, beam)
    return [np.nonzero(row >= least)[0] for at in range(0, len(queries), BATCH) for row in queries[at : at + BATCH] @ graph.vectors.T]


class Groups:
    """Union of places; a union of many that are one group already costs one comparison."""

    def __init__(self, n: int):
        self.label, self.parent = np.arange(n), list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, places: np.ndarray) -> int:
        labels = self.label[places]
        if (labels == labels[0]).all():
            return self.root(int(labels[0]))
        roots = {self.root(int(x)) for x in np.unique(labels)}
        low = min(roots)
        for x in roots:
            self.parent[x] = low
        self.label[places] = low
        return low


class Bits:
    """A square matrix of bits; a pair that either side came upon is a link of both."""

    def __init__(self, n: int):
        self.n, self.rows = n, np.zeros((n, -(-n // BLOCK) * BLOCK // 8), np.uint8)

    def put(self, row: int, places: np.ndarray) -> None:
        np.bitwise_or.at(self.rows[row], places >> 3, (128 >> (places & 7)).astype(np.uint8))

    def part(self, a: int, b: int) -> np.ndarray | None:
        packed = self.rows[a : a + BLOCK, b // 8 : (b + BLOCK) // 8]
        return np.unpackbits(packed, axis=1)[:, : self.n - b].astype(bool) if packed.any() else None

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """For each row, the weights of its links, itself left out."""
        out = np.zeros(self.n)
        for a in range(0, self.n, BLOCK):
            for b in range(a, self.n, BLOCK):
                one, other = self.part(a, b), self.part(b, a)
                both = one if other is None else other.T if one is None else one | other.T
                if both is None:
                    continue
                if a == b:
                    both = both.copy()
                    np.fill_diagonal(both, False)
                out[a : a + BLOCK] += both @ weight[b : b + BLOCK]
                if a != b:
                    out[b : b + BLOCK] += both.T @ weight[a : a + BLOCK]
        return out


def _vectors(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # huge and tiny numbers keep their direction
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _packed(batches):
    """Vectors as bytes of doubles; null where one can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            out.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])


LINKED = "id long, other long, n long"


def _linked(ids, others, counted, counts) -> pa.Table:
    """Links (id, other), and sums (id, n)."""
    ids, others, counted, counts = (np.asarray(x, np.int64) for x in (ids, others, counted, counts))
    some = counts > 0
    counted, counts = counted[some], counts[some]
    return pa.table({
        "id": pa.concat_arrays([pa.array(ids), pa.array(counted)]), "other": pa.concat_arrays([pa.array(others), pa.nulls(len(counted), pa.int64())]),
        "n": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(counts)]),
    })


def _built(threshold: float):
    """A shard's graph, as a row of binaries, and the links within the shard, as rows by LINKED."""

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        ids, copies, vectors = table.column("cid").to_numpy()[order], table.column("copies").to_numpy()[order], _vectors(table.column("vector"), dim)[order]
        unit = _unit(vectors)
        graph = Graph(unit.astype(np.float32))
        bits, groups = Bits(len(ids)), Groups(len(ids))
        for i, hit in enumerate(lookup(graph, graph.vectors, threshold - SLACK)):
            hit = hit[unit[hit] @ unit[i] >= threshold]
            if len(hit) > 1 or (len(hit) and hit[0] != i):
                hit = np.append(hit, i)
                bits.put(i, hit)
                groups.join(hit)
        roots = np.array([groups.root(i) for i in range(len(ids))])
        on = np.nonzero(roots != np.arange(len(ids)))[0]
        links = _linked(ids[on], ids[roots[on]], ids, bits.sums(copies.astype(float)))
        none = pa.nulls(links.num_rows, pa.binary())
        own = {"dim": pa.int32(), "shard": pa.int32(), "ids": pa.binary(), "copies": pa.binary(), "vectors": pa.binary()}
        values = [dim, table.column("shard")[0].as_py(), ids.tobytes(), copies.astype(np.int64).tobytes(), vectors.tobytes()]
        head = pa.table({
            **{k: pa.array([v], t) for (k, t), v in zip(own.items(), values, strict=True)}, "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
            **{k: pa.nulls(1, pa.int64()) for k in ("id", "other", "n")},
        })
        rest = {k: none.cast(t) for k, t in own.items()} | {"links": pa.nulls(links.num_rows, pa.list_(pa.binary()))} | {k: links.column(k) for k in ("id", "other", "n")}
        return pa.concat_tables([head, pa.table(rest)])

    return build


def _looked(threshold: float):
    """Links between the vectors of one shard and the graph of another."""

    def look(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        if not queries.num_rows or not graphs.num_rows:
            return _linked([], [], [], [])
        dim, graph = graphs.column("dim")[0].as_py(), Graph.__new__(Graph)
        ids, copies = (np.frombuffer(graphs.column(c)[0].as_py(), np.int64) for c in ("ids", "copies"))
        unit = _unit(np.frombuffer(graphs.column("vectors")[0].as_py(), np.float64).reshape(-1, dim))
        graph.vectors = unit.astype(np.float32)
        graph.links = [np.frombuffer(x, np.int32).reshape(-1, LINKS) for x in graphs.column("links")[0].as_py()]
        graph.sizes = [len(x) for x in graph.links]
        own, own_copies, asked = queries.column("cid").to_numpy(), queries.column("copies").to_numpy(), _unit(_vectors(queries.column("vector"), dim))
        groups, mine, theirs, first = Groups(len(ids)), np.zeros(len(own), np.int64), np.zeros(len(ids), np.int64), {}
        for i, hit in enumerate(lookup(graph, asked.astype(np.float32), threshold - SLACK)):
            hit = hit[unit[hit] @ asked[i] >= threshold]
            if len(hit):
                mine[i] = copies[hit].sum()
                theirs[hit] += own_copies[i]
                first[i] = groups.join(hit)
        hits = np.nonzero(theirs)[0]
        pairs = [(own[i], ids[groups.root(x)]) for i, x in first.items()] + [(ids[x], ids[groups.root(x)]) for x in hits.tolist() if groups.root(x) != x]
        return _linked([a for a, _ in pairs], [b for _, b in pairs], np.concatenate([own, ids]), np.concatenate([mine, theirs]))

    return look


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding); other columns aren't read.

    Two rows link when the cosine of their vectors, in double precision, is ``threshold`` or more, exactly ``threshold``
    included. Null, empty and zero vectors and those with null or non-finite components link with nothing, and vectors
    of different lengths don't link. Every row counts: rows that repeat an id, with one vector or with several, are rows
    of their own under that id, and so are rows without one. component_id is the smallest id reachable, null where no
    row reachable has an id; kept is vec_id = component_id, two nulls being equal. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = written(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_packed, "vec_id long, vector binary"))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # numbers are given once, as the table is written
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "low", "copies", "vector", (F.octet_length("vector") / 8).cast("int").alias("dim"), F.xxhash64("vector").alias("place")))
    shards = {r["dim"]: -(-r["n"] // SHARD) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a length of vectors
    many = F.lit(1)
    for dim, k in shards.items():
        many = F.when(F.col("dim") == dim, k).otherwise(many)
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vector", F.lit(1)), many).cast("int")).withColumn("many", many)
    kind = "dim int, shard int, ids binary, copies binary, vectors binary, links array<binary>, " + LINKED
    built = written(dealt.select("dim", "shard", "cid", "copies", "vector", "place").groupBy("dim", "shard").applyInArrow(_built(threshold), kind))
    graphs, within = built.where("ids is not null"), built.where("ids is null").select("id", "other", "n")
    asked = dealt.withColumn("target", F.explode(F.sequence(F.col("shard"), F.col("many") - 1))).where("target > shard").select("dim", "target", "shard", "cid", "copies", "vector")
    # each graph goes to the shards before it, which are as many as the table's size over SHARD
    sent = graphs.select(F.col("dim").alias("gdim"), F.col("shard").alias("gtarget"), "dim", "ids", "copies", "vectors", "links").withColumn("gshard", F.explode(F.sequence(F.lit(0), F.col("gtarget")))).where("gshard < gtarget")
    between = asked.groupBy("dim", "target", "shard").cogroup(sent.groupBy("gdim", "gtarget", "gshard")).applyInArrow(_looked(threshold), LINKED)
    links = written(within.unionByName(between) if any(k > 1 for k in shards.values()) else within)
    counts = links.where("n is not null").groupBy(F.col("id").alias("cid")).agg(F.sum("n").alias("linked"))
    named = classes.select("cid", "low", "copies", "vector").join(counts, "cid", "left")
    named = named.join(components(links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = written(named)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    named = spread_join(named, lowest, "component", "size").select("vector", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = spread_join(rows, named, "vector")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
