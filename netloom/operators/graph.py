"""Graph operators: connected components, neighbours, shortest paths, greedy matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.scratch import drop, written
from netloom.plans.workers import ship

ship(__name__)

#: Links of a page that one task joins; pages with more are joined by the whole cluster.
PAGE_LINKS = 2_000_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that ``links`` (a, b) names.

    Large-star / small-star rounds over a written edge table; every round is one shuffle for each star and aggregates
    before it groups. No component is gathered into a list; the edges of one star's centre share a join key, whose other
    side is a single row, and which adaptive execution splits over tasks.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    for _ in range(rounds):
        # each node points at the smallest node it touches; larger neighbours are passed on to that node
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = written(small)
        # a forest of stars no longer changes: no node that is pointed at points on, and each points at one
        busy = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        split = busy or after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        drop(edges)
        edges = after
        if not split:
            break
    else:
        raise RuntimeError("connected components did not settle")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _joined(table: pa.Table) -> pa.Table:
    """(page, id, component) of one page's links: the least number spreads over links until nothing changes."""
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    page = table.column("page")
    return pa.table({"page": pa.chunked_array([page.combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(ids), np.int64)))]), "id": ids, "component": ids[label]})


def page_components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(page, id, component): the smallest id reachable on its page from each id that ``links`` (page, a, b) names.

    A page of at most ``most`` links is joined in one task, all pages at a time; larger ones by the rounds of components().
    """
    most = PAGE_LINKS if most is None else most
    links = written(links.select("page", F.col("a").cast("long"), F.col("b").cast("long")))
    large = links.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > most).select("page")
    kind = f"page {links.schema['page'].dataType.simpleString()}, id long, component long"
    if not large.limit(1).count():
        return links.groupBy("page").applyInArrow(_joined, kind)
    large = written(large)
    out = links.join(large, "page", "left_anti").groupBy("page").applyInArrow(_joined, kind)
    rest = links.join(large, "page", "left_semi")
    names = rest.select("page", F.col("a").alias("id")).unionByName(rest.select("page", F.col("b").alias("id"))).distinct()
    names = written(names.withColumn("number", F.monotonically_increasing_id()))  # numbers are given once, as the table is written
    of = lambda c: names.select("page", F.col("id").alias(c), F.col("number").alias(f"{c}n"))
    numbered = rest.join(of("a"), ["page", "a"]).join(of("b"), ["page", "b"]).select(F.col("an").alias("a"), F.col("bn").alias("b"))
    found = names.join(components(numbered).withColumnRenamed("id", "number"), "number", "left").withColumn("group", F.coalesce("component", "number")).drop("component")
    low = found.groupBy("group").agg(F.min("id").alias("component"))
    return out.unionByName(found.join(low, "group").select("page", "id", "component"))


def grouped(nodes: DataFrame, links: DataFrame, node: str, group: str, most: int | None = None) -> DataFrame:
    """nodes (page, ``node``, ...) with their component as ``group``, their own number where nothing links them."""
    found = page_components(links, most).select("page", F.col("id").alias(node), F.col("component").alias(group))
    return nodes.join(found, ["page", node], "left").withColumn(group, F.coalesce(group, node))


def neighbors(edges: DataFrame) -> DataFrame:
    """(node, other): components that share a net, through one self-join on the net."""
    left = edges.select("net", F.col("node"))
    right = edges.select("net", F.col("node").alias("other"))
    return left.join(right, "net").where("node <> other").select("node", "other").distinct()


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, length) of everything that the nodes of ``start`` reach in an undirected graph of (a, b), breadth first.

    A round is one join of the frontier, until it is empty; nodes seen before are anti-joined away, which in an
    undirected graph are those of the last two rounds. length counts edges.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = written(start.select("node").distinct().withColumn("length", F.lit(0)))
    before, front, length = seen.limit(0), seen, 0
    while front.limit(1).count():
        length += 1
        step = front.select(F.col("node").alias("a")).join(both, "a").select(F.col("b").alias("node")).distinct()
        last = front.select("node").unionByName(before.select("node"))
        before, front = front, written(step.join(last, "node", "left_anti").withColumn("length", F.lit(length)))
        seen = seen.unionByName(front)
        if length % 20 == 0:  # a plan of bounded size
            seen = written(seen)
    return seen


def greedy_match(pairs: DataFrame, rank: list[Column], left: str, right: str, by: list[str]) -> DataFrame:
    """One-to-one matching that takes pairs in the order of ``rank`` when both ends are free.

    In every round the pairs that come first at both of their ends are taken and their ends removed, which gives what
    the sequential scan gives, as ``rank`` is a total order within ``by``.
    """
    open_pairs, taken = written(pairs), None
    while open_pairs.limit(1).count():
        at = [F.row_number().over(Window.partitionBy(*by, end).orderBy(*rank)) for end in (left, right)]
        best = written(open_pairs.withColumns({"_l": at[0], "_r": at[1]}).where("_l = 1 and _r = 1").drop("_l", "_r"))
        rest = open_pairs.join(best.select(*by, left), [*by, left], "left_anti").join(best.select(*by, right), [*by, right], "left_anti")
        rest = written(rest)
        drop(open_pairs)
        open_pairs, taken = rest, best if taken is None else taken.unionByName(best)
    return pairs.limit(0) if taken is None else taken


def shortest_paths(edges: DataFrame, start: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, length, path) of a shortest way from one of ``start`` to each node of ``ends``, those reached at all.

    Breadth first over an undirected graph of (a, b); a node's parent is the least one of the level before, so that of
    several shortest ways one is always taken. Levels end when no wanted node is left or nothing new is reached. path is
    an array of nodes, both ends included; a start that is wanted is a path of length 0.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    kind = both.schema["a"].dataType.simpleString()
    levels = [written(start.select("node").distinct().withColumn("parent", F.lit(None).cast(kind)))]
    seen, wanted = levels[0].select("node"), ends.select("node").distinct()
    while levels[-1].limit(1).count() and wanted.join(seen, "node", "left_anti").limit(1).count():
        step = levels[-1].select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        near = levels[-1].select("node").unionByName(levels[-2].select("node")) if len(levels) > 1 else levels[-1].select("node")
        levels.append(written(step.join(near, "node", "left_anti")))
        seen = written(seen.unionByName(levels[-1].select("node")))
    out = None
    for length, level in enumerate(levels):
        ways = level.join(wanted, "node", "left_semi").select("node", F.lit(length).alias("length"), F.array("node").alias("path"), F.col("parent").alias("head"))
        for above in range(length - 1, -1, -1):  # back along the parents
            up = levels[above].select(F.col("node").alias("head"), F.col("parent").alias("next"))
            ways = ways.join(up, "head").select("node", "length", F.concat(F.array("head"), "path").alias("path"), F.col("next").alias("head"))
        ways = ways.select("node", "length", "path")
        ways = written(ways) if length > 4 else ways
        out = ways if out is None else out.unionByName(ways)
    return out
