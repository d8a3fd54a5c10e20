"""Texts of a drawing put to what they name: designators and values to symbols, net labels to wires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.functions import text as T
from netloom.operators import spatial, tiles
from netloom.plans.scratch import written

#: How far a text may stand from what it names, and what each wrong direction weighs.
REACH, PENALTY = 50.0, 1.5


def kinds(texts: DataFrame) -> DataFrame:
    """texts (page, text_id, text, bx0..by1) that are designators, values or net labels, with kind and centre."""
    t = F.col("text")
    kind = F.when(T.is_ref(t), "ref").when(T.is_value(t), "value").when(T.is_net_label(t), "net_label")
    x, y = G.midpoint("bx0", "by0", "bx1", "by1")
    return texts.withColumns({"kind": kind, "x": x, "y": y}).where("kind is not null").select("page", "text_id", "text", "kind", "x", "y")


def candidates(shapes: DataFrame, segments: DataFrame) -> DataFrame:
    """(page, sym, sx, sy, bx0..by1) of symbols: a page's shapes (page, shape, bx0..by1), or all its segments where it has no shape."""
    x, y = G.midpoint("bx0", "by0", "bx1", "by1")
    own = shapes.select("page", F.col("shape").alias("sym"), x.alias("sx"), y.alias("sy"), "bx0", "by0", "bx1", "by1")
    x, y = G.midpoint()
    rest = segments.join(shapes.select("page").distinct(), "page", "left_anti")
    rest = rest.select("page", F.col("seg").alias("sym"), x.alias("sx"), y.alias("sy"), F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    return own.unionByName(rest)


def to_symbols(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Designators and values with the symbol of least weighted distance within REACH, the first of equals.

    A designator is looked for to the left of and above its symbol, a value to the right and below: each coordinate on
    the other side weighs its distance by PENALTY. Symbols, which are fewer, stand in all cells that they reach, a text in one.
    """
    points = spatial.padded(texts.where("kind in ('ref', 'value')"), 0.0, "x", "y", "x", "y")
    places = symbols.groupBy("page", "sx", "sy").agg(F.min("sym").alias("sym"))  # of symbols at one place the first wins
    centres = spatial.padded(places, REACH * (1 + 1e-6), "sx", "sy", "sx", "sy")
    dx, dy = F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy")
    wrong = lambda d: F.when(F.when(F.col("kind") == "ref", d > 0).otherwise(d < 0), PENALTY).otherwise(1.0)
    pairs = spatial.meeting(points, centres).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= REACH)
    best = pairs.withColumn("score", F.col("distance") * (wrong(dx) * wrong(dy))).groupBy("page", "text_id", "text", "kind")
    found = best.agg(F.min(F.struct("score", "_sym", "_sx", "_sy", "distance")).alias("m"))
    return found.select("page", "text_id", "text", "kind", F.col("m._sx").alias("ax"), F.col("m._sy").alias("ay"), "m.distance", F.greatest(F.lit(0.0), 1 - F.col("m.distance") / REACH).alias("confidence"))


def to_wires(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Net labels with the middle of the nearest segment of kind line, less than REACH away, the first of equals."""
    lines = segments.where("kind = 'line'")
    x, y = G.midpoint()
    # the middle comes along with what is found: a join with all segments would shuffle them once more
    lines = lines.select("page", "seg", "x0", "y0", "x1", "y1", x.alias("ax"), y.alias("ay"))
    found = spatial.nearest(texts.where("kind = 'net_label'"), lines, ["text_id"], tiles.CORNERS, ["ax", "ay"], REACH).where(F.col("d2") < REACH * REACH)
    named = found.select("page", "text_id", F.col("_ax").alias("ax"), F.col("_ay").alias("ay"), "d2").join(texts.select("page", "text_id", "text", "kind"), ["page", "text_id"])
    return named.select("page", "text_id", "text", "kind", "ax", "ay", F.sqrt("d2").alias("distance"), F.greatest(F.lit(0.0), 1 - F.sqrt("d2") / REACH).alias("confidence"))


def associate(texts: DataFrame, shapes: DataFrame, segments: DataFrame) -> DataFrame:
    """(page, text_id, text, kind, ax, ay, distance, confidence) of every text that names something near enough; (ax, ay) is what it names."""
    named = written(kinds(texts))  # patterns are tried once
    return to_symbols(named, candidates(shapes, segments)).unionByName(to_wires(named, segments))
