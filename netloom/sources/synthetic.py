"""Schematics made by rule: ladders, bridges and meshes of any number and size, as tables of wires, junctions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "page string, label long, text string, x double, y double, is_global boolean"


def ladders(spark: SparkSession, stages: list[int], spacing: float = 10.0, x: float = 50.0, y: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(wires, labels) of a ladder for each number of stages: a rail in ``stages`` steps, a branch to ground from the middle of all but the last."""
    base = spark.createDataFrame([(f"resistor_ladder_{n}", n) for n in stages], "page string, n int")
    steps = base.select("page", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    left = x + F.col("i") * spacing
    middle = left + spacing / 2
    wire = lambda seg, x0, y0, x1, y1: F.struct(seg.cast("long").alias("seg"), *(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))
    rail = steps.select("page", F.inline(F.array(wire(2 * F.col("i"), left, y, left + spacing, y))))
    branch = steps.where("i < n - 1").select("page", F.inline(F.array(wire(2 * F.col("i") + 1, middle, y, middle, y + spacing / 2))))
    label = lambda rows, number, text, at, py: rows.select("page", number.cast("long").alias("label"), F.lit(text).alias("text"), at.alias("x"), F.lit(float(py)).alias("y"), F.lit(True).alias("is_global"))
    labels = label(steps.where("i < n - 1"), F.col("i"), "GND", middle, y + spacing / 2).unionByName(label(base, F.col("n"), "VCC", F.lit(float(x)), y)).unionByName(label(base, F.col("n") + 1, "GND", x + F.col("n") * spacing, y))
    return rail.unionByName(branch), labels


def bridges(spark: SparkSession, sizes: list[float], x: float = 50.0, y: float = 50.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wires, junctions, labels) of a bridge rectifier of each size; places are multiples of the size."""
    wires = [(0, 0, 0.5, 0), (0, 1, 0.5, 1), (0.5, 0, 1, 0.5), (0.5, 1, 1, 0.5), (1, 0.5, 1.5, 0.5), (1, 0.5, 1, 1.5)]
    labels = [("AC_IN", 0, 0.5), ("VCC", 1.5, 0.5), ("GND", 1, 1.5)]
    name = [(f"bridge_rectifier_{s:g}", float(s)) for s in sizes]
    made = spark.createDataFrame([(n, i, *(c + s * v for c, v in zip((x, y, x, y), w, strict=True))) for n, s in name for i, w in enumerate(wires)], "page string, seg long, x0 double, y0 double, x1 double, y1 double")
    dots = spark.createDataFrame([(n, x + s, y + s / 2) for n, s in name], "page string, x double, y double")
    named = spark.createDataFrame([(n, i, t, x + s * a, y + s * b, True) for n, s in name for i, (t, a, b) in enumerate(labels)], LABEL)
    return made, dots, named


def meshes(spark: SparkSession, shapes: list[tuple[int, int, int]], area: float = 100.0, x: float = 50.0, y: float = 50.0) -> DataFrame:
    """wires of a mesh for each (nodes, edges, seed): a chain through all nodes, the rest between nodes drawn by the seed.

    Places and ends come from hashes of the seed, so a mesh is the same on every cluster.
    """
    base = spark.createDataFrame([(f"random_mesh_{n}_{e}", n, e, s) for n, e, s in shapes], "page string, n int, e int, seed int")
    even = lambda *c: F.pmod(F.xxhash64("seed", *c), F.lit(1 << 40)) / float(1 << 40)
    at = lambda node, axis, origin: origin + area * even(node, F.lit(axis))
    rows = base.select("page", "n", "seed", F.explode(F.sequence(F.lit(0), F.col("e") - 1)).alias("i"))
    chain = F.col("i") < F.col("n") - 1
    first = F.when(chain, F.col("i")).otherwise(F.floor(even(F.lit("a"), F.col("i")) * F.col("n")).cast("int"))
    step = 1 + F.floor(even(F.lit("b"), F.col("i")) * (F.col("n") - 1)).cast("int")
    rows = rows.withColumn("a", first).withColumn("b", F.when(chain, F.col("i") + 1).otherwise((F.col("a") + step) % F.col("n")))
    return rows.select("page", F.col("i").cast("long").alias("seg"), at("a", 0, x).alias("x0"), at("a", 1, y).alias("y0"), at("b", 0, x).alias("x1"), at("b", 1, y).alias("y1"))
