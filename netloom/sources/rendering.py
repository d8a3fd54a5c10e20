"""The library's tables as rendered from the driver's star schema, every row of it.

A part is a component, an order a net, and a line item a pin that joins them. An order is also a place on one of 50 pages
(its number modulo 50), whose line items are segments with whole-numbered ends and whose label is a text; customers are
shapes. Two further pages are empty. The thin view wires only pins with a quantity of 1, so that components and nets
without a connection exist; it is for queries of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGES, EMPTY, SIDE = 50, 2, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the graph


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ref = F.concat(F.substring(F.lit("RCLDQUJ"), (F.col("p_partkey") % 7 + 1).cast("int"), F.lit(1)), F.col("p_partkey") % 1000)
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("node"), ref.alias("ref"), F.col("p_type").alias("class_name"), F.col("p_name").alias("value"))


def pins(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    net = F.concat(F.lit("o"), "l_orderkey")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("node"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("pin_id"), (F.when(F.col("l_quantity") <= 1, net) if thin else net).alias("net"))


def edges(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    """One edge for each component and net, with its last pin."""
    return pins(spark, sf_dir, thin).where("net is not null").groupBy("node", "net").agg(F.max("pin_id").alias("pin_id"))


RAILS = ("VCC", "GND", "+5V", "3V3", "AGND/A", "+12", "GND_A", "VCCA", "PWR", "-12V")


def nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of urgent orders are those of rails, or nearly; partly filled orders have none."""
    o = table(spark, sf_dir, "orders")
    rail = F.get(F.array(*map(F.lit, RAILS)), (F.col("o_orderkey") % len(RAILS)).cast("int"))
    name = F.when(F.col("o_orderpriority").startswith("1"), F.concat(rail, F.lit("/"), "o_orderkey")).when(F.col("o_orderstatus") != "P", F.concat(F.lit("Net-"), "o_orderkey"))
    return o.select(F.concat(F.lit("o"), "o_orderkey").alias("net"), name.alias("name"), F.col("o_orderkey").alias("ord"))


# ---- drawings


def pages(spark: SparkSession) -> DataFrame:
    return spark.range(PAGES + EMPTY).select(F.col("id").alias("page"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, seg, ends, kind, color of every line item: level where its number is odd, upright where even, slanted at 5, a curve at 7.

    Line items that repeat an order's line number are told apart by their other columns. Only those that a segment comes
    from cross the network: of line items that tie in them all, whichever is first gives the same rows.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x, y = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % SIDE).cast("double"), ((F.col("l_suppkey") * 53 + F.col("l_orderkey") * 17) % SIDE).cast("double")
    size, odd, slanted = F.floor("l_quantity").cast("double"), F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") == 5
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    rgb = lambda r, g: F.array(F.lit(r), F.lit(g), F.lit(0))
    color = F.when(F.col("l_partkey") % 11 == 0, F.lit(None)).when(~slanted & (F.col("l_suppkey") % 10 < 8), rgb(0, 132)).otherwise(rgb(132, 0))
    return li.select(
        (F.col("l_orderkey") % PAGES).alias("page"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + copy - 1).alias("seg"), x.alias("x0"), y.alias("y0"),
        (x + F.when(odd | slanted, size).otherwise(0.0)).alias("x1"), (y + F.when(~odd | slanted, size).otherwise(0.0)).alias("y1"),
        F.when(F.col("l_linenumber") == 7, "curve").otherwise("line").alias("kind"), color.alias("color"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, text_id, text and box of a text for every order: designators, values, net labels and plain ones."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kinds = [F.concat(F.substring(F.lit("RCLDQU"), (k % 6 + 1).cast("int"), F.lit(1)), k % 200), F.concat(k % 100, F.lit("k"), k % 10), F.concat(F.lit("+"), k % 30, F.lit("V")), F.concat(F.lit("NET_"), k % 31), F.concat(F.lit("BC"), k % 1000), F.concat(F.lit(" U"), k % 40, F.lit("A ")), F.lit("a b"), F.concat(F.lit("SIG"), k % 23)]
    text = F.concat(k % 50, F.lit(".5uF"))
    for n, kind in enumerate(kinds):
        text = F.when(k % 9 == n, kind).otherwise(text)
    x, y = ((F.col("o_custkey") * 29 + k * 3) % SIDE).cast("double"), ((k * 31) % SIDE).cast("double")
    return o.select((k % PAGES).alias("page"), k.alias("text_id"), text.alias("text"), (x - 8).alias("bx0"), (y - 3).alias("by0"), (x + 8).alias("bx1"), (y + 3).alias("by1"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, shape, kind, vertices, fill of every customer: small circles, some filled, rectangles and diamonds."""
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    x, y = ((k * 41) % SIDE).cast("double"), ((k * 67) % SIDE).cast("double")
    circle, rect = k % 3 == 0, k % 3 == 1
    w = F.when(circle, 1 + n % 4).otherwise(6 + n % 5).cast("double")
    h = F.when(rect, w / 2).otherwise(w)
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    zero = F.lit(0.0)
    vertices = F.when(circle, F.array(at(zero, zero), at(w, h))).when(rect, F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))).otherwise(F.array(at(w / 2, zero), at(w, h / 2), at(w / 2, h), at(zero, h / 2)))
    kind = F.when(circle, "circle").when(rect, "rect").otherwise("polygon")
    fill = F.when(circle & (n % 2 == 0), F.array(F.lit(0), F.lit(0), F.lit(0)))
    return c.select((k % PAGES).alias("page"), k.alias("shape"), kind.alias("kind"), vertices.alias("vertices"), fill.alias("fill"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in pixels at 144 dots an inch around every supplier's place on a page."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x, y, w = ((k * 97) % SIDE).cast("double"), ((k * 59) % SIDE).cast("double"), (30 + F.col("s_nationkey")).cast("double")
    at = lambda v: v * 2.0
    return s.select(
        (k % PAGES).alias("page"), k.alias("box"), F.when(k % 2 == 0, "resistor").otherwise("ic").alias("class_name"), (0.5 + (k % 50) / 100).alias("confidence"), F.when(k % 4 == 0, F.concat(F.lit("X"), k)).alias("ref"),
        at(x).alias("px0"), at(y).alias("py0"), at(x + w).alias("px1"), at(y + w).alias("py1"),
    )
