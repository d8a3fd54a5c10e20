"""Graphs as text: structural netlists, exports, schematics, detector labels.

A graph is components (page, cluster, ref, value, class_name, confidence, bx0..by1), pins (page, cluster, pin, x, y, net)
and nets (page, net, number, name, n_segments), as page.build() returns it. Nets are called N and their number. Lines
come with a page and a place, so that a page's file is its lines in that order; save() writes a folder a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NET = "concat('N', number)"


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _joined(value: Column, order: Column | str) -> Column:
    """A group's strings in order, joined by spaces. A component has few pins, a net's nodes are lines of their own."""
    order = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), " ")


def pin_ids(parts: DataFrame, pins: DataFrame, nets: DataFrame) -> DataFrame:
    """pins with ref, pin_id (ref and number) and net_id, null for an unwired one."""
    named = nets.select("page", "net", F.expr(NET).alias("net_id"))
    out = pins.join(parts.select("page", "cluster", "ref", "class_name", "value"), ["page", "cluster"]).join(named, ["page", "net"], "left")
    return out.withColumn("pin_id", F.concat_ws("_", "ref", "pin"))


def spice(parts: DataFrame, pins: DataFrame, nets: DataFrame) -> DataFrame:
    """(page, place, line): a heading, a line a component with the nets of its pins in order, unwired ones by their own names, and .end."""
    rows = pin_ids(parts, pins, nets).groupBy("page", "cluster").agg(_joined(F.coalesce("net_id", "pin_id"), "pin").alias("pins"))
    body = parts.join(rows, ["page", "cluster"], "left").select("page", F.lit(1).alias("part"), "cluster", F.concat_ws(" ", "ref", F.coalesce("pins", F.lit("")), "class_name").alias("line"))
    pages = parts.select("page").distinct()
    around = pages.select("page", F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(k).cast("long").alias("cluster"), F.lit(t).alias("line")) for p, k, t in ((0, 0, "* Structural netlist"), (0, 1, ""), (2, 0, ""), (2, 1, ".end"))))))
    return _placed(body.unionByName(around), ["part", "cluster"])


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("page").orderBy(*order))
    return rows.select("page", place.alias("place"), "line")


def netlist(parts: DataFrame, pins: DataFrame, nets: DataFrame) -> DataFrame:
    """(page, place, line) of an S-expression netlist: components with their values, then nets with their nodes."""
    f = lambda fmt, *c: F.format_string(fmt, *c)
    pages = parts.select("page").union(nets.select("page")).distinct()
    fixed = ((0, "(export (version D)"), (1, "  (design"), (2, '    (source "extracted.pdf")'), (3, "  )"), (4, "  (components"), (6, "  )"), (7, "  (nets"), (9, "  )"), (10, ")"))
    around = pages.select("page", F.inline(F.array(*(F.struct(F.lit(p).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c"), F.lit("").alias("d"), F.lit(t).alias("line")) for p, t in fixed))))
    three = lambda *lines: F.inline(F.array(*(F.struct(F.lit(k).alias("c"), x.alias("line")) for k, x in enumerate(lines))))
    value = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("class_name"))
    comps = parts.select("page", F.lit(5).alias("a"), F.col("cluster").alias("b"), F.lit("").alias("d"), three(f('    (comp (ref "%s")', "ref"), f('      (value "%s")', value), F.lit("    )")))
    heads = nets.select("page", F.lit(8).alias("a"), F.col("number").alias("b"), F.inline(F.array(
        F.struct(F.lit(0).alias("c"), f('    (net (code "%s") (name "%s")', "number", F.coalesce("name", F.expr(NET))).alias("line")), F.struct(F.lit(2).alias("c"), F.lit("    )").alias("line")))), F.lit("").alias("d"))
    nodes = pin_ids(parts, pins, nets).join(nets.select("page", "net", "number"), ["page", "net"])
    nodes = nodes.select("page", F.lit(8).alias("a"), F.col("number").alias("b"), F.lit(1).alias("c"), F.col("pin_id").alias("d"), f('      (node (ref "%s") (pin "%s"))', "ref", F.col("pin").cast("string")).alias("line"))
    rows = around
    for more in (comps, heads, nodes):
        rows = rows.unionByName(more)
    return _placed(rows, ["a", "b", "c", "d"])


def graph_json(parts: DataFrame, pins: DataFrame, nets: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, section, item, json): an object for each component with its pins, each net and each edge of a graph.

    A graph of any size is a table of objects; a page's file has those of a section as an array.
    """
    ids = pin_ids(parts, pins, nets)
    pin = F.struct(F.col("pin").alias("o"), F.struct("pin_id", F.array("x", "y").alias("position"), F.col("net_id").alias("net")).alias("v"))
    own = ids.groupBy("page", "cluster").agg(F.transform(F.array_sort(F.collect_list(pin)), lambda s: s["v"]).alias("pins"))
    comps = parts.join(own, ["page", "cluster"], "left").select("page", F.lit("components").alias("section"), F.col("cluster").alias("item"), F.to_json(
        F.struct("ref", F.col("class_name").alias("class"), "value", "confidence", F.array("bx0", "by0", "bx1", "by1").alias("bbox"), F.coalesce("pins", F.array().cast(own.schema["pins"].dataType)).alias("pins"))).alias("json"))
    named = nets.select("page", F.lit("nets").alias("section"), F.col("net").alias("item"), F.to_json(F.struct(F.expr(NET).alias("net_id"), "name", F.lit(False).alias("is_global"), F.col("n_segments").alias("segments"))).alias("json"))
    both = edges.join(parts.select("page", "cluster", "ref"), ["page", "cluster"]).join(nets.select("page", "net", F.expr(NET).alias("net_id")), ["page", "net"])
    linked = both.select("page", F.lit("edges").alias("section"), F.col("cluster").alias("item"), F.to_json(F.struct(F.col("ref").alias("comp"), F.col("net_id").alias("net"))).alias("json"))
    return comps.unionByName(named).unionByName(linked)


def net_json(found: DataFrame, names: DataFrame, labels: DataFrame, junctions: DataFrame) -> DataFrame:
    """(page, section, item, json) of rebuilt nets: each with its id, name, segments and labels; then junctions, drawn or not.

    found: page, net, seg, x0..y1; labels: page, net, label, text, is_global; junctions: page, x, y, explicit.
    """
    point = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    segs = found.groupBy("page", "net").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.struct(point(0).alias("start"), point(1).alias("end")).alias("v")))), lambda s: s["v"]).alias("segments"))
    on = labels.groupBy("page", "net").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", F.struct("text", F.col("is_global").alias("global")).alias("v")))), lambda s: s["v"]).alias("labels"))
    rows = segs.join(names, ["page", "net"]).join(on, ["page", "net"], "left")
    nets = rows.select("page", F.lit("nets").alias("section"), F.col("net").alias("item"), F.to_json(F.struct(F.col("net").alias("id"), "name", "segments", F.coalesce("labels", F.array().cast(on.schema["labels"].dataType)).alias("labels"))).alias("json"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("x", "y")).cast("long")
    return nets.unionByName(junctions.select("page", F.lit("junctions").alias("section"), place.alias("item"), F.to_json(F.struct("x", "y", "explicit")).alias("json")))


def schematic(wires: DataFrame, junctions: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, place, line) of a schematic's S-expressions: junctions, wires and labels between a fixed head and end."""
    number = lambda c: F.col(c).cast("string")
    pages = wires.select("page").union(junctions.select("page")).union(labels.select("page")).distinct()
    fixed = ((0, "(kicad_sch (version 20211123) (generator eeschema)"), (1, '  (uuid "00000000-0000-0000-0000-000000000000")'), (2, '  (paper "A4")'), (3, "  (lib_symbols)"), (7, "  (sheet_instances"), (8, '    (path "/" (page "1"))'), (9, "  )"), (10, ")"))
    rows = pages.select("page", F.inline(F.array(*(F.struct(F.lit(p).alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("d"), F.lit(t).alias("line")) for p, t in fixed))))
    at = F.row_number().over(Window.partitionBy("page").orderBy("x", "y")).cast("long")
    rows = rows.unionByName(junctions.select("page", F.lit(4).alias("a"), at.alias("b"), F.lit("").alias("d"), F.format_string("  (junction (at %s %s))", number("x"), number("y")).alias("line")))
    uuid = F.lpad((F.row_number().over(Window.partitionBy("page").orderBy("seg")) - 1).cast("string"), 12, "0")
    wire = F.format_string('  (wire (pts (xy %s %s) (xy %s %s)) (uuid "00000000-0000-0000-0000-%s"))', *(number(c) for c in ("x0", "y0", "x1", "y1")), uuid)
    rows = rows.unionByName(wires.select("page", F.lit(5).alias("a"), F.col("seg").cast("long").alias("b"), F.lit("").alias("d"), wire.alias("line")))
    kind = F.when(F.col("is_global"), "global_label").otherwise("label")
    rows = rows.unionByName(labels.select("page", F.lit(6).alias("a"), F.col("label").cast("long").alias("b"), F.lit("").alias("d"), F.format_string('  (%s "%s" (at %s %s))', kind, "text", number("x"), number("y")).alias("line")))
    return _placed(rows, ["a", "b", "d"])


def save(lines: DataFrame, path: str) -> None:
    """Writes (page, place, line) as text, a folder a page, its lines in order."""
    lines.repartition("page").sortWithinPartitions("page", "place").select("page", F.col("line").alias("value")).write.partitionBy("page").mode("overwrite").text(path)


def box_labels(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """(page, box, line) of detector labels: class number, centre and size as shares of the page (px0..py1, width, height), six decimals."""
    number = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col("class_name")) - 1, F.lit(-1)).cast("int")
    share = lambda a, b, size, f: f(F.col(a), F.col(b)) / F.col(size)
    middle, span = (lambda a, b: (a + b) / 2), (lambda a, b: b - a)
    values = [share("px0", "px1", "width", middle), share("py0", "py1", "height", middle), share("px0", "px1", "width", span), share("py0", "py1", "height", span)]
    return boxes.where((F.col("px1") > F.col("px0")) & (F.col("py1") > F.col("py0"))).select("page", "box", F.format_string("%d %.6f %.6f %.6f %.6f", number, *values).alias("line"))


def symbol_boxes(pins: DataFrame, dpi: float = 150.0, margin_mm: float = 1.27) -> DataFrame:
    """(board, ref, px0, py0, px1, py1) around the pins (board, ref, x, y in mm) of real parts, in pixels and wider by a margin."""
    scale = dpi / 25.4
    at = lambda f, c, sign: f(c) * scale + sign * margin_mm * scale
    return pins.where(~F.col("ref").startswith("#")).groupBy("board", "ref").agg(
        at(F.min, "x", -1).alias("px0"), at(F.min, "y", -1).alias("py0"), at(F.max, "x", 1).alias("px1"), at(F.max, "y", 1).alias("py1"),
    )


def every_fifth(names: DataFrame, name: str, parts: int = 64) -> DataFrame:
    """names with place, from 0 in the order of the names, and split: val for every fifth from the first, else train.

    Names are dealt by ranges, counted by range, and ranked within it: no task has them all.
    """
    dealt = names.repartitionByRange(parts, name).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(name)))
    sums = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    place = F.col("_base") + F.col("_row") - 1
    return dealt.join(F.broadcast(sums.select("_part", "_base")), "_part").withColumn("place", place).withColumn("split", F.when(place % 5 == 0, "val").otherwise("train")).drop("_part", "_row", "_base")
