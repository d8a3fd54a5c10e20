"""Schematics written as S-expressions, as tables of wires, junctions, labels, symbols and pins, and their true nets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators import spatial
from netloom.operators.graph import page_components
from netloom.plans.scratch import written
from netloom.plans.workers import ship

ship(__name__)

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()"]+')
SCHEMA = "board string, kind string, name string, part string, x double, y double, x1 double, y1 double, turn double, mirror string"


def parse(text: str) -> list:
    """Nested lists of atoms; brackets that close nothing are an error, brackets left open are closed."""
    stack: list[list] = [[]]
    for token in TOKEN.findall(text):
        if token == "(":
            stack.append([])
        elif token == ")":
            done = stack.pop()
            if not stack:
                raise ValueError("a bracket closes nothing")
            stack[-1].append(done)
        else:
            stack[-1].append(token[1:-1] if token[0] == '"' else token)
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


def _named(node: list, name: str) -> list[list]:
    return [x for x in node if isinstance(x, list) and x and x[0] == name]


def _numbers(node: list, name: str, n: int) -> list[float]:
    found = _named(node, name)
    values = [float(v) for v in found[0][1:] if isinstance(v, str)][:n] if found else []
    return values + [0.0] * (n - len(values))


def _library_pins(node: list):
    for pin in _named(node, "pin"):
        number = _named(pin, "number")
        yield (number[0][1] if number else (pin[1] if len(pin) > 1 and isinstance(pin[1], str) else ""), *_numbers(pin, "at", 2))
    for inner in _named(node, "symbol"):
        yield from _library_pins(inner)


def records(board: str, text: str):
    """Rows by SCHEMA of one schematic."""
    trees = [t for t in parse(text) if isinstance(t, list) and t]
    root = trees[0] if trees else []
    for library in _named(root, "lib_symbols"):
        for symbol in _named(library, "symbol"):
            for number, x, y in _library_pins(symbol):
                yield board, "lib_pin", symbol[1], number, x, y, None, None, None, None
    for wire in _named(root, "wire"):
        points = [p for pts in _named(wire, "pts") for p in _named(pts, "xy")]
        if len(points) > 1:
            (x, y), (x1, y1) = ([float(v) for v in p[1:3]] for p in points[:2])
            yield board, "wire", None, None, x, y, x1, y1, None, None
    for junction in _named(root, "junction"):
        yield board, "junction", None, None, *_numbers(junction, "at", 2), None, None, None, None
    for kind in ("label", "global_label"):
        for label in _named(root, kind):
            yield board, kind, label[1] if len(label) > 1 and isinstance(label[1], str) else "", None, *_numbers(label, "at", 2), None, None, None, None
    for symbol in _named(root, "symbol"):
        ref = next((p[2] for p in _named(symbol, "property") if len(p) > 2 and p[1] == "Reference"), "")
        library = _named(symbol, "lib_id")
        x, y, turn = _numbers(symbol, "at", 3)
        mirror = _named(symbol, "mirror")
        yield board, "symbol", ref, library[0][1] if library else "", x, y, None, None, turn, mirror[0][1] if mirror else None
        for pin in _named(symbol, "pin"):
            if _named(pin, "at"):
                yield board, "pin", ref, pin[1], *_numbers(pin, "at", 2), None, None, None, None


def files(spark: SparkSession, path: str) -> DataFrame:
    """(board, value) of the schematics under a path. A board is a file's whole path without its ending, so that equal names in different folders stay apart."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"\.[^./]*$", "").alias("board"), F.col("value"))


def boards(spark: SparkSession, path: str, endings: tuple[str, ...] = ("pdf", "kicad_sch")) -> DataFrame:
    """(folder, a column an ending): the first file of each ending, of folders under a path that have them all."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    listed = listed.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ending"))
    found = listed.groupBy("folder").agg(*(F.min(F.when(F.col("ending") == e, F.col("path"))).alias(e) for e in endings))
    return found.dropna(subset=list(endings))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the schematics under a path, a file a board."""
    return parsed(files(spark, path))


def parsed(texts: DataFrame) -> DataFrame:
    """All records of schematics given as text (board, value)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string()] * 4 + [pa.float64()] * 5 + [pa.string()]

    def each(batches):
        for batch in batches:
            rows = [r for b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in records(b, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return texts.select("board", "value").mapInArrow(each, SCHEMA)


NUMBER = r"(-?[0-9.]+)"


def scanned(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wires, junctions, labels) of schematics given as text (board, value), found by patterns alone, whatever surrounds them.

    wires: page, seg, x0..y1, kind; junctions: page, x, y, explicit; labels: page, label, text, x, y, is_global. A label's
    place is looked for on its own line.
    """
    t = texts.select(F.col("board").alias("page"), F.col("value"))

    def found(pattern: str, groups: int) -> DataFrame:
        parts = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(pattern), F.lit(k + 1)).alias(f"g{k}") for k in range(groups)))
        return t.select("page", F.posexplode(parts).alias("place", "m")).select("page", F.col("place").cast("long").alias("place"), "m.*")

    d = lambda k: F.col(f"g{k}").cast("double")
    wires = found(rf"\(wire\s+\(pts\s+\(xy\s+{NUMBER}\s+{NUMBER}\)\s+\(xy\s+{NUMBER}\s+{NUMBER}\)", 4).select("page", F.col("place").alias("seg"), d(0).alias("x0"), d(1).alias("y0"), d(2).alias("x1"), d(3).alias("y1"), F.lit("line").alias("kind"))
    dots = found(rf"\(junction\s+\(at\s+{NUMBER}\s+{NUMBER}", 2).select("page", d(0).alias("x"), d(1).alias("y"), F.lit(True).alias("explicit"))
    labels = found(rf'\((global_label|label)\s+"([^"]*)".*?\(at\s+{NUMBER}\s+{NUMBER}', 4)
    return wires, dots, labels.select("page", F.col("place").alias("label"), F.col("g1").alias("text"), d(2).alias("x"), d(3).alias("y"), (F.col("g0") == "global_label").alias("is_global"))


def symbol_blocks(texts: DataFrame) -> DataFrame:
    """(board, ref, value, x, y) of placed symbols: each bracketed block that begins with symbol and has a place and a Reference of its own."""
    names = ["board", "ref", "value", "x", "y"]

    def each(batches):
        for batch in batches:
            out = []
            for board, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trees = [t for t in parse(text or "") if isinstance(t, list)]
                for symbol in (s for t in trees for s in _named(t, "symbol")):
                    own = {p[1]: p[2] for p in _named(symbol, "property") if len(p) > 2 and isinstance(p[1], str)}
                    if _named(symbol, "at") and own.get("Reference"):
                        out.append((board, own["Reference"], own.get("Value", ""), *_numbers(symbol, "at", 2)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.string()] * 3 + [pa.float64()] * 2)], names=names)

    return texts.select("board", "value").mapInArrow(each, "board string, ref string, value string, x double, y double")


def placed_pins(rows: DataFrame) -> DataFrame:
    """(board, ref, pin, x, y): a symbol's own pins, else those of its library part mirrored, turned and moved."""
    symbols = rows.where("kind = 'symbol'").select("board", F.col("name").alias("ref"), "part", "x", "y", "turn", "mirror")
    own = rows.where("kind = 'pin'").select("board", F.col("name").alias("ref"), F.col("part").alias("pin"), "x", "y")
    library = rows.where("kind = 'lib_pin'").select("board", F.col("name").alias("part"), F.col("part").alias("pin"), F.col("x").alias("px"), F.col("y").alias("py"))
    px = F.when(F.col("mirror") == "x", -F.col("px")).otherwise(F.col("px"))
    py = F.when(F.col("mirror") == "y", -F.col("py")).otherwise(F.col("py"))
    c, s = F.cos(F.radians("turn")), F.sin(F.radians("turn"))
    moved = symbols.join(own.select("board", "ref").distinct(), ["board", "ref"], "left_anti").join(library, ["board", "part"])
    return own.unionByName(moved.select("board", "ref", "pin", (F.col("x") + px * c - py * s).alias("x"), (F.col("y") + px * s + py * c).alias("y")))


def _places(rows: DataFrame) -> DataFrame:
    """Coordinates to three decimals, as whole thousandths."""
    return rows.withColumns({c: F.bround(F.col(c) * 1000).cast("long") for c in ("x", "y", "x1", "y1") if c in rows.columns})


def true_nets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pins (board, net, name, ref, pin), counts (board, net_count)) of a schematic's own nets.

    Wires join their ends; a junction within a wire joins it to what meets there; a wire's middle joins nothing else. A
    net's name is the last label at one of its places, local ones before global ones, else GT_NET_ and its number; nets
    of one name are one. net_count counts groups of places before that, those of pins and labels alone too.
    """
    wires = _places(rows.where("kind = 'wire'").select("board", "x", "y", "x1", "y1")).distinct()
    wires = written(wires)
    dots = _places(rows.where("kind = 'junction'").select("board", "x", "y")).distinct()
    at = lambda t: t.select(F.col("board").alias("page"), *(c for c in t.columns if c != "board"))
    near = spatial.meeting(spatial.padded(at(dots), 1.0, "x", "y", "x", "y"), spatial.padded(at(wires).withColumnsRenamed({"x": "x0", "y": "y0"}).withColumnRenamed("x1", "x9").withColumnRenamed("y1", "y9"), 0.0, "x0", "y0", "x9", "y9"), 4096.0)
    a, b = F.hypot(F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0")), F.hypot(F.col("x") - F.col("_x9"), F.col("y") - F.col("_y9"))
    whole = F.hypot(F.col("_x9") - F.col("_x0"), F.col("_y9") - F.col("_y0"))
    on = near.where((F.abs(a + b - whole) < 1.0) & (a > 0) & (b > 0)).select(F.col("page").alias("board"), F.col("_x0").alias("x"), F.col("_y0").alias("y"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pins = _places(placed_pins(rows))
    labels = _places(rows.where("kind in ('label', 'global_label')").select("board", "kind", "name", "x", "y")).withColumn("order", F.struct((F.col("kind") == "global_label").alias("g"), F.monotonically_increasing_id().alias("i")))
    labels = written(labels)
    links = wires.select("board", "x", "y", "x1", "y1").unionByName(on)
    places = links.select("board", "x", "y").unionByName(links.select("board", F.col("x1").alias("x"), F.col("y1").alias("y"))).unionByName(pins.select("board", "x", "y")).unionByName(labels.select("board", "x", "y")).distinct()
    places = written(places.withColumn("id", F.monotonically_increasing_id()))
    end = places.select("board", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("id").alias("b"))
    joined = links.join(places, ["board", "x", "y"]).join(end, ["board", "x1", "y1"]).select(F.col("board").alias("page"), F.col("id").alias("a"), "b")
    found = page_components(joined).select(F.col("page").alias("board"), "id", "component")
    places = written(places.join(found, ["board", "id"], "left").withColumn("net", F.coalesce("component", "id")).select("board", "x", "y", "net"))
    counts = places.groupBy("board").agg(F.count_distinct("net").alias("net_count"))
    names = labels.join(places, ["board", "x", "y"]).groupBy("board", "net").agg(F.max(F.struct("order", "name")).alias("m")).select("board", "net", F.col("m.name").alias("label"))
    number = F.dense_rank().over(Window.partitionBy("board").orderBy("net"))
    own = pins.join(places, ["board", "x", "y"]).join(names, ["board", "net"], "left").withColumn("name", F.coalesce("label", F.concat(F.lit("GT_NET_"), number)))
    return own.withColumn("net", F.min("net").over(Window.partitionBy("board", "name"))).select("board", "net", "name", "ref", "pin"), counts


def true_memberships(pins: DataFrame) -> DataFrame:
    """(board, net, ref) of real parts: power ports and flags, whose names begin with #, are no parts."""
    return pins.where(~F.col("ref").startswith("#")).select("board", F.col("name").alias("net"), "ref").distinct()
