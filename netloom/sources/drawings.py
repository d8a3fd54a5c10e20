"""Drawings as rows: what a document reader, a text recogniser or a detector gives, turned into segments, shapes and texts.

No reader of documents is part of the library. Its contract is these tables, which any reader can write:
drawings (page, drawing, color array<double>, width, fill array<double>, rect struct<x0,y0,x1,y1>, items array<struct<kind,
points array<struct<x,y>>>>), kinds being l (line: 2 points), c (curve: 4), re (rectangle: 2 corners) and qu (4 corners);
spans (page, block_type, line, span, text, size, font, flags, bx0, by0, bx1, by1);
recognised (page, row, points array<struct<x,y>>, text, confidence) in pixels;
documents (doc, producer, creator, first_page).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.functions import text as T

#: Native characters of a page below which its texts are taken from the picture, and how sure a recogniser has to be.
LEAST_CHARACTERS, LEAST_CONFIDENCE = 16, 0.5


def filled_circles(drawings: DataFrame) -> DataFrame:
    """(page, shape, kind, vertices, fill) of drawings that are one filled circle: curves only, a box as wide as high within a fifth."""
    w, h = F.col("rect.x1") - F.col("rect.x0"), F.col("rect.y1") - F.col("rect.y0")
    fill = F.transform(F.when(F.size("fill") == 1, F.concat("fill", "fill", "fill")).otherwise(F.slice("fill", 1, 3)), lambda v: F.floor(v * 255).cast("int"))
    ok = F.col("fill").isNotNull() & F.size("fill").isin(1, 3, 4) & (F.size("items") > 0) & F.forall("items", lambda i: i["kind"] == "c") & (w > 0) & (h > 0) & (F.abs(w - h) <= 0.2 * F.greatest(w, h))
    corner = lambda k: F.struct(F.col(f"rect.x{k}").alias("x"), F.col(f"rect.y{k}").alias("y"))
    return drawings.where(F.coalesce(ok, F.lit(False))).select("page", (F.col("drawing") * 1024).alias("shape"), F.lit("circle").alias("kind"), F.array(corner(0), corner(1)).alias("vertices"), fill.alias("fill"))


def items(drawings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, shapes) of all drawings that are no filled circle. Curves are their chords; other kinds are left out.

    Numbers are a drawing's times 1024 and the item's place, which a drawing of more items than that would outgrow.
    """
    circles = filled_circles(drawings).select("page", (F.col("shape") / 1024).cast("long").alias("drawing"))
    rest = drawings.withColumn("drawing", F.col("drawing").cast("long")).join(circles, ["page", "drawing"], "left_anti")
    rows = rest.select("page", "drawing", G.rgb255(F.col("color")).alias("color"), F.coalesce("width", F.lit(0.0)).alias("width"), F.posexplode("items").alias("place", "item"))
    rows = rows.select("page", (F.col("drawing") * 1024 + F.col("place")).alias("id"), "color", "width", "item.kind", "item.points")
    point = lambda i, v: F.get(F.col("points"), F.lit(i))[v]
    last = F.when(F.col("kind") == "c", 3).otherwise(1)
    lines = rows.where("kind in ('l', 'c')").select(
        "page", F.col("id").alias("seg"), point(0, "x").alias("x0"), point(0, "y").alias("y0"), F.get("points", last)["x"].alias("x1"), F.get("points", last)["y"].alias("y1"),
        F.when(F.col("kind") == "c", "curve").otherwise("line").alias("kind"), "color", "width",
    )
    corner = lambda i, j: F.struct(point(i, "x").alias("x"), point(j, "y").alias("y"))
    square = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    shapes = rows.where("kind in ('re', 'qu')").select(
        "page", F.col("id").alias("shape"), F.when(F.col("kind") == "re", "rect").otherwise("polygon").alias("kind"), F.when(F.col("kind") == "re", square).otherwise(F.col("points")).alias("vertices"),
        F.lit(None).cast("array<int>").alias("fill"),
    )
    return lines, shapes


def text_blocks(spans: DataFrame) -> DataFrame:
    """(page, line, text_id, text, bx0, by0, bx1, by1, size, font, bold): spans of a line with gaps of less than 0.6 of its mean size between them, as one.

    Spans stand by their left edges; blocks of pictures and those that are blank are left out, and what is joined is trimmed.
    """
    own = spans.where("block_type = 0")
    by = Window.partitionBy("page", "line")
    order = by.orderBy("bx0", "span")
    gap = F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))).over(by), F.lit(10.0)) * 0.6
    new = F.when(F.col("bx0") - F.lag("bx1").over(order) < gap, 0).otherwise(1)
    cut = own.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("bx0", "span", F.coalesce("text", F.lit("")).alias("t"), "bx1", "size", "font", "flags")
    joined = cut.groupBy("page", "line", "island").agg(F.array_sort(F.collect_list(place)).alias("l"), F.min("by0").alias("by0"), F.max("by1").alias("by1"))  # spans of a line
    first, last = F.get("l", F.lit(0)), F.element_at("l", -1)
    out = joined.withColumn("text", F.trim(F.array_join(F.transform("l", lambda s: s["t"]), ""))).where("text <> ''")
    return out.select(
        "page", "line", F.col("island").cast("int").alias("text_id"), "text", first["bx0"].alias("bx0"), "by0", last["bx1"].alias("bx1"), "by1", first["size"].alias("size"), first["font"].alias("font"),
        (F.coalesce(first["flags"], F.lit(0)).bitwiseAND(16) > 0).alias("bold"),
    )


def recognised_blocks(rows: DataFrame, dpi: float = 72.0, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(page, text_id, text, bx0..by1, size) of a recogniser's rows, in points; blank, unsure and malformed ones are left out. No confidence is a sure one."""
    scale = dpi / 72.0
    ok = (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("confidence", F.lit(1.0)) >= least) & (F.size("points") > 0) & F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    side = lambda f, v: f(F.transform("points", lambda p: p[v])) / scale
    out = rows.where(F.coalesce(ok, F.lit(False))).select("page", F.col("row").alias("text_id"), F.trim("text").alias("text"), side(F.array_min, "x").alias("bx0"), side(F.array_min, "y").alias("by0"), side(F.array_max, "x").alias("bx1"), side(F.array_max, "y").alias("by1"))
    return out.withColumn("size", F.col("by1") - F.col("by0"))


def chosen_texts(native: DataFrame, recognised: DataFrame, pages: DataFrame, least: int = LEAST_CHARACTERS) -> DataFrame:
    """A page's own texts if they have ``least`` visible characters, else what was recognised in its picture, in their place."""
    n = pages.select("page").join(native.groupBy("page").agg(F.sum(T.visible_characters(F.col("text"))).alias("n")), "page", "left").where(F.coalesce("n", F.lit(0)) < least).select("page")
    columns = ["page", "text_id", "text", "bx0", "by0", "bx1", "by1"]
    return native.join(n, "page", "left_anti").select(*columns).unionByName(recognised.join(n, "page", "left_semi").select(*columns))


def recognise(pictures: DataFrame, ocr) -> DataFrame:
    """rows by the contract above of pictures (page, image binary): ``ocr`` maps a picture's bytes to rows (points, text, confidence), a batch of pictures at a time."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(page, k, [{"x": float(x), "y": float(y)} for x, y in points], text, confidence) for page, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (points, text, confidence) in enumerate(ocr(image) or ())]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["page", "row", "points", "text", "confidence"])

    kind = f"page {pictures.schema['page'].dataType.simpleString()}, row long, points array<struct<x:double,y:double>>, text string, confidence double"
    return pictures.select("page", "image").mapInArrow(read, kind)


def formats(documents: DataFrame) -> DataFrame:
    """(doc, format): kicad, altium, eagle or unknown."""
    return documents.select("doc", T.source_format(F.col("producer"), F.col("creator"), F.col("first_page")).alias("format"))
