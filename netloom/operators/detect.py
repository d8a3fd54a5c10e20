"""Components out of a detector's boxes: what lies in a box is a part's drawing, and a designator beside it names the part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.operators import spatial
from netloom.operators.page import Clusters, summed
from netloom.plans.scratch import written
from netloom.plans.workers import ship

ship(__name__)


def in_points(detections: DataFrame, dpi: float = 72.0) -> DataFrame:
    """(page, box, class_name, confidence, ref, bx0..by1) of detections in pixels (px0..py1), which a detector of any make writes."""
    at = lambda v: (F.col(v) * 72.0 / dpi)
    return detections.select("page", "box", "class_name", "confidence", "ref", at("px0").alias("bx0"), at("py0").alias("by0"), at("px1").alias("bx1"), at("py1").alias("by1"))


def segments_in(segments: DataFrame, boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    """(page, seg, box): the smallest box, widened by ``pad``, that has a segment's middle or one of its ends."""
    return spatial.smallest_box(segments, boxes, ["seg"], [G.midpoint(), ("x0", "y0"), ("x1", "y1")], pad)


def pick_refs(boxes: DataFrame, named: DataFrame) -> DataFrame:
    """(page, box, text): for each box in turn the nearest designator that no box before has.

    One within the box goes first, then one as far beside it as half its height. What a box gets depends on those
    before it, so the candidates of a page are one task; they are only the designators within reach of a box. Equal
    texts are one designator; of equally near ones the first wins.
    """
    refs = named.where("kind = 'ref'").select("page", "text_id", "text", F.col("ax").alias("x"), F.col("ay").alias("y"))
    tol = 0.5 * F.greatest(F.lit(0.0), F.col("by1") - F.col("by0"))
    wide = boxes.select("page", "box", "bx0", "by0", "bx1", "by1").withColumns({"cx": (F.col("bx0") + F.col("bx1")) / 2, "cy": (F.col("by0") + F.col("by1")) / 2, "ix0": F.col("bx0"), "iy0": F.col("by0"), "ix1": F.col("bx1"), "iy1": F.col("by1")})
    wide = wide.withColumns({"bx0": F.col("bx0") - tol, "by0": F.col("by0") - tol, "bx1": F.col("bx1") + tol, "by1": F.col("by1") + tol})
    near = spatial.meeting(wide, spatial.padded(refs, 0.0, "x", "y", "x", "y"))
    near = near.withColumn("outside", (~G.in_box("_x", "_y", "ix0", "iy0", "ix1", "iy1")).cast("int")).withColumn("d2", G.distance2("_x", "_y", "cx", "cy"))
    rows = near.select("page", "box", "outside", "d2", F.col("_text_id").alias("text_id"), F.col("_text").alias("text"))

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("box", "outside", "d2", "text_id")])
        used, done, out = set(), set(), []
        for box, text in zip(table.column("box").to_pylist(), table.column("text").to_pylist(), strict=True):
            if box not in done and text not in used:
                used.add(text)
                done.add(box)
                out.append((box, text))
        page = table.column("page").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(out), np.int64)))
        return pa.table({"page": page, "box": pa.array([b for b, _ in out], pa.int64()), "text": pa.array([t for _, t in out], pa.string())})

    kind = f"page {rows.schema['page'].dataType.simpleString()}, box long, text string"
    return rows.withColumn("box", F.col("box").cast("long")).groupBy("page").applyInArrow(pick, kind)


def components(detections: DataFrame, segments: DataFrame, named: DataFrame, pad: float = 0.0) -> tuple[DataFrame, Clusters]:
    """(components, clusters) of boxes that hold a segment; detections are in points.

    components: page, cluster (the box), ref, class_name, confidence, bx0..by1. A box without a designator keeps the
    detection's own ref, else it is DET and its number.
    """
    placed = written(segments.join(segments_in(segments, detections, pad), ["page", "seg"]).select("page", F.col("box").cast("long").alias("cluster"), "seg", "x0", "y0", "x1", "y1"))
    full = detections.withColumn("box", F.col("box").cast("long")).join(placed.select("page", F.col("cluster").alias("box")).distinct(), ["page", "box"], "left_semi")
    picked = written(pick_refs(full, named))
    out = full.join(picked, ["page", "box"], "left").select("page", F.col("box").alias("cluster"), F.coalesce("text", "ref", F.concat(F.lit("DET"), "box")).alias("ref"), "class_name", "confidence", "bx0", "by0", "bx1", "by1")
    none = placed.select("page", "cluster", F.lit(0).cast("long").alias("shape"), *(F.lit(0.0).alias(b) for b in ("bx0", "by0", "bx1", "by1"))).limit(0)
    counted = summed(placed, none).drop("bx0", "by0", "bx1", "by1").join(out.select("page", "cluster", "bx0", "by0", "bx1", "by1"), ["page", "cluster"])
    return out, Clusters(placed, none, counted, placed.drop("cluster").limit(0))


def coverage(found: DataFrame, named: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, n_components, n_refs, use_detector): a detector that finds fewer parts than ``least`` of the page's designators is passed over."""
    refs = named.where("kind = 'ref'").groupBy("page").agg(F.count_distinct("text").alias("n_refs"))
    n = found.groupBy("page").agg(F.count("*").alias("n_components"))
    out = pages.select("page").join(n, "page", "left").join(refs, "page", "left").na.fill(0, ["n_components", "n_refs"])
    return out.withColumn("use_detector", (F.col("n_refs") == 0) | (F.col("n_components") >= least * F.col("n_refs")))
