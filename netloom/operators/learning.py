"""Features of clusters, and a classifier that is trained on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.operators import spatial
from netloom.operators.page import Clusters

NAMES = [
    "aspect_ratio", "num_segments", "bb_area", "convex_hull_area", "solidity", "total_segment_length", "num_shapes", "shape_area_ratio",
    "centroid_x", "centroid_y", "std_x", "std_y", "max_segment_length",
]
#: How sure the classifier has to be.
SURE = 0.7


def points(found: Clusters, shapes: DataFrame) -> DataFrame:
    """(page, cluster, x, y) of the ends of a cluster's segments and of its shapes' vertices."""
    own = spatial.ends_of(found.members).select("page", "cluster", "x", "y")
    corners = found.shapes.select("page", "cluster", "shape").join(shapes.select("page", "shape", F.explode("vertices").alias("v")), ["page", "shape"])
    return own.unionByName(corners.select("page", "cluster", "v.x", "v.y"))


def hull_area(of: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, hull): the area of the convex hull of a group's points, by a monotone chain over its distinct points in order.

    Of points with one x only the lowest and the highest can be on the hull. The chains are folds over a sorted array, so
    these points of a group stand in one row.
    """
    point = F.struct("x", "y")
    rims = of.groupBy(*by, "x").agg(F.count("*").alias("m"), F.array(F.min("y"), F.max("y")).alias("ys"))
    rims = rims.select(*by, "x", F.posexplode("ys").alias("k", "y"), F.col("m"))
    sets = rims.groupBy(*by).agg(F.sum(F.when(F.col("k") == 0, F.col("m"))).alias("n"), F.array_sort(F.collect_set(point)).alias("p"))
    kind = "array<struct<x:double,y:double>>"

    def left(a, b, c):  # whether c lies to the left of the way from a to b
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]) > 0

    def chain(points_):
        # the point goes behind the last one of the chain that it turns left at; all behind that one are dropped
        def add(kept, p):
            turns = F.transform(F.sequence(F.lit(1), F.size(kept)), lambda i: (i < 2) | left(F.element_at(kept, F.greatest(i - 1, F.lit(1))), F.element_at(kept, i), p))
            upto = F.size(kept) - F.coalesce(F.array_position(F.reverse(turns), True).cast("int"), F.size(kept)) + 1
            return F.when(F.size(kept) == 0, F.array(p)).otherwise(F.concat(F.slice(kept, F.lit(1), upto), F.array(p)))

        return F.aggregate(points_, F.array().cast(kind), add)

    lower, upper = chain(F.col("p")), chain(F.reverse("p"))
    around = F.concat(F.slice("lower", F.lit(1), F.size("lower") - 1), F.slice("upper", F.lit(1), F.size("upper") - 1))
    sets = sets.withColumns({"lower": lower, "upper": upper}).withColumn("around", around)
    return sets.select(*by, "n", F.when(F.size("p") >= 3, G.shoelace("around")).otherwise(0.0).alias("hull"))


def features(found: Clusters, shapes: DataFrame) -> DataFrame:
    """(page, cluster, and NAMES) of every cluster: counts, areas and lengths by the log of one more, ratios, and where its points lie.

    A cluster of fewer than three points, or of points in one line, has its box's area as that of its hull.
    """
    key = ["page", "cluster"]
    at = points(found, shapes)
    lengths = found.members.groupBy(*key).agg(F.sum(G.length()).alias("total"), F.max(G.length()).alias("longest"))
    areas = found.shapes.select("page", "cluster", "shape").join(shapes.select("page", "shape", G.shape_area().alias("area")), ["page", "shape"]).groupBy(*key).agg(F.sum("area").alias("area"))
    spread = at.groupBy(*key).agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.stddev_pop("x").alias("std_x"), F.stddev_pop("y").alias("std_y"))
    rows = found.clusters.join(lengths, key, "left").join(areas, key, "left").join(spread, key, "left").join(hull_area(at, key), key, "left")
    w, h = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    box = w * h
    hull = F.when(F.col("hull") > 0, F.col("hull")).otherwise(box)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        *key, F.when(h > 0, F.try_divide(w, h)).otherwise(1.0).alias("aspect_ratio"), F.log1p("n_segments").alias("num_segments"), F.log1p(box).alias("bb_area"), F.log1p(hull).alias("convex_hull_area"),
        F.when(box > 0, F.try_divide(hull, box)).otherwise(1.0).alias("solidity"), F.log1p(zero("total")).alias("total_segment_length"), F.col("n_shapes").cast("double").alias("num_shapes"),
        F.when(box > 0, F.try_divide(zero("area"), box)).otherwise(0.0).alias("shape_area_ratio"), zero("centroid_x").alias("centroid_x"), zero("centroid_y").alias("centroid_y"),
        zero("std_x").alias("std_x"), zero("std_y").alias("std_y"), F.log1p(zero("longest")).alias("max_segment_length"),
    )


def train(labelled: DataFrame, trees: int = 100, depth: int = 20, seed: int = 42):
    """A pipeline of random trees over rows with NAMES and class_name; save it with ``write()``, load it with PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    names = StringIndexer(inputCol="class_name", outputCol="label", stringOrderType="alphabetAsc").fit(labelled)
    stages = [VectorAssembler(inputCols=NAMES, outputCol="vector"), RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed), IndexToString(inputCol="prediction", outputCol="likely", labels=names.labels)]
    return Pipeline(stages=stages).fit(names.transform(labelled))


def predict(model, rows: DataFrame, least: float = SURE) -> DataFrame:
    """rows with predicted and confidence; unknown where the trees are less sure than ``least``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.withColumn("predicted", F.when(F.col("confidence") >= least, F.col("likely")).otherwise("unknown")).drop("vector", "rawPrediction", "probability", "prediction", "likely", "label")
