"""Extracted nets held against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators.graph import greedy_match
from netloom.plans.scratch import written


def ratio(over: Column, under: Column) -> Column:
    """0 where there is nothing below."""
    return F.when(under == 0, 0.0).otherwise(F.coalesce(F.try_divide(over.cast("double"), under.cast("double")), F.lit(0.0)))


def f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def memberships(pages: DataFrame) -> DataFrame:
    """(board, net, ref) of extracted pins (board, page, net, ref), nets of different pages kept apart."""
    return pages.where("net is not null").select("board", F.concat_ws(":", "page", "net").alias("net"), "ref").distinct()


def in_common(extracted: DataFrame, true: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' memberships of the parts that both have."""
    shared = extracted.select("board", "ref").intersect(true.select("board", "ref"))
    return extracted.join(shared, ["board", "ref"], "left_semi").distinct(), true.join(shared, ["board", "ref"], "left_semi").distinct()


def overlaps(extracted: DataFrame, true: DataFrame) -> DataFrame:
    """(board, ext, gt, overlap) of nets with parts in common."""
    pairs = extracted.select("board", "ref", F.col("net").alias("ext")).join(true.select("board", "ref", F.col("net").alias("gt")), ["board", "ref"])
    return pairs.groupBy("board", "ext", "gt").agg(F.count("*").alias("overlap"))


def matched(extracted: DataFrame, true: DataFrame) -> DataFrame:
    """(board, ext, gt, overlap): nets one to one, greatest overlap first, of equals the last by name."""
    return greedy_match(overlaps(extracted, true), [F.desc("overlap"), F.desc("ext"), F.desc("gt")], "ext", "gt", ["board"])


def judged(extracted: DataFrame, true: DataFrame, match: DataFrame) -> DataFrame:
    """(board, ref, net, kind): memberships found (tp) and missed (fn) of true nets, and wrong ones (fp) of extracted nets."""
    mapped = extracted.join(match.select("board", F.col("ext").alias("net"), "gt"), ["board", "net"], "left")
    found = mapped.where("gt is not null").select("board", "ref", F.col("gt").alias("net"), F.lit(True).alias("found"))
    hits = true.join(found, ["board", "ref", "net"], "left").select("board", "ref", "net", F.when(F.col("found"), "tp").otherwise("fn").alias("kind"))
    wrong = mapped.join(true.select("board", "ref", F.col("net").alias("gt")), ["board", "ref", "gt"], "left_anti").select("board", "ref", "net", F.lit("fp").alias("kind"))
    return hits.unionByName(wrong)


def score_boards(extracted: DataFrame, true: DataFrame) -> DataFrame:
    """(board, num_gt, overlap_refs, tp, fp, fn, precision, recall, f1) of every board that either side has; memberships are (board, net, ref)."""
    extracted, true = extracted.distinct(), true.distinct()
    e, g = in_common(extracted, true)
    e, g = written(e), written(g)
    match = written(matched(e, g))
    n = judged(e, g, match).groupBy("board").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")))
    boards = extracted.select("board").union(true.select("board")).distinct()
    size = lambda d, name: d.groupBy("board").agg(F.count_distinct("ref").alias(name))
    out = boards.join(size(true, "num_gt"), "board", "left").join(size(e, "overlap_refs"), "board", "left").join(n, "board", "left").na.fill(0)
    return out.withColumns(f1(F.col("tp"), F.col("fp"), F.col("fn")))


def summary(scores: DataFrame, value: str = "f1", by: list[str] | None = None) -> DataFrame:
    """Mean, median, least and greatest over boards with true parts; the median is the upper of two."""
    real = scores.where("num_gt > 0") if "num_gt" in scores.columns else scores
    # as many rows as boards: ranked by counts of equal values, never gathered
    by = by or []
    n = real.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    counted = real.groupBy(*by, value).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(value))
    key = [*by, "_one"]
    ranked = counted.withColumn("upto", upto).withColumn("_one", F.lit(0)).join(n.withColumn("_one", F.lit(0)), key)
    middle = ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*key).agg(F.min(value).alias("median"))
    return n.withColumn("_one", F.lit(0)).join(middle, key).drop("_one")


def error_buckets(extracted: DataFrame, true: DataFrame, classes: DataFrame) -> DataFrame:
    """(board, class_name, fn, fp, fn_power, fn_signal, deg1_2, deg3_4, deg5_up): misses and wrong memberships by the part's class.

    classes are (board, ref, class_name); degrees are those of the true net over all its parts.
    """
    extracted, true = extracted.distinct(), true.distinct()
    e, g = (written(x) for x in in_common(extracted, true))
    rows = judged(e, g, written(matched(e, g))).where("kind <> 'tp'")
    degree = true.groupBy("board", "net").agg(F.count_distinct("ref").alias("degree"))
    rows = rows.join(degree, ["board", "net"], "left").join(classes, ["board", "ref"], "left").withColumn("class_name", F.coalesce("class_name", F.lit("?")))
    missed = F.col("kind") == "fn"
    return rows.groupBy("board", "class_name").agg(
        F.count_if(missed).alias("fn"), F.count_if(~missed).alias("fp"),
        F.count_if(missed & T.is_power(F.col("net"))).alias("fn_power"), F.count_if(missed & ~T.is_power(F.col("net"))).alias("fn_signal"),
        F.count_if(missed & (F.col("degree") <= 2)).alias("deg1_2"), F.count_if(missed & F.col("degree").between(3, 4)).alias("deg3_4"), F.count_if(missed & (F.col("degree") >= 5)).alias("deg5_up"),
    )


def most_common(counted: DataFrame, by: list[str], value: str, n: int = 5, first: str = "class_name") -> DataFrame:
    """The n rows with the largest value of each group, of equals the first by name."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.col(first)))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def pair_f1(extracted: DataFrame, true: DataFrame) -> DataFrame:
    """(board, tp, fp, fn, precision, recall, f1) over pairs of parts that share a net; both without pairs score 1.

    Nets with the same parts are one before pairs are made, so that copies of a net cost nothing.
    """

    def pairs(m: DataFrame) -> DataFrame:
        sets = m.select("board", "net", "ref").distinct().groupBy("board", "net").agg(F.array_sort(F.collect_list("ref")).alias("refs")).select("board", "refs").distinct()
        pair = F.flatten(F.transform("refs", lambda a, i: F.transform(F.slice(F.col("refs"), i + 2, F.greatest(F.size("refs") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        return sets.select("board", F.explode(pair).alias("p")).distinct()

    boards = extracted.select("board").union(true.select("board")).distinct()
    both = pairs(true).withColumn("g", F.lit(1)).join(pairs(extracted).withColumn("e", F.lit(1)), ["board", "p"], "full_outer")
    n = both.groupBy("board").agg(F.count_if(F.expr("g = 1 and e = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("e is null")).alias("fn"))
    out = boards.join(n, "board", "left").na.fill(0, ["tp", "fp", "fn"]).withColumns(f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumn("f1", F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(F.col("f1")))


def segment_sets(segments: DataFrame) -> DataFrame:
    """(net, key): a net's segments (net, x0, y0, x1, y1) to six decimals, either way round, as one sorted string."""
    number = lambda v: F.round(F.col(v), 6) + 0.0
    start, end = F.struct(number("x0").alias("x"), number("y0").alias("y")), F.struct(number("x1").alias("x"), number("y1").alias("y"))
    one = F.concat_ws(" ", *(f"{s}.{v}" for s in ("a", "b") for v in ("x", "y")))
    rows = segments.select("net", F.least(start, end).alias("a"), F.greatest(start, end).alias("b")).select("net", one.alias("s")).distinct()
    return rows.groupBy("net").agg(F.array_join(F.array_sort(F.collect_list("s")), ";").alias("key"))


def equivalent_nets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(net_a, net_b) of two netlists: nets with equal sets of segments paired one to one, and those left over with a null."""
    order = lambda net: F.row_number().over(Window.partitionBy("key").orderBy(net))
    left = segment_sets(a).select("key", F.col("net").alias("net_a")).withColumn("n", order("net_a"))
    right = segment_sets(b).select("key", F.col("net").alias("net_b")).withColumn("n", order("net_b"))
    return left.join(right, ["key", "n"], "full_outer").select("net_a", "net_b")


def equivalence(pairs: DataFrame) -> DataFrame:
    """One row: equivalent, matched_nets, nets_a, nets_b."""
    n = pairs.agg(F.count_if(F.expr("net_a is not null and net_b is not null")).alias("matched_nets"), F.count("net_a").alias("nets_a"), F.count("net_b").alias("nets_b"))
    return n.select((F.expr("matched_nets = nets_a and matched_nets = nets_b")).alias("equivalent"), "matched_nets", "nets_a", "nets_b")


def count_ratio(a: Column, b: Column) -> Column:
    """How near two counts of nets are: 1 if equal, else the smaller over the larger."""
    return F.when(a == b, 1.0).otherwise(ratio(F.least(a, b), F.greatest(a, b)))


def compared(geometric: DataFrame, detected: DataFrame, flag: float = 0.02) -> DataFrame:
    """(board, geo_f1, det_f1, delta, change): two scores of each board; better and worse begin at ``flag``."""
    d = F.col("det_f1") - F.col("geo_f1")
    j = geometric.select("board", F.col("f1").alias("geo_f1")).join(detected.select("board", F.col("f1").alias("det_f1")), "board")
    return j.withColumn("delta", d).withColumn("change", F.when(d > flag, "better").when(d < -flag, "worse").otherwise("same"))


def fit_translation(anchors: DataFrame, size: float = 72 / 25.4) -> DataFrame:
    """(board, sx, sy, tx, ty, residual) that carry true places (board, gx, gy) to extracted ones (ex, ey).

    The scale is given, the translation is the median, and y is turned over where that leaves the smaller median residual.
    """
    both = None
    for sign in (1.0, -1.0):
        t = anchors.groupBy("board").agg(F.percentile(F.col("ex") - size * F.col("gx"), F.lit(0.5)).alias("tx"), F.percentile(F.col("ey") - sign * size * F.col("gy"), F.lit(0.5)).alias("ty"))
        off = F.hypot(size * F.col("gx") + F.col("tx") - F.col("ex"), sign * size * F.col("gy") + F.col("ty") - F.col("ey"))
        fit = anchors.join(t, "board").groupBy("board", "tx", "ty").agg(F.percentile(off, F.lit(0.5)).alias("residual")).withColumns({"sx": F.lit(size), "sy": F.lit(sign * size), "turned": F.lit(int(sign < 0))})
        both = fit if both is None else both.unionByName(fit)
    return both.groupBy("board").agg(F.min(F.struct("residual", "turned", "sx", "sy", "tx", "ty")).alias("m")).select("board", "m.sx", "m.sy", "m.tx", "m.ty", "m.residual")
