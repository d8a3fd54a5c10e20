"""Rule checks and the scope gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(components: DataFrame, pins: DataFrame, nets: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, severity, rule, item): isolated components, floating pins, unconnected, dangling and unnamed nets; place is the rule's order in a report."""
    row = lambda place, severity, rule, item: [F.lit(place).alias("place"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col(item).alias("item")]
    degree = edges.groupBy("net").agg(F.count("*").alias("n"))
    return (
        components.join(edges, "node", "left_anti").select(*row(1, "error", "ISOLATED_COMPONENT", "node"))
        .unionByName(pins.where("net is null").select(*row(2, "warning", "FLOATING_PIN", "pin_id")))
        .unionByName(nets.join(edges, "net", "left_anti").select(*row(3, "error", "UNCONNECTED_NET", "net")))
        .unionByName(degree.where("n = 1").select(*row(3, "warning", "DANGLING_NET", "net")))
        .unionByName(nets.where("name is null or name = ''").select(*row(4, "warning", "UNNAMED_NET", "net")))
    )


def summary(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, has_errors, summary."""
    n = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.select("errors", "warnings", (F.col("errors") > 0).alias("has_errors"), F.concat("errors", F.lit(" error(s), "), "warnings", F.lit(" warning(s)")).alias("summary"))


def scope(components: Column, nets: Column, ratio: float = 8.0, most: int = 80) -> tuple[Column, Column]:
    """(ratio of nets to components, in scope): bus-dominated and too large drawings are out; no component is an infinite ratio."""
    by = F.when(components == 0, F.lit(float("inf"))).otherwise(F.try_divide(nets.cast("double"), components))
    return by, (by <= ratio) & (components <= most)


def assessed(counts: DataFrame, ratio: float = 8.0, most: int = 80) -> DataFrame:
    """counts (page, n_components, n_nets) with ratio, in_scope, confidence and reason."""
    by, ok = scope(F.col("n_components"), F.col("n_nets"), ratio, most)
    shown = F.when(F.col("n_components") == 0, "inf").otherwise(F.format_string("%.1f", by))
    bus = F.when(by > ratio, F.concat(F.lit("bus-dominated (nets/comp "), shown, F.lit(f" > {ratio})")))
    large = F.when(F.col("n_components") > most, F.concat(F.lit("too large ("), F.col("n_components").cast("string"), F.lit(f" comps > {most})")))
    reason = F.when(ok, "in supported density envelope").otherwise(F.concat_ws("; ", bus, large))
    rounded = F.when(F.col("n_components") == 0, F.lit(float("inf"))).otherwise(F.round(by, 2))
    return counts.select("page", "n_components", "n_nets", rounded.alias("ratio"), ok.alias("in_scope"), F.when(ok, "high").otherwise("low").alias("confidence"), reason.alias("reason"))
