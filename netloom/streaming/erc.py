"""Rule checks over a stream of pin files: an extension, as drawings themselves have no time.

Floating pins are known from each pin alone. Whether a net dangles depends on all pins that ever came: its first and last
component by name are kept as the stream's state, and a net whose two differ has more than one. Every micro-batch writes
the nets that it changed, one folder a batch, so that a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def floating(pins: DataFrame) -> DataFrame:
    """(node, pin_id) of unwired pins, of a table or a stream."""
    return pins.where(F.col("net").isNull()).select("node", "pin_id")


def dangling(pins: DataFrame) -> DataFrame:
    """(net, dangling) of every wired net, of a table or, in update mode, of a stream."""
    ends = pins.where("net is not null").groupBy("net").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    return ends.select("net", (F.col("first") == F.col("last")).alias("dangling"))


def watch(pins: DataFrame, out: str, checkpoint: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Starts writing the floating pins and the state of nets of ``pins`` (node, pin_id, net) under ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/nets/batch={number}")

    pins_out = floating(pins).writeStream.format("parquet").option("path", f"{out}/pins").option("checkpointLocation", f"{checkpoint}/pins").trigger(availableNow=True).start()
    nets_out = dangling(pins).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/nets").trigger(availableNow=True).start()
    return pins_out, nets_out


def report(spark: SparkSession, out: str) -> DataFrame:
    """(rule, item) of all that was watched so far: each net by its last state."""
    nets = spark.read.parquet(f"{out}/nets").groupBy("net").agg(F.max_by("dangling", "batch").alias("dangling")).where("dangling")
    pins = spark.read.parquet(f"{out}/pins")
    return pins.select(F.lit("FLOATING_PIN").alias("rule"), F.col("pin_id").alias("item")).unionByName(nets.select(F.lit("DANGLING_NET").alias("rule"), F.col("net").alias("item")))
