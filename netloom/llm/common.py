"""What the operators of this subpackage share: scratch tables, shipping of worker code, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.graph import components
from netloom.plans.scratch import checkpoint_dir, drop, remove, scope, written
from netloom.plans.workers import ship

__all__ = ["SPACE", "bounded_sample", "carried", "checkpoint_dir", "components", "drop", "partitions", "remove", "scope", "ship", "spread_join", "tune", "written"]

#: White space between words is 0x20 and 0x09-0x0D in every contract; bytes.split() cuts at the same six bytes.
SPACE = r"\x20\x09-\x0D"


ship(__name__)


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as rows, so that very long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the least hashes of their key, fewer if there are fewer.

    A threshold on the hash first leaves about half as many rows again, so what meets in one task is bounded by ``most``
    and not by the number of files.
    """
    share = min(1.0, (1.5 * most + 200) / max(rows.count(), 1))
    order = F.xxhash64(key, F.lit(3))
    return rows.where(F.pmod(order, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod(order, F.lit(1 << 30)), key).limit(most)


def spread_join(rows: DataFrame, classes: DataFrame, key: str, size: str = "copies", parts: int = 64) -> DataFrame:
    """rows with what ``classes``, one row a key, has for each; rows without a class keep nulls. ``size`` is a key's number of rows.

    A key with more than a thousandth of the rows is dealt over ``parts`` tasks: fewer than a thousand keys are so
    common, whatever the input's size, and their list is broadcast to mark their rows.
    """
    bar = max((classes.agg(F.sum(size)).first()[0] or 0) // 1000, 1000)
    hot = classes.where(F.col(size) > bar).select(key, F.lit(True).alias("_hot"))
    dealt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_part", dealt).drop("_hot")
    last = F.when(F.col(size) > bar, parts - 1).otherwise(0)
    return rows.join(classes.withColumn("_part", F.explode(F.sequence(F.lit(0), last))), [key, "_part"], "left").drop("_part")


def carried(docs: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``op`` makes of docs, with all columns of docs as they were but for text, whatever their names.

    ``op`` is given doc_id and text by name and all others under names that no operator uses, and returns them too.
    """
    safe = [c if c in ("doc_id", "text") else f"carried_{i}" for i, c in enumerate(docs.columns)]
    out = op(docs.toDF(*safe))
    return out.select(*(F.col(s).alias(c) for s, c in zip(safe, docs.columns, strict=True)))
