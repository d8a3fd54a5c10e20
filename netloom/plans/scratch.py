"""Tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scopes that are open, each with the paths written since it began; the first one lasts as long as the application.
_scopes: list[list[str]] = [[]]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    A folder of our own stands in for it only where it is unset and driver and executors are one process; on a cluster
    executors would write there what nobody else sees, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset; {master} needs a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints", f"netloom-{os.getpid()}")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: nothing reads them again, and they would stay until the driver's collector runs."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut, and no executor's loss takes rows with it.

    The table lasts until drop(), the end of the scope() around it, or that of the application.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/netloom-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.netloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    for scope in _scopes:
        if df.netloom_path in scope:
            scope.remove(df.netloom_path)
    remove(df.sparkSession, df.netloom_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables of written() made inside are deleted at its end: what they led to has to be computed by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


@atexit.register
def _end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _scopes[0]:
        try:
            remove(spark, path)
        except Exception:  # the application is ending, and its JVM may be gone
            return
