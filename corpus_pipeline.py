"""A corpus made ready for training: toxic and poor documents go, near copies and repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it; all but the last return
the columns of ``documents``, and whatever others docs has, unchanged but for text and, with it, n_chars. Null and empty
texts are no toxic ones and fail the quality rules. Rows without a doc_id are documents like others. Rows that repeat an
id are judged each for itself by the first three stages, the third of which keeps one of any near copies, whatever their
ids; the fourth cuts only what stands in a document with a smaller id. Empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import jaccard, packing, quality, repeats, toxicity
from netloom.llm.common import carried, checkpoint_dir, remove, scope, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. The machine learns from the labelled rows of the whole corpus that aren't held out."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = toxicity.fit(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return carried(docs, lambda d: toxicity.score(d, machine).where("predicted = 0"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed."""
    return _counted(carried(docs, quality.clean))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by their place in the table, which reading it again gives again; that it does is checked. Rows
    without an id, and all rows of an id that repeats, go by their place instead of their id.
    """
    number, at, check, again = F.monotonically_increasing_id(), "__row", "__check", "__again"
    mark = F.xxhash64("doc_id", "text")
    placed = docs.select(number.alias(at), F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = written(placed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias(again)))
    if repeated.limit(1).count():
        placed = placed.join(repeated, "doc_id", "left")
    else:
        placed = placed.withColumn(again, F.lit(None).cast("boolean"))
    own = F.when(F.col("doc_id").isNull() | F.col(again), F.lit(1 << 62) + F.col(at)).otherwise(F.col("doc_id"))
    placed = placed.withColumn("own", own)
    rows = written(placed.select("own", at, "doc_id", mark.alias(check)))
    groups = jaccard.similar(placed.select(F.col("own").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", at, check))
    keep = rows.join(groups, "own").groupBy("component_id").agg(first.alias("m")).select(f"m.{at}", F.col(f"m.{check}").alias(check))

    def kept(d: DataFrame) -> DataFrame:
        same = F.when(F.col(check) == mark, True).otherwise(F.raise_error(F.lit("the documents changed places between two readings")).cast("boolean"))
        return d.withColumn(at, number).join(keep, at).where(same)

    return carried(docs, kept)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that documents of smaller ids have as well; a character that is cut through goes."""
    return _counted(carried(docs, lambda d: repeats.find_repeats(d).withColumn("text", repeats.whole_characters("text", "kept"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where docs has it, follows the text."""
    return docs.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: SQL can't express the trained machine or the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's rows written before the next reads them; only the last one's stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
