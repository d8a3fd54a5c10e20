"""One query for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, jaccard, licences, near, quality, repeats, resampling, toxicity, warc
from netloom.llm.packing import pack_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the 50k ranks and decoded again, as digests."""
    import public_tokenizers as vocabulary

    ranks = vocabulary.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), ranks, vocabulary.PATTERN))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and line-first verdict of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).drop("text", "cleaned")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, those marked that a damaged replica's tree locates."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.check(pages, warc.damaged(pages))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against those labelled as good, and the draw."""
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resampling.resample(table(spark, sf_dir, "documents"), target)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that a document of a smaller id has as well, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digests(repeats.find_repeats(docs))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all embeddings at a cosine of 0.95."""
    return near.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share nine tenths of their 3-word shingles."""
    return jaccard.similar(table(spark, sf_dir, "documents"), width=3, threshold=90)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, machine).withColumn("held_out", toxicity.held_out())
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op9_licence_scan": op9_licence_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op2_warc_fixity": op2_warc_fixity,
    "op4_importance_resampling": op4_importance_resampling,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op1_byte_bpe": op1_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc_fixity": warc.SQL,
    "op3_quality_rules": quality.SQL,
}
