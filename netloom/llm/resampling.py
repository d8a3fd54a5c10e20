"""Importance resampling: documents drawn by the ratio of two hashed n-gram models, one of target text, one of all text.

A document's weight is the sum over its words and word pairs of log p_target - log p_raw; adding Gumbel noise and
keeping the k largest keys draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_sample, ship, tune, written

ship(__name__)

#: Slots of the models, whatever the input's size.
SLOTS = 10_000
#: Labelled rows, at most, that make up the target model; the raw model counts all rows.
TARGET_SAMPLE = 20_000
#: Share of the documents that is drawn.
FRACTION = 0.85
REMEMBERED = 500_000


class Slots(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def features(data: bytes | None, slots: Slots) -> np.ndarray:
    """Slots of the words and word pairs of a text."""
    words = data.lower().split() if data else ()
    own = np.fromiter(map(slots.__getitem__, words), np.uint64, len(words))
    pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:]
    pairs ^= pairs >> np.uint64(32)
    return (np.concatenate([own, pairs * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(20)) % np.uint64(SLOTS)


def _counted(batches):
    slots, raw, target = Slots(), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        flags = batch.column(1).to_pylist()
        found = [features(x.as_py(), slots) for x in batch.column(0).cast(pa.binary())]
        for into, some in ((raw, found), (target, [f for f, flag in zip(found, flags, strict=True) if flag])):
            if some:
                into += np.bincount(np.concatenate(some).astype(np.int64), minlength=SLOTS)
    yield pa.RecordBatch.from_arrays([pa.array([raw]), pa.array([target])], names=["raw", "target"])


def models(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p_target - log p_raw by slot, smoothed by one count a slot. target_ids: doc_id of labelled target rows."""
    some = bounded_sample(target_ids.where("doc_id is not null").select("doc_id").distinct(), "doc_id", TARGET_SAMPLE)
    flagged = docs.select("doc_id", "text").join(F.broadcast(some.withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    parts = flagged.mapInArrow(_counted, "raw array<long>, target array<long>")
    slot = parts.select(F.posexplode(F.arrays_zip("raw", "target")).alias("slot", "n")).groupBy("slot").agg(F.sum("n.raw").alias("raw"), F.sum("n.target").alias("target"))
    raw, target = np.ones(SLOTS), np.ones(SLOTS)
    for row in slot.collect():  # SLOTS rows
        raw[row["slot"]] += row["raw"]
        target[row["slot"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight of every row; a null or empty text has no features and weight 0."""

    def rate(batches):
        slots = Slots()
        for batch in batches:
            found = [features(x.as_py(), slots).astype(np.int64) for x in batch.column(1).cast(pa.binary())]
            sums = [float(np.round(ratio[f].sum(), 9)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "n_features", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, n_features long, log_weight double")


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by counts over ever finer bins; at most ``bins`` counts come to the driver at a time."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = (high - low) / bins
        if low + step <= low or high - step >= high:
            bins, step = 2, (high - low) / 2
        at = F.least(F.greatest(F.floor((F.col(column) - low) / step), F.lit(0)), F.lit(bins - 1))
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at.alias("at"))
        found = sorted(inside.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["at"])
        for row in found:
            if k <= row["n"]:
                break
            k -= row["n"]
        if (row["lo"], row["hi"]) == (low, high) and len(found) == 1:
            break
        low, high = row["lo"], row["hi"]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = FRACTION, seed: int = 17) -> DataFrame:
    """doc_id, n_features, log_weight, sample_key and kept of every row; the ``fraction`` of rows with the largest keys is kept.

    The noise comes from the id, so that a draw can be repeated. Rows equal in key, which have one id and one text,
    share their fate. Empty tables give empty ones; without target rows all weights come from the smoothed model.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    even = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = weigh(docs, models(docs, target_ids)).withColumn("sample_key", F.col("log_weight") - F.log(-F.log(even)))
    keyed = written(keyed)
    k = int(keyed.count() * fraction)
    bar = kth_largest(keyed, "sample_key", k) if k else float("inf")
    return keyed.withColumn("kept", F.col("sample_key") >= F.lit(bar))
