import random

import numpy as np
import pyarrow as pa

from netloom.llm import resampling


def made():
    r = random.Random(1)
    good = [(i, " ".join(r.choices(["river", "stone", "cloud", "green", "field"], k=30))) for i in range(60)]
    bad = [(i + 100, " ".join(r.choices(["zzq", "qqx", "xxz"], k=30))) for i in range(40)]
    return good + bad + [(300, None), (301, ""), (302, "river " * 20000)]


def test_drawn_rows_and_weights(spark):
    docs = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as target", "'k' as kept")
    target = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (3,)], "doc_id long")
    out = resampling.resample(frame, target, fraction=0.5).collect()
    assert len(out) == len(docs) and sum(r["kept"] for r in out) == len(docs) // 2
    bar = min(r["sample_key"] for r in out if r["kept"])
    assert all(r["kept"] == (r["sample_key"] >= bar) for r in out)
    assert not any(r["kept"] for r in out if 100 <= r["doc_id"] < 140)
    slots, raw, aim = resampling.Slots(), np.ones(resampling.SLOTS), np.ones(resampling.SLOTS)
    found = {i: resampling.features((t or "").encode(), slots).astype(int) for i, t in docs}
    for i, f in found.items():
        np.add.at(raw, f, 1)
        if i < 30:
            np.add.at(aim, f, 1)
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    for r in out:
        assert abs(r["log_weight"] - ratio[found[r["doc_id"]]].sum()) < 1e-4 and r["n_features"] == len(found[r["doc_id"]])


def test_kth_largest(spark):
    r = random.Random(3)
    values = [r.choice([1e300, -5.0, 0.0, 1.5, r.random(), r.gauss(0, 1e6)]) for _ in range(500)]
    frame = spark.createDataFrame(pa.table({"v": values}).to_pandas())
    for k in (1, 2, 250, 499, 500):
        assert resampling.kth_largest(frame, "v", k, bins=8) == sorted(values, reverse=True)[k - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    assert resampling.resample(none, none.select("doc_id")).count() == 0
    assert len(resampling.resample(some, none.select("doc_id")).collect()) == 3


def plain_slots(text):
    """Slots by whole numbers: words by their hash, pairs by both."""
    import xxhash

    mask, words = (1 << 64) - 1, [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    pairs = []
    for a, b in zip(words, words[1:], strict=False):
        p = (a * 0x9E3779B97F4A7C15 & mask) ^ b
        p ^= p >> 32
        pairs.append(p * 0xD6E8FEB86659FD93 & mask)
    return [(h >> 20) % resampling.SLOTS for h in words + pairs]


def test_keys_and_the_draw_by_their_definition(spark):
    import math
    from collections import Counter

    docs, aim = made(), set(range(30))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in aim], "doc_id long")
    raw, good = Counter(), Counter()
    for i, t in docs:
        raw.update(plain_slots(t))
        good.update(plain_slots(t) if i in aim else ())
    n_raw, n_good = sum(raw.values()) + resampling.SLOTS, sum(good.values()) + resampling.SLOTS
    noise = {r["doc_id"]: r["h"] % (1 << 64) for r in frame.selectExpr("doc_id", "xxhash64(doc_id, 17) as h").collect()}
    want = {}
    for i, t in docs:
        weight = sum(math.log((good[s] + 1) / n_good) - math.log((raw[s] + 1) / n_raw) for s in plain_slots(t))
        want[i] = weight - math.log(-math.log(((noise[i] >> 11) + 0.5) / (1 << 53)))
    out = {r["doc_id"]: r for r in resampling.resample(frame, target, fraction=0.3).collect()}
    assert all(abs(out[i]["sample_key"] - k) < 1e-5 * (1 + abs(k)) for i, k in want.items())
    drawn = sorted(want, key=lambda i: -want[i])[: int(len(docs) * 0.3)]
    assert {i for i, r in out.items() if r["kept"]} == set(drawn)
