import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from netloom.llm import quality, toxicity

TOXIC = ["numpty", "blockhead", "scallywag"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _block int, score double, spans string, n_words string, predicted int"


def prose(r, n):
    return "\n".join(" ".join("".join(r.choices(["ta", "ri", "mo", "len", "su", "ka", "ped", "vor"], k=r.randint(1, 4))) for _ in range(12)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, folder = random.Random(4), tmp_path_factory.mktemp("corpus")
    docs = [(i, prose(r, 8)) for i in range(200)]
    toxic = {i for i in range(200) if i % 5 == 0}
    for i in toxic:
        docs[i] = (i, docs[i][1] + "\n" + " ".join(["You", *r.sample(TOXIC, 2), "there."]))
    shared = prose(r, 2)
    docs += [(300, docs[1][1]), (301, docs[2][1] + " Extra."), (302, prose(r, 6) + "\n" + shared), (303, prose(r, 6) + "\n" + shared)]
    docs += [(400, "Home | About | Help | Shop\n" * 30), (401, "short text"), (402, None), (403, ""), (500, prose(r, 900))]
    docs += [(None, prose(r, 7)), (None, prose(r, 7)), (None, docs[3][1]), (600, prose(r, 7)), (600, prose(r, 7)), (601, docs[4][1]), (601, docs[4][1])]
    rows = [(i, t, "en", "s", len(t or ""), f"kept {k}", k, k / 7, f"spans {k}", "w", -k) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, toxic, shared


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    """One row of each group by all pairs; rows are (doc_id, text, place)."""
    sets, group = [shingles(t or "") for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    best = {}
    for i, (doc_id, _, place) in enumerate(rows):
        best.setdefault(find(i), []).append((doc_id is None, doc_id or 0, place, i))
    return sorted(min(v)[-1] for v in best.values())


def plain_repeats(rows, length=50):
    first = {}
    for doc_id, text, _ in rows:
        data, own = (text or "").encode(), 2**62 if doc_id is None else doc_id
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, own), own)
    out = []
    for doc_id, text, place in rows:
        data, own = (text or "").encode(), 2**62 if doc_id is None else doc_id
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < own:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, kept.decode("utf-8", "ignore") if any(gone) else text, place))
    return out


def test_run_against_a_brute_force_version(spark, corpus):
    """Verdicts of single documents come from the operators that tests beside hold to theirs; what stages do across documents is done anew."""
    folder, rows, toxic, shared = corpus
    texts = {p: t for _, t, _, _, _, _, p, *_ in rows}
    machine = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = machine.scores([t or "" for t in texts.values()])
    left = [(r[0], r[1], r[6]) for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    assert not {i for i, _, _ in left} & toxic - {None} or len({i for i, _, _ in left} & toxic) <= 2
    judged = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame([(p, t) for _, t, p in left], "doc_id long, text string")).collect()}
    left = [(i, judged[p]["cleaned"], p) for i, _, p in left if judged[p]["kept"]]
    assert not {400, 401, 402, 403} & {i for i, _, _ in left}
    order = sorted(left, key=lambda x: x[2])
    left = [order[k] for k in plain_groups(order)]
    ids = Counter(i for i, _, _ in left)
    assert 300 not in ids and 301 not in ids and ids[None] == 2 and ids[600] == 2 and ids[601] == 0
    left = plain_repeats(left)
    assert sum(shared in t for _, t, _ in left) == 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in left:
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(own), 2048)):
            part = own[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    found = P.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(int)
    for r in found:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= 1 + sum(bins.values()) // 1500


def test_stages_carry_all_columns(spark, corpus):
    folder, rows, _, _ = corpus
    frame = docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = {r[6]: r for r in rows}
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        stage(spark, frame, folder).write.parquet(f"{folder}/own/{k}")
        frame = spark.read.parquet(f"{folder}/own/{k}")
        assert frame.schema.names == docs.schema.names
        for r in frame.collect():
            old = own[r["_block"]]
            assert (r["doc_id"], r["lang"], r["source"], r["kept"], r["score"], r["spans"], r["n_words"], r["predicted"]) == (*old[:1], *old[2:4], old[5], *old[7:])
            assert k == 0 or r["n_chars"] == len(r["text"])


def test_only_the_last_table_stays(spark, corpus):
    import glob
    import os

    from netloom.llm.common import checkpoint_dir

    at = checkpoint_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{at}/*"))
    P.run(spark, corpus[0])
    new = set(glob.glob(f"{at}/*")) - before
    assert len(new) == 1 and [os.path.basename(x) for x in glob.glob(f"{new.pop()}/*")] == ["4"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
