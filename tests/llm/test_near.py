import numpy as np
import pytest

from netloom.llm import near


def brute(rows, threshold=0.95):
    ok = {}
    for k, (_, v) in enumerate(rows):
        x = np.array(v, float) if v and None not in v else np.zeros(0)
        if len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            ok[k] = x / np.linalg.norm(x)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and (ok[i] @ ok[j] >= threshold or rows[i][1] == rows[j][1]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[b] = a
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min((x for x in (low.get(find(k)), i) if x is not None), default=None)
    return sorted(((i, links[k], low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as copies", "'x' as vector")
    return sorted((tuple(x) for x in near.near_duplicates(frame).collect()), key=str)


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, 16))
    return [(i * 7 % n + 10, (centers[i % 12] + r.normal(size=16) * r.choice([0.01, 0.2, 2])).tolist()) for i in range(n)]


@pytest.mark.parametrize(("shard", "n"), [(32768, 150), (60, 200), (32768, 900), (400, 900)])
def test_against_all_pairs(spark, monkeypatch, shard, n):
    monkeypatch.setattr(near, "SHARD", shard)
    rows = clustered(n, n)
    rows += [(1000 + i, rows[3][1]) for i in range(20)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None] + [0.0] * 14), (5, [float("nan")] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15), (7, [1e200] * 16), (8, [1e-200] * 16), (9, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.03]), (None, [0.0, 2.0]), (None, [-1.0, -1.0]), (None, [-1.0, -1.0]), (7, [-1.0, -1.01]), (None, None), (8, [1.0, -1.0]), (8, [1.0, -1.0])]
    assert run(spark, rows) == brute(rows)


def test_cosine_at_the_bound(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.5999999, 0.8000001])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in near.near_duplicates(frame, 0.6).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_hot_group_leaves_its_tasks_as_sums(spark, monkeypatch):
    """A thousand near copies, over two shards: rows that leave the tasks grow with the vectors, not with their pairs."""
    monkeypatch.setattr(near, "SHARD", 600)
    r = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + r.normal(size=8) * 0.01).tolist()) for i in range(1000)] + [(i, r.normal(size=8).tolist()) for i in range(1000, 1100)]
    assert run(spark, rows) == brute(rows)


def test_the_graph_finds_what_look_ups_return(monkeypatch):
    """Above any small size no shard is scanned, but for the audit's sample, and recall is that of the graph."""
    x = near._unit(np.array([v for _, v in clustered(3000)])).astype(np.float32)
    graph = near.Graph(x)
    beam = near.beam_for(graph, x, 0.95 - near.SLACK)
    assert 0 < beam <= 4 * near.BEAM
    hits = near.found(graph, x, 0.95 - near.SLACK, beam)
    truth = [np.nonzero(row >= 0.95 - near.SLACK)[0] for row in x @ x.T]
    assert sum(np.isin(t, f).sum() for t, f in zip(truth, hits, strict=True)) >= 0.99 * sum(map(len, truth))
    assert max(map(len, truth)) > near.BEAM  # some beams were full and went on by links


def test_bits():
    r = np.random.default_rng(9)
    n = 2500
    bits, plain = near.Bits(n), np.zeros((n, n), bool)
    for _ in range(400):
        i, places = int(r.integers(n)), r.integers(n, size=5)
        bits.put(i, places)
        plain[i, places] = True
    plain |= plain.T
    np.fill_diagonal(plain, False)
    weight = r.integers(1, 9, size=n).astype(float)
    assert (bits.sums(weight) == plain @ weight).all()


def test_empty_table(spark):
    assert near.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_a_graph():
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(500, 24)), 4, axis=0) + r.normal(size=(2000, 24)) * 0.15
    x = near._unit(x[r.permutation(2000)]).astype(np.float32)
    graph = near.Graph(x)
    found = near.lookup(graph, x, 0.9)
    truth = [np.nonzero(row >= 0.9)[0] for row in x @ x.T]
    got = sum(np.isin(t, f).sum() for t, f in zip(truth, found, strict=True))
    assert got >= 0.98 * sum(map(len, truth)) and all((x[f] @ x[i] >= 0.9 - 1e-5).all() for i, f in enumerate(found))


def severed(x):
    """A graph whose ground level leads nowhere."""
    graph = near.Graph(x)
    graph.links[0][:] = -1
    return graph


def test_a_dense_group_without_a_way_in_is_found():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 16))
    x[300:340] = x[300] + r.normal(size=(40, 16)) * 0.01
    x = near._unit(x).astype(np.float32)
    found = near.lookup(severed(x), x[300:340], 0.95)
    assert all(set(range(300, 340)) <= set(f.tolist()) for f in found)


def test_links_are_found_where_no_audited_look_up_has_any():
    r = np.random.default_rng(6)
    x = near._unit(r.normal(size=(600, 32))).astype(np.float32)
    asked = near._unit(r.normal(size=(400, 32))).astype(np.float32)
    sample = np.linspace(0, 399, near.AUDIT).astype(int)
    others = np.setdiff1d(np.arange(400), sample)[:50]
    asked[others] = x[200:250]
    assert not (asked[sample] @ x.T >= 0.95).any()
    for graph in (severed(x), near.Graph(x)):
        found = near.lookup(graph, asked, 0.95)
        assert all(200 + k in found[i] for k, i in enumerate(others))
