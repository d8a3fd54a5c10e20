"""Pages built in one task, against the same pages built stage by stage."""

import random

import numpy as np

from netloom.operators import page, reports, sheet
from netloom.sinks import netlists

NAMES = ["R1", "R2", "R3", "U7", "C12", "D4", "10k", "4.7uF", "NET_1", "NET_2", "SIG", "SIG", "42", "a b", " U3A ", None]


def drawing(spark, pages=5, n=160, side=240):
    r = random.Random(5)
    segs, shapes, texts = [], [], []
    for k in range(n * pages):
        x, y, long, kind = r.randrange(side), r.randrange(side), r.choice((0, 1, 2, 3, 4, 5, 30, 60)), r.randrange(4)
        segs.append((k % pages, k, float(x), float(y), float(x + long * (kind != 1)), float(y + long * (kind in (1, 3))), r.choice(("line", "line", "line", "rect", "curve")), None))
    segs.append((2, 10_000, None, 5.0, 9.0, 5.0, "line", None))
    for k in range(25 * pages):
        x, y, w = r.randrange(side), r.randrange(side), float(r.randrange(1, 9))
        kind = r.choice(("circle", "rect"))
        if k % pages != 1:  # a page without shapes: texts stand by segments
            shapes.append((k % pages, k, kind, [(float(x), float(y)), (x + w, y + w)], [0, 0, 0] if kind == "circle" and w < 5 else None))
    for k in range(80 * pages):
        x, y = r.randrange(side), r.randrange(side)
        texts.append((k % pages, k, r.choice([*NAMES, f"R{k}", f"C{k}", f"J{k}"]), float(x - 8), float(y - 3), float(x + 8), float(y + 3)))
    return (
        spark.createDataFrame(segs, "page long, seg long, x0 double, y0 double, x1 double, y1 double, kind string, color array<int>"),
        spark.createDataFrame(shapes, "page long, shape long, kind string, vertices array<struct<x:double,y:double>>, fill array<int>"),
        spark.createDataFrame(texts, "page long, text_id long, text string, bx0 double, by0 double, bx1 double, by1 double"),
        spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 9)], "page long"),  # 4 is drawn on and no page, 9 is empty
    )


def test_a_page_in_one_task_is_the_page_stage_by_stage(spark, monkeypatch):
    drawn, tables = drawing(spark), ("components", "pins", "nets", "wires", "edges")
    asked, real = [], page.staged
    monkeypatch.setattr(page, "staged", lambda *a: asked.append(sorted(x.page for x in a[0].select("page").distinct().collect())) or real(*a))
    found = page.build(*drawn, reach=1.0, recover=True)
    assert asked == [[2, 4]]  # a segment without a coordinate, and no row of pages
    plain = real(*drawn, reach=1.0, recover=True)
    for name in tables:
        a, b = getattr(found, name), getattr(plain, name)
        assert dict(a.dtypes) == dict(b.dtypes)
        rows = [sorted(map(repr, d.select(sorted(b.columns)).collect())) for d in (a, b)]
        assert rows[0] == rows[1] and rows[0], name
    assert found.components.where("cluster < 0").count() and found.nets.where("name = 'SIG'").count()


def test_a_drawing_of_pages_that_fit_is_read_in_one_task_a_page(spark, monkeypatch):
    segments, shapes, texts, pages = drawing(spark)
    monkeypatch.setattr(page, "staged", None)
    g = page.build(*(t.where("page in (0, 3)") for t in (segments, shapes, texts)), pages, reach=1.0, recover=True)
    assert g.edges.count() and g.components.where("cluster < 0").count() and g.nets.where("name = 'SIG'").count()


def test_boxes_that_meet():
    r = np.random.default_rng(1)
    low = r.integers(0, 3000, (2, 150))
    a = np.concatenate([low, low + r.integers(0, 200, (2, 150))]).astype(float)
    b = a[:, 50:]
    got = sorted((i, j) for p, q in sheet.meeting(a[:, :80], b, most=40) for i, j in zip(p.tolist(), q.tolist(), strict=True))
    want = [(i, j) for i in range(80) for j in range(b.shape[1]) if (a[:2, i] <= b[2:, j]).all() and (b[:2, j] <= a[2:, i]).all()]
    assert got == want and want


N = 260_000


def many(spark):
    """The graph of a page of many rows."""
    segments = spark.range(N).selectExpr("0L as page", "id as seg", "double(id % 500 * 10) as x0", "double(id div 500 % 40 * 10) as y0", "double(id % 500 * 10 + if(id % 3 = 0, 1, 9)) as x1", "double(id div 500 % 40 * 10) as y1", "'line' as kind", "cast(null as array<int>) as color")
    shapes, texts = (t.where("false") for t in drawing(spark, 1)[1:3])
    return page.build(segments, shapes, texts, spark.range(1).selectExpr("id as page"))


def test_a_page_of_many_rows_is_read_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(page, "staged", None)
    g = many(spark)
    assert g.pins.where("net is null").count() <= g.pins.count() and g.wires.count() >= N * 2 // 3  # a third is too short for a wire


def test_counters_of_a_page_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(page, "staged", None)
    g = many(spark)
    (row,) = reports.counters(g.components, g.pins, g.nets, g.edges, spark.range(1).selectExpr("id as page")).collect()
    assert row.nets == g.nets.count() > 0 and row.components == g.components.count()


def test_nets_of_a_page_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(page, "staged", None)
    g = many(spark)
    rows = g.nets.orderBy("net").collect()
    assert [r.number for r in rows] == list(range(1, len(rows) + 1)) and sum(r.n_segments for r in rows) == g.wires.count()


def test_netlist_of_a_page_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(page, "staged", None)
    g = many(spark)
    lines = netlists.netlist(g.components, g.pins, g.nets)
    assert lines.where("line like '    (net (code%'").count() == g.nets.count() > 0
