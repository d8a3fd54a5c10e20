import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.functions import text as T
from netloom.operators import checks, graph, spatial
from netloom.sources import sexpr

SEGMENT = "page long, seg int, x0 double, y0 double, x1 double, y1 double"


def test_text_predicates(spark):
    texts = ["R1", "C105", "QB1", "U1A", "SW1", "BC547", "49R9", "4k7", "10uF", "+5V", "3V3", "2N2222", "GND", "SIG_OUT", "a b", "", " R2 "]
    t = F.col("t")
    out = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.is_ref(t).alias("r"), T.is_value(t).alias("v"), T.is_net_label(t).alias("l"), T.is_rail(t).alias("p")).collect()
    assert {r["t"] for r in out if r["r"]} == {"R1", "C105", "QB1", "U1A", "SW1", " R2 "}
    assert {r["t"] for r in out if r["v"]} == {"BC547", "49R9", "4k7", "10uF", "+5V", "3V3", "2N2222"}
    assert {r["t"] for r in out if r["l"]} == {"GND", "SIG_OUT"}
    assert {r["t"] for r in out if r["p"]} == {"GND", "+5V", "3V3"}


def test_geometry(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)]
    row = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, square)], "x0 double, y0 double, x1 double, y1 double, vertices array<struct<x:double,y:double>>")
    out = row.select(G.length(), G.axis_aligned(), G.shoelace(), G.point_segment_d2(F.lit(3.0), F.lit(0.0), "x0", "y0", "x1", "y1"), G.point_segment_d2(F.lit(1.0), F.lit(1.0), "x0", "y0", "x0", "y0")).first()
    assert out[0] == 5 and out[1] is False and out[2] == 6 and abs(out[3] - 5.76) < 1e-9 and out[4] == 2


def plain_d2(px, py, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / size)) if size else 0.0
    return (px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2


def plain_touch(a, b, tol):
    return any(plain_d2(*p, *s) <= tol * tol for p, s in ((a[:2], b), (a[2:], b), (b[:2], a), (b[2:], a)))


def test_touching_with_and_without_cells(spark):
    r = random.Random(2)
    rows = [(p, s, *(float(r.randint(0, 40)) for _ in range(4))) for p in range(3) for s in range(25)]
    frame = spark.createDataFrame(rows, SEGMENT)
    whole = sorted(map(tuple, spatial.touching(frame).collect()))
    assert whole == sorted(map(tuple, spatial.touching(frame, cell=7.0).collect())) and whole
    assert whole == sorted((p, a, b) for p, a, *sa in rows for q, b, *sb in rows if p == q and a < b and plain_touch(sa, sb, 1.001))
    crossing = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 10.0, 10.0, 0.0)], SEGMENT)
    assert spatial.touching(crossing).count() == 0


LINE = SEGMENT + ", kind string, color array<int>"


def lines(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r), "line", None) for i, r in enumerate(rows)], LINE)


def ends(frame):
    return sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in frame.collect())


def test_merged(spark):
    meet = lines(spark, [(0, 0, 10, 0), (15, 0, 5, 0), (30, 0, 40, 0), (0, 5, 10, 5), (10, 5, 10, 9), (10, 7, 10, 20), (0, 0, 3, 3), (2, 2, 6, 6), (9, 9, 8, 8), (50, 50, 50, 50)])
    assert ends(spatial.merged(meet)) == [(0, 0, 6, 6), (0, 0, 15, 0), (0, 5, 10, 5), (8, 8, 9, 9), (10, 5, 10, 20), (30, 0, 40, 0), (50, 50, 50, 50)]
    apart = lines(spark, [(0, 0, 10, 0), (0, 100, 10, 100)])  # parallel lines stay two, near or far
    assert spatial.merged(apart).count() == 2 and spatial.merged(lines(spark, [(0, 0, 10, 0), (0, 5, 10, 5)])).count() == 2
    assert ends(spatial.merged(lines(spark, [(0, 0, 10, 0), (10.4, 0, 20, 0)]), 0.5)) == [(0, 0, 20, 0)]
    free = {(r["x"], r["y"]) for r in spatial.free_ends(meet).collect()}
    assert (10.0, 5.0) not in free and (0.0, 5.0) in free


def test_measures_of_pages(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page long")
    one = lambda f, *a: {r[0]: r[1] for r in f(*a).collect()}
    ladder = lines(spark, [(0, 0, n, 0) for n in range(1, 11)])
    assert one(spatial.scale, ladder, pages) == {1: 1.0, 2: 1.0} and one(spatial.scale, lines(spark, [(0, 0, 10, 0)]), pages) == {1: 10.0, 2: 1.0}
    assert one(spatial.wire_tolerance, lines(spark, [(0, 0, 10, 0)]), pages) == {1: 1.0, 2: 1.0} and one(spatial.link_distance, lines(spark, [(0, 0, 10, 0)]), pages) == {1: 10.0, 2: 10.0}
    r = random.Random(3)
    rows = [tuple(r.randint(0, 900) for _ in range(4)) for _ in range(40)]
    frame = lines(spark, rows)
    near = sorted(min(plain_d2(*p, *o) for j, o in enumerate(rows) if j != i) ** 0.5 for i, s in enumerate(rows) for p in (s[:2], s[2:]))
    quantile = lambda v, q: v[int(q * (len(v) - 1))] + (q * (len(v) - 1) % 1) * (v[min(int(q * (len(v) - 1)) + 1, len(v) - 1)] - v[int(q * (len(v) - 1))])
    assert abs(one(spatial.wire_tolerance, frame, pages)[1] - quantile(near, 0.25)) < 1e-9
    near = sorted(min((p[0] - e[0]) ** 2 + (p[1] - e[1]) ** 2 for j, o in enumerate(rows) if j != i for e in (o[:2], o[2:])) ** 0.5 for i, s in enumerate(rows) for p in (s[:2], s[2:]))
    assert abs(one(spatial.link_distance, frame, pages)[1] - max(5, quantile(near, 0.6))) < 1e-9


def test_wires_by_length_and_color(spark):
    green, red = [0, 132, 0], [132, 0, 0]
    rows = [(1, i, 0.0, 10.0 * i, 60.0, 10.0 * i, "line", green) for i in range(5)] + [(1, 10 + i, 5.0 * i, 200.0, 5.0 * i + 2, 200.0, "line", red) for i in range(9)]
    rows += [(1, 30, 0.0, 300.0, 3.0, 300.0, "line", green), (1, 31, 0.0, 0.0, 40.0, 40.0, "line", green), (1, 32, 0.0, 0.0, 90.0, 0.0, "curve", green)]
    frame = spark.createDataFrame(rows, LINE)
    wires = lambda f: {r["seg"] for r in f.where("is_wire").collect()}
    assert wires(spatial.separate(frame)) == set(range(5)) and wires(spatial.separate(frame, use_color=True)) == {*range(5), 30}
    assert 32 not in {r["seg"] for r in spatial.separate(frame).collect()}


def test_components_and_distances(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    out = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((x["id"], x["component"]) for x in out) == sorted((x, find(x)) for x in parent)
    chain = graph.distances(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (8, 9)], "a long, b long"), spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, chain.collect())) == [(0, 0), (1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_greedy_match(spark, seed):
    r = random.Random(seed)
    pairs = [(b, e, g, r.randint(1, 4)) for b in range(2) for e in range(8) for g in range(8) if r.random() < 0.4]
    taken = []
    for b, e, g, n in sorted(pairs, key=lambda p: (-p[3], -p[1], -p[2])):
        if not any(t[0] == b and (t[1] == e or t[2] == g) for t in taken):
            taken.append((b, e, g, n))
    out = graph.greedy_match(spark.createDataFrame(pairs, "board int, ext int, gt int, n int"), [F.desc("n"), F.desc("ext"), F.desc("gt")], "ext", "gt", ["board"])
    assert sorted(map(tuple, out.select("board", "ext", "gt", "n").collect())) == sorted(taken)


def test_rule_checks(spark):
    comp = spark.createDataFrame([("R1",), ("C1",), ("X1",)], "node string")
    pins = spark.createDataFrame([("R1", "1", "N1"), ("C1", "1", "N1"), ("C1", "2", None), ("R1", "2", "N2")], "node string, pin_id string, net string")
    nets = spark.createDataFrame([("N1", "VCC"), ("N2", None), ("N3", "Net-3")], "net string, name string")
    out = checks.violations(comp, pins, nets, pins.where("net is not null").select("node", "net"))
    assert sorted((r["rule"], r["item"]) for r in out.collect()) == [("DANGLING_NET", "N2"), ("FLOATING_PIN", "2"), ("ISOLATED_COMPONENT", "X1"), ("UNCONNECTED_NET", "N3"), ("UNNAMED_NET", "N2")]
    rows = spark.createDataFrame([(8, 517), (97, 143), (8, 11), (0, 0), (42, 261)], "c int, n int")
    assert [r[0] for r in rows.select(checks.scope(F.col("c"), F.col("n"))[1]).collect()] == [False, False, True, False, True]
    assert [tuple(r) for r in checks.summary(out).collect()] == [(2, 3, True, "2 error(s), 3 warning(s)")]


SHEET = """(kicad_sch (lib_symbols (symbol "Device:R" (symbol "R_1_1" (pin passive line (at 0 2.54 270) (number "1")) (pin passive line (at 0 -2.54 90) (number "2")))))
(wire (pts (xy 10 12.54) (xy 20 12.54))) (wire (pts (xy 20 12.54) (xy 20 30))) (wire (pts (xy 15 5) (xy 15 12.54))) (junction (at 15 12.54))
(label "A" (at 15 5)) (label "A" (at 90 90)) (symbol (lib_id "Device:R") (at 10 10 0) (property "Reference" "R1"))
(symbol (lib_id "Device:R") (at 20 32.54 0) (property "Reference" "R2")) (symbol (lib_id "x") (at 90 90 0) (property "Reference" "R3") (pin "7" (at 90 90))))"""


def test_schematic_nets(spark, tmp_path):
    for folder in ("a", "b"):  # boards of one name in two folders stay apart
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "sheet.kicad_sch").write_text(SHEET)
    (tmp_path / "a" / "sheet.pdf").write_bytes(b"%PDF")
    pins, counts = sexpr.true_nets(sexpr.read(spark, str(tmp_path / "*")))
    groups = {}
    for r in pins.collect():
        groups.setdefault((r["board"], r["net"], r["name"]), set()).add((r["ref"], r["pin"]))
    by_board = {}
    for (board, _, name), members in groups.items():
        by_board.setdefault(board[-7:], []).append((name == "A", sorted(members)))
    want = [(False, [("R1", "2")]), (False, [("R2", "1")]), (True, [("R1", "1"), ("R2", "2"), ("R3", "7")])]
    assert {k: sorted(v) for k, v in by_board.items()} == {"a/sheet": want, "b/sheet": want}
    assert {r["net_count"] for r in counts.collect()} == {4}  # the places of both labels are two groups before they are merged
    assert [r["folder"][-1] for r in sexpr.boards(spark, str(tmp_path)).collect()] == ["a"]
    with pytest.raises(ValueError, match="closes nothing"):
        sexpr.parse("(a))")


def test_power_ports_are_no_parts(spark):
    text = SHEET.replace('"R3"', '"#PWR01"')
    pins, _ = sexpr.true_nets(sexpr.parsed(spark.createDataFrame([("b", text)], "board string, value string")))
    assert {r["ref"] for r in sexpr.true_memberships(pins).collect()} == {"R1", "R2"} and pins.where("ref = '#PWR01'").count() == 1


def test_schematics_by_patterns(spark):
    text = '(kicad_sch (wire (pts (xy 1 2) (xy 3.5 -4))) (junction (at 5 6)) (label "A" (at 7 8 0)) (global_label "B" (shape input) (at 9 10 180))\n(symbol (lib_id "x") (at 1 2 0) (property "Reference" "R1") (property "Value" "10k")))'
    texts = spark.createDataFrame([("b", text), ("c", ""), ("d", None)], "board string, value string")
    wires, dots, labels = sexpr.scanned(texts)
    assert [tuple(r)[:6] for r in wires.collect()] == [("b", 0, 1.0, 2.0, 3.5, -4.0)] and [tuple(r)[:3] for r in dots.collect()] == [("b", 5.0, 6.0)]
    assert sorted((r["text"], r["x"], r["y"], r["is_global"]) for r in labels.collect()) == [("A", 7.0, 8.0, False), ("B", 9.0, 10.0, True)]
    assert [tuple(r) for r in sexpr.symbol_blocks(texts).collect()] == [("b", "R1", "10k", 1.0, 2.0)]


def test_streamed_checks(spark, tmp_path):
    from netloom.streaming import erc

    kind = "node string, pin_id string, net string"

    def come(name, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        for q in erc.watch(stream, str(tmp_path / "out"), str(tmp_path / "state")):
            q.awaitTermination(120)
        return sorted((r["rule"], r["item"]) for r in erc.report(spark, str(tmp_path / "out")).collect())

    assert come("1", [("R1", "1", "N1"), ("C1", "2", None), ("R1", "3", "N2")]) == [("DANGLING_NET", "N1"), ("DANGLING_NET", "N2"), ("FLOATING_PIN", "2")]
    # a second component comes in a later batch: the net no longer dangles
    assert come("2", [("C1", "4", "N1"), ("R1", "5", "N2")]) == [("DANGLING_NET", "N2"), ("FLOATING_PIN", "2")]


def test_distances_along_a_chain_of_more_than_a_hundred_edges(spark):
    chain = spark.range(104).selectExpr("id as a", "id + 1 as b")
    found = graph.distances(chain, spark.range(1).selectExpr("id as node")).collect()
    assert sorted((r["node"], r["length"]) for r in found) == [(k, k) for k in range(105)]
