"""Queries that score extracted nets, rebuild nets from wires, and write netlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import reconstruct, scoring
from netloom.plans.drawing import _plain, _split, built
from netloom.plans.registry import LEN, grown, pp, query, view, with_views
from netloom.plans.scratch import written
from netloom.sinks import netlists
from netloom.sources import rendering as R

# ---- extracted nets against true ones: a supplier is a true net, its halves by quantity are extracted ones; a board is a nation

view("gt", "", "SELECT DISTINCT s_nationkey AS board, 'g' || l_suppkey AS net, 'p' || l_partkey AS ref FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
view("ex", "", "SELECT DISTINCT s_nationkey AS board, 'e' || l_suppkey || '_' || CAST(CAST(l_quantity AS BIGINT) % 5 = 0 AS INT) AS net, 'p' || l_partkey AS ref FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber % 5 <> 0")


def _true(spark, sf_dir):
    li, s = R.table(spark, sf_dir, "lineitem"), R.table(spark, sf_dir, "supplier")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("s_nationkey").alias("board"), F.concat(F.lit("g"), "l_suppkey").alias("net"), F.concat(F.lit("p"), "l_partkey").alias("ref")).distinct()


def _extracted(spark, sf_dir):
    li, s = R.table(spark, sf_dir, "lineitem"), R.table(spark, sf_dir, "supplier")
    j = li.where("l_linenumber % 5 <> 0").join(s, li.l_suppkey == s.s_suppkey)
    half = (F.col("l_quantity").cast("long") % 5 == 0).cast("int")
    return j.select(F.col("s_nationkey").alias("board"), F.concat(F.lit("e"), "l_suppkey", F.lit("_"), half).alias("net"), F.concat(F.lit("p"), "l_partkey").alias("ref")).distinct()


@query(with_views("gt ex", "SELECT board, ext, gt, count(*) AS overlap FROM (SELECT e.board, e.net AS ext, g.net AS gt FROM ex e JOIN gt g ON e.board = g.board AND e.ref = g.ref) GROUP BY ALL"))
def net_overlaps(spark, sf_dir):
    """Parts that extracted and true nets have in common."""
    return scoring.overlaps(_extracted(spark, sf_dir), _true(spark, sf_dir))


# every true net's larger half overlaps it most: the matching in SQL takes each true net's best half where both best agree
view("ov", "gt ex", "SELECT board, ext, gt, overlap, row_number() OVER (PARTITION BY board, ext ORDER BY overlap DESC, ext DESC, gt DESC) AS re, row_number() OVER (PARTITION BY board, gt ORDER BY overlap DESC, ext DESC, gt DESC) AS rg FROM (SELECT e.board, e.net AS ext, g.net AS gt, count(*) AS overlap FROM ex e JOIN gt g ON e.board = g.board AND e.ref = g.ref GROUP BY ALL)")


@query(with_views("ov", "SELECT board, ext, gt, overlap FROM ov WHERE re = 1 AND rg = 1"))
def best_matches(spark, sf_dir):
    """Nets that are each other's best match: what the first round of the greedy matching takes."""
    from netloom.operators.spatial import one_per

    pairs = written(scoring.overlaps(_extracted(spark, sf_dir), _true(spark, sf_dir)))
    order = [F.desc("overlap"), F.desc("ext"), F.desc("gt")]
    return one_per(pairs, ["board", "ext"], order).join(one_per(pairs, ["board", "gt"], order).select("board", "ext", "gt"), ["board", "ext", "gt"]).select("board", "ext", "gt", "overlap")


@query()
def greedy_match(spark, sf_dir):
    """Extracted nets matched one to one with true ones by their common parts; the order is total."""
    return scoring.matched(*scoring.in_common(_extracted(spark, sf_dir), _true(spark, sf_dir)))


@query(with_views("gt", """SELECT g.board, g.net AS ext, g.net AS gt, count(DISTINCT g.ref) AS overlap FROM gt g GROUP BY ALL"""))
def greedy_match_itself(spark, sf_dir):
    """True nets matched with themselves: each has more in common with itself than with any other."""
    g = _true(spark, sf_dir)
    return scoring.matched(g, g)


@query()
def board_scores(spark, sf_dir):
    """True and false positives, misses, precision, recall and F1 of every board."""
    s = scoring.score_boards(_extracted(spark, sf_dir), _true(spark, sf_dir))
    return s.select("board", "num_gt", "overlap_refs", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(with_views("gt", "SELECT board, count(DISTINCT ref) AS num_gt, count(DISTINCT ref) AS overlap_refs, count(*) AS tp, 0 AS fp, 0 AS fn, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1 FROM gt GROUP BY board"))
def perfect_scores(spark, sf_dir):
    """The same of true nets against themselves."""
    g = _true(spark, sf_dir)
    s = scoring.score_boards(g, g)
    return s.select("board", "num_gt", "overlap_refs", "tp", F.col("fp").cast("int").alias("fp"), F.col("fn").cast("int").alias("fn"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query()
def score_summary(spark, sf_dir):
    """Mean, upper median, least and greatest F1 over boards."""
    out = scoring.summary(scoring.score_boards(_extracted(spark, sf_dir), _true(spark, sf_dir)))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "low", "high")))


@query()
def error_buckets(spark, sf_dir):
    """Missed and wrong memberships by the part's class and the true net's degree."""
    classes = _true(spark, sf_dir).select("board", "ref").distinct().join(R.components(spark, sf_dir).select(F.col("node").alias("ref"), "class_name"), "ref")
    return scoring.error_buckets(_extracted(spark, sf_dir), _true(spark, sf_dir), classes)


@query("""SELECT o_custkey AS ref, list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS INT) + 1] AS median, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY o_custkey""")
def board_medians(spark, sf_dir):
    """Means and upper medians, as scores over boards are reported."""
    out = scoring.summary(R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref"), "o_totalprice"), "o_totalprice", ["ref"])
    return out.select("ref", "median", F.round("mean", 6).alias("mean"), "low", "high", "n")


_PAIRS = "SELECT DISTINCT a.board, a.ref AS a, b.ref AS b FROM {0} a JOIN {0} b ON a.board = b.board AND a.net = b.net AND a.ref < b.ref"
view("po_g", "", "SELECT DISTINCT l_orderkey % 50 AS board, l_orderkey AS net, l_partkey AS ref FROM lineitem")
view("po_e", "", "SELECT DISTINCT l_orderkey % 50 AS board, l_orderkey AS net, l_partkey AS ref FROM lineitem WHERE l_linenumber % 5 <> 0")


@query(with_views("po_g po_e", f"""SELECT board, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT board, count(*) FILTER (g AND e) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (e IS NULL) AS fn
FROM (SELECT *, true AS g FROM ({_PAIRS.format('po_g')})) FULL JOIN (SELECT *, true AS e FROM ({_PAIRS.format('po_e')})) USING (board, a, b) GROUP BY board)"""))
def pair_f1(spark, sf_dir):
    """Pairs of parts that share an order, found against true, by the order's page."""
    li = R.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("board"), F.col("l_orderkey").alias("net"), F.col("l_partkey").alias("ref"), "l_linenumber")
    out = scoring.pair_f1(li.where("l_linenumber % 5 <> 0").drop("l_linenumber"), li.drop("l_linenumber"))
    return out.select("board", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_KEY = "string_agg(DISTINCT k, ';' ORDER BY k)"


def _sets(flag: str) -> str:
    return f"SELECT net, {_KEY} AS key FROM (SELECT l_orderkey AS net, (l_partkey % 4) || '.0 ' || (l_suppkey % 3) || '.0 ' || (l_partkey % 4 + 1) || '.0 ' || (l_suppkey % 3) || '.0' AS k FROM lineitem WHERE l_returnflag = '{flag}') GROUP BY net"


def _drawn(spark, sf_dir, flag):
    li = R.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    x, y = (F.col("l_partkey") % 4).cast("double"), (F.col("l_suppkey") % 3).cast("double")
    return li.select(F.col("l_orderkey").alias("net"), (x + 1).alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))


@query(f"""WITH a AS (SELECT net AS net_a, key, row_number() OVER (PARTITION BY key ORDER BY net) AS n FROM ({_sets('R')})), b AS (SELECT net AS net_b, key, row_number() OVER (PARTITION BY key ORDER BY net) AS n FROM ({_sets('A')})) SELECT net_a, net_b FROM a FULL JOIN b USING (key, n)""")
def net_equivalence(spark, sf_dir):
    """Nets of two netlists with equal segments, paired, and those without a counterpart."""
    return scoring.equivalent_nets(_drawn(spark, sf_dir, "R"), _drawn(spark, sf_dir, "A"))


@query(f"WITH a AS (SELECT key, count(*) AS na FROM ({_sets('R')}) GROUP BY key), b AS (SELECT key, count(*) AS nb FROM ({_sets('A')}) GROUP BY key) SELECT false AS equivalent, CAST(sum(least(coalesce(na, 0), coalesce(nb, 0))) AS BIGINT) AS matched_nets, CAST(sum(na) AS BIGINT) AS nets_a, CAST(sum(nb) AS BIGINT) AS nets_b FROM a FULL JOIN b USING (key)")
def netlists_equivalent(spark, sf_dir):
    """How many nets of two netlists match."""
    return scoring.equivalence(net_equivalence(spark, sf_dir))


@query("SELECT l_suppkey AS board, round(CASE WHEN a = b THEN 1.0 ELSE least(a, b) * 1.0 / greatest(a, b) END, 6) AS ratio FROM (SELECT l_suppkey, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b FROM lineitem GROUP BY 1)")
def count_ratio(spark, sf_dir):
    """How near two counts are to each other."""
    n = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("board")).agg(F.count_distinct("l_orderkey").alias("a"), F.count_distinct("l_partkey").alias("b"))
    return n.select("board", F.round(scoring.count_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("SELECT s_suppkey AS board, geo AS geo_f1, det AS det_f1, round(det - geo, 6) AS delta, CASE WHEN det - geo > 0.02 THEN 'better' WHEN det - geo < -0.02 THEN 'worse' ELSE 'same' END AS change FROM (SELECT s_suppkey, s_suppkey % 7 / 8.0 AS geo, s_suppkey % 5 / 8.0 AS det FROM supplier)")
def compared_scores(spark, sf_dir):
    """Two scores of each board and which is better."""
    s = R.table(spark, sf_dir, "supplier")
    f = lambda m: s.select(F.col("s_suppkey").alias("board"), (F.col("s_suppkey") % m / 8.0).alias("f1"))
    return scoring.compared(f(7), f(5)).withColumn("delta", F.round("delta", 6))


@query("""WITH a AS (SELECT o_orderkey % 40 AS board, CAST(o_custkey % 100 AS DOUBLE) AS gx, CAST(o_orderkey % 90 AS DOUBLE) AS gy, 72 / 25.4 * (o_custkey % 100) + 5 + o_orderkey % 3 AS ex, CASE WHEN o_orderkey % 40 % 2 = 0 THEN 1 ELSE -1 END * 72 / 25.4 * (o_orderkey % 90) + 7 AS ey FROM orders),
t AS (SELECT board, quantile_cont(ex - 72 / 25.4 * gx, 0.5) AS tx, quantile_cont(ey - CASE WHEN board % 2 = 0 THEN 1 ELSE -1 END * 72 / 25.4 * gy, 0.5) AS ty FROM a GROUP BY board)
SELECT board, board % 2 = 1 AS turned, round(tx, 6) AS tx, round(ty, 6) AS ty FROM t""")
def translation_fit(spark, sf_dir):
    """Where true places lie on the page, by the medians of what was recognised; half of the boards are upside down."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gx, gy = (c % 100).cast("double"), (k % 90).cast("double")
    board = k % 40
    sign = F.when(board % 2 == 0, 1).otherwise(-1)
    a = R.table(spark, sf_dir, "orders").select(board.alias("board"), gx.alias("gx"), gy.alias("gy"), (72 / 25.4 * gx + 5 + k % 3).alias("ex"), (sign * 72 / 25.4 * gy + 7).alias("ey"))
    return scoring.fit_translation(a).select("board", (F.col("sy") < 0).alias("turned"), F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


# ---- nets rebuilt from wires: the drawing's wires, with orders as labels and every seventh customer as a junction

view("jun", "", "SELECT DISTINCT c_custkey % 50 AS page, CAST((c_custkey * 41) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 67) % 1000 AS DOUBLE) AS y FROM customer WHERE c_custkey % 7 = 0")
_ON = "({p} BETWEEN least({s}x0, {s}x1) - {t} AND greatest({s}x0, {s}x1) + {t} AND {q} BETWEEN least({s}y0, {s}y1) - {t} AND greatest({s}y0, {s}y1) + {t} AND abs(({s}x1 - {s}x0) * ({q} - {s}y0) - ({s}y1 - {s}y0) * ({p} - {s}x0)) < {t})"


def _on(p: str, q: str, s: str, t: str) -> str:
    return _ON.format(p=p, q=q, s=s, t=t)


view("wend", "wir", "SELECT page, seg, x0 AS x, y0 AS y FROM wir UNION SELECT page, seg, x1, y1 FROM wir")
view("tjun", "wend wir jun", f"""SELECT DISTINCT e.page, e.x, e.y FROM wend e JOIN wir w ON w.page = e.page AND w.seg <> e.seg WHERE {_on('e.x', 'e.y', 'w.', '0.01')} AND {pp('e.x', 'e.y', 'w.x0', 'w.y0')} > 0.0001 AND {pp('e.x', 'e.y', 'w.x1', 'w.y1')} > 0.0001
  AND NOT EXISTS (SELECT 1 FROM jun j WHERE j.page = e.page AND j.x = e.x AND j.y = e.y)""")


def _drawn_junctions(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").where("c_custkey % 7 = 0")
    k = F.col("c_custkey")
    return c.select((k % 50).alias("page"), ((k * 41) % 1000).cast("double").alias("x"), ((k * 67) % 1000).cast("double").alias("y")).distinct()


def _wires(spark, sf_dir):
    return _plain(_split(spark, sf_dir).where("is_wire"))


@query(with_views("tjun", "SELECT * FROM tjun"))
def t_junctions(spark, sf_dir):
    """Wire ends on other wires where no junction is drawn."""
    return reconstruct.t_junctions(_wires(spark, sf_dir), _drawn_junctions(spark, sf_dir))


view("jwire", "tjun jun wir", f"SELECT DISTINCT j.page, j.x, j.y, w.seg FROM (SELECT * FROM jun UNION ALL SELECT * FROM tjun) j JOIN wir w ON w.page = j.page AND {_on('j.x', 'j.y', 'w.', '0.01')}")


@query(with_views("jwire", "SELECT * FROM jwire"))
def junction_wires(spark, sf_dir):
    """The wires that each junction joins."""
    w, j = _wires(spark, sf_dir), _drawn_junctions(spark, sf_dir)
    return reconstruct.junction_wires(written(j.unionByName(reconstruct.t_junctions(w, j))), w)


view("rplace", "wend jwire", "SELECT page, x, y, seg FROM wend UNION SELECT page, x, y, seg FROM jwire")
view("rlnk", "rplace", "SELECT DISTINCT a.page, a.seg AS a, b.seg AS b FROM rplace a JOIN rplace b USING (page, x, y) WHERE a.seg <> b.seg")
grown("rgrow", "wir rlnk", "wir", "seg", "rlnk")
view("rnet", "rgrow wir", "SELECT w.page, n.net, w.seg, x0, y0, x1, y1 FROM wir w JOIN (SELECT page, id AS seg, min(root) AS net FROM rgrow GROUP BY ALL) n USING (page, seg)")


def _rebuilt(spark, sf_dir):
    return written(reconstruct.nets(_wires(spark, sf_dir), _drawn_junctions(spark, sf_dir)))


@query(with_views("rnet", "SELECT page, seg, net FROM rnet"))
def rebuilt_nets(spark, sf_dir):
    """Wires that share an end or a junction."""
    return _rebuilt(spark, sf_dir).select("page", "seg", "net")


view("rlab", "", "SELECT o_orderkey % 50 AS page, o_orderkey AS label, 'NET_' || o_orderkey % 31 AS text, CAST((o_custkey * 29 + o_orderkey * 3) % 1000 AS DOUBLE) AS x, CAST((o_orderkey * 31) % 1000 AS DOUBLE) AS y, o_orderkey % 4 = 0 AS is_global FROM orders")


def _labels(spark, sf_dir):
    k = F.col("o_orderkey")
    o = R.table(spark, sf_dir, "orders")
    return o.select((k % 50).alias("page"), k.alias("label"), F.concat(F.lit("NET_"), k % 31).alias("text"), ((F.col("o_custkey") * 29 + k * 3) % 1000).cast("double").alias("x"), ((k * 31) % 1000).cast("double").alias("y"), (k % 4 == 0).alias("is_global"))


view("rname", "rnet rlab", f"""SELECT page, net, coalesce(arg_max(text, label) FILTER (is_global), arg_min(text, label) FILTER (NOT is_global), 'Net-' || net) AS name FROM (SELECT DISTINCT page, net FROM rnet) LEFT JOIN (SELECT DISTINCT w.page, w.net, l.label, l.text, l.is_global FROM rlab l JOIN rnet w ON w.page = l.page AND {_on('l.x', 'l.y', 'w.', '0.5')}) USING (page, net) GROUP BY page, net""")


@query(with_views("rname", "SELECT * FROM rname"))
def rebuilt_names(spark, sf_dir):
    """Names of rebuilt nets by the labels on them, global ones first."""
    return reconstruct.names(_rebuilt(spark, sf_dir), _labels(spark, sf_dir))


@query(with_views("rnet jun rlab", f"""SELECT page, wires, nets, total_length, round(wires / nets, 2) AS segments_a_net, coalesce(j, 0) AS junctions, coalesce(l, 0) AS labels, nets > 0 AS passed FROM (SELECT page, count(*) AS wires, count(DISTINCT net) AS nets, round(sum({LEN}), 2) AS total_length FROM rnet GROUP BY page)
LEFT JOIN (SELECT page, count(*) AS j FROM jun GROUP BY page) USING (page) LEFT JOIN (SELECT page, count(*) AS l FROM rlab GROUP BY page) USING (page)"""))
def stress_metrics(spark, sf_dir):
    """Counts and lengths of rebuilt nets by page."""
    return reconstruct.stress_metrics(_rebuilt(spark, sf_dir), _drawn_junctions(spark, sf_dir), _labels(spark, sf_dir))


@query()
def global_scope(spark, sf_dir):
    """Rebuilt nets, those nearest to global labels of one text as one."""
    return reconstruct.global_scope(_rebuilt(spark, sf_dir), _labels(spark, sf_dir)).select("page", "seg", "net")


@query("""WITH p AS (SELECT 'resistor_ladder_' || n AS page, n, unnest(range(n)) AS i FROM (SELECT unnest([3, 10, 200]) AS n))
SELECT page, seg, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM (SELECT page, 2 * i AS seg, 50 + 10 * i AS x0, 50 AS y0, 60 + 10 * i AS x1, 50 AS y1 FROM p UNION ALL SELECT page, 2 * i + 1, 55 + 10 * i, 50, 55 + 10 * i, 55 FROM p WHERE i < n - 1)""")
def ladders(spark, sf_dir):
    """Wires of ladders of three lengths."""
    from netloom.sources import synthetic

    return synthetic.ladders(spark, [3, 10, 200])[0]


@query()
def synthetic_nets(spark, sf_dir):
    """Nets of ladders, bridges and meshes."""
    from netloom.sources import synthetic

    wires, labels = synthetic.ladders(spark, [3, 10])
    more, dots, named = synthetic.bridges(spark, [20.0, 50.0])
    wires = written(wires.unionByName(more).unionByName(synthetic.meshes(spark, [(5, 7, 42), (20, 30, 123), (50, 80, 999)])))
    found, names = reconstruct.rebuild(wires, dots, written(labels.unionByName(named)))
    return found.groupBy("page").agg(F.count("*").alias("wires"), F.count_distinct("net").alias("nets")).join(names.groupBy("page").agg(F.count_if(~F.col("name").startswith("Net-")).alias("named")), "page")


# ---- sinks


@query(with_views("part_node pin_net net_row", """SELECT page, ref || ' ' || coalesce((SELECT string_agg(coalesce('N' || number, ref || '_' || pin), ' ' ORDER BY pin) FROM pin_net p LEFT JOIN net_row n ON n.page = p.page AND n.net = p.net WHERE p.page = c.page AND p.cluster = c.cluster), '') || ' ' || class_name AS line FROM part_node c
UNION ALL SELECT page, unnest(['* Structural netlist', '', '', '.end']) FROM (SELECT DISTINCT page FROM part_node)"""))
def spice_lines(spark, sf_dir):
    """The lines of each page's structural netlist."""
    g = built(spark, sf_dir)
    return netlists.spice(g.components, g.pins, g.nets).select("page", "line")


@query(with_views("part_node pin_net net_row", """SELECT page, line, count(*) AS n FROM (SELECT page, '    (comp (ref "' || ref || '")' AS line FROM part_node UNION ALL SELECT page, '      (value "' || coalesce(nullif(value, ''), class_name) || '")' FROM part_node UNION ALL SELECT page, '    )' FROM part_node UNION ALL SELECT page, '    )' FROM net_row
  UNION ALL SELECT page, '    (net (code "' || number || '") (name "' || name || '")' FROM net_row UNION ALL SELECT page, '      (node (ref "' || ref || '") (pin "' || pin || '"))' FROM pin_net JOIN part_node USING (page, cluster) WHERE net IS NOT NULL
  UNION ALL SELECT page, unnest(['(export (version D)', '  (design', '    (source "extracted.pdf")', '  )', '  (components', '  )', '  (nets', '  )', ')']) FROM (SELECT DISTINCT page FROM net_row)) GROUP BY page, line"""))
def netlist_lines(spark, sf_dir):
    """How often each line stands in each page's S-expression netlist."""
    g = built(spark, sf_dir)
    return netlists.netlist(g.components, g.pins, g.nets).groupBy("page", "line").agg(F.count("*").alias("n"))


@query(with_views("net_row", """SELECT page, net AS item, '{"net_id":"N' || number || '","name":"' || name || '","is_global":false,"segments":' || n_segments || '}' AS json FROM net_row"""))
def netlist_json(spark, sf_dir):
    """The nets of each page's graph as JSON objects."""
    g = built(spark, sf_dir)
    return netlists.graph_json(g.components, g.pins, g.nets, g.edges).where("section = 'nets'").select("page", "item", "json")


@query(with_views("wir", """SELECT page, count(*) + 8 AS lines, sum(CAST(starts_with(line, '  (wire') AS BIGINT)) AS wires, min(line) AS first_wire FROM (SELECT page, '  (wire (pts (xy ' || x0 || ' ' || y0 || ') (xy ' || x1 || ' ' || y1 || ')) (uuid "00000000-0000-0000-0000-' || lpad(CAST(row_number() OVER (PARTITION BY page ORDER BY seg) - 1 AS VARCHAR), 12, '0') || '"))' AS line FROM wir) GROUP BY page"""))
def schematic_lines(spark, sf_dir):
    """Each page's wires as a schematic."""
    w = _wires(spark, sf_dir)
    none = w.select("page", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    lines = netlists.schematic(w, none, none.select("page", F.lit(0).cast("long").alias("label"), F.lit("").alias("text"), "x", "y", F.lit(True).alias("is_global")))
    wire = F.col("line").startswith("  (wire")
    return lines.groupBy("page").agg(F.count("*").alias("lines"), F.sum(wire.cast("long")).alias("wires"), F.min(F.when(wire, F.col("line"))).alias("first_wire"))


@query("""SELECT s_suppkey % 50 AS page, s_suppkey AS box, printf('%d %.6f %.6f %.6f %.6f', CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, ((s_suppkey * 97) % 1000 + w / 2) * 2 / 5000, ((s_suppkey * 59) % 1000 + w / 2) * 2 / 5000, w * 2 / 5000, w * 2 / 5000) AS line FROM (SELECT s_suppkey, CAST(30 + s_nationkey AS DOUBLE) AS w FROM supplier)""")
def box_labels(spark, sf_dir):
    """Detector labels of the boxes on pages of 5000 pixels."""
    d = R.detections(spark, sf_dir).withColumns({"width": F.lit(5000.0), "height": F.lit(5000.0)})
    return netlists.box_labels(d, ["resistor", "ic"])


@query("SELECT s_suppkey AS board, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS place, CASE WHEN (row_number() OVER (ORDER BY s_suppkey) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM supplier")
def dataset_split(spark, sf_dir):
    """Every fifth board in order validates."""
    return netlists.every_fifth(R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("board")), "board").select("board", F.col("place").cast("long").alias("place"), "split")
