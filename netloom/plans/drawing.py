"""Queries over drawings: measures and joins by place, and the way from a page to its graph, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.functions import text as T
from netloom.operators import association, detect, page, reports, spatial, tiles
from netloom.plans.registry import ALIGNED, LEN, d2, ends, grown, link_reach, pp, query, scale, tolerance, touch, view, with_views
from netloom.plans.scratch import written
from netloom.sources import rendering as R

_R = 6  # decimals of what is compared


def _r(column, name=None):
    return F.round(column, _R).alias(name or column)


def _flat(spark, sf_dir):
    return page.boxed_shapes(R.shapes(spark, sf_dir))


def _drawn(spark, sf_dir):
    """All segments, written once: a join of the rendering with itself would render each row anew for each of its cells."""
    return written(R.segments(spark, sf_dir))


def _split(spark, sf_dir):
    """Segments apart from curves with is_wire, written once for all that a query reads of them."""
    drawn = written(R.segments(spark, sf_dir).select("page", "seg", "x0", "y0", "x1", "y1", "kind"))
    return written(spatial.separate(drawn).select("page", "seg", "x0", "y0", "x1", "y1", "is_wire"))


def _plain(rows):
    return rows.select("page", "seg", "x0", "y0", "x1", "y1")


# ---- measures of segments, shapes and points


@query(with_views("seg", f"SELECT page, seg, round({LEN}, 6) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, {ALIGNED} AS aligned, kind <> 'curve' AND (abs(x1 - x0) < 1 OR abs(y1 - y0) < 1) AS near_axis, y0 = y1 AS horizontal, x0 = x1 AS vertical FROM seg"))
def segment_measures(spark, sf_dir):
    """Length, middle and direction of each segment."""
    mx, my = G.midpoint()
    return R.segments(spark, sf_dir).select("page", "seg", _r(G.length(), "len"), mx.alias("mx"), my.alias("my"), G.axis_aligned().alias("aligned"), G.near_axis().alias("near_axis"), G.horizontal().alias("horizontal"), G.vertical().alias("vertical"))


@query(with_views("seg", f"""SELECT page, seg, round((x1 - x0) / {LEN}, 6) AS ux, round((y1 - y0) / {LEN}, 6) AS uy, x0 + 0.25 * (x1 - x0) AS qx, y0 + 0.25 * (y1 - y0) AS qy, x0 * x1 + y0 * y1 AS dot, x0 * y1 - y0 * x1 AS crossed,
  abs((x1 - x0) * (x0 + x1) / 2 - (x1 - x0) * x0) < 1e9 AND y0 = y1 AS holds FROM seg"""))
def vectors(spark, sf_dir):
    """Unit vectors, a point at a quarter, products of the ends, and whether a level segment holds its middle."""
    ux, uy = G.normalized(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    qx, qy = G.point_at(F.lit(0.25))
    mx, my = G.midpoint()
    s = R.segments(spark, sf_dir)
    holds = (F.col("y0") == F.col("y1")) & G.contains_point(mx, my, 0.01)
    return s.select("page", "seg", _r(ux, "ux"), _r(uy, "uy"), qx.alias("qx"), qy.alias("qy"), G.dot("x0", "y0", "x1", "y1").alias("dot"), G.cross("x0", "y0", "x1", "y1").alias("crossed"), holds.alias("holds"))


@query(with_views("shp", "SELECT page, shape, kind, CASE WHEN kind = 'polygon' THEN bx0 ELSE bx0 END AS bx0, by0, bx1, by1, round(CASE kind WHEN 'circle' THEN pi() * pow((w + h) / 4, 2) WHEN 'rect' THEN w * h ELSE w * h / 2 END, 6) AS area, fill AND w > 0.5 AND w < 5 AS is_dot, (bx0 + bx1) / 2 AS cx, w * h AS box_area FROM shp"))
def shape_measures(spark, sf_dir):
    """Boxes and areas of shapes, and which are junctions."""
    s = R.shapes(spark, sf_dir).withColumns({"area": G.shape_area(), "is_dot": G.is_dot()}).withColumns(G.shape_box())
    cx, _ = G.midpoint("bx0", "by0", "bx1", "by1")
    return s.select("page", "shape", "kind", "bx0", "by0", "bx1", "by1", _r("area"), "is_dot", cx.alias("cx"), G.box_area().alias("box_area"))


view("sep", "seg", f"""SELECT *, coalesce({ALIGNED} AND len >= greatest(5.0, 3.0 * p25), false) AS is_wire FROM (SELECT *, quantile_cont(len, 0.25) FILTER (len > 0.1) OVER (PARTITION BY page) AS p25 FROM (SELECT *, {LEN} AS len FROM seg WHERE kind <> 'curve'))""")
view("sym", "sep", "SELECT page, seg, x0, y0, x1, y1 FROM sep WHERE NOT is_wire")
view("wir", "sep", "SELECT page, seg, x0, y0, x1, y1 FROM sep WHERE is_wire")


@query(with_views("sep", "SELECT page, seg, is_wire FROM sep"))
def separate_wires(spark, sf_dir):
    """Wires by direction and by length against the page's lower quartile."""
    return spatial.separate(_drawn(spark, sf_dir)).select("page", "seg", "is_wire")


_MODE = "SELECT page, color, n FROM (SELECT page, color, count(*) AS n, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, min(seg)) AS r FROM {0} WHERE color IS NOT NULL GROUP BY page, color) WHERE r = 1"


def _rgb():
    return F.when(F.get("color", F.lit(0)) == 0, "green").otherwise("red")


@query(with_views("sep", _MODE.format("sep")))
def dominant_color(spark, sf_dir):
    """The most frequent colour of each page, the first drawn among equals."""
    return spatial.dominant_color(spatial.separate(_drawn(spark, sf_dir))).select("page", _rgb().alias("color"), "n")


view("wcol", "sep", f"""SELECT w.page, w.color FROM ({_MODE.format("(SELECT * FROM sep WHERE is_wire)")}) w LEFT JOIN ({_MODE.format("(SELECT * FROM sep WHERE NOT is_wire)")}) s USING (page)
  WHERE (SELECT count(*) FROM sep c WHERE c.page = w.page AND c.is_wire AND c.color IS NOT NULL) >= 4 AND (s.color IS NULL OR s.color <> w.color)""")


@query(with_views("sep wcol", f"SELECT s.page, s.seg, s.is_wire OR ({ALIGNED} AND coalesce(s.color = w.color, false)) AS is_wire FROM sep s LEFT JOIN wcol w USING (page)"))
def separate_by_color(spark, sf_dir):
    """Wires by direction and length, and shorter ones in the colour that wires have."""
    return spatial.separate(_drawn(spark, sf_dir), use_color=True).select("page", "seg", "is_wire")


@query(with_views("seg pg", scale("seg").replace("scale FROM", "scale FROM", 1)))
def estimate_scale(spark, sf_dir):
    """The nearest-rank tenth percentile of lengths, by page; 1 on empty pages."""
    return spatial.scale(R.segments(spark, sf_dir), R.pages(spark))


@query(with_views("wir pg", f"SELECT page, round(tol, 6) AS tol FROM ({tolerance('wir')})"))
def wire_tolerance(spark, sf_dir):
    """Each page's tolerance: the lower quartile of wires' ends' distances to the nearest other wire; 1 on empty pages."""
    wires = _plain(_split(spark, sf_dir).where("is_wire"))
    return spatial.wire_tolerance(wires, R.pages(spark)).select("page", _r("tol"))


@query(with_views("sym pg", f"SELECT page, round(reach, 6) AS link_dist FROM ({link_reach('sym')})"))
def link_distance(spark, sf_dir):
    """Each page's linking distance: the 60th percentile of symbols' ends' distances to the nearest end of another; 10 on empty pages."""
    return spatial.link_distance(_plain(_split(spark, sf_dir).where("not is_wire")), R.pages(spark)).select("page", _r("reach", "link_dist"))


view("shp_mid", "shp", "SELECT page, shape AS point, (bx0 + bx1) / 2 AS x, (by0 + by1) / 2 AS y FROM shp")


@query(with_views("shp_mid pg", f"""SELECT page, round(CASE WHEN count(d) = 0 THEN 10.0 ELSE greatest(5.0, quantile_cont(d, 0.9) * 1.5) END, 6) AS eps FROM pg LEFT JOIN (SELECT page, point, d FROM (SELECT a.page, a.point, sqrt({pp('a.x', 'a.y', 'b.x', 'b.y')}) AS d,
  row_number() OVER (PARTITION BY a.page, a.point ORDER BY {pp('a.x', 'a.y', 'b.x', 'b.y')}) AS r, count(*) OVER (PARTITION BY a.page, a.point) AS n FROM shp_mid a JOIN shp_mid b ON a.page = b.page AND a.point <> b.point) WHERE r = least(n, 3)) USING (page) GROUP BY page"""))
def point_spacing(spark, sf_dir):
    """A scale from the spacing of shapes' centres."""
    x, y = G.midpoint("bx0", "by0", "bx1", "by1")
    return spatial.point_spacing(_flat(spark, sf_dir).select("page", F.col("shape").alias("point"), x.alias("x"), y.alias("y")), R.pages(spark)).select("page", _r("eps"))


@query(with_views("seg", f"SELECT page, x, y FROM ({ends('seg')}) GROUP BY page, x, y HAVING count(*) = 1"))
def free_endpoints(spark, sf_dir):
    """Ends that no other segment shares."""
    return spatial.free_ends(R.segments(spark, sf_dir))


view("line_key", "seg", f"""SELECT page, x0, y0, x1, y1, CASE WHEN {LEN} < 1e-9 OR kind = 'curve' THEN 'own' || seg WHEN x0 = x1 THEN 'v' || x0 WHEN y0 = y1 THEN 'h' || y0 ELSE 'd' || (y0 - x0) END AS line, CASE WHEN x0 = x1 THEN y0 ELSE x0 END AS lo, CASE WHEN x0 = x1 THEN y1 ELSE x1 END AS hi FROM seg""")


@query(with_views("line_key", """SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page, line ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY page, line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM line_key)) GROUP BY page, line, island"""))
def collinear_merge(spark, sf_dir):
    """Segments of one line that meet, as one, whatever its direction; others as they are."""
    return spatial.merged(R.segments(spark, sf_dir))


@query(with_views("wir", f"SELECT a.page, a.seg AS a, b.seg AS b FROM wir a JOIN wir b ON a.page = b.page AND a.seg < b.seg WHERE ((a.x0 = a.x1) = (b.x0 = b.x1)) AND least({pp('a.x0', 'a.y0', 'b.x0', 'b.y0')}, {pp('a.x0', 'a.y0', 'b.x1', 'b.y1')}, {pp('a.x1', 'a.y1', 'b.x0', 'b.y0')}, {pp('a.x1', 'a.y1', 'b.x1', 'b.y1')}) < 9"))
def collinear_neighbors(spark, sf_dir):
    """Wires in one direction with ends less than three units apart."""
    return spatial.collinear_neighbors(_plain(_split(spark, sf_dir).where("is_wire")), 3.0).select("page", "a", "b")


# ---- joins by place


@query(with_views("seg", f"SELECT a.page, a.seg AS a, b.seg AS b FROM seg a JOIN seg b ON a.page = b.page AND a.seg < b.seg WHERE {touch('1.001')}"))
def segments_touch(spark, sf_dir):
    """Pairs of segments of a page that touch."""
    return spatial.touching(_plain(_drawn(spark, sf_dir)))


_SIDE = "(({1}x1 - {1}x0) * ({0}y{2} - {1}y0) - ({1}y1 - {1}y0) * ({0}x{2} - {1}x0))"


@query(with_views("seg", f"""SELECT a.page, a.seg AS a, b.seg AS b FROM seg a JOIN seg b ON a.page = b.page AND a.seg < b.seg WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
  AND {_SIDE.format('b.', 'a.', 0)} * {_SIDE.format('b.', 'a.', 1)} <= 0 AND {_SIDE.format('a.', 'b.', 0)} * {_SIDE.format('a.', 'b.', 1)} <= 0"""))
def segments_intersect(spark, sf_dir):
    """Pairs of segments that cross or touch."""
    s = spatial.padded(_plain(_drawn(spark, sf_dir)))
    return spatial.meeting(s, s).where((F.col("seg") < F.col("_seg")) & G.intersects()).select("page", F.col("seg").alias("a"), F.col("_seg").alias("b"))


view("touch_link", "seg", f"SELECT a.page, a.seg AS a, b.seg AS b FROM seg a JOIN seg b ON a.page = b.page AND a.seg <> b.seg WHERE {touch('1.001')}")
grown("touch_grow", "seg touch_link", "seg", "seg", "touch_link")


@query(with_views("touch_grow", "SELECT page, id AS seg, min(root) AS net FROM touch_grow GROUP BY page, id"))
def build_nets(spark, sf_dir):
    """The net of each segment: the first segment that touching ones lead to."""
    return spatial.touch_groups(written(_plain(R.segments(spark, sf_dir))), "net").select("page", "seg", "net")


@query(with_views("seg txt", f"SELECT page, text_id, seg, round(d2, 6) AS d2 FROM (SELECT page, text_id, seg, {d2('x', 'y')} AS d2, row_number() OVER (PARTITION BY page, text_id ORDER BY {d2('x', 'y')}, seg) AS r FROM seg JOIN txt USING (page)) WHERE r = 1"))
def nearest_wire(spark, sf_dir):
    """The nearest segment of each text, however far; the first of equals."""
    return spatial.nearest_segment(_centres(spark, sf_dir), written(_plain(R.segments(spark, sf_dir))), ["text_id"]).select("page", "text_id", "seg", _r("d2"))


def _centres(spark, sf_dir):
    x, y = G.midpoint("bx0", "by0", "bx1", "by1")
    return R.texts(spark, sf_dir).select("page", "text_id", x.alias("x"), y.alias("y"))


@query(with_views("seg txt", f"SELECT page, text_id, seg, round(d2, 6) AS d2 FROM (SELECT page, text_id, seg, {d2('x', 'y')} AS d2, row_number() OVER (PARTITION BY page, text_id ORDER BY {d2('x', 'y')}, seg DESC) AS r FROM seg JOIN txt USING (page) WHERE {d2('x', 'y')} <= 25) WHERE r = 1"))
def nearest_net(spark, sf_dir):
    """The nearest segment within 5 units; the last of equals."""
    return spatial.nearest_segment(_centres(spark, sf_dir), _drawn(spark, sf_dir), ["text_id"], 5.0, last=True).select("page", "text_id", "seg", _r("d2"))


_BOX = "least(x0, x1) - 2 AS bx0, least(y0, y1) - 2 AS by0, greatest(x0, x1) + 2 AS bx1, greatest(y0, y1) + 2 AS by1"


@query(with_views("seg", f"SELECT a.page, a.seg AS a, b.seg AS b FROM (SELECT page, seg, {_BOX} FROM seg) a JOIN (SELECT page, seg, {_BOX} FROM seg) b ON a.page = b.page AND a.seg < b.seg WHERE a.bx0 <= b.bx1 AND b.bx0 <= a.bx1 AND a.by0 <= b.by1 AND b.by0 <= a.by1"))
def box_overlap(spark, sf_dir):
    """Segments whose padded boxes meet."""
    return tiles.overlapping(spatial.padded(_plain(_drawn(spark, sf_dir)), 2.0))


@query(with_views("seg txt", f"SELECT page, text_id, seg FROM (SELECT page, text_id, seg, row_number() OVER (PARTITION BY page, text_id ORDER BY (bx1 - bx0) * (by1 - by0), seg) AS r FROM (SELECT page, seg, {_BOX} FROM seg) JOIN txt USING (page) WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1) WHERE r = 1"))
def smallest_box(spark, sf_dir):
    """The smallest box around each text's centre."""
    boxes = spatial.padded(_drawn(spark, sf_dir), 2.0).select("page", F.col("seg").alias("box"), "bx0", "by0", "bx1", "by1")
    return spatial.smallest_box(_centres(spark, sf_dir), boxes, ["text_id"], [("x", "y")]).select("page", "text_id", F.col("box").alias("seg"))


# ---- from a page to its graph

view("rch", "sym pg", link_reach("sym"))
view("send", "sym", ends("sym"))
view("lnk", "send rch", f"SELECT DISTINCT a.page, a.seg AS a, b.seg AS b FROM send a JOIN rch USING (page) JOIN send b ON a.page = b.page AND a.seg <> b.seg WHERE {pp('a.x', 'a.y', 'b.x', 'b.y')} <= reach * reach")
grown("grow", "sym lnk", "sym", "seg", "lnk")
view("grp", "grow sym", "SELECT s.page, s.seg, c.cluster, x0, y0, x1, y1 FROM sym s JOIN (SELECT page, id AS seg, min(root) AS cluster FROM grow GROUP BY ALL) c USING (page, seg)")
view("shc", "shp send grp rch", f"""SELECT s.page, s.shape, g.cluster, s.bx0, s.by0, s.bx1, s.by1 FROM shp s JOIN (SELECT page, shape, seg FROM (SELECT p.page, p.shape, e.seg, row_number() OVER (PARTITION BY p.page, p.shape ORDER BY {pp('p.x', 'p.y', 'e.x', 'e.y')}, e.seg DESC) AS r
  FROM (SELECT page, shape, (bx0 + bx1) / 2 AS x, (by0 + by1) / 2 AS y FROM shp) p JOIN rch USING (page) JOIN send e ON e.page = p.page WHERE {pp('p.x', 'p.y', 'e.x', 'e.y')} <= reach * reach) WHERE r = 1) n USING (page, shape) JOIN grp g USING (page, seg)""")


def _clusters(name: str, members: str, shapes: str, least: int) -> None:
    view(name, f"{members} {shapes}", f"""SELECT page, cluster, sum(s) AS n_segments, sum(1 - s) AS n_shapes, min(bx0) AS bx0, min(by0) AS by0, max(bx1) AS bx1, max(by1) AS by1 FROM (SELECT page, cluster, 1 AS s, least(x0, x1) AS bx0, least(y0, y1) AS by0, greatest(x0, x1) AS bx1, greatest(y0, y1) AS by1 FROM {members}
  UNION ALL SELECT page, cluster, 0, bx0, by0, bx1, by1 FROM {shapes}) GROUP BY page, cluster HAVING count(*) >= {least}""")


_clusters("clu", "grp", "shc", 2)


def _found(spark, sf_dir, split=None, reach=None):
    s = _split(spark, sf_dir) if split is None else split
    return page.cluster(_plain(s.where("not is_wire")), _flat(spark, sf_dir), R.pages(spark), reach)


_SHOWN = "page, cluster, CAST(n_segments AS BIGINT) AS n_segments, CAST(n_shapes AS BIGINT) AS n_shapes, bx0, by0, bx1, by1"


@query(with_views("clu", f"SELECT {_SHOWN} FROM clu"))
def page_clusters(spark, sf_dir):
    """Symbols' segments joined by the ends that lie near each other, with the shapes beside them."""
    return _found(spark, sf_dir).clusters


@query(with_views("grp clu", "SELECT page, seg FROM grp g WHERE NOT EXISTS (SELECT 1 FROM clu c WHERE c.page = g.page AND c.cluster = g.cluster)"))
def orphan_segments(spark, sf_dir):
    """Segments that are no part of a cluster."""
    return _found(spark, sf_dir).orphans.select("page", "seg")


@query()
def merged_fragments(spark, sf_dir):
    """Clusters of one or two segments that end next to each other, taken together in their order."""
    s = _split(spark, sf_dir)
    reach = written(spatial.link_distance(_plain(s.where("not is_wire")), R.pages(spark)))
    found = _found(spark, sf_dir, s, reach)
    return page.merge_fragments(found.members, found.clusters, reach.select("page", (3 * F.col("reach")).alias("reach")))


view("zon", "txt", r"SELECT page, text_id, x - 8 - 24 AS bx0, y - 3 - 20 AS by0, x + 8 + 24 AS bx1, y + 3 + 20 AS by1 FROM txt WHERE regexp_matches(trim(text), '^[A-Za-z]+\d+[A-Za-z]*$')")
view("znear", "zon clu", "SELECT z.page, z.text_id, c.cluster, c.n_segments > 5 AS is_large FROM zon z JOIN clu c USING (page) WHERE NOT (c.bx1 < z.bx0 OR c.bx0 > z.bx1 OR c.by1 < z.by0 OR c.by0 > z.by1)")
view("zlnk", "znear", "SELECT DISTINCT a.page, a.cluster AS a, b.cluster AS b FROM znear a JOIN znear b USING (page, text_id) WHERE a.cluster <> b.cluster AND (SELECT count(*) FROM znear n WHERE n.page = a.page AND n.text_id = a.text_id AND n.is_large) <= 1")
grown("zgrow", "clu zlnk", "clu", "cluster", "zlnk")
view("zmap", "zgrow", "SELECT page, id AS cluster, min(root) AS merged FROM zgrow GROUP BY ALL")
view("mem", "grp zmap", "SELECT page, merged AS cluster, seg, x0, y0, x1, y1 FROM grp JOIN zmap USING (page, cluster)")
view("msh", "shc zmap", "SELECT page, merged AS cluster, shape, bx0, by0, bx1, by1 FROM shc JOIN zmap USING (page, cluster)")
_clusters("mclu", "mem", "msh", 1)


def _merged(spark, sf_dir, split=None):
    return page.merge_by_text(_found(spark, sf_dir, split), R.texts(spark, sf_dir))


@query(with_views("mclu", f"SELECT {_SHOWN} FROM mclu"))
def text_clusters(spark, sf_dir):
    """Clusters that meet the zone of one designator, as one."""
    return _merged(spark, sf_dir).clusters


_REF, _VALUE, _LABEL = (p.replace("'", "''") for p in (T.REF, T.VALUE, T.LABEL))
view("named", "txt", f"""SELECT * FROM (SELECT page, text_id, text, x, y, CASE WHEN regexp_matches(trim(text), '{_REF}') THEN 'ref' WHEN regexp_matches(trim(text), '{_VALUE}') THEN 'value' WHEN length(trim(text)) BETWEEN 1 AND 50 AND regexp_matches(trim(text), '{_LABEL}') THEN 'net_label' END AS kind FROM txt) WHERE kind IS NOT NULL""")
view("asc_sym", "named shp", """SELECT page, text_id, text, kind, sx AS ax, sy AS ay, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, text_id ORDER BY distance * (CASE WHEN (kind = 'ref' AND x - sx > 0) OR (kind = 'value' AND x - sx < 0) THEN 1.5 ELSE 1.0 END
  * CASE WHEN (kind = 'ref' AND y - sy > 0) OR (kind = 'value' AND y - sy < 0) THEN 1.5 ELSE 1.0 END), shape) AS r FROM (SELECT n.*, s.shape, s.sx, s.sy, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS distance FROM named n JOIN (SELECT page, shape, (bx0 + bx1) / 2 AS sx, (by0 + by1) / 2 AS sy FROM shp) s USING (page) WHERE kind <> 'net_label') WHERE distance <= 50) WHERE r = 1""")
view("asc_wire", "named seg", f"""SELECT page, text_id, text, kind, mx AS ax, my AS ay, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, text_id ORDER BY distance, seg) AS r FROM (SELECT n.page, n.text_id, n.text, n.kind, s.seg, (s.x0 + s.x1) / 2 AS mx, (s.y0 + s.y1) / 2 AS my, sqrt({d2('x', 'y', 's.')}) AS distance
  FROM named n JOIN seg s USING (page) WHERE n.kind = 'net_label' AND s.kind = 'line') WHERE distance < 50) WHERE r = 1""")
view("assoc", "asc_sym asc_wire", "SELECT * FROM asc_sym UNION ALL SELECT * FROM asc_wire")


def _named(spark, sf_dir):
    return association.associate(R.texts(spark, sf_dir), _flat(spark, sf_dir), _drawn(spark, sf_dir))


@query(with_views("assoc", "SELECT page, text_id, text, kind, ax, ay, round(distance, 6) AS distance, round(greatest(0.0, 1 - distance / 50), 6) AS confidence FROM assoc"))
def text_association(spark, sf_dir):
    """What each designator, value and net label names."""
    return _named(spark, sf_dir).select("page", "text_id", "text", "kind", "ax", "ay", _r("distance"), _r("confidence"))


def _case(expr: str, values: dict[str, object]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


view("own_text", "asc_sym mclu", f"""SELECT page, cluster, max(CASE WHEN kind = 'ref' THEN text END) AS ref, max(CASE WHEN kind = 'value' THEN text END) AS value FROM (SELECT a.page, n.cluster, a.kind, a.text, row_number() OVER (PARTITION BY a.page, n.cluster, a.kind ORDER BY a.distance, a.text_id) AS r FROM asc_sym a JOIN (
  SELECT page, text_id, cluster FROM (SELECT a.page, a.text_id, c.cluster, row_number() OVER (PARTITION BY a.page, a.text_id ORDER BY {pp('ax', 'ay', 'c.cx', 'c.cy')}, c.cluster) AS r FROM asc_sym a JOIN (SELECT page, cluster, (bx0 + bx1) / 2 AS cx, (by0 + by1) / 2 AS cy FROM mclu) c USING (page)) WHERE r = 1) n USING (page, text_id)) WHERE r = 1 GROUP BY page, cluster""")
_TWO, _ONE = _case("substr(l, 1, 2)", T.RULE_CLASSES_2), _case("substr(l, 1, 1)", T.RULE_CLASSES_1)
_SURE = f"CASE WHEN {_TWO} IS NOT NULL THEN coalesce({_case('substr(l, 1, 2)', T.RULE_SURE_2)}, 0.95) WHEN {_ONE} IS NOT NULL THEN coalesce({_case('substr(l, 1, 1)', T.RULE_SURE_1)}, 0.95)"
_W, _H = "(bx1 - bx0)", "(by1 - by0)"
_DRAWN = f"CASE WHEN n_segments <= 4 AND n_shapes = 0 AND {_W} * {_H} < 400 THEN {{0}} WHEN CASE WHEN {_H} > 0 THEN {_W} / {_H} ELSE 1.0 END > 3 AND n_segments > 4 THEN {{1}} ELSE {{2}} END"
view("part_node", "mclu own_text", f"""SELECT page, cluster, coalesce(ref, 'U' || number) AS ref, value, coalesce({_TWO}, {_ONE}, {_DRAWN.format("'power_symbol'", "'ic'", "'unknown'")}) AS class_name, CAST({_SURE} ELSE {_DRAWN.format('0.45', '0.35', '0.25')} END AS DOUBLE) AS confidence, bx0, by0, bx1, by1
  FROM (SELECT c.*, o.ref, o.value, row_number() OVER (PARTITION BY c.page ORDER BY c.cluster) - 1 AS number, regexp_extract(upper(coalesce(o.ref, '')), '^([A-Z]+)\\d', 1) AS l FROM mclu c LEFT JOIN own_text o USING (page, cluster))""")


@query(with_views("part_node", "SELECT * FROM part_node"))
def component_nodes(spark, sf_dir):
    """Clusters with the designator and value nearest to each, and their class."""
    return page.components(_merged(spark, sf_dir).clusters, written(_named(spark, sf_dir)))


view("stub_all", "mem", f"""SELECT m.*, {ALIGNED} AND EXISTS (SELECT 1 FROM (SELECT page, cluster, x, y FROM (SELECT page, cluster, x0 AS x, y0 AS y FROM mem UNION ALL SELECT page, cluster, x1, y1 FROM mem) GROUP BY ALL HAVING count(*) = 1) f
  WHERE f.page = m.page AND f.cluster = m.cluster AND ((f.x = m.x0 AND f.y = m.y0) OR (f.x = m.x1 AND f.y = m.y1))) AS stub FROM mem m""")
view("stub", "stub_all mclu", "SELECT s.*, s.stub AND (SELECT count(*) FILTER (NOT t.stub) FROM stub_all t WHERE t.page = s.page AND t.cluster = s.cluster) + c.n_shapes >= 2 AS gives FROM stub_all s JOIN mclu c USING (page, cluster)")


@query(with_views("stub", "SELECT page, seg, gives AS is_stub FROM stub"))
def stub_wires(spark, sf_dir):
    """Segments of clusters that are wires after all."""
    body, stubs = page.recover_stubs(_merged(spark, sf_dir))
    return body.select("page", "seg", F.lit(False).alias("is_stub")).unionByName(stubs.select("page", "seg", F.lit(True).alias("is_stub")))


view("orp", "grp clu", "SELECT page, seg, x0, y0, x1, y1 FROM grp g WHERE NOT EXISTS (SELECT 1 FROM clu c WHERE c.page = g.page AND c.cluster = g.cluster)")
view("wire2", "wir orp", f"SELECT * FROM wir UNION ALL SELECT * FROM orp WHERE {ALIGNED}")
view("wire3", "wire2 stub", "SELECT * FROM wire2 UNION ALL SELECT page, seg, x0, y0, x1, y1 FROM stub WHERE gives")
view("tol1", "wire3 pg", tolerance("wire3"))
view("wire4", "wire3 shp", "SELECT * FROM wire3 UNION ALL SELECT page, shape + 1152921504606846976, (bx0 + bx1) / 2, (by0 + by1) / 2, (bx0 + bx1) / 2, (by0 + by1) / 2 FROM shp WHERE fill AND w > 0.5 AND w < 5")
view("wlnk", "wire4 tol1", f"SELECT a.page, a.seg AS a, b.seg AS b FROM wire4 a JOIN tol1 t USING (page) JOIN wire4 b ON a.page = b.page AND a.seg <> b.seg WHERE {touch('(tol + 0.001)')}")
grown("wgrow", "wire4 wlnk", "wire4", "seg", "wlnk")
view("netw", "wgrow wire4", "SELECT w.*, n.net FROM wire4 w JOIN (SELECT page, id AS seg, min(root) AS net FROM wgrow GROUP BY ALL) n USING (page, seg)")


@query(with_views("netw", "SELECT page, seg, net FROM netw"))
def page_nets(spark, sf_dir):
    """Wires, reclaimed orphans, stubs and junctions joined to nets within each page's own tolerance."""
    s = _split(spark, sf_dir)
    found = _found(spark, sf_dir, s)
    _, stubs = page.recover_stubs(page.merge_by_text(found, R.texts(spark, sf_dir)))
    wires = _plain(s.where("is_wire"))
    wires = written(wires.unionByName(page.reclaimed(found.orphans, wires, R.pages(spark).withColumn("scale", F.lit(1.0)))).unionByName(stubs))
    return page.nets(wires, page.dots(R.shapes(spark, sf_dir)), R.pages(spark)).select("page", "seg", "net")


view("tol2", "netw pg", tolerance("netw"))
view("lab", "asc_wire netw tol2", f"""SELECT page, name, net FROM (SELECT a.page, trim(a.text) AS name, w.net, row_number() OVER (PARTITION BY a.page, a.text_id ORDER BY {d2('ax', 'ay', 'w.')}, w.net DESC) AS r FROM asc_wire a JOIN tol2 t USING (page) JOIN netw w USING (page)
  WHERE trim(a.text) <> '' AND NOT regexp_matches(trim(a.text), '^[0-9]+$') AND {d2('ax', 'ay', 'w.')} <= (tol * 6.0) * (tol * 6.0)) WHERE r = 1""")
view("lab_lnk", "lab", "SELECT DISTINCT a.page, a.net AS a, b.net AS b FROM lab a JOIN lab b USING (page, name) WHERE a.net <> b.net")
view("net_id", "netw", "SELECT DISTINCT page, net FROM netw")
grown("lgrow", "net_id lab_lnk", "net_id", "net", "lab_lnk")
view("lmap", "lgrow", "SELECT page, id AS net, min(root) AS merged FROM lgrow GROUP BY ALL")
view("lnet", "netw lmap", "SELECT w.page, w.seg, m.merged AS net, x0, y0, x1, y1 FROM netw w JOIN lmap m USING (page, net)")
view("lname", "lab lmap", "SELECT page, merged AS net, min(name) AS name FROM lab JOIN lmap USING (page, net) GROUP BY ALL")
view("net_row", "lnet lname", "SELECT page, net, number, coalesce(name, 'Net-' || number) AS name, n_segments FROM (SELECT page, net, name, n_segments, row_number() OVER (PARTITION BY page ORDER BY net) AS number FROM (SELECT page, net, count(*) AS n_segments FROM lnet GROUP BY ALL) LEFT JOIN lname USING (page, net))")
view("scl", "wire2 pg", scale("wire2"))
view("body", "stub", "SELECT page, cluster, seg, x0, y0, x1, y1 FROM stub WHERE NOT gives")
view("rim", "body mclu", """SELECT f.page, f.cluster, f.x, f.y, least(f.x - bx0, bx1 - f.x, f.y - by0, by1 - f.y) AS rim FROM (SELECT page, cluster, x, y FROM (SELECT page, cluster, x0 AS x, y0 AS y FROM body UNION ALL SELECT page, cluster, x1, y1 FROM body) GROUP BY ALL HAVING count(*) = 1) f JOIN mclu USING (page, cluster)""")
view("pin_at", "rim", "SELECT page, cluster, CAST(row_number() OVER (PARTITION BY page, cluster ORDER BY x, y) AS INT) AS pin, x, y FROM (SELECT *, greatest(1.0, quantile_cont(rim, 0.5) OVER (PARTITION BY page, cluster)) AS tol FROM rim) WHERE rim <= tol + 0.001")
view("pin_net", "pin_at lnet tol2 scl", f"""SELECT page, cluster, pin, x, y, net FROM pin_at LEFT JOIN (SELECT p.page, p.cluster, p.pin, w.net, row_number() OVER (PARTITION BY p.page, p.cluster, p.pin ORDER BY {d2('x', 'y', 'w.')}, w.net DESC) AS r FROM pin_at p JOIN tol2 USING (page) JOIN scl USING (page) JOIN lnet w USING (page)
  WHERE {d2('x', 'y', 'w.')} <= greatest(3.0 * tol, 2.0 * scale) * greatest(3.0 * tol, 2.0 * scale)) n USING (page, cluster, pin) WHERE r = 1 OR r IS NULL""")


def built(spark, sf_dir) -> page.Graph:
    return page.build(_drawn(spark, sf_dir), R.shapes(spark, sf_dir), R.texts(spark, sf_dir), R.pages(spark))


@query(with_views("net_row", "SELECT * FROM net_row"))
def label_nets(spark, sf_dir):
    """Nets of the built graph: those next to labels of one name are one, and have that name."""
    return built(spark, sf_dir).nets


@query(with_views("pin_net", "SELECT * FROM pin_net"))
def page_pins(spark, sf_dir):
    """Pins of the built graph with their nets."""
    return built(spark, sf_dir).pins


@query(with_views("part_node pin_net net_row", "SELECT p.page, p.cluster, p.ref, p.class_name, p.value, e.net, n.name, e.pin FROM (SELECT page, cluster, net, max(pin) AS pin FROM pin_net WHERE net IS NOT NULL GROUP BY ALL) e JOIN part_node p USING (page, cluster) JOIN net_row n USING (page, net)"))
def build_page(spark, sf_dir):
    """The graph of every page: which component is on which net, by which pin."""
    g = built(spark, sf_dir)
    return g.edges.join(g.components, ["page", "cluster"]).join(g.nets, ["page", "net"]).select("page", "cluster", "ref", "class_name", "value", "net", "name", "pin")


@query()
def recovered_parts(spark, sf_dir):
    """Edges of the graph with parts made up for designators that lost their cluster to another."""
    g = page.build(_drawn(spark, sf_dir), R.shapes(spark, sf_dir), R.texts(spark, sf_dir), R.pages(spark), recover=True)
    return g.edges.join(g.components.where("cluster < 0"), ["page", "cluster"]).select("page", "ref", "class_name", "net", "pin")


# ---- features and detections

view("cpoint", "mem shp msh", """SELECT page, cluster, x0 AS x, y0 AS y FROM mem UNION ALL SELECT page, cluster, x1, y1 FROM mem
  UNION ALL SELECT m.page, m.cluster, unnest(CASE kind WHEN 'circle' THEN [s.bx0, s.bx1] WHEN 'rect' THEN [s.bx0, s.bx1, s.bx1, s.bx0] ELSE [(s.bx0 + s.bx1) / 2, s.bx1, (s.bx0 + s.bx1) / 2, s.bx0] END),
  unnest(CASE kind WHEN 'circle' THEN [s.by0, s.by1] WHEN 'rect' THEN [s.by0, s.by0, s.by1, s.by1] ELSE [s.by0, (s.by0 + s.by1) / 2, s.by1, (s.by0 + s.by1) / 2] END) FROM msh m JOIN shp s USING (page, shape)""")
view("cseg", "mem", f"SELECT page, cluster, ln(1 + sum({LEN})) AS total, ln(1 + max({LEN})) AS longest FROM mem GROUP BY ALL")
view("carea", "msh shp", "SELECT m.page, m.cluster, sum(CASE s.kind WHEN 'circle' THEN pi() * pow((s.w + s.h) / 4, 2) WHEN 'rect' THEN s.w * s.h ELSE s.w * s.h / 2 END) AS area FROM msh m JOIN shp s USING (page, shape) GROUP BY ALL")


@query(with_views("mclu cseg carea cpoint", f"""SELECT page, cluster, round(CASE WHEN {_H} > 0 THEN {_W} / {_H} ELSE 1.0 END, 6) AS aspect_ratio, round(ln(1 + n_segments), 6) AS num_segments, round(ln(1 + {_W} * {_H}), 6) AS bb_area, CAST(n_shapes AS DOUBLE) AS num_shapes,
  round(CASE WHEN {_W} * {_H} > 0 THEN coalesce(area, 0) / ({_W} * {_H}) ELSE 0 END, 6) AS shape_area_ratio, round(total, 6) AS total_segment_length, round(longest, 6) AS max_segment_length, round(mx, 6) AS centroid_x, round(my, 6) AS centroid_y, round(sx, 6) AS std_x, round(sy, 6) AS std_y
  FROM mclu LEFT JOIN cseg USING (page, cluster) LEFT JOIN carea USING (page, cluster) LEFT JOIN (SELECT page, cluster, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM cpoint GROUP BY ALL) USING (page, cluster)"""))
def features(spark, sf_dir):
    """Eleven of the thirteen features of each cluster; the hull's two are in features_hull."""
    return _features(spark, sf_dir).select("page", "cluster", *(_r(c) for c in ("aspect_ratio", "num_segments", "bb_area", "num_shapes", "shape_area_ratio", "total_segment_length", "max_segment_length", "centroid_x", "centroid_y", "std_x", "std_y")))


def _features(spark, sf_dir):
    from netloom.operators import learning

    return learning.features(_merged(spark, sf_dir), _flat(spark, sf_dir))


@query()
def features_hull(spark, sf_dir):
    """Area and share of the convex hull of each cluster's points."""
    return _features(spark, sf_dir).select("page", "cluster", _r("convex_hull_area"), _r("solidity"))


view("det", "", "SELECT s_suppkey % 50 AS page, s_suppkey AS box, CASE WHEN s_suppkey % 2 = 0 THEN 'resistor' ELSE 'ic' END AS class_name, CASE WHEN s_suppkey % 4 = 0 THEN 'X' || s_suppkey END AS ref, CAST((s_suppkey * 97) % 1000 AS DOUBLE) AS bx0, CAST((s_suppkey * 59) % 1000 AS DOUBLE) AS by0, CAST((s_suppkey * 97) % 1000 + 30 + s_nationkey AS DOUBLE) AS bx1, CAST((s_suppkey * 59) % 1000 + 30 + s_nationkey AS DOUBLE) AS by1 FROM supplier")
view("det_seg", "det seg", """SELECT page, seg, box FROM (SELECT s.page, s.seg, d.box, row_number() OVER (PARTITION BY s.page, s.seg ORDER BY (d.bx1 - d.bx0) * (d.by1 - d.by0), d.box) AS r FROM seg s JOIN det d USING (page) WHERE (s.x0 BETWEEN d.bx0 - 3 AND d.bx1 + 3 AND s.y0 BETWEEN d.by0 - 3 AND d.by1 + 3)
  OR (s.x1 BETWEEN d.bx0 - 3 AND d.bx1 + 3 AND s.y1 BETWEEN d.by0 - 3 AND d.by1 + 3) OR ((s.x0 + s.x1) / 2 BETWEEN d.bx0 - 3 AND d.bx1 + 3 AND (s.y0 + s.y1) / 2 BETWEEN d.by0 - 3 AND d.by1 + 3)) WHERE r = 1""")


def _boxes(spark, sf_dir):
    return detect.in_points(R.detections(spark, sf_dir), 144.0)


@query(with_views("det_seg", "SELECT * FROM det_seg"))
def detected_segments(spark, sf_dir):
    """The smallest detection around each segment."""
    return detect.segments_in(_drawn(spark, sf_dir), _boxes(spark, sf_dir), 3.0)


@query()
def detected_parts(spark, sf_dir):
    """Detections that hold a segment, with the designators that they get in turn."""
    parts, _ = detect.components(_boxes(spark, sf_dir), _drawn(spark, sf_dir), _named(spark, sf_dir), 3.0)
    return parts.select("page", "cluster", "ref", "class_name", "confidence")


@query(with_views("det_seg asc_sym pg", "SELECT page, coalesce(c, 0) AS n_components, coalesce(r, 0) AS n_refs, coalesce(r, 0) = 0 OR coalesce(c, 0) >= 0.5 * coalesce(r, 0) AS use_detector FROM pg LEFT JOIN (SELECT page, count(DISTINCT box) AS c FROM det_seg GROUP BY page) USING (page) LEFT JOIN (SELECT page, count(DISTINCT text) AS r FROM asc_sym WHERE kind = 'ref' GROUP BY page) USING (page)"))
def detector_coverage(spark, sf_dir):
    """Pages whose detections cover half of the designators."""
    drawn = _drawn(spark, sf_dir)
    named = written(association.associate(R.texts(spark, sf_dir), _flat(spark, sf_dir), drawn))
    parts, _ = detect.components(_boxes(spark, sf_dir), drawn, named, 3.0)
    return detect.coverage(parts, named, R.pages(spark))


# ---- reports


@query(with_views("wir", f"SELECT page, bin, count(*) FILTER (hit) AS n FROM (SELECT w.page, b.bin, least(coalesce(floor((len - lo) / nullif(hi - lo, 0) * 10), 0), 9) = b.bin AS hit FROM (SELECT page, {LEN} AS len FROM wir) w JOIN (SELECT page, min({LEN}) AS lo, max({LEN}) AS hi FROM wir GROUP BY page) e USING (page), (SELECT CAST(range AS INT) AS bin FROM range(10)) b) GROUP BY page, bin"))
def length_histogram(spark, sf_dir):
    """Ten bins of wires' lengths by page."""
    s = _plain(_split(spark, sf_dir).where("is_wire"))
    return reports.histogram(s.select("page", G.length().alias("len")), ["page"], "len")


view("hist", "wir", f"SELECT page, bin, count(*) FILTER (hit) AS n FROM (SELECT w.page, b.bin, least(coalesce(floor((len - lo) / nullif(hi - lo, 0) * 10), 0), 9) = b.bin AS hit FROM (SELECT page, {LEN} AS len FROM wir) w JOIN (SELECT page, min({LEN}) AS lo, max({LEN}) AS hi FROM wir GROUP BY page) e USING (page), (SELECT CAST(range AS INT) AS bin FROM range(10)) b) GROUP BY page, bin")


@query(with_views("hist", "SELECT page, count(*) FILTER (peak) AS peaks, count(*) FILTER (peak) >= 2 AS bimodal FROM (SELECT page, n > coalesce(lag(n) OVER w, -1) AND n > coalesce(lead(n) OVER w, -1) AND n > 0.5 * avg(n) OVER (PARTITION BY page) AS peak FROM hist WINDOW w AS (PARTITION BY page ORDER BY bin)) GROUP BY page"))
def length_peaks(spark, sf_dir):
    """Whether wires' lengths have two peaks."""
    return reports.two_peaks(length_histogram(spark, sf_dir), ["page"])


@query(with_views("wir", f"""SELECT page, max(n) AS n, min(len) FILTER (r > least(floor(n * 0.0), n - 1)) AS least, min(len) FILTER (r > least(floor(n * 0.25), n - 1)) AS p25, min(len) FILTER (r > least(floor(n * 0.5), n - 1)) AS p50, min(len) FILTER (r > least(floor(n * 0.9), n - 1)) AS p90
  FROM (SELECT page, {LEN} AS len, row_number() OVER (PARTITION BY page ORDER BY {LEN}) AS r, count(*) OVER (PARTITION BY page) AS n FROM wir) GROUP BY page"""))
def length_ranks(spark, sf_dir):
    """Nearest-rank percentiles of wires' lengths."""
    s = _plain(_split(spark, sf_dir).where("is_wire")).select("page", G.length().alias("len"))
    return reports.ranked(s, ["page"], "len", {"least": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9})


@query(with_views("wir", f"SELECT page, CAST(least(d, 5) AS INT) AS degree, count(*) AS n FROM (SELECT page, x, y, count(*) AS d FROM ({ends('wir')}) GROUP BY ALL) GROUP BY ALL"))
def end_degrees(spark, sf_dir):
    """How many wire ends meet at one place."""
    return reports.end_degrees(_plain(_split(spark, sf_dir).where("is_wire")))


@query(with_views("seg sep pg", f"""SELECT page, count(s.seg) AS n, round(coalesce(100.0 * count(*) FILTER (s.kind <> 'curve' AND (abs(s.x1 - s.x0) < 1 OR abs(s.y1 - s.y0) < 1)) / nullif(count(s.seg), 0), 0), 6) AS pct_aligned, round(coalesce(100.0 * count(*) FILTER (s.kind = 'curve') / nullif(count(s.seg), 0), 0), 6) AS pct_curve,
  coalesce(max(p50), 0.0) AS p50, count(*) FILTER (is_wire) AS n_wires, count(*) FILTER (NOT is_wire) AS n_symbols, count(*) FILTER (NOT is_wire AND (abs(s.x1 - s.x0) < 1 OR abs(s.y1 - s.y0) < 1) AND len < p50) AS short_aligned
  FROM pg LEFT JOIN seg s USING (page) LEFT JOIN (SELECT page, seg, is_wire, len FROM sep) USING (page, seg) LEFT JOIN (SELECT page, min(len) AS p50 FROM (SELECT page, {LEN} AS len, row_number() OVER (PARTITION BY page ORDER BY {LEN}) AS r, count(*) OVER (PARTITION BY page) AS n FROM seg WHERE kind = 'line') WHERE r > least(floor(n * 0.5), n - 1) GROUP BY page) USING (page) GROUP BY page"""))
def separation_audit(spark, sf_dir):
    """What separating wires from symbols did on each page."""
    every = R.segments(spark, sf_dir).join(_split(spark, sf_dir).select("page", "seg", "is_wire"), ["page", "seg"], "left")
    out = reports.separation(every, R.pages(spark))
    return out.withColumns({"pct_aligned": F.round("pct_aligned", _R), "pct_curve": F.round("pct_curve", _R)})


@query(with_views("mclu", "SELECT page, count(*) FILTER (n_segments <= 2) AS one_two, count(*) FILTER (n_segments BETWEEN 3 AND 5) AS three_five, count(*) FILTER (n_segments >= 6) AS six_up FROM mclu GROUP BY page"))
def cluster_sizes(spark, sf_dir):
    """Clusters by size."""
    return reports.cluster_sizes(_merged(spark, sf_dir).clusters)


@query(with_views("txt named pg", "SELECT page, count(t.text_id) AS n_texts, count(*) FILTER (kind = 'ref') AS n_ref, count(*) FILTER (kind = 'value') AS n_value, count(*) FILTER (kind = 'net_label') AS n_label FROM pg LEFT JOIN txt t USING (page) LEFT JOIN (SELECT page, text_id, kind FROM named) USING (page, text_id) GROUP BY page"))
def text_counts(spark, sf_dir):
    """Texts of each page by kind."""
    return reports.text_counts(R.texts(spark, sf_dir), R.pages(spark))


@query(with_views("part_node pin_net net_row pg", """SELECT page, coalesce(c, 0) AS components, coalesce(i, 0) AS isolated, coalesce(t, 0) AS three_up, coalesce(n, 0) AS nets, coalesce(e, 0) AS edges, coalesce(p, 0) AS pins FROM pg
  LEFT JOIN (SELECT page, count(*) AS c, count(*) FILTER (w IS NULL) AS i, count(*) FILTER (w >= 3) AS t FROM part_node LEFT JOIN (SELECT page, cluster, count(*) AS w FROM pin_net WHERE net IS NOT NULL GROUP BY ALL) USING (page, cluster) GROUP BY page) USING (page)
  LEFT JOIN (SELECT page, count(*) AS n FROM net_row GROUP BY page) USING (page) LEFT JOIN (SELECT page, count(DISTINCT (cluster, net)) AS e FROM pin_net WHERE net IS NOT NULL GROUP BY page) USING (page) LEFT JOIN (SELECT page, count(*) AS p FROM pin_net GROUP BY page) USING (page)"""))
def page_counters(spark, sf_dir):
    """Components, nets, edges and pins of each page's graph."""
    g = built(spark, sf_dir)
    return reports.counters(g.components, g.pins, g.nets, g.edges, R.pages(spark)).select("page", "components", "isolated", "three_up", "nets", "edges", "pins")


@query(with_views("lnet", f"SELECT page, net, count(*) AS n_segments, round(sum({LEN}), 6) AS length, min(least(x0, x1)) AS bx0, min(least(y0, y1)) AS by0, max(greatest(x0, x1)) AS bx1, max(greatest(y0, y1)) AS by1 FROM lnet GROUP BY ALL"))
def net_measures(spark, sf_dir):
    """Length and box of each net."""
    return reports.net_measures(built(spark, sf_dir).wires).withColumn("length", F.round("length", _R))


view("free_at", "mem", "SELECT page, cluster, x, y FROM (SELECT page, cluster, x0 AS x, y0 AS y FROM mem UNION ALL SELECT page, cluster, x1, y1 FROM mem) GROUP BY ALL HAVING count(*) = 1")


@query(with_views("free_at wir", f"""SELECT page, cluster, count(*) AS n_free, count(*) FILTER (d < 5) AS lt5, count(*) FILTER (d >= 5 AND d < 15) AS to15, count(*) FILTER (d BETWEEN 15 AND 30) AS to30, count(*) FILTER (d > 30) AS gt30, round(min(d), 6) AS nearest
  FROM (SELECT f.page, f.cluster, f.x, f.y, sqrt(min({d2('f.x', 'f.y', 'w.')})) AS d FROM free_at f JOIN wir w USING (page) GROUP BY ALL) GROUP BY page, cluster"""))
def pin_distances(spark, sf_dir):
    """Free ends of clusters by their distance to wires."""
    s = _split(spark, sf_dir)
    wires = _plain(s.where("is_wire")).withColumn("net", F.col("seg"))
    return reports.pin_distances(_merged(spark, sf_dir, s).members, wires).drop("net").withColumn("nearest", F.round("nearest", _R))
