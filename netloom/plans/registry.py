"""Queries by name, and the SQL that says the same: views over the driver's tables, each with those that it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.sources.rendering import RAILS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir), with its SQL if SQL can say it and does so in reasonable time."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def d2(px: str, py: str, s: str = "") -> str:
    """Squared distance of a point to a segment with columns x0..y1 of alias ``s``."""
    dx, dy = f"({s}x1 - {s}x0)", f"({s}y1 - {s}y0)"
    size = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {size} < 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, (({px} - {s}x0) * {dx} + ({py} - {s}y0) * {dy}) / {size})) END)"
    qx, qy = f"({px} - ({s}x0 + {t} * {dx}))", f"({py} - ({s}y0 + {t} * {dy}))"
    return f"({qx} * {qx} + {qy} * {qy})"


def pp(ax: str, ay: str, bx: str, by: str) -> str:
    """Squared distance of two points."""
    return f"(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def touch(limit: str, a: str = "a.", b: str = "b.") -> str:
    return "(" + " OR ".join(f"{d2(f'{p}x{k}', f'{p}y{k}', s)} <= {limit} * {limit}" for p, s in ((a, b), (b, a)) for k in (0, 1)) + ")"


def ends(table: str) -> str:
    return f"SELECT page, seg, 0 AS k, x0 AS x, y0 AS y FROM {table} UNION ALL SELECT page, seg, 1, x1, y1 FROM {table}"


LEN = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
ALIGNED = "(abs(x1 - x0) + abs(y1 - y0) >= 0.1 AND (degrees(atan2(abs(y1 - y0), abs(x1 - x0))) <= 5 OR degrees(atan2(abs(y1 - y0), abs(x1 - x0))) >= 85))"
#: Each view with the names of those it reads.
VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


def grown(name: str, needs: str, nodes: str, node: str, links: str) -> None:
    """A recursive view (page, id, root) of what the links (page, a, b), given both ways, spread from each smaller number."""
    view(name, needs, f"SELECT page, {node} AS id, {node} AS root FROM {nodes} UNION SELECT g.page, l.b, g.root FROM {name} g JOIN {links} l ON l.page = g.page AND l.a = g.id WHERE l.b > g.root")


def with_views(names: str, sql: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in VIEWS[name][0].split():
                add(n)
            order.append(name)

    for name in names.split():
        add(name)
    recursive = any(f"FROM {n} g JOIN" in VIEWS[n][1] for n in order)
    parts = [f"{n} AS ({VIEWS[n][1]})" if f"FROM {n} g JOIN" in VIEWS[n][1] else f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql


def tolerance(segments: str, pages: str = "pg") -> str:
    """Each page's lower quartile of ends' distances to the nearest other segment, by its definition."""
    near = f"SELECT e.page, e.seg, e.k, min({d2('e.x', 'e.y', 's.')}) AS d2 FROM ({ends(segments)}) e JOIN {segments} s ON s.page = e.page AND s.seg <> e.seg GROUP BY ALL"
    return f"SELECT page, CASE WHEN count(d2) = 0 OR quantile_cont(sqrt(d2), 0.25) < 0.1 THEN 1.0 ELSE quantile_cont(sqrt(d2), 0.25) END AS tol FROM {pages} LEFT JOIN ({near}) USING (page) GROUP BY page"


def link_reach(segments: str, pages: str = "pg") -> str:
    near = f"SELECT a.page, a.seg, a.k, min(sqrt({pp('a.x', 'a.y', 'b.x', 'b.y')})) AS d FROM ({ends(segments)}) a JOIN ({ends(segments)}) b ON a.page = b.page AND a.seg <> b.seg GROUP BY ALL"
    return f"SELECT page, CASE WHEN count(d) = 0 THEN 10.0 ELSE greatest(5.0, quantile_cont(d, 0.6)) END AS reach FROM {pages} LEFT JOIN ({near}) USING (page) GROUP BY page"


def scale(segments: str, pages: str = "pg") -> str:
    ranked = f"SELECT page, {LEN} AS len, row_number() OVER (PARTITION BY page ORDER BY {LEN}) AS r, count(*) OVER (PARTITION BY page) AS n FROM {segments} WHERE {LEN} > 0.1"
    return f"SELECT page, coalesce(greatest(1.0, min(len)), 1.0) AS scale FROM {pages} LEFT JOIN (SELECT * FROM ({ranked}) WHERE r = greatest(1, CAST(floor(n * 0.1) AS BIGINT))) USING (page) GROUP BY page"


_RAIL = "[" + ", ".join(f"'{r}'" for r in RAILS) + "]"
_COPY = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1"
view("comp", "", "SELECT 'p' || p_partkey AS node, substr('RCLDQUJ', CAST(p_partkey % 7 + 1 AS INT), 1) || (p_partkey % 1000) AS ref, p_type AS class_name, p_name AS value FROM part")
view("pin", "", "SELECT 'p' || l_partkey AS node, l_orderkey || '_' || l_linenumber AS pin_id, 'o' || l_orderkey AS net FROM lineitem")
view("thin", "", "SELECT 'p' || l_partkey AS node, l_orderkey || '_' || l_linenumber AS pin_id, CASE WHEN l_quantity <= 1 THEN 'o' || l_orderkey END AS net FROM lineitem")
view("edge", "pin", "SELECT node, net, max(pin_id) AS pin_id FROM pin WHERE net IS NOT NULL GROUP BY node, net")
view("thin_edge", "thin", "SELECT node, net, max(pin_id) AS pin_id FROM thin WHERE net IS NOT NULL GROUP BY node, net")
view("net", "", f"SELECT 'o' || o_orderkey AS net, CASE WHEN starts_with(o_orderpriority, '1') THEN {_RAIL}[CAST(o_orderkey % {len(RAILS)} AS INT) + 1] || '/' || o_orderkey WHEN o_orderstatus <> 'P' THEN 'Net-' || o_orderkey END AS name, o_orderkey AS ord FROM orders")
view("pg", "", "SELECT CAST(range AS BIGINT) AS page FROM range(52)")
view("seg", "", f"""SELECT l_orderkey % 50 AS page, (l_orderkey * 8 + l_linenumber) * 64 + {_COPY} AS seg, x AS x0, y AS y0, x + CASE WHEN l_linenumber % 2 = 1 THEN floor(l_quantity) ELSE 0.0 END AS x1,
  y + CASE WHEN l_linenumber % 2 = 0 OR l_linenumber = 5 THEN floor(l_quantity) ELSE 0.0 END AS y1, CASE WHEN l_linenumber = 7 THEN 'curve' ELSE 'line' END AS kind,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_linenumber <> 5 AND l_suppkey % 10 < 8 THEN 'green' ELSE 'red' END AS color
  FROM (SELECT *, CAST((l_partkey * 37 + l_linenumber * 11) % 1000 AS DOUBLE) AS x, CAST((l_suppkey * 53 + l_orderkey * 17) % 1000 AS DOUBLE) AS y FROM lineitem)""")
view("txt", "", """SELECT o_orderkey % 50 AS page, o_orderkey AS text_id, CASE o_orderkey % 9 WHEN 0 THEN substr('RCLDQU', CAST(o_orderkey % 6 + 1 AS INT), 1) || o_orderkey % 200 WHEN 1 THEN o_orderkey % 100 || 'k' || o_orderkey % 10
  WHEN 2 THEN '+' || o_orderkey % 30 || 'V' WHEN 3 THEN 'NET_' || o_orderkey % 31 WHEN 4 THEN 'BC' || o_orderkey % 1000 WHEN 5 THEN ' U' || o_orderkey % 40 || 'A ' WHEN 6 THEN 'a b' WHEN 7 THEN 'SIG' || o_orderkey % 23
  ELSE o_orderkey % 50 || '.5uF' END AS text, CAST((o_custkey * 29 + o_orderkey * 3) % 1000 AS DOUBLE) AS x, CAST((o_orderkey * 31) % 1000 AS DOUBLE) AS y FROM orders""")
view("shp", "", """SELECT page, shape, kind, x AS bx0, y AS by0, x + w AS bx1, y + h AS by1, w, h, fill FROM (SELECT *, CASE WHEN kind = 'rect' THEN w / 2 ELSE w END AS h FROM (SELECT c_custkey % 50 AS page, c_custkey AS shape,
  CASE c_custkey % 3 WHEN 0 THEN 'circle' WHEN 1 THEN 'rect' ELSE 'polygon' END AS kind, CAST((c_custkey * 41) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 67) % 1000 AS DOUBLE) AS y,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 + c_nationkey % 4 ELSE 6 + c_nationkey % 5 END AS DOUBLE) AS w, c_custkey % 3 = 0 AND c_nationkey % 2 = 0 AS fill FROM customer))""")
