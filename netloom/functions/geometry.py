"""Plane geometry as column expressions over doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[str | Column, str | Column]


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


# ---- points and vectors


def length(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return F.hypot(c(x1) - c(x0), c(y1) - c(y0))


def distance2(ax, ay, bx, by) -> Column:
    dx, dy = c(ax) - c(bx), c(ay) - c(by)
    return dx * dx + dy * dy


def midpoint(x0="x0", y0="y0", x1="x1", y1="y1") -> tuple[Column, Column]:
    """Of a segment's ends, or the centre of a box."""
    return (c(x0) + c(x1)) / 2, (c(y0) + c(y1)) / 2


def dot(ax, ay, bx, by) -> Column:
    return c(ax) * c(bx) + c(ay) * c(by)


def cross(ax, ay, bx, by) -> Column:
    return c(ax) * c(by) - c(ay) * c(bx)


def normalized(x, y) -> tuple[Column, Column]:
    """The unit vector; (0, 0) for one that is next to nothing."""
    size = F.hypot(c(x), c(y))
    part = lambda v: F.when(size < 1e-12, 0.0).otherwise(F.try_divide(c(v), size))
    return part(x), part(y)


def point_at(t, x0="x0", y0="y0", x1="x1", y1="y1") -> tuple[Column, Column]:
    """The point that divides a segment at the share t."""
    return c(x0) + c(t) * (c(x1) - c(x0)), c(y0) + c(t) * (c(y1) - c(y0))


# ---- points, segments and boxes


def point_segment_d2(px, py, x0, y0, x1, y1) -> Column:
    """Squared distance of a point to a segment; a segment without length is a point."""
    dx, dy = c(x1) - c(x0), c(y1) - c(y0)
    size = dx * dx + dy * dy
    t = F.when(size < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((c(px) - c(x0)) * dx + (c(py) - c(y0)) * dy, size))))
    return distance2(px, py, c(x0) + t * dx, c(y0) + t * dy)


def directed() -> dict[str, Column]:
    """A segment's direction and one over its squared length, to be computed once a segment and not once a pair."""
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    size = dx * dx + dy * dy
    return {"dx": dx, "dy": dy, "inverse": F.when(size < 1e-12, 0.0).otherwise(F.try_divide(F.lit(1.0), size))}


def end_distance2(px, py, s: str = "_") -> Column:
    """Squared distance of a point to a segment that has the columns of directed()."""
    x, y = c(px) - c(f"{s}x0"), c(py) - c(f"{s}y0")
    along = (x * c(f"{s}dx") + y * c(f"{s}dy")) * c(f"{s}inverse")
    t = F.when(along < 0, 0.0).when(along > 1, 1.0).otherwise(along)
    qx, qy = x - t * c(f"{s}dx"), y - t * c(f"{s}dy")
    return qx * qx + qy * qy


def touches(limit2: Column, a: str = "", b: str = "_") -> Column:
    """Segments a* and b* with an end of one on the other, at a squared distance of at most ``limit2``; crossing alone is no touch.

    Both have the columns of directed(); their boxes are to be compared first.
    """
    on = lambda p, k, s: end_distance2(f"{p}x{k}", f"{p}y{k}", s) <= limit2
    return on(a, 0, b) | on(a, 1, b) | on(b, 0, a) | on(b, 1, a)


def intersects(a: str = "", b: str = "_") -> Column:
    """Segments that cross or touch, ends included, by boxes and by the sides that ends lie on."""
    side = lambda s, p, k: cross(c(f"{s}x1") - c(f"{s}x0"), c(f"{s}y1") - c(f"{s}y0"), c(f"{p}x{k}") - c(f"{s}x0"), c(f"{p}y{k}") - c(f"{s}y0"))
    boxes = [F.greatest(f"{p}{v}0", f"{p}{v}1") >= F.least(f"{q}{v}0", f"{q}{v}1") for v in "xy" for p, q in ((a, b), (b, a))]
    return boxes[0] & boxes[1] & boxes[2] & boxes[3] & (side(a, b, 0) * side(a, b, 1) <= 0) & (side(b, a, 0) * side(b, a, 1) <= 0)


def contains_point(px, py, tol: float, s: str = "") -> Column:
    """A point on a segment: next to its line by the cross product, and within its padded box."""
    turn = cross(c(f"{s}x1") - c(f"{s}x0"), c(f"{s}y1") - c(f"{s}y0"), c(px) - c(f"{s}x0"), c(py) - c(f"{s}y0"))
    return (F.abs(turn) < tol) & in_box(px, py, *(F.least(f"{s}{v}0", f"{s}{v}1") - tol for v in "xy"), *(F.greatest(f"{s}{v}0", f"{s}{v}1") + tol for v in "xy"))


def in_box(px, py, bx0="bx0", by0="by0", bx1="bx1", by1="by1", pad: float | Column = 0.0) -> Column:
    """A point within a box, its rim included."""
    pad = F.lit(pad) if isinstance(pad, (int, float)) else pad
    return (c(px) >= c(bx0) - pad) & (c(px) <= c(bx1) + pad) & (c(py) >= c(by0) - pad) & (c(py) <= c(by1) + pad)


def box_area(bx0="bx0", by0="by0", bx1="bx1", by1="by1") -> Column:
    """A box's area; one turned inside out has none."""
    return F.greatest(F.lit(0.0), c(bx1) - c(bx0)) * F.greatest(F.lit(0.0), c(by1) - c(by0))


# ---- directions


def axis_aligned(tolerance: float = 5.0) -> Column:
    """Not a dot, and within ``tolerance`` degrees of level or upright."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    angle = F.degrees(F.atan2(dy, dx))
    return (dx + dy >= 0.1) & ((angle <= tolerance) | (angle >= 90 - tolerance))


def near_axis(points: float = 1.0) -> Column:
    """No curve, and less than so many points off level or upright."""
    return (F.col("kind") != "curve") & ((F.abs(F.col("x1") - F.col("x0")) < points) | (F.abs(F.col("y1") - F.col("y0")) < points))


def horizontal() -> Column:
    return F.abs(F.col("y1") - F.col("y0")) < 1e-6


def vertical() -> Column:
    return F.abs(F.col("x1") - F.col("x0")) < 1e-6


# ---- shapes: array<struct<x,y>>, and a kind of circle (two corners of its box), rect or polygon


def shape_box(vertices: str = "vertices") -> dict[str, Column]:
    v, of = F.col(vertices), lambda k: lambda p: p[k]
    return {f"b{k}{i}": f(F.transform(v, of(k))) for i, f in ((0, F.array_min), (1, F.array_max)) for k in "xy"}


def shoelace(vertices: str = "vertices") -> Column:
    """Area of a polygon given as array<struct<x,y>>."""
    v = F.col(vertices)
    turned = F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    parts = F.zip_with(v, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)) / 2


def shape_area(kind: str = "kind", vertices: str = "vertices") -> Column:
    """A circle by the mean of its box's sides, a rectangle by its sides, a polygon by its vertices."""
    b = shape_box(vertices)
    w, h = b["bx1"] - b["bx0"], b["by1"] - b["by0"]
    return F.when(F.col(kind) == "circle", F.lit(3.141592653589793) * F.pow((w + h) / 4, F.lit(2.0))).when(F.col(kind) == "rect", w * h).otherwise(shoelace(vertices))


def is_dot(kind: str = "kind", vertices: str = "vertices", fill: str = "fill") -> Column:
    """A filled circle of the size of a junction: more than 0.5 and less than 5 either way, sides less than 1 apart."""
    b = shape_box(vertices)
    w, h = b["bx1"] - b["bx0"], b["by1"] - b["by0"]
    return (F.col(kind) == "circle") & F.col(fill).isNotNull() & (w > 0.5) & (w < 5) & (h > 0.5) & (h < 5) & (F.abs(w - h) < 1)


# ---- units and colours

MM_PER_INCH, POINTS_PER_INCH, MM_PER_MIL = 25.4, 72, 0.0254


def mm_to_points(mm: Column) -> Column:
    return mm / F.lit(MM_PER_INCH) * POINTS_PER_INCH


def points_to_mm(points: Column) -> Column:
    return points / POINTS_PER_INCH * MM_PER_INCH


def mils_to_mm(mils: Column) -> Column:
    return mils * F.lit(MM_PER_MIL)


def mm_to_mils(mm: Column) -> Column:
    return mm / F.lit(MM_PER_MIL)


def mils_to_points(mils: Column) -> Column:
    return mm_to_points(mils_to_mm(mils))


def points_to_mils(points: Column) -> Column:
    return mm_to_mils(points_to_mm(points))


def rgb255(color: Column) -> Column:
    """Three shares as numbers up to 255, halves to the even one; null for no colour, and for fewer than three."""
    return F.when(F.size(color) >= 3, F.transform(F.slice(color, 1, 3), lambda v: F.bround(v * 255).cast("int")))


def color_distance(a: Column, b: Column) -> Column:
    """Between two array<int>; infinite where either is missing."""
    parts = F.zip_with(a, b, lambda x, y: F.pow((x - y).cast("double"), F.lit(2.0)))
    return F.coalesce(F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)), F.lit(float("inf")))


def same_color(a: Column, b: Column, tol: float = 45.0) -> Column:
    return a.isNotNull() & b.isNotNull() & (color_distance(a, b) <= tol)
