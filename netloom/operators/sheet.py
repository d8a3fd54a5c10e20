"""The graph of a page in one task: what page.build() does by joins, for pages that a worker holds.

Stages and rules are those of page.py, spatial.py and association.py, ties included; texts are read and components
classed by the same column expressions, before and after. Rows cross the network once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from netloom.functions import geometry as G
from netloom.functions import text as T
from netloom.operators.association import PENALTY, REACH
from netloom.operators.tiles import CORNERS, PAIRS, Grid, _columns, _components, _join, _runs, _unpacked, closest, packed
from netloom.plans.workers import ship

ship(__name__)

#: Segments, shapes and texts of a page that one task takes: of 914,000 a worker takes 0.6 to 0.8 GB at the peak.
MOST = 1_250_000
#: Numbers of junctions among the wires, after those of all segments.
DOTS = 1 << 60
WHOLE = (ByteType, ShortType, IntegerType, LongType)
FIELDS = {"what": pa.int32(), "cluster": pa.int64(), "net": pa.int64(), "seg": pa.int64(), "pin": pa.int32(), "number": pa.int64(), "n_segments": pa.int64(), "n_shapes": pa.int64(), "ref": pa.string(), "value": pa.string(), "name": pa.string(), "class_name": pa.string(), "confidence": pa.float64(), "x0": pa.float64(), "y0": pa.float64(), "x1": pa.float64(), "y1": pa.float64()}
KIND = ", ".join(f"{n} {({pa.int32(): 'int', pa.int64(): 'long', pa.string(): 'string', pa.float64(): 'double'})[t]}" for n, t in FIELDS.items())
PART, PIN, NET, WIRE, LOST = range(5)


def fitting(segments: DataFrame, flat: DataFrame, texts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, fits) of every page with a row, and of those that don't fit: too many rows, coordinates that are missing or endless, or no row of pages."""
    def endless(*names):
        out = F.lit(False)
        for n in names:
            out = out | ~F.coalesce(F.abs(n) < float("inf"), F.lit(False))
        return out

    box = ("bx0", "by0", "bx1", "by1")
    rows = segments.select("page", endless(*CORNERS).alias("odd"))
    for more in (flat, texts):
        rows = rows.unionByName(more.select("page", endless(*box).alias("odd")))
    known = pages.select("page", F.lit(True).alias("known")).distinct()
    n = rows.groupBy("page").agg(F.count("*").alias("n"), F.max("odd").alias("odd")).join(known, "page", "left")
    fits = (F.col("n") <= MOST) & ~F.col("odd") & F.coalesce("known", F.lit(False))
    sized = n.select("page", fits.alias("fits"))
    return sized, sized.where("not fits")


def numbered(*tables_and_names) -> bool:
    """Whether all of these columns are whole numbers."""
    return all(isinstance(t.schema[n].dataType, WHOLE) for t, n in tables_and_names)


def found(segments: DataFrame, flat: DataFrame, texts: DataFrame, zones: DataFrame, reach: float | None, pin_factor: float, label_factor: float, recover: bool) -> DataFrame:
    """(page, what, ...): rows of components, pins, nets and wires of every page; ``zones`` are those of page.zones()."""
    kind = F.when(F.col("kind") == "curve", 0).when(F.col("kind") == "line", 1).when(F.col("kind").isNotNull(), 2).otherwise(3)
    d = lambda *names: [F.col(n).cast("double").alias(n) for n in names]
    s = segments.select("page", F.col("seg").cast("long").alias("seg"), *d(*CORNERS), G.length().alias("len"), F.coalesce(G.axis_aligned(), F.lit(False)).alias("aligned"), kind.alias("kind"))
    box = ("bx0", "by0", "bx1", "by1")
    h = flat.select("page", F.col("shape").cast("long").alias("shape"), *d(*box), F.coalesce(G.is_dot(), F.lit(False)).alias("dot"))
    t, x, y = F.col("text"), *G.midpoint("bx0", "by0", "bx1", "by1")
    sort = F.when(T.is_ref(t), 0).when(T.is_value(t), 1).when(T.is_net_label(t), 2).otherwise(-1)
    name = F.trim("text")
    label = F.coalesce((name != "") & ~name.rlike("^[0-9]+$"), F.lit(False))
    sure = T.rule_class_or_null(t) if recover else F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("confidence"))
    w = texts.select("page", F.col("text_id").cast("long").alias("text_id"), F.coalesce(t, F.lit("")).alias("text"), F.coalesce(sort, F.lit(-1)).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.coalesce(name, F.lit("")).alias("name"), label.alias("label"), F.coalesce(sure["name"], F.lit("")).alias("class_name"), F.coalesce(sure["confidence"], F.lit(0.0)).alias("confidence"))
    z = zones.select("page", F.col("text_id").cast("long").alias("text_id"), *d(*box))
    blocks, schemas = None, []
    for k, rows in enumerate((s, h, w, z)):
        own, schema = packed(rows, ["page"])
        own = own.select("page", F.lit(k).alias("what"), "size_", "rows_")
        blocks = own if blocks is None else blocks.unionByName(own)
        schemas.append(schema)
    parts = max(64, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    graph = _graph(schemas, reach, pin_factor, label_factor, recover)
    return blocks.repartition(parts, "page").groupBy("page").applyInArrow(graph, f"page {segments.schema['page'].dataType.simpleString()}, {KIND}")


def percentile(values: np.ndarray, share: float) -> float:
    """As Spark's percentile()."""
    v, at = np.sort(values), (len(values) - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    if low == high or v[low] == v[high]:
        return float(v[low])
    return float((high - at) * v[low] + (at - low) * v[high])


def meeting(a: np.ndarray, b: np.ndarray, cell: float = 32.0, most: int = PAIRS):
    """Places of boxes (4, n) and (4, m) that meet, rims included, in pieces; each pair once, in the cell of the lower corner of their common part."""
    if not a.shape[1] or not b.shape[1]:
        return
    low = np.minimum(a[:2].min(axis=1), b[:2].min(axis=1))
    span = np.maximum(a[2:].max(axis=1), b[2:].max(axis=1)) - low
    cell = max(cell, float(span.max()) / 1000)
    lines = int(span[1] / cell) + 1
    at = lambda v, k: np.floor((v - low[k]) / cell).astype(np.int64)

    def cut(box):
        x, y = at(box[0], 0), at(box[1], 1)
        h = at(box[3], 1) - y + 1
        n = np.maximum((at(box[2], 0) - x + 1) * h, 0)
        of, k = np.repeat(np.arange(len(x)), n), _runs(n)
        return of, (x[of] + k // h[of]) * lines + y[of] + k % h[of]

    (p, pc), (q, qc) = cut(a), cut(b)
    order = np.argsort(qc, kind="stable")
    q, qc = q[order], qc[order]
    start = np.searchsorted(qc, pc)
    n = np.searchsorted(qc, pc, "right") - start
    upto, k = np.cumsum(n), 0
    while k < len(p):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most, "right")))
        i, c = np.repeat(p[k:end], n[k:end]), np.repeat(pc[k:end], n[k:end])
        j = q[np.repeat(start[k:end], n[k:end]) + _runs(n[k:end])]
        x, y = np.maximum(a[0, i], b[0, j]), np.maximum(a[1, i], b[1, j])
        ok = (x <= np.minimum(a[2, i], b[2, j])) & (y <= np.minimum(a[3, i], b[3, j])) & (at(x, 0) * lines + at(y, 1) == c)
        yield i[ok], j[ok]
        k = end


def _graph(schemas, reach, pin_factor, label_factor, recover):
    expected = None
    if recover:
        from netloom.operators.page import EXPECTED_PINS as expected

    def graph(table: pa.Table) -> pa.Table:
        what, page = table.column("what").to_numpy(), table.column("page").combine_chunks().slice(0, 1)
        s, h, w, z = (_unpacked(table.filter(pa.array(what == k)), schema) for k, schema in enumerate(schemas))
        s, w = s.sort_by("seg"), w.sort_by("text_id")
        seg, length, aligned, kind = _columns(s, "seg", "len", "aligned", "kind")
        at = np.array(_columns(s, *CORNERS)).reshape(4, -1)
        shape, dot = _columns(h, "shape", "dot")
        box = np.array(_columns(h, "bx0", "by0", "bx1", "by1")).reshape(4, -1)
        hx, hy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        tid, sort, tx, ty, is_label = _columns(w, "text_id", "kind", "x", "y", "label")
        text, name = w.column("text").to_pylist(), w.column("name").to_pylist()
        out = []

        def emit(what, n, **columns):
            given = {"what": np.full(n, what, np.int32), **columns}
            out.append(pa.table([pa.array(given[c], k, from_pandas=False) if c in given else pa.nulls(n, k) for c, k in FIELDS.items()], list(FIELDS)))

        def ends(boxes):
            """Coordinates of both ends, and whose they are."""
            return np.concatenate([boxes[0], boxes[2]]), np.concatenate([boxes[1], boxes[3]]), np.tile(np.arange(boxes.shape[1]), 2)

        def once(group, x, y):
            """Places of ends that no other end of the group shares, by group, x and y."""
            order = np.lexsort((y, x, group))
            g, a, b = group[order], x[order], y[order]
            apart = np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])
            return order[apart[1:] & apart[:-1]]

        def tolerance(boxes):
            x, y, of = ends(boxes)
            best, _ = closest(x, y, None, boxes, None, of, np.arange(boxes.shape[1]))
            near = np.sqrt(best[np.isfinite(best)])
            tol = percentile(near, 0.25) if len(near) else 1.0
            return 1.0 if tol < 0.1 else tol

        def summed(group, some, own, shapes):
            """The groups' numbers, and counts and boxes by them, out of segments and shapes."""
            ids, of = np.unique(np.concatenate([group, own]), return_inverse=True)
            low = np.concatenate([np.minimum(some[:2], some[2:]), shapes[:2]], axis=1)
            high = np.concatenate([np.maximum(some[:2], some[2:]), shapes[2:]], axis=1)
            boxes = np.concatenate([np.full((2, len(ids)), np.inf), np.full((2, len(ids)), -np.inf)])
            for k in (0, 1):
                np.minimum.at(boxes[k], of, low[k])
                np.maximum.at(boxes[2 + k], of, high[k])
            return ids, np.bincount(of[: len(group)], minlength=len(ids)), np.bincount(of[len(group) :], minlength=len(ids)), boxes

        # wires apart from symbols
        drawn = (kind == 1) | (kind == 2)
        some = length[drawn & (length > 0.1)]
        wire = drawn & aligned & (length >= max(5.0, 3.0 * percentile(some, 0.25) if len(some) else 5.0))
        sym = np.flatnonzero(drawn & ~wire)
        # clusters
        c = at[:, sym]
        x, y, of = ends(c)
        points, far = np.array([x, y, x, y]), reach
        if far is None:
            best, _ = closest(x, y, None, points, None, of, of)
            near = np.sqrt(best[np.isfinite(best)])
            far = max(5.0, percentile(near, 0.6)) if len(near) else 10.0
        group = _components(x, y, of, points, of, len(sym), far)
        best, place = closest(hx, hy, far, points, -of)
        near = np.isfinite(best)
        held, own = np.flatnonzero(near), group[of[place[near]]] if len(of) else np.zeros(0, np.int64)
        ids, n, m, boxes = summed(group, c, own, box[:, held])
        kept = n + m >= 2
        few = ~kept[np.searchsorted(ids, group)]
        orphan, sym, group = sym[few], sym[~few], group[~few]
        stays = kept[np.searchsorted(ids, own)]
        held, own = held[stays], own[stays]
        ids, n, boxes = ids[kept], n[kept], boxes[:, kept]
        # clusters in one designator's zone
        zid = z.column("text_id").to_numpy()
        zone = np.array(_columns(z, "bx0", "by0", "bx1", "by1")).reshape(4, -1)
        pairs = list(meeting(zone, boxes))
        a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        fine = (np.bincount(a, n[b] > 5, len(zid)) <= 1)[a]
        a, b = a[fine], b[fine]
        first = np.full(len(zid), len(ids))
        np.minimum.at(first, a, b)
        label = _join(np.arange(len(ids)), first[a], b)
        group, own = label[np.searchsorted(ids, group)], label[np.searchsorted(ids, own)]  # places in ids, whose order is that of numbers
        places, n, m, boxes = summed(group, at[:, sym], own, box[:, held])
        group, own, number = np.searchsorted(places, group), np.searchsorted(places, own), seg[np.flatnonzero(drawn & ~wire)][ids[places]]
        wires = np.union1d(np.flatnonzero(wire), orphan[aligned[orphan]])
        # texts and what they name
        ax, ay, away = np.zeros(len(tid)), np.zeros(len(tid)), np.full(len(tid), np.inf)
        if len(shape):
            sx, sy, rank = hx, hy, shape
        else:
            sx, sy, rank = (at[0] + at[2]) / 2, (at[1] + at[3]) / 2, seg
        ask = np.flatnonzero((sort == 0) | (sort == 1))
        if len(ask) and len(sx):
            order = np.lexsort((rank, sy, sx))
            left = order[np.append(True, (sx[order][1:] != sx[order][:-1]) | (sy[order][1:] != sy[order][:-1]))]
            sx, sy, rank = sx[left], sy[left], rank[left]
            for _, _, p, q in Grid(np.array([sx, sy, sx, sy]), REACH).pairs(tx[ask], ty[ask]):
                p = ask[p]
                dx, dy = tx[p] - sx[q], ty[p] - sy[q]
                distance = np.sqrt(dx * dx + dy * dy)
                ok = distance <= REACH
                p, q, dx, dy, distance = p[ok], q[ok], dx[ok], dy[ok], distance[ok]
                wrong = lambda v: np.where(np.where(sort[p] == 0, v > 0, v < 0), PENALTY, 1.0)  # noqa: B023, E731
                order = np.lexsort((rank[q], distance * (wrong(dx) * wrong(dy)), p))
                one = order[np.append(True, np.diff(p[order]) > 0)] if len(order) else order
                ax[p[one]], ay[p[one]], away[p[one]] = sx[q[one]], sy[q[one]], distance[one]
        ask, lines = np.flatnonzero(sort == 2), np.flatnonzero(kind == 1)
        best, place = closest(tx[ask], ty[ask], REACH, at[:, lines], lines)
        near = best < REACH * REACH
        ask, to = ask[near], lines[place[near]] if len(lines) else lines
        ax[ask], ay[ask], away[ask] = (at[0, to] + at[2, to]) / 2, (at[1, to] + at[3, to]) / 2, np.sqrt(best[near])
        # components
        ref, value = [None] * len(places), [None] * len(places)
        ask = np.flatnonzero(((sort == 0) | (sort == 1)) & np.isfinite(away))
        cx, cy = (boxes[0] + boxes[2]) / 2, (boxes[1] + boxes[3]) / 2
        best, place = closest(ax[ask], ay[ask], None, np.array([cx, cy, cx, cy]), np.arange(len(places)))
        if len(places):
            for k in ask[np.lexsort((ask, away[ask]))][::-1]:  # the nearest, then the first, comes last
                mine = ref if sort[k] == 0 else value
                mine[place[np.searchsorted(ask, k)]] = text[k]
        emit(PART, len(places), cluster=number, number=np.arange(len(places)), n_segments=n, n_shapes=m, ref=ref, value=value, x0=boxes[0], y0=boxes[1], x1=boxes[2], y1=boxes[3])
        # scale
        sized = np.sort(length[wires if len(wires) else drawn & ~wire])
        sized = sized[sized > 0.1]
        scale = max(1.0, float(sized[max(int(np.floor(len(sized) * 0.1)), 1) - 1])) if len(sized) else 1.0
        # clusters' segments that are wires after all
        x, y, of = ends(at[:, sym])
        stub = np.zeros(len(sym), bool)
        stub[of[once(group[of], x, y)]] = True
        stub &= aligned[sym]
        gives = stub & (np.bincount(group, ~stub, len(places)) + m >= 2)[group]
        body, inside = sym[~gives], group[~gives]
        # nets
        joined = np.concatenate([wires, sym[gives]])
        dots = np.flatnonzero(dot) if len(wires) else np.zeros(0, np.int64)
        lines = np.concatenate([at[:, joined], np.array([hx[dots], hy[dots], hx[dots], hy[dots]])], axis=1)
        every = np.concatenate([seg[joined], shape[dots] + DOTS])
        tol = tolerance(at[:, joined])
        order = np.argsort(every, kind="stable")
        every, lines = every[order], lines[:, order]
        x, y, of = ends(lines)
        net = _components(x, y, of, lines, np.arange(len(every)), len(every), tol + 1e-3)
        tol = tolerance(lines)
        # names: nets beside labels of one name are one
        ask = np.flatnonzero((sort == 2) & is_label & np.isfinite(away))
        best, place = closest(ax[ask], ay[ask], tol * label_factor, lines, -net)
        near = np.isfinite(best)
        ask, to = ask[near], net[place[near]] if len(net) else net
        first = {}
        for k, v in zip(ask.tolist(), to.tolist(), strict=True):
            first[name[k]] = min(v, first.get(name[k], v))
        net_label = _join(np.arange(len(every)), np.array([first[name[k]] for k in ask.tolist()], np.int64), to)
        net = net_label[net]
        called = {}
        for k, v in zip(ask.tolist(), net_label[to].tolist(), strict=True):
            called[v] = min(name[k], called.get(v, name[k]))
        nets, count = np.unique(net, return_counts=True)
        emit(NET, len(nets), net=every[nets], number=np.arange(1, len(nets) + 1), name=[called.get(v, f"Net-{k}") for k, v in enumerate(nets.tolist(), 1)], n_segments=count)
        emit(WIRE, len(every), net=every[net], seg=every, x0=lines[0], y0=lines[1], x1=lines[2], y1=lines[3])
        # pins
        around = max(3.0 * tol, pin_factor * scale)

        def wired(x, y):
            best, place = closest(x, y, around, lines, -net)
            near = np.isfinite(best)
            return pa.array(every[net[place]] if len(net) else np.zeros(len(x), np.int64), pa.int64(), mask=~near)

        x, y, of = ends(at[:, body])
        free = once(inside[of], x, y)
        x, y, of = x[free], y[free], inside[of[free]]
        rim = np.minimum(np.minimum(x - boxes[0, of], boxes[2, of] - x), np.minimum(y - boxes[1, of], boxes[3, of] - y))
        cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        limit = np.array([max(1.0, percentile(rim[a:b], 0.5)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        ok = rim <= np.repeat(limit, np.diff(cuts)) + 1e-3
        x, y, of = x[ok], y[ok], of[ok]
        emit(PIN, len(x), cluster=number[of], pin=_runs(np.diff(np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)))) + 1, x0=x, y0=y, net=wired(x, y))
        if recover:
            lost(w, text, sort, ax, ay, away, ref, boxes, at[:, wires], scale, wired, emit)
        whole = pa.concat_tables(out)
        return pa.table([page.take(pa.array(np.zeros(whole.num_rows, np.int64))), *whole.columns], ["page", *FIELDS])

    def lost(w, text, sort, ax, ay, away, ref, boxes, wires, scale, wired, emit, radius=3.0, most=4):
        taken = {r if r is not None else f"U{k}" for k, r in enumerate(ref)}
        ask = np.flatnonzero((sort == 0) & np.isfinite(away))
        best = {}
        for k in ask[np.lexsort((ask, away[ask]))].tolist():
            if text[k] not in taken:
                best.setdefault(text[k], k)
        ask = np.array(sorted(best.values()), np.int64)
        inside = np.zeros(len(ask), bool)
        for i, _ in meeting(np.array([ax[ask], ay[ask], ax[ask], ay[ask]]), boxes):
            inside[i] = True
        kinds, sure = w.column("class_name").to_pylist(), w.column("confidence").to_pylist()
        ask = [k for k in ask[~inside].tolist() if kinds[k]]
        x, y, rows = np.concatenate([wires[0], wires[2]]), np.concatenate([wires[1], wires[3]]), []
        order_k, order_seg = np.repeat([0, 1], wires.shape[1]), np.tile(np.arange(wires.shape[1]), 2)
        for k in sorted(ask, key=lambda k: text[k]):
            d2 = (ax[k] - x) ** 2 + (ay[k] - y) ** 2
            near = np.flatnonzero(d2 <= radius * scale * (radius * scale))
            stubs = []
            for e in near[np.lexsort((order_k[near], order_seg[near], d2[near]))]:
                if len(stubs) < most and all((x[e] - a) ** 2 + (y[e] - b) ** 2 > (0.5 * scale) ** 2 for a, b in stubs):
                    stubs.append((x[e], y[e]))
            if stubs:
                rows.append((k, stubs[: min(expected.get(kinds[k], most), most)]))
        emit(LOST, len(rows), cluster=np.arange(-1, -len(rows) - 1, -1), ref=[text[k] for k, _ in rows], class_name=[kinds[k] for k, _ in rows], confidence=[sure[k] for k, _ in rows])
        flat = [(-i, j, *p) for i, (_, stubs) in enumerate(rows, 1) for j, p in enumerate(stubs, 1)]
        c, pin, x, y = (np.array([r[k] for r in flat]) for k in range(4)) if flat else [np.zeros(0)] * 4
        emit(PIN, len(flat), cluster=c.astype(np.int64), pin=pin.astype(np.int32), x0=x.astype(float), y0=y.astype(float), net=wired(x, y))

    return graph
