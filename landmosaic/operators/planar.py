"""Planar geometry on plain columns: rings as arrays of {x, y}, boxes as four numbers, cells as integer keys."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.runtime import durable, width


def _next(r: Column) -> Column:
    """The ring turned by one vertex."""
    return F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _cross(r: Column) -> Column:
    return F.zip_with(r, _next(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def ring_area(r: Column) -> Column:
    """Area of an open ring (shoelace), whatever its direction. Holes: subtract theirs."""
    return F.abs(_sum(_cross(r))) / 2


def ring_length(r: Column) -> Column:
    return _sum(F.zip_with(r, _next(r), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))


def line_length(v: Column) -> Column:
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return _sum(F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))


def ring_centroid(r: Column) -> Column:
    six = 3 * _sum(_cross(r))
    cx = _sum(F.zip_with(r, _next(r), lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    cy = _sum(F.zip_with(r, _next(r), lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    return F.struct(F.try_divide(cx, six).alias("x"), F.try_divide(cy, six).alias("y"))


def bounds(r: Column) -> Column:
    x, y = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def in_ring(r: Column, x: Column, y: Column) -> Column:
    """Ray casting; lower and left edges belong to the ring."""
    hits = F.zip_with(r, _next(r), lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h) % 2 == 1


def edge_distance(r: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a ring's outline."""

    def one(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    return F.array_min(F.zip_with(r, _next(r), one))


def signed_distance(r: Column, x: Column, y: Column) -> Column:
    """Negative inside, positive outside."""
    return F.when(in_ring(r, x, y), -edge_distance(r, x, y)).otherwise(edge_distance(r, x, y))


def shape_metrics(area: Column, perimeter: Column, w: Column, h: Column) -> dict[str, Column]:
    """Null where a divisor is zero."""
    long, short = F.greatest(w, h), F.least(w, h)
    return {
        "compactness": F.try_divide(4 * math.pi * area, perimeter * perimeter),
        "thinness": F.try_divide(perimeter * perimeter, area),
        "aspect": F.try_divide(long, short),
        "box_fill": F.try_divide(area, w * h),
        "approx_width": F.try_divide(area, long),
        "diagonal": F.hypot(w, h),
        "log_area": F.log1p(area),
    }


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def line_count(x0: str, y0: str, x1: str, y1: str, spacing: float) -> tuple[Column, Column]:
    """Length of a straight line, and number of its points by :func:`line_points`."""
    length = F.hypot(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))
    return length, F.floor(length / spacing + F.lit(0.5)).cast("int")


def line_points(df: DataFrame, x0: str, y0: str, x1: str, y1: str, spacing: float) -> DataFrame:
    """Points at s/2, 3s/2, ... up to the end of each straight line; none on a line shorter than s/2. Adds distance, x, y."""
    length, n = line_count(x0, y0, x1, y1, spacing)
    d = df.withColumns({"_l": length, "_n": n}).where("_n >= 1").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = (F.col("_i") + 0.5) * spacing
    t = F.least(F.lit(1.0), at / F.col("_l"))
    return d.withColumns({"distance": at, "x": F.col(x0) + t * (F.col(x1) - F.col(x0)), "y": F.col(y0) + t * (F.col(y1) - F.col(y0))}).drop("_l", "_n", "_i")


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint")


def clip_box(x0: str, y0: str, x1: str, y1: str, box: tuple[float, float, float, float]) -> dict[str, Column]:
    """A rectangle cut to a box; all null where they don't overlap."""
    a, b = F.greatest(F.col(x0), F.lit(box[0])), F.greatest(F.col(y0), F.lit(box[1]))
    c, d = F.least(F.col(x1), F.lit(box[2])), F.least(F.col(y1), F.lit(box[3]))
    ok = (a < c) & (b < d)
    return {n: F.when(ok, v) for n, v in zip((x0, y0, x1, y1), (a, b, c, d))}


def square_grid(spark, box: tuple[float, float, float, float], size: float, stride: float) -> DataFrame:
    """Anchors at multiples of the stride from below the box to above it, inclusive; row by row from 1."""
    lo = lambda v: int(math.floor(v / stride))
    hi = lambda v: int(math.ceil(v / stride))
    nx = hi(box[2]) - lo(box[0]) + 1
    g = spark.range((hi(box[3]) - lo(box[1]) + 1) * nx)
    x, y = (F.col("id") % nx + lo(box[0])) * stride, (F.floor(F.col("id") / nx) + lo(box[1])) * stride
    return g.select((F.col("id") + 1).alias("cell_id"), x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + size).cast("double").alias("xmax"), (y + size).cast("double").alias("ymax"))


def contained_boxes(df: DataFrame, key: str, group: list[str], size: float, strict: bool = True) -> DataFrame:
    """Ids of rectangles (xmin..ymax, area) inside another of their group that is larger (or, not strict, at least as large).

    Candidates meet on cells of ``size``: the inner one by its lower left
    corner's cell, the outer one by all cells that it covers. So a group with
    most rows is still spread over its cells, and no pair outside a cell is
    formed. One pass, not iterated: a removed rectangle may still contain.
    """
    key_cols = [F.col(g) for g in group]
    outer = df.select(*[c.alias(f"_g{i}") for i, c in enumerate(key_cols)], F.col(key).alias("_o"), *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "area")])
    outer = outer.withColumn("_cx", F.explode(F.sequence(cell("_xmin", size), cell("_xmax", size)))).withColumn("_cy", F.explode(F.sequence(cell("_ymin", size), cell("_ymax", size))))
    inner = df.withColumns({"_ix": cell("xmin", size), "_iy": cell("ymin", size)})
    on = (F.col("_ix") == F.col("_cx")) & (F.col("_iy") == F.col("_cy"))
    for i, c in enumerate(key_cols):
        on = on & (c == F.col(f"_g{i}"))
    within = (F.col("xmin") >= F.col("_xmin")) & (F.col("ymin") >= F.col("_ymin")) & (F.col("xmax") <= F.col("_xmax")) & (F.col("ymax") <= F.col("_ymax")) & (F.col(key) != F.col("_o"))
    larger = F.col("_area") > F.col("area") + 1e-6 if strict else F.col("_area") >= F.col("area")
    return inner.join(outer, on & within & larger).select(key).distinct()


#: Open points of a round that are broadcast, with their 9 cells each; then no other row moves.
OPEN_SENT = 20_000


#: Places of a cell that are compared with each other at most, as far as MOST_HALVINGS of its size go.
CELL_PLACES, MOST_HALVINGS = 256, 16


def nearest_distance(points: DataFrame, key: str, size: float, rounds: int = 28) -> DataFrame:
    """(key, distance) to the nearest other point, by rings of cells.

    Points at one place have distance 0; all others are compared as places.
    The cells begin with ``size``, halved until the fullest has about
    CELL_PLACES places. Each round doubles them and looks at the 3 x 3 cells
    around a place; a distance up to the cell size is final. Only places
    without one go on, so few take part in the wide rounds; these few are
    broadcast, so that a wide cell is no task of its own. A lone point and one
    without coordinates have null.
    """
    places = durable(points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")))
    full = places.groupBy(cell("x", size), cell("y", size)).count().agg(F.max("count")).first()[0] or 0
    size = size / 2 ** min(MOST_HALVINGS, max(0, math.ceil(math.log2(max(1, full) / CELL_PLACES) / 2)))
    base, todo = places.select("k", "x", "y"), places.where("n = 1").select("k", "x", "y")
    done = places.where("n > 1").select("k", F.lit(0.0).alias("d"))
    for i in range(rounds):
        n = todo.count()
        if not n:
            break
        s = size * 2**i
        near = base.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x", s).alias("cx"), cell("y", s).alias("cy"))
        around = _around(todo, s)
        d = near.join(F.broadcast(around) if n <= OPEN_SENT else around, ["cx", "cy"]).where("k != k2").groupBy("k").agg(F.min(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("d"))
        hit = durable(todo.join(d.where(F.col("d") <= s), "k", "left"))
        done = done.unionByName(hit.where("d IS NOT NULL").select("k", "d"))
        todo = hit.where("d IS NULL").select("k", "x", "y")
    by_place = places.select("x", "y", "k").join(done, "k").select("x", "y", "d")
    return points.select(key, "x", "y").join(by_place, ["x", "y"], "left").select(key, F.col("d").alias("distance"))


def _around(points: DataFrame, s: float) -> DataFrame:
    """Each point under the 3 x 3 cells of size s around it."""
    return points.withColumn("cx", F.explode(F.sequence(cell("x", s) - 1, cell("x", s) + 1))).withColumn("cy", F.explode(F.sequence(cell("y", s) - 1, cell("y", s) + 1)))


def nearest_box(points: DataFrame, key: str, boxes: DataFrame, ref: str, size: float, rounds: int = 24) -> DataFrame:
    """(key, ref, distance): the box next to each point, 0 if it holds the point; of equals the least ref.

    ``boxes`` has ref and xmin..ymax; a box of no size is a point. Rings of
    cells as in :func:`nearest_distance`: a box within s of a point covers one
    of the 3 x 3 cells of size s around it, so a distance up to s is final.
    Each round looks only at boxes in cells that open points still ask for.
    A first round looks for boxes that hold a point, in the point's own cell.
    Points at one place are asked once, and of equal boxes only the least ref.
    """
    places = durable(points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min(key).alias("k")))
    todo, done = places.select("k", "x", "y"), None
    sides = [F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    base = durable(boxes.groupBy(*sides).agg(F.min(ref).alias("ref")))
    dx = F.greatest(F.lit(0.0), F.col("_xmin") - F.col("x"), F.col("x") - F.col("_xmax"))
    dy = F.greatest(F.lit(0.0), F.col("_ymin") - F.col("y"), F.col("y") - F.col("_ymax"))
    for i in range(-1, rounds):
        n = todo.count()
        if not n:
            break
        s = size * 2 ** max(0, i)
        around, final = (todo.withColumns({"cx": cell("x", s), "cy": cell("y", s)}), 0.0) if i < 0 else (_around(todo, s), s)
        covers = base.withColumn("cx", F.explode(F.sequence(cell("_xmin", s), cell("_xmax", s)))).withColumn("cy", F.explode(F.sequence(cell("_ymin", s), cell("_ymax", s))))
        best = covers.join(F.broadcast(around) if n <= OPEN_SENT else around, ["cx", "cy"]).withColumn("d", F.hypot(dx, dy)).groupBy("k").agg(F.min(F.struct("d", "ref")).alias("b"))
        hit = durable(todo.join(best.where(F.col("b.d") <= final), "k", "left"))
        found = hit.where("b IS NOT NULL").select("k", "b.ref", "b.d")
        done = found if done is None else done.unionByName(found)
        todo = hit.where("b IS NULL").select("k", "x", "y")
    kind = dict(boxes.dtypes)[ref]
    rest = todo.select("k", F.lit(None).cast(kind).alias("ref"), F.lit(None).cast("double").alias("d"))
    by_place = places.join(rest if done is None else done.unionByName(rest), "k").select("x", "y", F.col("ref").alias("_ref"), "d")
    return points.select(key, "x", "y").join(by_place, ["x", "y"], "left").select(key, F.col("_ref").alias(ref), F.col("d").alias("distance"))


def dissolved_area(boxes: DataFrame, group: str, size: float) -> DataFrame:
    """(group, area) of the union of each group's rectangles.

    Rectangles are cut along the cells of a lattice; within a cell the union
    is measured exactly by its coordinates, and the cells' areas add up. So a
    group with most rows is spread over its cells. Rows with a null side are
    left out; a null group is a group.
    """
    span = lambda a, b: F.explode(F.sequence(cell(a, size), cell(b, size)))
    ok = boxes.where((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))).select(F.col(group).alias("g"), "xmin", "ymin", "xmax", "ymax")
    d = ok.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    side = lambda low, high, c: (F.greatest(low, F.col(c) * size), F.least(high, (F.col(c) + 1) * size))
    (x0, x1), (y0, y1) = side("xmin", "xmax", "cx"), side("ymin", "ymax", "cy")
    cut = d.select("g", "cx", "cy", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).where("x0 < x1 AND y0 < y1").distinct()

    def union(p: pd.DataFrame) -> pd.DataFrame:
        xs = np.unique(p[["x0", "x1"]].to_numpy())
        area = 0.0
        for left, right in zip(xs, xs[1:]):
            on = p[(p["x0"] <= left) & (p["x1"] >= right)].sort_values("y0")
            if len(on):
                top = np.maximum.accumulate(on["y1"].to_numpy())
                low = np.maximum(on["y0"].to_numpy()[1:], top[:-1])
                area += (right - left) * (on["y1"].iloc[0] - on["y0"].iloc[0] + np.maximum(on["y1"].to_numpy()[1:] - low, 0).sum())
        return pd.DataFrame({"g": p["g"].iloc[:1], "area": [area]})

    per = cut.groupBy("g", "cx", "cy").applyInPandas(union, f"g {dict(boxes.dtypes)[group]}, area double")
    return per.groupBy("g").agg(F.sum("area").alias("area")).toDF(group, "area")


#: Thinning: points of the fullest cell that a batch should hold, kept points that are broadcast (under 9 cells each), and points whose priorities place the end of a batch.
BATCH_PLACES, KEPT_SENT, PROBED = 4, 100_000, 20_000


def thin(points: DataFrame, key: str, priority: str, spacing: float) -> DataFrame:
    """The points that greedy thinning keeps: in order of priority, each at least ``spacing`` from all kept before.

    A batch of the first points by priority is thinned by itself, as no later
    point matters to it; then all points near those it keeps go, and the next
    batch is taken from what is left. A cell in which any two points are near
    each other keeps one at most, so a batch that takes a few points of the
    fullest cell settles that cell: the work grows with the points, not with
    their pairs, and few batches do. Nothing is left out: the last batch is
    all that is left. ``points`` is read several times, so it must be the same
    each time; of what it holds only what a batch leaves is written.
    """
    todo = points.select(F.col(key).alias("k"), F.col(priority).alias("p"), "x", "y")
    side = spacing / 1.5
    kept = None
    while True:
        n, full = _fullest(todo, side)
        batch, last = todo, full <= 2 * BATCH_PLACES
        if not last:
            some = todo.where(F.pmod(F.xxhash64("k"), F.lit(max(1, n // PROBED))) == 0).select("p")
            probed = sorted((r["p"] for r in some.collect()), key=lambda v: (v is not None, v))
            if probed:
                end = probed[min(len(probed) - 1, int(len(probed) * BATCH_PLACES / full))]
                batch = todo.where(F.col("p").isNull() if end is None else F.coalesce(F.col("p") <= F.lit(end), F.lit(True)))
        win = _thinned(batch, spacing)
        kept = win if kept is None else kept.unionByName(win)
        if last:
            return kept.select(F.col("k").alias(key), F.col("p").alias(priority), "x", "y")
        todo = durable(_apart(todo, win, spacing))


def _fullest(points: DataFrame, side: float) -> tuple[int, int]:
    """Number of points that have a place, and the most in a cell."""
    r = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(cell("x", side), cell("y", side)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    return r[0] or 0, r[1] or 0


def _apart(points: DataFrame, kept: DataFrame, spacing: float) -> DataFrame:
    """The points that are no kept ones and not near any."""
    one = lambda cx, cy: F.shiftleft(cx, 32) + cy
    near = _around(kept.select("x", "y"), spacing).select(F.col("x").alias("o_x"), F.col("y").alias("o_y"), one(F.col("cx"), F.col("cy")).alias("o_c"))
    if kept.count() <= KEPT_SENT:
        near = F.broadcast(near)
    close = (F.col("x") - F.col("o_x")) ** 2 + (F.col("y") - F.col("o_y")) ** 2 < spacing**2
    left = points.join(near, (one(cell("x", spacing), cell("y", spacing)) == F.col("o_c")) & close, "left_anti")
    placeless = F.col("x").isNull() | F.col("y").isNull()
    return left.where(~placeless).unionByName(left.where(placeless).join(kept.where(placeless).select("k"), "k", "left_anti"))


def _thinned(points: DataFrame, spacing: float) -> DataFrame:
    """(k, p, x, y) of the points that greedy thinning keeps, by comparing all that are near each other.

    Rounds instead of a sequential pass: a point whose priority is the least
    among the undecided points near it is kept, and points near it go. For
    fixed priorities this gives the very set of the sequential pass. Each
    round is an equi-join on cells; about log(n) rounds do.
    """
    cells = lambda d: d.withColumns({"cx": cell("x", spacing), "cy": cell("y", spacing)})
    todo = durable(cells(points))
    kept = None
    while True:
        around = todo.withColumn("nx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("ny", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
        o = todo.select(*[F.col(c).alias(f"o_{c}") for c in ("k", "p", "x", "y", "cx", "cy")])
        close = (F.col("x") - F.col("o_x")) ** 2 + (F.col("y") - F.col("o_y")) ** 2 < spacing**2
        earlier = F.struct("o_p", "o_k") < F.struct("p", "k")
        near = around.join(o, (F.col("nx") == F.col("o_cx")) & (F.col("ny") == F.col("o_cy")) & close & (F.col("k") != F.col("o_k")))
        beaten = near.where(earlier).select("k").distinct()
        win = durable(todo.join(beaten, "k", "left_anti"))
        kept = win if kept is None else kept.unionByName(win)
        lose = near.join(win.select(F.col("k").alias("o_k")), "o_k", "left_semi").select("k").distinct()
        todo = durable(todo.join(win.select("k"), "k", "left_anti").join(lose, "k", "left_anti"))
        if not todo.limit(1).count():
            return durable(kept.select("k", "p", "x", "y").coalesce(width(points)))


class Near:
    """The points kept so far, which are ``spacing`` apart, to ask of many points whether they are near any.

    A cell of a third less than the spacing holds one of them at most, and
    points near it lie two cells away at most. The cells are wrapped to a torus
    that is no larger than SIDE each way; those that meet there lie in layers.
    """

    SIDE = 2048
    STEPS = sorted(((i, j) for i in range(-2, 3) for j in range(-2, 3)), key=lambda s: s[0] ** 2 + s[1] ** 2)

    def __init__(self, x: np.ndarray, y: np.ndarray, spacing: float) -> None:
        self.spacing, self.layers = spacing, []
        if not len(x):
            return
        cx, cy = self._cells(x, y)
        long = lambda c: int(min(self.SIDE, 2 ** math.ceil(math.log2(int(c.max()) - int(c.min()) + 6))))
        self.mx, self.my = long(cx), long(cy)
        at = (cx & (self.mx - 1)) * self.my + (cy & (self.my - 1))
        order = np.argsort(at, kind="stable")
        at, x, y = at[order], x[order], y[order]
        layer = np.arange(len(at)) - np.searchsorted(at, at)
        for i in range(int(layer.max()) + 1):
            px, py = (np.full(self.mx * self.my, np.inf) for _ in range(2))
            px[at[layer == i]], py[at[layer == i]] = x[layer == i], y[layer == i]
            self.layers.append((px, py))

    def _cells(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = self.spacing / 1.5
        return np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)

    def others(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places, in the arrays, of the points that aren't near any."""
        left = np.arange(len(x))
        if not self.layers:
            return left
        cx, cy = self._cells(x, y)
        for i, j in self.STEPS:
            at = ((cx + i) & (self.mx - 1)) * self.my + ((cy + j) & (self.my - 1))
            far = np.ones(len(left), bool)
            for px, py in self.layers:
                far &= ~((x - px[at]) ** 2 + (y - py[at]) ** 2 < self.spacing**2)
            left, x, y, cx, cy = (a[far] for a in (left, x, y, cx, cy))
        return left


#: Tiles of :func:`thin_by_tiles`, and the rim of others around each, in spacings.
TILE, RIM = 40, 10


def tile_side(spacing: float) -> float:
    return TILE * spacing


def thin_by_tiles(points: DataFrame, spacing: float) -> DataFrame:
    """(k, u, x, y) of the points that greedy thinning in the order of u and k keeps; all four are numbers without null or NaN.

    Each tile sees the points of a rim around it and takes them in order. What
    depends on points that it doesn't see stays open; it is settled in a next
    round, when the tiles around have settled theirs. The first of the open
    points is always settled, and chains of points across a rim are rare, so
    one or two rounds do. A tile is one task: take batches that fill no tile
    too much (:func:`tile_counts`).
    """
    side, rim = tile_side(spacing), RIM * spacing
    tiles = lambda v: F.explode(F.sequence(cell(F.col(v) - rim, side), cell(F.col(v) + rim, side)))

    def settle(tile: pd.DataFrame) -> pd.DataFrame:
        x, y = tile["x"].to_numpy(), tile["y"].to_numpy()
        deep, own = np.ones(len(x), bool), np.ones(len(x), bool)
        for v, t in ((x, tile["tx"].iloc[0]), (y, tile["ty"].iloc[0])):
            deep &= (v >= t * side - rim + 2 * spacing) & (v < (t + 1) * side + rim - 2 * spacing)
            own &= np.floor(v / side) == t
        state = _in_order(tile["k"].to_numpy(), tile["u"].to_numpy(), x, y, tile["sure"].to_numpy(), deep, spacing)
        return tile.assign(sure=state == 1)[own & (state > 0)].drop(columns=["tx", "ty"])

    todo = points.select("k", "u", "x", "y", F.lit(False).alias("sure"))
    while True:
        seen = todo.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
        todo = durable(seen.groupBy("tx", "ty").applyInPandas(settle, "k bigint, u double, x double, y double, sure boolean"))
        if not todo.where("NOT sure").limit(1).count():
            return todo.drop("sure")


def _in_order(k: np.ndarray, u: np.ndarray, x: np.ndarray, y: np.ndarray, sure: np.ndarray, deep: np.ndarray, spacing: float) -> np.ndarray:
    """Of each point: 1 if it is kept, 0 if it goes, 2 if that depends on points that aren't here. ``sure`` ones are kept, around ``deep`` ones all are here."""
    side, row, near = spacing / 1.5, 1 << 32, spacing**2
    at = (np.floor(x / side).astype(np.int64) * row + np.floor(y / side).astype(np.int64)).tolist()
    steps = [i * row + j for i, j in Near.STEPS]
    state, kept, unsettled = np.zeros(len(k), np.int8), {}, defaultdict(list)
    order = np.lexsort((k, u, ~sure))
    xs, ys, sures, deeps = x.tolist(), y.tolist(), sure.tolist(), deep.tolist()
    for i in order.tolist():
        c, px, py = at[i], xs[i], ys[i]
        if not sures[i]:
            if c in kept:  # any two points of a cell are near each other
                continue
            around = [c + s for s in steps]
            if any((px - q[0]) ** 2 + (py - q[1]) ** 2 < near for q in map(kept.get, around) if q):
                continue
            if not deeps[i] or any((px - q[0]) ** 2 + (py - q[1]) ** 2 < near for o in around if o in unsettled for q in unsettled[o]):
                state[i] = 2
                unsettled[c].append((px, py))
                continue
        state[i] = 1
        kept[c] = (px, py)
    return state


def tile_counts(points: DataFrame, spacing: float, n: Column | None = None) -> tuple[int, int]:
    """Number of points, and the most in a tile of :func:`thin_by_tiles`; ``n`` is the number of points that a row stands for."""
    side = tile_side(spacing)
    r = points.groupBy(cell("x", side), cell("y", side)).agg(F.sum(F.lit(1) if n is None else n).alias("n")).agg(F.sum("n"), F.max("n")).first()
    return r[0] or 0, r[1] or 0


def quantile_bin(c: str, k: int, total: int) -> Column:
    """floor((rank - 1) k / n); not ntile. The rank comes from :func:`landmosaic.runtime.ranked` as rank0."""
    return F.floor(F.col(c) * k / total).cast("bigint")


