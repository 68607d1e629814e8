"""Radius self-join of places on the sphere, and the square cell that holds a place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.functions.geo import EARTH_RADIUS_M
from landmosaic.runtime import durable

#: Upper bound of the pivots; with two doubles each they take 64 kB.
MAX_PIVOTS = 4096
#: Distinct places that a pivot stands for, as far as MAX_PIVOTS goes.
PLACES_PER_PIVOT = 512
#: Members of a cell that one task joins with all of the cell's places.
MEMBERS_PER_TASK = 20_000
_LEAF = 96


def _haversine(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres; the arguments are radians and broadcast against each other."""
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def _tree_join(data: np.ndarray, queries: np.ndarray, lon: np.ndarray, lat: np.ndarray, radius: float, out: list) -> None:
    """All (query, datum) index pairs within the radius.

    A vantage-point tree that is built as far as queries reach it: at each
    node the data are halved at the median distance to a vantage point, and a
    query goes into a half only where the triangle inequality lets it have a
    partner there. The metre of slack is far above rounding errors.
    """
    stack = [(data, queries)]
    while stack:
        d, q = stack.pop()
        if not len(d) or not len(q):
            continue
        if len(d) <= _LEAF:
            for part in np.array_split(q, max(1, len(q) // 2048)):
                i, j = np.nonzero(_haversine(lon[part][:, None], lat[part][:, None], lon[d][None], lat[d][None]) <= radius)
                out.append((part[i], d[j]))
            continue
        v = d[len(d) // 2]
        near = _haversine(lon[v], lat[v], lon[d], lat[d])
        mu = np.median(near)
        inner = near <= mu
        if inner.all():  # half the data at the very same distance
            inner = near < mu
            if not inner.any():
                inner[: len(d) // 2] = True
                stack += [(d[inner], q), (d[~inner], q)]
                continue
        far = _haversine(lon[v], lat[v], lon[q], lat[q])
        stack += [(d[inner], q[far <= mu + radius + 1]), (d[~inner], q[far >= mu - radius - 1])]


def radius_pairs(places: DataFrame, lon: str, lat: str, radius_m: float) -> DataFrame:
    """All pairs of different places at most ``radius_m`` apart, each once.

    ``places`` has one row per distinct place; rows without finite coordinates
    pair with nothing. The plane is cut into the Voronoi cells of pivots (a
    sample of the places, at most MAX_PIVOTS, the only thing broadcast). A
    place of cell p lies in cell p as a member and is copied to every cell c
    with d(place, c) <= d(place, p) + 2 r: by the triangle inequality only
    such cells can hold a member within r. Each cell is then joined alone with
    a vantage-point tree and the exact great-circle metric, so the result is
    complete. A pair in two cells is given by the cell of its lesser place. A
    cell that holds more than MEMBERS_PER_TASK members is joined in blocks.

    Returns lon_a, lat_a, lon_b, lat_b; a precedes b by (lon, lat).
    """
    spark = places.sparkSession
    p = places.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    p = p.where((F.abs("lon") <= 360) & (F.abs("lat") <= 90) & ~F.isnan("lon") & ~F.isnan("lat"))
    n = p.count()
    k = min(MAX_PIVOTS, max(1, n // PLACES_PER_PIVOT))
    # a bounded sample: the k least hashes
    pivots = np.radians(np.array([tuple(r) for r in p.orderBy(F.xxhash64("lon", "lat")).limit(k).collect()], dtype=float).reshape(-1, 2))
    if not len(pivots):
        return spark.createDataFrame([], "lon_a double, lat_a double, lon_b double, lat_b double")
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = held.value
        unit = np.stack([np.cos(at[:, 1]) * np.cos(at[:, 0]), np.cos(at[:, 1]) * np.sin(at[:, 0]), np.sin(at[:, 1])], axis=1)
        for batch in batches:
            for start in range(0, len(batch), 512):
                b = batch.iloc[start : start + 512]
                x, y = np.radians(b["lon"].to_numpy()), np.radians(b["lat"].to_numpy())
                u = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)
                # a first screen by the squared chord; the great-circle metric decides on what it leaves
                dot = np.clip(u @ unit.T, -1, 1)
                arc = np.arccos(dot) * EARTH_RADIUS_M
                slack = 2 * radius_m + 2.0  # arccos loses up to 0.15 m near 0
                i, c = np.nonzero(arc <= arc.min(axis=1, keepdims=True) + slack)
                d = _haversine(x[i], y[i], at[c, 0], at[c, 1])
                best = np.full(len(b), np.inf)
                np.minimum.at(best, i, d)
                home = np.full(len(b), len(at))
                tie = d == best[i]
                np.minimum.at(home, i[tie], c[tie])
                keep = d <= best[i] + 2 * radius_m + 0.01
                i, c = i[keep], c[keep]
                yield pd.DataFrame({"cell": c.astype("int32"), "member": home[i] == c, "lon": b["lon"].to_numpy()[i], "lat": b["lat"].to_numpy()[i]})

    def within(cell: pd.DataFrame) -> pd.DataFrame:
        x0, y0, member = cell["lon"].to_numpy(), cell["lat"].to_numpy(), cell["member"].to_numpy()
        x, y = np.radians(x0), np.radians(y0)
        found: list = []
        _tree_join(np.arange(len(cell)), np.flatnonzero(member), x, y, radius_m, found)
        q = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        d = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
        keep = (x0[q] < x0[d]) | ((x0[q] == x0[d]) & (y0[q] < y0[d]))  # the member is the lesser place
        q, d = q[keep], d[keep]
        return pd.DataFrame({"lon_a": x0[q], "lat_a": y0[q], "lon_b": x0[d], "lat_b": y0[d]})

    cells = durable(p.mapInPandas(assign, "cell int, member boolean, lon double, lat double"))
    # a cell with many members is joined in blocks of them, each with all that the cell holds; one row per pivot is broadcast
    blocks = cells.where("member").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("lon", "lat"), F.col("blocks")).cast("int")
    split = cells.join(F.broadcast(blocks), "cell").select("cell", "member", "lon", "lat", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    split = split.select("cell", "block", (F.col("member") & (F.col("mine") == F.col("block"))).alias("member"), "lon", "lat")
    return split.groupBy("cell", "block").applyInPandas(within, "lon_a double, lat_a double, lon_b double, lat_b double")


def place_in_square(points: DataFrame, x: str, y: str, squares: DataFrame, square_id: str, cx: str, cy: str, side: str, lattice_m: float = 500.0) -> DataFrame:
    """Attach to each point the squares that hold it (left and lower edges belong to a square).

    Points and squares meet on the cells of a lattice, an equi-join; a square
    is listed under each lattice cell that it touches. Squares may overlap:
    then a point comes out once for each. Points in no square, or without
    coordinates, are left out; squares with a null or non-positive side hold
    nothing.
    """
    half = F.col(side) / 2
    s = squares.where((F.col(side) > 0) & F.col(cx).isNotNull() & F.col(cy).isNotNull()).select(
        F.col(square_id).alias("_sid"), (F.col(cx) - half).alias("_x0"), (F.col(cy) - half).alias("_y0"), (F.col(cx) + half).alias("_x1"), (F.col(cy) + half).alias("_y1")
    )
    low, high = (lambda c: F.floor(F.col(c) / lattice_m)), (lambda c: F.floor(F.col(c) / lattice_m))
    s = s.withColumn("_gx", F.explode(F.sequence(low("_x0"), high("_x1")))).withColumn("_gy", F.explode(F.sequence(low("_y0"), high("_y1"))))
    q = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).withColumns({"_px": F.floor(F.col(x) / lattice_m), "_py": F.floor(F.col(y) / lattice_m)})
    inside = (F.col(x) >= F.col("_x0")) & (F.col(x) < F.col("_x1")) & (F.col(y) >= F.col("_y0")) & (F.col(y) < F.col("_y1"))
    joined = q.join(s, (F.col("_px") == F.col("_gx")) & (F.col("_py") == F.col("_gy")) & inside)
    return joined.withColumnRenamed("_sid", square_id).drop("_px", "_py", "_gx", "_gy", "_x0", "_y0", "_x1", "_y1")
