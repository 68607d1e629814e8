"""Square grids, scenes, road sampling and folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

try:  # no part of the library's interface, but quicker with texts of a few bytes
    from _sha2 import sha256
except ImportError:
    from hashlib import sha256

from landmosaic.functions.text import truthy, unit_hash
from landmosaic.operators.planar import KEPT_SENT, Near, cell, line_count, line_points, thin, thin_by_tiles, tile_counts, tile_side
from landmosaic.runtime import durable, ranked, width

#: Ranks of the road classes that are sampled.
ROAD_RANKS = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "residential": 6, "living_street": 7, "road": 8, "unclassified": 9}
#: Parts of a boundary are few; more would have to be joined.
MAX_PARTS = 10_000
#: Road samples: points of the fullest tile and, for each point that is wanted, of a batch; points that are made at once.
TILE_FILL, BATCH_FILL, PIECE = 14_400, 8, 200_000


def anchors(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], stride: float, size: float) -> DataFrame:
    """Cells anchored at x[0] + i stride up to x[1] and y[0] + j stride up to y[1], both included, numbered row by row from 1."""
    nx, ny = int(math.floor((x[1] - x[0]) / stride + 1e-9)) + 1, int(math.floor((y[1] - y[0]) / stride + 1e-9)) + 1
    g = spark.range(max(0, nx) * max(0, ny))
    left, low = F.lit(x[0]) + (F.col("id") % nx) * F.lit(stride), F.lit(y[0]) + F.floor(F.col("id") / nx) * F.lit(stride)
    return g.select((F.col("id") + 1).alias("n"), left.alias("xmin"), low.alias("ymin"), (left + size).alias("xmax"), (low + size).alias("ymax"))


def with_coverage(cells: DataFrame, parts: DataFrame, name: str = "part") -> DataFrame:
    """``cells`` that a part of the boundary meets with positive area, with coverage_ratio in [0, 1] and within_boundary.

    ``parts`` are the boundary's disjoint rectangles (xmin..ymax). A part is
    listed under the cells of a lattice that it touches and meets grid cells
    there, so neither side is compared with all of the other.
    """
    size = 1000.0
    span = lambda a, b: F.sequence(cell(a, size), cell(b, size))
    p = parts.select(F.monotonically_increasing_id().alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    p = p.withColumn("_gx", F.explode(span("_xmin", "_xmax"))).withColumn("_gy", F.explode(span("_ymin", "_ymax")))
    g = cells.withColumn("_gx", F.explode(span("xmin", "xmax"))).withColumn("_gy", F.explode(span("ymin", "ymax")))
    w = F.least("xmax", "_xmax") - F.greatest("xmin", "_xmin")
    h = F.least("ymax", "_ymax") - F.greatest("ymin", "_ymin")
    met = g.join(p, ["_gx", "_gy"]).where((w > 0) & (h > 0)).select("n", "_p", (w * h).alias("_a")).distinct()
    share = met.groupBy("n").agg(F.sum("_a").alias("_a"))
    whole = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_a") / whole))
    return cells.join(share, "n").withColumn("coverage_ratio", ratio).withColumn("within_boundary", F.col("coverage_ratio") >= 1 - 1e-9).drop("_a")


def total_bounds(parts: DataFrame) -> tuple[float, float, float, float] | None:
    r = parts.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    return None if r is None or r[0] is None else tuple(float(v) for v in r)


def boundary_grid(parts: DataFrame, size: float) -> DataFrame:
    """Cells from the boundary's lower left corner that meet it, numbered row by row from 1 as grid_id."""
    spark, b = parts.sparkSession, total_bounds(parts)
    if b is None:
        return spark.createDataFrame([], "grid_id bigint, xmin double, ymin double, xmax double, ymax double")
    g = with_coverage(anchors(spark, (b[0], b[2]), (b[1], b[3]), size, size), parts)
    return ranked(g, ["n"]).select((F.col("rank0") + 1).alias("grid_id"), "xmin", "ymin", "xmax", "ymax")


def snapped(spark: SparkSession, b: tuple[float, float, float, float], size: float, stride: float) -> DataFrame:
    """Candidate cells at multiples of the stride, from below the bounds to above them, inclusive; a cell may be larger than the stride."""
    lo, hi = (lambda v: math.floor(v / stride) * stride), (lambda v: math.ceil(v / stride) * stride)
    return anchors(spark, (lo(b[0]), hi(b[2])), (lo(b[1]), hi(b[3])), stride, size)


def scene_grid(parts: DataFrame, region: str, size: float, stride: float) -> DataFrame:
    """Scenes of a region: snapped cells that meet the boundary, numbered, with their attributes."""
    spark, b = parts.sparkSession, total_bounds(parts)
    kind = "nonoverlap" if stride == size else "overlap"
    if b is None:
        b = (0.0, 0.0, -stride, -stride)
    g = ranked(with_coverage(snapped(spark, b, size, stride), parts), ["n"])
    return g.select(
        F.concat(F.lit(f"{region}_{kind}_"), F.format_string("%06d", F.col("rank0") + 1)).alias("scene_id"), F.lit(region).alias("region"), F.lit(kind).alias("grid_type"),
        F.lit(float(size)).alias("cell_size_m"), F.lit(float(stride)).alias("stride_m"), F.lit(float(size * size)).alias("area_m2"),
        ((F.col("xmin") + F.col("xmax")) / 2).alias("centroid_x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("centroid_y"), F.lit(True).alias("intersects_boundary"), "within_boundary", "coverage_ratio",
    )


def scene_grids(parts: DataFrame, region: str, size: float, strides: list[float]) -> DataFrame:
    """The scenes of several strides in one table."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [scene_grid(parts, region, size, s) for s in strides])


def six_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, minimum, quartiles (type 7), mean and maximum per group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), q.alias("_q"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return a.select(*by, "n", "low", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), "mean", F.col("_q")[2].alias("p75"), "high")


def box_grid(spark: SparkSession, b: tuple[float, float, float, float], region: str, size: float, stride: float) -> DataFrame:
    """All cells over the bounds, none left out: what a region without a boundary gets. Coverage is set to 1, not measured."""
    g = snapped(spark, b, size, stride)
    kind = "nonoverlap" if stride == size else "overlap"
    return g.select(F.concat(F.lit(f"{region}_{kind}_"), F.format_string("%06d", "n")).alias("scene_id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("centroid_x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("centroid_y"), F.lit(1.0).alias("coverage_ratio"))


def road_network(roads: DataFrame, box: tuple[float, float, float, float], ranks: dict[str, int] | None = None) -> DataFrame:
    """Roads to sample: no tunnels, ranked classes only, horizontal or vertical lines cut to the box, length above 0.

    ``roads`` has source_road_id, highway_class, tunnel, x0, y0, x1, y1. Lines
    are cut by Liang and Barsky's parameters, so any straight line will do.
    Adds sampled_rank and length_m.
    """
    ranks = ROAD_RANKS if ranks is None else ranks
    rank = F.try_element_at(F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv]), F.col("highway_class"))
    r = roads.where(~truthy("tunnel")).withColumn("sampled_rank", rank).where("sampled_rank IS NOT NULL")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low, high, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for d, at, lo, hi in ((dx, "x0", box[0], box[2]), (dy, "y0", box[1], box[3])):
        a, b = F.try_divide(F.lit(lo) - F.col(at), d), F.try_divide(F.lit(hi) - F.col(at), d)
        low.append(F.coalesce(F.least(a, b), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
        outside = outside | ((d == 0) & ((F.col(at) < lo) | (F.col(at) > hi)))
    # exploded, as filters on plain columns would hold all of their expressions again, several times over
    ends = F.explode(F.array(F.struct(F.greatest(*low).alias("_t0"), F.least(*high).alias("_t1"))))
    r = r.where(~outside).withColumn("_t", ends).select("*", "_t.*").drop("_t").where("_t0 < _t1")
    x, y = (lambda t: F.col("x0") + F.col(t) * dx), (lambda t: F.col("y0") + F.col(t) * dy)
    r = r.withColumn("_p", F.struct(x("_t0").alias("x0"), y("_t0").alias("y0"), x("_t1").alias("x1"), y("_t1").alias("y1")))
    r = r.select(*[c for c in roads.columns if c not in ("x0", "y0", "x1", "y1")], "sampled_rank", "_p.*")
    return r.withColumn("length_m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("length_m > 0")


#: What :func:`_numbered` adds to the roads.
_HELPERS = ("_pid", "_l", "_n", "_after", "_offset", "_before")


def _numbered(network: DataFrame, spacing: float) -> tuple[DataFrame, DataFrame | None]:
    """Roads whose points are numbered from _before + 1, and the numbered points of the roads that share an id (None if no roads do).

    The roads are put in order, not their points: a road's first number is one
    more than the points of all roads before it. Roads that share an id take
    turns by distance, so only their points are ranked.
    """
    length, n = line_count("x0", "y0", "x1", "y1", spacing)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            after = total + np.cumsum(b.column(b.num_columns - 1).to_numpy())
            total = int(after[-1]) if len(after) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(after)], names=[*b.schema.names, "_after"])

    placed = durable(network.withColumn("_l", length).withColumn("_n", n.cast("bigint")).where("_n >= 1"))  # ranges are sampled first, which would cut the roads twice
    placed = placed.repartitionByRange(width(placed), "source_road_id").sortWithinPartitions("source_road_id")
    schema = StructType([*placed.schema.fields, StructField("_after", LongType())])
    placed = durable(placed.mapInArrow(before, schema).withColumn("_pid", F.spark_partition_id()))
    # one row per partition
    runs = placed.groupBy("_pid").agg(F.sum("_n").alias("_s")).select("_pid", F.expr("coalesce(sum(_s) OVER (ORDER BY _pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_offset"))
    roads = placed.join(F.broadcast(runs), "_pid").withColumn("_before", F.col("_offset") + F.col("_after") - F.col("_n"))
    several = durable(placed.groupBy(F.col("source_road_id").alias("_id")).agg(F.count(F.lit(1)).alias("_roads"), F.min(F.col("_after") - F.col("_n")).alias("_start")).where("_roads > 1").drop("_roads"))
    if not several.limit(1).count():
        return roads, None
    same = F.col("source_road_id").eqNullSafe(F.col("_id"))
    turns = ranked(line_points(roads.join(several, same), "x0", "y0", "x1", "y1", spacing), ["source_road_id", "distance", "x", "y"])
    first = turns.groupBy(F.col("source_road_id").alias("_id")).agg(F.min("rank0").alias("_first"))
    turns = turns.drop("_id").join(first, same).withColumn("candidate_id", F.col("_offset") + F.col("_start") + F.col("rank0") - F.col("_first") + 1)
    return roads.join(several, same, "left_anti"), turns.drop("rank0", "_id", "_start", "_first", *_HELPERS)


def road_candidates(network: DataFrame, spacing: float) -> DataFrame:
    """Regular points along the roads, numbered from 1 by road and distance as candidate_id."""
    roads, turns = _numbered(network, spacing)
    number = F.col("_before") + F.round(F.col("distance") / spacing + 0.5).cast("bigint")
    alone = line_points(roads, "x0", "y0", "x1", "y1", spacing).withColumn("candidate_id", number).drop(*_HELPERS)
    return alone if turns is None else alone.unionByName(turns)


def _drawn(b: pa.RecordBatch, spacing: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The points of numbered roads as in :func:`line_points`: row of the road, candidate_id, x, y; in pieces, however long a road is."""
    n, before, length, x0, y0, x1, y1 = (b.column(c).to_numpy() for c in ("_n", "_before", "_l", "x0", "y0", "x1", "y1"))
    ends = np.cumsum(n)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
        j = np.arange(at, min(at + PIECE, int(ends[-1])))
        row = np.searchsorted(ends, j, side="right")
        i = j - (ends[row] - n[row])
        t = np.minimum(1.0, (i + 0.5) * spacing / length[row])
        yield row, before[row] + i + 1, x0[row] + t * (x1[row] - x0[row]), y0[row] + t * (y1[row] - y0[row])


def _hashed(seed: int, ids: np.ndarray) -> np.ndarray:
    """:func:`unit_hash` of seed and number."""
    start = f"{seed}|".encode()
    return np.frombuffer(b"".join([sha256(start + b"%d" % k).digest() for k in ids.tolist()]), "<u8")[::4].astype(float) / 2.0**64


def _road_points(roads: DataFrame, spacing: float, seed: int, held, apart: float, low: float, high: float) -> DataFrame:
    """Points (k, u, x, y) of the roads with low < u <= high that are not near the kept ones held; hashed are only the latter."""
    stay = [c for c in roads.columns if c not in (*_HELPERS, "x0", "y0", "x1", "y1")]
    schema = StructType([StructField("k", LongType()), *[StructField(c, DoubleType()) for c in "uxy"], *[roads.schema[c] for c in stay]])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near(*held.value, apart)
        for b in batches:
            for row, k, x, y in _drawn(b, spacing):
                left = near.others(x, y)
                u = _hashed(seed, k[left])
                took = (u > low) & (u <= high)
                left = left[took]
                if len(left):
                    of = pa.array(row[left])
                    yield pa.RecordBatch.from_arrays([pa.array(k[left]), pa.array(u[took]), pa.array(x[left]), pa.array(y[left]), *[b.column(c).take(of) for c in stay]], names=schema.names)

    return roads.mapInArrow(points, schema)


def _road_tiles(roads: DataFrame, spacing: float, apart: float) -> DataFrame:
    """x and y of a point in a tile of the thinning, and n points of the roads that lie there; several rows a tile."""

    side = tile_side(apart)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, x, y in _drawn(b, spacing):
                _, one, n = np.unique(np.floor(x / side).astype(np.int64) * (1 << 32) + np.floor(y / side).astype(np.int64), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x[one]), pa.array(y[one]), pa.array(n.astype(np.int64))], names=["x", "y", "n"])

    return roads.mapInArrow(tiles, "x double, y double, n bigint")


def _thinned_roads(roads: DataFrame, spacing: float, apart: float, most: int, seed: int) -> DataFrame:
    """(k, u, x, y, ...) of the points of numbered roads that greedy thinning in the order of their hashes keeps, of which the first ``most`` are sure to be there.

    A batch of the first points by hash is thinned by itself, as no later
    point matters to it; then the points near those it keeps go, and the next
    batch is taken from what is left. Points are made from the roads where
    they are needed: for the first batch, and for what it leaves, which is
    little. A batch of BATCH_FILL points for each one wanted keeps as many as
    are wanted, which ends it, or the roads are so crowded that nearly all
    points go.
    """
    sc, kept, todo, found, low = roads.sparkSession.sparkContext, None, None, 0, -1.0
    while True:
        n, full = tile_counts(_road_tiles(roads, spacing, apart), apart, F.col("n")) if todo is None else tile_counts(todo, apart)
        share = min(TILE_FILL / max(1, full), BATCH_FILL * max(1, most) / max(1, n))
        high = 1.0 if share > 0.5 else max(low, 0.0) + (1.0 - max(low, 0.0)) * share
        if todo is None:
            none = sc.broadcast((np.empty(0), np.empty(0)))
            batch = durable(_road_points(roads, spacing, seed, none, apart, low, high))
        else:
            batch = todo.where(F.col("u") <= high)
        win = thin_by_tiles(batch, apart)
        found += win.count()
        some = batch.join(win.select("k"), "k", "left_semi")
        kept = some if kept is None else kept.unionByName(some)
        if high >= 1.0 or found >= most:
            return kept
        at = win.select("x", "y").toPandas()  # fewer than ``most``
        held = sc.broadcast((at["x"].to_numpy(), at["y"].to_numpy()))
        todo = durable(_road_points(roads, spacing, seed, held, apart, high, 1.0) if todo is None else _far(todo.where(F.col("u") > high), held, apart))
        held.unpersist()
        low = high


def _far(points: DataFrame, held, apart: float) -> DataFrame:
    """The points that are not near the kept ones held."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near(*held.value, apart)
        for b in batches:
            yield b.take(pa.array(near.others(b.column("x").to_numpy(), b.column("y").to_numpy())))

    return points.mapInArrow(others, points.schema)


def sample_roads(roads: DataFrame, box: tuple[float, float, float, float], spacing: float, apart: float, most: int, seed: int, grid: float) -> DataFrame:
    """Network, candidates, thinning in a seeded order, at most ``most`` points, and the grid cell of each: the sample of a road network.

    Returns point_id (in the order of acceptance), grid_x, grid_y,
    highway_class, sampled_rank, x, y, source_road_id and the settings.
    """
    network = road_network(roads, box).select("source_road_id", "highway_class", "sampled_rank", "x0", "y0", "x1", "y1")
    if most <= KEPT_SENT * 4:
        numbered, turns = _numbered(network, spacing)
        if turns is not None:  # each a road of one point
            same = {"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y"), "_l": F.lit(1.0), "_n": F.lit(1).cast("bigint"), "_before": F.col("candidate_id") - 1}
            numbered = numbered.drop("_pid", "_after", "_offset").unionByName(turns.withColumns(same).drop("x", "y", "distance", "candidate_id"))
            numbered = durable(numbered)
        out = ranked(_thinned_roads(numbered, spacing, apart, most, seed).orderBy("u", "k").limit(most), ["u", "k"])
    else:
        c = road_candidates(network, spacing).withColumn("_u", unit_hash(str(seed), "candidate_id"))
        kept = thin(c, "candidate_id", "_u", apart).select("candidate_id", "_u")
        kept = durable(kept.orderBy("_u", "candidate_id").limit(most))
        out = ranked(c.drop("_u").join(kept, "candidate_id"), ["_u", "candidate_id"])
    return out.select(
        (F.col("rank0") + 1).alias("point_id"), cell("x", grid).alias("grid_x"), cell("y", grid).alias("grid_y"), "highway_class", "sampled_rank", "x", "y", "source_road_id",
        F.lit(seed).alias("candidate_seed"), F.lit(float(spacing)).alias("candidate_spacing_m"), F.lit(float(apart)).alias("candidate_min_spacing_m"),
    )


def block_id(df: DataFrame, x: str, y: str, size: float, name: str = "spatial_block_id") -> DataFrame:
    """Blocks counted from the least x and y of the table, as 'i_j'. The bounds are one row."""
    low = df.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    part = lambda c, o: F.floor((F.col(c) - F.col(o)) / size).cast("string")
    return df.join(F.broadcast(low)).withColumn(name, F.concat_ws("_", part(x, "_x0"), part(y, "_y0"))).drop("_x0", "_y0")


def balanced_folds(sizes: DataFrame, group: str, size: str, k: int) -> DataFrame:
    """Groups to folds 1..k: largest first, each to the fold with least so far, the first of equals.

    The order is inherently sequential, so the groups (blocks, districts; not
    records) go through the driver, from a sorted stream in pieces; only the
    k loads are held there besides the (group, fold) rows that come out.
    """
    loads = [0] * k
    out = []
    for r in sizes.orderBy(F.desc(size), group).select(group, size).toLocalIterator():
        f = min(range(k), key=lambda i: (loads[i], i))
        loads[f] += r[size] or 0
        out.append((r[group], f + 1))
    return sizes.sparkSession.createDataFrame(out, f"`{group}` {dict(sizes.dtypes)[group]}, fold int")


def hash_fold(seed: str, k: int, *cs: str) -> Column:
    """Fold 1..k by the unit hash."""
    return F.least(F.floor(unit_hash(seed, *cs) * k) + 1, F.lit(k)).cast("int")


def chunked(df: DataFrame, by: list[str], n: str, size: int) -> DataFrame:
    """A task per chunk of ``size`` rows of each entry: chunk from 1, first and last row. Entries without rows have none."""
    first = F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint"), F.lit(size).cast("bigint"))))
    d = df.select(*by, F.col(n).alias("_n"), first.alias("first"))
    return d.select(*by, F.ceil(F.col("first") / size).cast("bigint").alias("chunk"), "first", F.least("_n", F.col("first") + size - 1).alias("last"))
