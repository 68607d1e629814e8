"""Queries over grids, scenes, road samples and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.functions import text
from landmosaic.operators import grids, planar, relational
from landmosaic.plans.reference import BOX, Tables, c, lit, n_, q, r6
from landmosaic.plans.scalar import _UNIT
from landmosaic.runtime import ranked

PARTS = "(SELECT CAST(120 AS DOUBLE) AS xmin, CAST(0 AS DOUBLE) AS ymin, CAST(1130 AS DOUBLE) AS xmax, CAST(499 AS DOUBLE) AS ymax UNION ALL SELECT 2000 + 300 * n_nationkey, 700, 2100 + 300 * n_nationkey, 1350 FROM nation)"


def _parts(t: Tables) -> DataFrame:
    """A boundary of 26 rectangles."""
    d = lambda e, n: e.cast("double").alias(n)
    k = 300 * c("n_nationkey")
    one = t.spark.range(1).select(d(lit(120), "xmin"), d(lit(0), "ymin"), d(lit(1130), "xmax"), d(lit(499), "ymax"))
    return one.union(t.nation.select(d(2000 + k, "xmin"), d(lit(700), "ymin"), d(2100 + k, "xmax"), d(lit(1350), "ymax")))


def _cells(x0: str, x1: str, y0: str, y1: str, stride: int, size: int) -> str:
    """SQL of all candidate cells, with n row by row."""
    x = f"SELECT {x0} + i * {stride} AS x, i FROM range(CAST(floor(({x1} - ({x0})) / {stride} + 1e-9) AS BIGINT) + 1) r(i)"
    y = f"SELECT {y0} + j * {stride} AS y, j FROM range(CAST(floor(({y1} - ({y0})) / {stride} + 1e-9) AS BIGINT) + 1) r(j)"
    return f"(SELECT CAST(x AS DOUBLE) AS xmin, CAST(y AS DOUBLE) AS ymin, CAST(x + {size} AS DOUBLE) AS xmax, CAST(y + {size} AS DOUBLE) AS ymax, j, i FROM ({x}), ({y}))"


_SNAP = lambda stride, size: _cells("0", "9500", "0", "1500", stride, size)


def _covered(cells: str, size: int) -> str:
    return f"(SELECT g.xmin, g.ymin, g.xmax, g.ymax, least(1.0, sum((least(g.xmax, p.xmax) - greatest(g.xmin, p.xmin)) * (least(g.ymax, p.ymax) - greatest(g.ymin, p.ymin))) / {size * size}) AS coverage_ratio FROM {cells} g JOIN {PARTS} p ON least(g.xmax, p.xmax) > greatest(g.xmin, p.xmin) AND least(g.ymax, p.ymax) > greatest(g.ymin, p.ymin) GROUP BY 1, 2, 3, 4)"


q("C01", f"SELECT row_number() OVER (ORDER BY ymin, xmin) AS grid_id, xmin, ymin FROM {_covered(_cells('120', '9300', '0', '1350', 500, 500), 500)}")(lambda t: grids.boundary_grid(_parts(t), 500.0).select("grid_id", "xmin", "ymin"))
q("C02", f"SELECT row_number() OVER (ORDER BY j, i) AS n, xmin, ymin, xmax, ymax FROM {_SNAP(250, 500)}")(lambda t: grids.snapped(t.spark, grids.total_bounds(_parts(t)), 500.0, 250.0))
q("C03", f"SELECT 'r_nonoverlap_' || printf('%06d', row_number() OVER (ORDER BY ymin, xmin)) AS scene_id, (xmin + xmax) / 2 AS centroid_x, (ymin + ymax) / 2 AS centroid_y, coverage_ratio >= 1 - 1e-9 AS within_boundary, round(coverage_ratio, 6) AS coverage_ratio FROM {_covered(_SNAP(500, 500), 500)}")(
    lambda t: grids.scene_grid(_parts(t), "r", 500.0, 500.0).select("scene_id", "centroid_x", "centroid_y", "within_boundary", r6(c("coverage_ratio"), "coverage_ratio"))
)
_STRIDES = f"(SELECT 'nonoverlap' AS grid_type, coverage_ratio FROM {_covered(_SNAP(500, 500), 500)} UNION ALL SELECT 'overlap', coverage_ratio FROM {_covered(_SNAP(250, 500), 500)})"
q("C04", f"SELECT grid_type, count(*) AS n, round(min(coverage_ratio), 6) AS low, round(quantile_cont(coverage_ratio, 0.25), 6) AS p25, round(median(coverage_ratio), 6) AS p50, round(avg(coverage_ratio), 6) AS mean, round(quantile_cont(coverage_ratio, 0.75), 6) AS p75, round(max(coverage_ratio), 6) AS high FROM {_STRIDES} GROUP BY 1")(
    lambda t: grids.six_numbers(grids.scene_grids(_parts(t), "r", 500.0, [500.0, 250.0]), ["grid_type"], "coverage_ratio").select("grid_type", "n", *[r6(c(x), x) for x in ("low", "p25", "p50", "mean", "p75", "high")])
)
q("C05", f"SELECT 'r_overlap_' || printf('%06d', row_number() OVER (ORDER BY j, i)) AS scene_id, (xmin + xmax) / 2 AS centroid_x, (ymin + ymax) / 2 AS centroid_y, 1.0::DOUBLE AS coverage_ratio FROM {_SNAP(250, 500)}")(lambda t: grids.box_grid(t.spark, grids.total_bounds(_parts(t)), "r", 500.0, 250.0))

_CLASS = ["primary", "residential", "service", "trunk", "footway"]
_ROAD = "(SELECT o_orderkey AS source_road_id, CASE o_custkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'trunk' ELSE 'footway' END AS highway_class, CASE WHEN o_orderkey % 11 = 0 THEN 'Yes' END AS tunnel, CAST((o_orderkey * 13) % 9000 AS DOUBLE) AS x0, CAST((o_orderkey * 17) % 10000 AS DOUBLE) AS y0, CAST((o_orderkey * 13) % 9000 + o_custkey % 300 AS DOUBLE) AS x1 FROM orders)"
_BOX = (500.0, 500.0, 8000.0, 8000.0)


def _roads(t: Tables) -> DataFrame:
    k, m = c("o_orderkey"), c("o_custkey")
    x, y = ((k * 13) % 9000).cast("double"), ((k * 17) % 10000).cast("double")
    kind = F.element_at(F.array(*map(lit, _CLASS)), (m % 5 + 1).cast("int"))
    return t.orders.select(k.alias("source_road_id"), kind.alias("highway_class"), F.when(k % 11 == 0, "Yes").alias("tunnel"), x.alias("x0"), y.alias("y0"), (x + m % 300).alias("x1"), y.alias("y1"))


_NET = f"(SELECT source_road_id, highway_class, CASE highway_class WHEN 'primary' THEN 3 WHEN 'trunk' THEN 2 ELSE 6 END AS sampled_rank, greatest(x0, 500) AS x0, y0, least(x1, 8000) AS x1 FROM {_ROAD} WHERE coalesce(lower(tunnel), '') NOT IN ('yes', 'true', '1') AND highway_class IN ('primary', 'residential', 'trunk') AND y0 BETWEEN 500 AND 8000 AND least(x1, 8000) > greatest(x0, 500))"
_CAND = f"(SELECT source_road_id, highway_class, (i + 0.5::DOUBLE) * 10 AS distance, x0 + (i + 0.5::DOUBLE) * 10 AS x, y0 AS y FROM {_NET}, range(40) r(i) WHERE (i + 0.5) * 10 <= x1 - x0)"
q("C06", f"SELECT source_road_id, highway_class, sampled_rank, round(x0, 6) AS x0, round(x1 - x0, 6) AS length_m FROM {_NET}")(lambda t: grids.road_network(_roads(t), _BOX).select("source_road_id", "highway_class", "sampled_rank", r6(c("x0"), "x0"), r6(c("length_m"), "length_m")))
q("C07", f"SELECT row_number() OVER (ORDER BY source_road_id, distance) AS candidate_id, source_road_id, distance, round(x, 6) AS x, y FROM {_CAND}")(lambda t: grids.road_candidates(grids.road_network(_roads(t), _BOX), 10.0).select("candidate_id", "source_road_id", "distance", r6(c("x"), "x"), "y"))
q("C08")(lambda t: grids.sample_roads(_roads(t), _BOX, 8.0, 25.0, 150_000, 20260524, 500.0))
q("C09")(lambda t: grids.sample_roads(_roads(t), _BOX, 10.0, 50.0, 40_000, 20260517, 500.0))
q("C10", f"SELECT highway_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(DISTINCT (floor(x / 500), floor(y / 500))) AS cells, round(median(x), 6) AS x50 FROM {_CAND} GROUP BY 1")(
    lambda t: grids.road_candidates(grids.road_network(_roads(t), _BOX), 10.0).groupBy("highway_class").agg(n_(), F.countDistinct(planar.cell("x", 500.0), planar.cell("y", 500.0)).alias("cells"), r6(F.median("x"), "x50")).select("highway_class", "n", r6(c("n") / F.sum("n").over(Window.partitionBy()), "share"), "cells", "x50")
)
_ENT = "(SELECT DISTINCT geo2vec_internal_id AS id, building_id, scene_id, source_system, area, perimeter, centroid_x, centroid_y FROM scene_entities WHERE centroid_x IS NOT NULL AND centroid_y IS NOT NULL)"


def entities(t: Tables) -> DataFrame:
    e = t.scene_entities.where("centroid_x IS NOT NULL AND centroid_y IS NOT NULL")
    return e.select(c("geo2vec_internal_id").alias("id"), "building_id", "scene_id", "source_system", "area", "perimeter", "centroid_x", "centroid_y").distinct()


_BLOCK = f"(SELECT id, floor((centroid_x - (SELECT min(centroid_x) FROM {_ENT})) / 500)::BIGINT || '_' || floor((centroid_y - (SELECT min(centroid_y) FROM {_ENT})) / 500)::BIGINT AS spatial_block_id FROM {_ENT})"
q("C11", f"SELECT id, spatial_block_id FROM {_BLOCK}")(lambda t: grids.block_id(entities(t), "centroid_x", "centroid_y", 500.0).select("id", "spatial_block_id"))
q("C12", "SELECT 'pois' AS layer, count(*) AS n, round(sum(x), 3) AS sx FROM korea_pois_point WHERE x BETWEEN 190000 AND 210000 AND y BETWEEN 540000 AND 560000 UNION ALL SELECT 'entities', count(*), round(sum(centroid_x), 3) FROM scene_entities WHERE centroid_x BETWEEN 190000 AND 210000 AND centroid_y BETWEEN 540000 AND 560000 UNION ALL SELECT 'polygons', count(*), round(sum(greatest(xmin, 190000)), 3) FROM togieeum_polygon_pois WHERE xmax > 190000 AND xmin < 210000 AND ymax > 540000 AND ymin < 560000")(lambda t: _regional(t))


def _regional(t: Tables) -> DataFrame:
    """Several layers cut to one region: points filtered, boxes clipped."""
    inside = lambda x, y: F.col(x).between(190000, 210000) & F.col(y).between(540000, 560000)
    part = lambda d, name, x: d.agg(n_(), F.round(F.sum(x), 3).alias("sx")).select(lit(name).alias("layer"), "n", "sx")
    poly = t.togieeum_polygon_pois.select("xmin", "ymin", "xmax", "ymax").withColumns(planar.clip_box("xmin", "ymin", "xmax", "ymax", (190000.0, 540000.0, 210000.0, 560000.0))).where("xmin IS NOT NULL")
    return part(t.korea_pois_point.where(inside("x", "y")), "pois", "x").union(part(t.scene_entities.where(inside("centroid_x", "centroid_y")), "entities", "centroid_x")).union(part(poly, "polygons", "xmin"))


q("C13", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 AND c_custkey % 3 <> 0 THEN c_acctbal ELSE o_totalprice END AS x, c_acctbal > 0 AND c_custkey % 3 <> 0 AS from_pano FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: _pano(t))


def _pano(t: Tables) -> DataFrame:
    """The panorama's place where both its coordinates are known, else the sample's."""
    j = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "o_totalprice", F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("px"), F.when(c("c_custkey") % 3 != 0, c("c_custkey")).alias("py"))
    known = c("px").isNotNull() & c("py").isNotNull()
    return j.select("o_orderkey", F.when(known, c("px")).otherwise(c("o_totalprice")).alias("x"), known.alias("from_pano"))


_CATALOGUE = [("east", "equals", "n_name", "NATION_3"), ("i", "prefix", "n_name", "NATION_1"), ("ends", "regex", "n_name", "[05]$")]
q("C14", "SELECT 'east' AS region, n_nationkey FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'i', n_nationkey FROM nation WHERE starts_with(n_name, 'NATION_1') UNION ALL SELECT 'ends', n_nationkey FROM nation WHERE regexp_matches(n_name, '[05]$')")(lambda t: _catalogue(t))


def _catalogue(t: Tables) -> DataFrame:
    """Regions by a catalogue of (name, match, field, value); every entry is a filter that the scan can take."""
    from functools import reduce

    test = {"equals": lambda f, v: c(f) == v, "prefix": lambda f, v: c(f).startswith(v), "regex": lambda f, v: c(f).rlike(v)}
    return reduce(DataFrame.union, [t.nation.where(test[m](f, v)).select(lit(r).alias("region"), "n_nationkey") for r, m, f, v in _CATALOGUE])


q("C15", "SELECT source_system, source_shp, CAST(ceil(f / 25) AS BIGINT) AS chunk, f AS first, least(n, f + 24) AS last FROM (SELECT source_system, source_shp, count(*) AS n FROM togieeum_polygon_pois GROUP BY 1, 2), LATERAL (SELECT unnest(generate_series(1, n, 25)) AS f)")(
    lambda t: grids.chunked(t.togieeum_polygon_pois.groupBy("source_system", "source_shp").agg(n_()), ["source_system", "source_shp"], "n", 25)
)
q("C16", "SELECT source_system, count(*) AS rows, count(*) FILTER (geometry_wkt IS NULL) AS empty, count(*) FILTER (geometry_wkt IS NOT NULL AND NOT starts_with(upper(trim(geometry_wkt)), 'POLYGON')) AS other, count(*) FILTER (starts_with(upper(trim(geometry_wkt)), 'POLYGON')) AS polygons FROM scene_entities GROUP BY 1")(
    lambda t: t.scene_entities.withColumn("k", F.regexp_extract(F.upper(F.trim("geometry_wkt")), "^[A-Z]+", 0)).groupBy("source_system").agg(F.count(lit(1)).alias("rows"), F.count_if(c("geometry_wkt").isNull()).alias("empty"), F.count_if(~c("k").startswith("POLYGON")).alias("other"), F.count_if(c("k").startswith("POLYGON")).alias("polygons"))
)
q("C17", "SELECT row_number() OVER (ORDER BY try_cast(osm_id AS DOUBLE) NULLS LAST, osm_id NULLS LAST, poi_id) AS n, poi_id, CASE WHEN poi_class IS NOT NULL THEN 'poi_class' ELSE 'poi_type' END AS tag, coalesce(poi_class, poi_type) AS value FROM (SELECT DISTINCT poi_id, osm_id, poi_class, poi_type FROM korea_pois_point WHERE poi_class IS NOT NULL OR poi_type IS NOT NULL)")(
    lambda t: ranked(
        t.korea_pois_point.withColumn("tag", text.first_tag(["poi_class", "poi_type"])).where("tag IS NOT NULL").select("poi_id", "osm_id", "poi_class", "poi_type", "tag.*").distinct(),
        [F.asc_nulls_last(F.expr("try_cast(osm_id AS double)")), F.asc_nulls_last("osm_id"), "poi_id"],
    ).select((c("rank0") + 1).alias("n"), "poi_id", c("key").alias("tag"), "value")
)
_CODES = "(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN split_part(p_name, ' ', 1) END AS l, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS m, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS s FROM part)"


def _codes(t: Tables) -> DataFrame:
    k = c("p_partkey")
    return t.part.select("p_partkey", F.when(k % 7 != 0, F.split_part("p_name", lit(" "), lit(1))).alias("l"), F.when(k % 3 == 0, c("p_type")).alias("m"), F.when(k % 2 == 0, c("p_brand")).alias("s"))


_MAP = "(SELECT p_type AS code, 'type ' || p_type AS label FROM part UNION SELECT p_brand, 'brand ' || p_brand FROM part WHERE p_brand <> 'Brand#3')"
q("C18", f"SELECT p_partkey, coalesce(s, m, l) AS type_code, coalesce(label, CASE WHEN l IS NOT NULL THEN 'record ' || l END) AS label, CASE WHEN coalesce(s, m, l) IS NULL THEN 'no_code' WHEN label IS NOT NULL THEN 'code_map' WHEN l IS NOT NULL THEN 'record_map' ELSE 'unknown' END AS status FROM {_CODES} LEFT JOIN {_MAP} ON coalesce(s, m, l) = code")(lambda t: _decoded(t))


def _decoded(t: Tables) -> DataFrame:
    """The most specific code, its label from the code map or else from the record, and where that came from."""
    m = t.part.select(c("p_type").alias("code"), F.concat(lit("type "), "p_type").alias("label")).union(t.part.where("p_brand <> 'Brand#3'").select("p_brand", F.concat(lit("brand "), "p_brand"))).distinct()
    d = _codes(t).withColumn("type_code", F.coalesce("s", "m", "l")).join(m, c("type_code") == c("code"), "left")
    status = F.when(c("type_code").isNull(), "no_code").when(c("label").isNotNull(), "code_map").when(c("l").isNotNull(), "record_map").otherwise("unknown")
    return d.select("p_partkey", "type_code", F.coalesce("label", F.concat(lit("record "), "l")).alias("label"), status.alias("status"))


_METRIC = f"(SELECT id, kind, 4*pi()*area/pow(2*((xmax-xmin)+(ymax-ymin)), 2) AS compactness, area/greatest(xmax-xmin,ymax-ymin) AS width, greatest(xmax-xmin,ymax-ymin)/least(xmax-xmin,ymax-ymin) AS aspect FROM {BOX})"
q("C19", f"SELECT kind, count(*) AS input, count(*) FILTER (hit) AS candidates, count(*) FILTER (NOT hit) AS facilities FROM (SELECT *, compactness <= 0.4 AND (aspect >= 8 OR width <= 4) AS hit FROM {_METRIC}) GROUP BY 1")(lambda t: _partition(t))


def _partition(t: Tables) -> DataFrame:
    """Corridor candidates and facilities: two disjoint parts whose counts per class are merged again."""
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    m = t.box.withColumns(planar.shape_metrics(c("area"), 2 * (w + h), w, h)).withColumn("hit", F.coalesce((c("compactness") <= 0.4) & ((c("aspect") >= 8) | (c("approx_width") <= 4)), lit(False)))
    count = lambda d, n: d.groupBy("kind").agg(F.count(lit(1)).alias(n))
    out = relational.null_safe_join(relational.null_safe_join(count(m, "input"), count(m.where("hit"), "candidates"), ["kind"], "full"), count(m.where("NOT hit"), "facilities"), ["kind"], "full")
    return out.fillna(0, ["input", "candidates", "facilities"])


# ---- folds and splits ------------------------------------------------------------------------------------------------
def _lpt(t: Tables) -> DataFrame:
    return grids.balanced_folds(t.part.groupBy("p_type").agg(n_()), "p_type", "n", 3)


q(
    "D02",
    "WITH RECURSIVE s AS (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1), f AS (SELECT 0 AS r, ''::VARCHAR AS p_type, 0 AS fold, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c UNION ALL SELECT s.r, s.p_type, CASE WHEN a <= b AND a <= c THEN 1 WHEN b <= c THEN 2 ELSE 3 END, CASE WHEN a <= b AND a <= c THEN a + n ELSE a END, CASE WHEN NOT (a <= b AND a <= c) AND b <= c THEN b + n ELSE b END, CASE WHEN NOT (a <= b AND a <= c) AND NOT b <= c THEN c + n ELSE c END FROM f JOIN s ON s.r = f.r + 1) SELECT p_type, fold FROM f WHERE r > 0",
)(_lpt)
_FOLD = f"least(floor({_UNIT.format(chr(39) + '20260610|' + chr(39) + ' || id')} * 5) + 1, 5)::INTEGER"
q("E08", f"SELECT id, {_FOLD} AS fold_random, CASE WHEN {_FOLD} = 5 THEN 'test' ELSE 'train' END AS split_random FROM {_ENT}")(
    lambda t: entities(t).withColumn("fold_random", grids.hash_fold("20260610", 5, "id")).select("id", "fold_random", F.when(c("fold_random") == 5, "test").otherwise("train").alias("split_random"))
)
_BINS = f"SELECT id, floor((row_number() OVER (ORDER BY centroid_x, id) - 1) * 5 / count(*) OVER ()) AS bx, floor((row_number() OVER (ORDER BY centroid_y, id) - 1) * 5 / count(*) OVER ()) AS by_ FROM {_ENT}"
q("E09", f"SELECT id, CAST((bx * 2 + by_ * 3) % 5 + 1 AS INTEGER) AS fold_spatial FROM ({_BINS})")(lambda t: _spatial(t))


def _spatial(t: Tables) -> DataFrame:
    """Quantile bins of both coordinates, mixed to one fold."""
    e = entities(t).select("id", "centroid_x", "centroid_y")
    e = ranked(ranked(e, ["centroid_x", "id"], name="rx"), ["centroid_y", "id"], name="ry").join(F.broadcast(e.agg(F.count(lit(1)).alias("n"))))
    b = lambda r: F.floor(c(r) * 5 / c("n"))
    return e.select("id", ((b("rx") * 2 + b("ry") * 3) % 5 + 1).cast("int").alias("fold_spatial"))


q("E10", f"WITH b AS {_BLOCK}, s AS (SELECT spatial_block_id, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS entities, (SELECT count(*) FROM s) AS blocks FROM b")(lambda t: _holdout(t))


def _holdout(t: Tables) -> DataFrame:
    """Whole blocks to folds: every entity has one fold and every block too."""
    e = grids.block_id(entities(t), "centroid_x", "centroid_y", 500.0)
    f = grids.balanced_folds(e.groupBy("spatial_block_id").agg(n_()), "spatial_block_id", "n", 5)
    j = e.join(f, "spatial_block_id")
    return j.where("fold BETWEEN 1 AND 5").agg(F.count(lit(1)).alias("entities"), F.countDistinct("spatial_block_id", "fold").alias("blocks"))
