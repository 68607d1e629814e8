"""The general corpus queries: points near points (p2) and results per skewed key (p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.functions.geo import sql_5186, with_5186
from landmosaic.operators.keyed import balanced_key_totals, canonical_code, heavy_keys
from landmosaic.operators.proximity import place_in_square, radius_pairs
from landmosaic.runtime import durable, table

KEYS = ("major_category", "semantic_type_key")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key of the category as stored and the type code in upper case: rows, distinct row ids and their area."""
    t = table(spark, sf_dir, "togieeum_polygon_pois").select("row_id", "area_m2", KEYS[0], canonical_code(KEYS[1]).alias(KEYS[1]))
    return balanced_key_totals(t, KEYS, "row_id", "area_m2").withColumn("total", F.round("total", 1))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(p6_totals(spark, sf_dir), KEYS, 0.04).select(*KEYS)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (point_id, lon, lat). Missing coordinates, NaN included, are dropped."""
    s = table(spark, sf_dir, "sample_points").select("point_id", "lon", "lat")
    return s.where(F.col("point_id").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")).distinct()


def _scene_of(points: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``points`` (with lon, lat) in a nonoverlap scene, with its scene_id."""
    on_map = (F.abs(F.col("lon") - 127) < 20) & (F.abs("lat") < 80)  # where the projection is defined; no scene lies elsewhere
    squares = table(spark, sf_dir, "scene_grid").where(F.col("grid_type") == "nonoverlap")
    p = with_5186(points.where(on_map), "lon", "lat", "px", "py")
    return place_in_square(p, "px", "py", squares, "scene_id", "centroid_x", "centroid_y", "cell_size_m").select(*points.columns, "scene_id")


def p2_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene_of(_points(spark, sf_dir), spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near points. A pair needs its lesser point in a scene, so points without one are never spelled out as that side, whatever shares their place."""
    points = durable(_points(spark, sf_dir))
    pairs = radius_pairs(durable(points.select("lon", "lat").distinct()), "lon", "lat", 30.0)
    turned = F.explode(F.array(F.struct("lon_a", "lat_a", "lon_b", "lat_b"), F.struct(F.col("lon_b").alias("lon_a"), F.col("lat_b").alias("lat_a"), F.col("lon_a").alias("lon_b"), F.col("lat_a").alias("lat_b"))))
    either = pairs.select(turned.alias("p")).select("p.*")
    held = durable(_scene_of(points, spark, sf_dir).select(F.col("point_id").alias("point_id_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), "scene_id").distinct())
    other = points.select(F.col("point_id").alias("point_id_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    order = F.col("point_id_a") < F.col("point_id_b")
    apart = either.join(held, ["lon_a", "lat_a"]).join(other, ["lon_b", "lat_b"]).where(order).select("point_id_a", "point_id_b", "scene_id")
    at_one = held.join(other.withColumnsRenamed({"lon_b": "lon_a", "lat_b": "lat_a"}), ["lon_a", "lat_a"]).where(order).select("point_id_a", "point_id_b", "scene_id")
    return apart.union(at_one).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_scenes": p2_scenes, "p6_found": p6_found, "p6_totals": p6_totals}

_CODE = r"upper(regexp_replace({0}, '^[\s\x{{3000}}\x{{A0}}]+|[\s\x{{3000}}\x{{A0}}]+$', '', 'g'))"
_TOTALS = f"""
WITH one AS (
  SELECT DISTINCT major_category, {_CODE.format("semantic_type_key")} AS semantic_type_key, row_id, area_m2
  FROM togieeum_polygon_pois
), raw AS (
  SELECT major_category, {_CODE.format("semantic_type_key")} AS semantic_type_key, count(*) AS n_rows
  FROM togieeum_polygon_pois GROUP BY 1, 2
), ids AS (
  SELECT major_category, semantic_type_key, count(DISTINCT row_id) AS n_ids,
         round(sum(CASE WHEN isfinite(area_m2) THEN area_m2 ELSE 0 END), 1) AS total
  FROM one GROUP BY 1, 2
)
SELECT ids.major_category, ids.semantic_type_key, n_rows, n_ids, total
FROM ids JOIN raw ON ids.major_category IS NOT DISTINCT FROM raw.major_category
 AND ids.semantic_type_key IS NOT DISTINCT FROM raw.semantic_type_key
"""
_E, _N = sql_5186("lon", "lat")
_PLACED = f"""
WITH p AS (
  SELECT DISTINCT point_id, lon, lat FROM sample_points WHERE point_id IS NOT NULL AND isfinite(lon) AND isfinite(lat)
), flat AS (
  SELECT *, {_E} AS x, {_N} AS y FROM p WHERE abs(lon - 127) < 20 AND abs(lat) < 80
), placed AS (
  SELECT point_id, lon, lat, scene_id FROM flat JOIN scene_grid g
  ON g.grid_type = 'nonoverlap' AND x >= centroid_x - cell_size_m / 2 AND x < centroid_x + cell_size_m / 2 AND y >= centroid_y - cell_size_m / 2 AND y < centroid_y + cell_size_m / 2
)"""
_H = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"
SQL: dict[str, str] = {
    "p2_scenes": f"{_PLACED} SELECT point_id, lon, lat, scene_id FROM placed",
    "p2_found": f"{_PLACED} SELECT DISTINCT a.point_id AS point_id_a, b.point_id AS point_id_b, a.scene_id FROM placed a JOIN p b ON a.point_id < b.point_id AND b.lat BETWEEN a.lat - 0.0003 AND a.lat + 0.0003 WHERE 2 * 6371008.8 * asin(sqrt(least(1, {_H}))) <= 30",
    "p6_totals": _TOTALS,
    "p6_found": f"SELECT major_category, semantic_type_key FROM ({_TOTALS}) WHERE major_category IS NOT NULL AND semantic_type_key IS NOT NULL AND n_ids >= 0.04 * (SELECT count(DISTINCT row_id) FROM togieeum_polygon_pois)",
}
