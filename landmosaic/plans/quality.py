"""Queries over the checks of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.functions import text
from landmosaic.operators import quality, shapes
from landmosaic.plans.reference import BOX, Tables, c, lit, q
from landmosaic.plans.scenes import _partition
from landmosaic.plans.shapes import _faulty

q("Q01", "WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT 'missing_columns' AS rule, 1::BIGINT AS violations UNION ALL SELECT 'null_keys', count(*) FILTER (k IS NULL) FROM a UNION ALL SELECT 'repeated_keys', count(k) - count(DISTINCT k) FROM a UNION ALL SELECT 'only_in_first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'only_in_second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")(
    lambda t: quality.contract(t.customer.select(c("c_custkey").alias("k"), "c_name"), "k", ["c_name", "geometry"], t.orders.select(c("o_custkey").alias("k")))
)
q("Q02", "SELECT count(*) AS n, count(*) FILTER (geo2vec_internal_id IS NULL) AS nulls, count(geo2vec_internal_id) - count(DISTINCT geo2vec_internal_id) AS repeats, min(geo2vec_internal_id) AS low, max(geo2vec_internal_id) AS high, count(*) = count(DISTINCT geo2vec_internal_id) AND min(geo2vec_internal_id) = 0 AND max(geo2vec_internal_id) = count(*) - 1 AS dense FROM scene_entities")(
    lambda t: quality.dense_ids(t.scene_entities, "geo2vec_internal_id")
)
q("Q03", "SELECT event_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'status' END, CASE WHEN value > 50 THEN 'distance' END, CASE WHEN user_id % 8 < 3 THEN 'year' END], lambda x: x IS NOT NULL)) AS rule FROM events ORDER BY rule, event_id LIMIT 50")(
    lambda t: quality.violations(t.events, "event_id", {"status": c("event_type") == "error", "distance": c("value") > 50, "year": c("user_id") % 8 < 3}, 50)
)
q("Q04", "WITH e AS (SELECT c_custkey AS id, v FROM customer, (VALUES ('left'), ('right')) w(v)), g AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'rear' END AS v FROM orders) SELECT id, v AS view, 'missing' AS state FROM (SELECT * FROM e EXCEPT SELECT * FROM g) UNION ALL SELECT id, v, 'extra' FROM (SELECT * FROM g EXCEPT SELECT * FROM e)")(
    lambda t: quality.completeness(
        t.customer.select(c("c_custkey").alias("id"), F.explode(F.array(lit("left"), lit("right"))).alias("view")),
        t.orders.select(c("o_custkey").alias("id"), F.when(c("o_orderkey") % 2 == 0, "left").otherwise("rear").alias("view")), ["id", "view"],
    )
)
q("Q05", "SELECT CAST(geo2vec_internal_id // 200 AS BIGINT) AS shard, count(*) AS rows, count(*) FILTER (NOT coalesce(isfinite(sdf), false)) AS not_finite, count(*) FILTER (split = 0) AS train, count(*) FILTER (split = 1) AS validation, count(DISTINCT geo2vec_internal_id) AS entities, count(DISTINCT CASE WHEN geo2vec_internal_id NOT IN (SELECT geo2vec_internal_id FROM geo2vec_vectors WHERE geo2vec_internal_id IS NOT NULL) THEN geo2vec_internal_id END) AS unknown FROM sdf_samples GROUP BY 1")(
    lambda t: quality.samples_by_shard(t.sdf_samples, "geo2vec_internal_id", "sdf", "split", 200, t.geo2vec_vectors)
)
_SUM = "(SELECT o_orderkey // 1000 AS shard, CAST(sum(CAST('0x' || substr(sha256(o_orderkey || '|' || {0}), 1, 8) AS UBIGINT)) AS HUGEINT) AS checksum FROM orders WHERE {1} GROUP BY 1)"
q("Q06", f"SELECT CAST(coalesce(a.shard, b.shard) AS BIGINT) AS shard, CASE WHEN a.checksum IS NULL THEN 'second only' WHEN b.checksum IS NULL THEN 'first only' WHEN a.checksum = b.checksum THEN 'same' ELSE 'differs' END AS state FROM {_SUM.format('o_custkey', 'o_orderkey < 9000')} a FULL JOIN {_SUM.format('CASE WHEN o_orderkey = 4000 THEN 0 ELSE o_custkey END', 'o_orderkey >= 2000')} b ON a.shard = b.shard")(lambda t: _two_runs(t))


def _two_runs(t: Tables) -> DataFrame:
    shard = F.floor(c("o_orderkey") / 1000).alias("shard")
    run = lambda d: d.groupBy(shard).agg(F.sum(text.row_checksum("o_orderkey", "o_custkey")).alias("checksum"))
    o = t.orders.select("o_orderkey", "o_custkey")
    return quality.same_content(run(o.where("o_orderkey < 9000")), run(o.where("o_orderkey >= 2000").withColumn("o_custkey", F.when(c("o_orderkey") == 4000, lit(0)).otherwise(c("o_custkey")))), "shard", "checksum")


q("Q07", "SELECT p_brand AS shard, unnest(list_filter([CASE WHEN count(*) < 80 THEN 'too few rows' END, CASE WHEN min(p_retailprice) <= 900 THEN 'invalid' END], lambda x: x IS NOT NULL)) AS rule FROM part GROUP BY 1")(
    lambda t: quality.violations(t.part.groupBy(c("p_brand").alias("shard")).agg(F.count(lit(1)).alias("rows"), F.min("p_retailprice").alias("low")), "shard", {"too few rows": c("rows") < 80, "invalid": c("low") <= 900})
)
q("Q08", "SELECT scene_id, unnest(list_filter([CASE WHEN coverage_ratio <= 0 OR coverage_ratio > 1 OR NOT isfinite(coverage_ratio) THEN 'coverage' END, CASE WHEN coverage_ratio IS NULL THEN 'no coverage' END, CASE WHEN abs(area_m2 - cell_size_m * cell_size_m) > 1e-6 THEN 'area' END, CASE WHEN (grid_type = 'overlap') = (stride_m = cell_size_m) THEN 'stride' END, CASE WHEN within_boundary AND NOT intersects_boundary THEN 'boundary' END], lambda x: x IS NOT NULL)) AS rule FROM scene_grid")(
    lambda t: quality.violations(
        t.scene_grid, "scene_id",
        {"coverage": ~(c("coverage_ratio") > 0) | ~(c("coverage_ratio") <= 1), "no coverage": c("coverage_ratio").isNull(), "area": F.abs(c("area_m2") - c("cell_size_m") * c("cell_size_m")) > 1e-6,
         "stride": (c("grid_type") == "overlap") == (c("stride_m") == c("cell_size_m")), "boundary": c("within_boundary") & ~c("intersects_boundary")},
    )
)
q("Q09", f"SELECT CASE id % 6 WHEN 1 THEN 'self-crossing' WHEN 2 THEN 'not closed' WHEN 3 THEN 'repeated point' WHEN 5 THEN 'too few points' ELSE 'sound' END AS state, count(*) AS n FROM {BOX} GROUP BY 1")(
    lambda t: _faulty(t).select(F.coalesce(shapes.measures("wkt")["fault"], lit("sound")).alias("state")).groupBy("state").agg(F.count(lit(1)).alias("n"))
)
q("Q10", "SELECT count(*) AS classes, count(DISTINCT p_brand) AS complete FROM (SELECT DISTINCT p_brand FROM part)")(lambda t: _partition(t).agg(F.count(lit(1)).alias("classes"), F.count_if(c("candidates") + c("facilities") == c("input")).alias("complete")))
q("Q11", "SELECT CAST(coalesce(len(embedding), -1) AS INTEGER) AS dim, count(*) AS n, count(*) FILTER (embedding IS NULL) AS nulls, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0 OR x IS NULL)) = 0) AS all_zero FROM geo2vec_vectors GROUP BY 1")(
    lambda t: quality.vector_audit(t.geo2vec_vectors, "embedding")
)
q("Q12", "SELECT source_system, count(*) AS rows, count(*) FILTER (geometry_wkt IS NULL) AS nulls, count(DISTINCT regexp_extract(upper(geometry_wkt), '[A-Z]+', 0)) AS kinds FROM scene_entities GROUP BY 1")(
    lambda t: t.scene_entities.groupBy("source_system").agg(F.count(lit(1)).alias("rows"), F.count_if(c("geometry_wkt").isNull()).alias("nulls"), F.countDistinct(F.regexp_extract(F.upper("geometry_wkt"), "[A-Z]+", 0)).alias("kinds"))
)
_TAGS = ["poi_class", "poi_type", "name", "addr_street", "phone"]
q("Q14", " UNION ALL ".join(f"SELECT '{x}' AS tag, count({x}) AS present, count(*) FILTER (trim({x}) <> '') AS filled, count(DISTINCT {x}) AS distinct_values FROM korea_pois_point" for x in _TAGS))(lambda t: quality.tag_report(t.korea_pois_point, _TAGS))
q("Q15", "WITH f AS (SELECT vec_id // 4 AS g, vec_id, CAST(embedding[1:6] AS DOUBLE[]) AS p FROM embeddings), d AS (SELECT a.g, min((abs(a.p[1]-b.p[1])+abs(a.p[2]-b.p[2])+abs(a.p[3]-b.p[3])+abs(a.p[4]-b.p[4])+abs(a.p[5]-b.p[5])+abs(a.p[6]-b.p[6]))/6) AS least FROM f a JOIN f b ON a.g = b.g AND a.vec_id < b.vec_id GROUP BY 1), e AS (SELECT g, max(greatest(abs(p[1]-p[2]), abs(p[2]-p[3]), abs(p[3]-p[4]), abs(p[4]-p[5]), abs(p[5]-p[6]))) AS edge FROM f GROUP BY 1) SELECT CAST(e.g AS BIGINT) AS scene, round(least, 5) AS least, round(edge, 5) AS edge FROM e LEFT JOIN d ON d.g = e.g")(
    lambda t: quality.frame_difference(t.embeddings.select(F.floor(c("vec_id") / 4).alias("scene"), "vec_id", F.slice(c("embedding").cast("array<double>"), 1, 6).alias("p")), "scene", "vec_id", "p").select("scene", F.round("least", 5).alias("least"), F.round("edge", 5).alias("edge"))
)
