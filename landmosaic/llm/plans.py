"""The corpus queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.llm import encoding, linkage, mixing, neighbours, overlap, residue, splits, tokens
from landmosaic.functions.geo import to_5186
from landmosaic.runtime import table

ID = "geo2vec_internal_id"


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split) of each entity that has one."""
    s = table(spark, sf_dir, "sdf_samples").where("split IS NOT NULL AND geo2vec_internal_id IS NOT NULL")
    return s.groupBy(ID).agg(F.max("split").alias("split"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.broken_groups(table(spark, sf_dir, "scene_entities"), _splits(spark, sf_dir), ID, "building_id", "scene_id")
    return out.withColumnRenamed("group_place", "group_scene_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "scene_entities").select(ID, "building_id", "scene_id", "source_system").distinct()
    g = splits.record_groups(e, ID, "building_id", "scene_id").select(ID, "group").distinct()
    return e.select(ID, "source_system").distinct().join(g, ID)


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = splits.durable(p1_groups(spark, sf_dir))
    return g.join(splits.assign_splits(g, "source_system"), "group").select(ID, "group", "source_system", "split")


def p1_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = p1_splits(spark, sf_dir).groupBy("split", "source_system").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("group").alias("groups"))
    return s.orderBy("split", "source_system")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.usable(table(spark, sf_dir, "geo2vec_vectors"), ID, "geo_dim", "embedding", 64)


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_of_all(_vectors(spark, sf_dir), ID).select("id", "other")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = neighbours.nearest(_vectors(spark, sf_dir), ID).select(F.least("id", "other").alias("internal_id_a"), F.greatest("id", "other").alias("internal_id_b"))
    return pair.distinct()


def _poi_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, sf_dir, "korea_pois_point")
    a = k.select(F.col("poi_id").alias("id"), "name", F.col("poi_type").alias("kind"), "x", "y", F.concat_ws(" ", "addr_street", "addr_housenumber").alias("addr"), F.col("phone").alias("tel"))
    r = table(spark, sf_dir, "registry_pois")
    on_map = (F.abs(F.col("lon") - 127) < 20) & (F.abs("lat") < 80)
    x, y = to_5186(F.when(on_map, F.col("lon")), F.when(on_map, F.col("lat")))
    b = r.select(F.col("registry_id").alias("id"), F.col("biz_name").alias("name"), F.col("category_label").alias("kind"), x.alias("x"), y.alias("y"), F.col("road_address").alias("addr"), "tel")
    return a, b


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.matches(*_poi_lists(spark, sf_dir)).select(F.col("a").alias("poi_id"), F.col("b").alias("registry_id"), "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("poi_id", "registry_id")


P5_FIELDS = (("bnd_sigungu", "sigungu_nm", "sido_cd", "sigungu_cd"), ("togieeum_polygon_pois", "source_shp", "source_system", "row_id"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = None
    for name, value, source, _ in P5_FIELDS:
        t = table(spark, sf_dir, name).select(F.lit(name).alias("field"), F.col(source).cast("string").alias("source"), F.col(value).alias("value")).distinct()
        v = t if v is None else v.unionByName(t)
    return encoding.misread_values(encoding.durable(v))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = encoding.durable(p5_values(spark, sf_dir).groupBy("field", "value").agg(F.max_by("chain", "probability").alias("chain"), F.max_by("restored", "probability").alias("restored"), F.max("probability").alias("probability")))
    out = None
    for name, value, _, key in P5_FIELDS:
        t = table(spark, sf_dir, name).where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_key"), F.col(value).alias("value"))
        t = t.join(bad.where(F.col("field") == name).drop("field"), "value").distinct()
        out = t if out is None else out.unionByName(t)
    return out.select("table_name", "record_key", "value", "chain", "restored", "probability")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_records(spark, sf_dir).select("table_name", "record_key").distinct()


P7_COLUMNS = ("entity_key", "building_id", "geometry_wkt", "split")


def _split_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scene_entities").select(ID, "entity_key", "building_id", "geometry_wkt").join(_splits(spark, sf_dir), ID)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlap.split_overlaps(_split_entities(spark, sf_dir), *P7_COLUMNS)
    return o.select(F.least("train", "eval").alias("entity_key_a"), F.greatest("train", "eval").alias("entity_key_b")).distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = overlap.overlap_counts(_split_entities(spark, sf_dir), *P7_COLUMNS)
    e = table(spark, sf_dir, "scene_entities").select(ID, "entity_key", "source_system").distinct().join(_splits(spark, sf_dir).where("split IN (1, 2)"), ID)
    e = e.join(hit, F.col("entity_key") == F.col("eval"), "left")
    return e.groupBy("split", "source_system").agg(F.count(F.lit(1)).alias("entities"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")


def p8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k", sizes_only=True)


def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    slim = d.where("source IS NOT NULL").select("source", "doc_id", "text").withColumn("row", F.struct("doc_id", "source"))
    sized = tokens.encode(slim, "row", "text", "byte_bpe_50k", sizes_only=True).select("row.*", "n_tokens")
    return mixing.draw(sized, table(spark, sf_dir, "mixture_targets"), "doc_id", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(p9_sample(spark, sf_dir), table(spark, sf_dir, "mixture_targets"), "source")


def p10_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_records(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_cases(spark, sf_dir).select("doc_id")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.join(p10_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_balance": p1_balance,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p5_values": p5_values,
    "p5_records": p5_records,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_ids": p8_ids,
    "p8_sizes": p8_sizes,
    "p9_sample": p9_sample,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_cases": p10_cases,
    "p10_clean": p10_clean,
}

_GROUPS = """
WITH RECURSIVE pairs AS (SELECT DISTINCT building_id AS b, scene_id AS s FROM scene_entities WHERE building_id IS NOT NULL AND scene_id IS NOT NULL),
step AS (SELECT DISTINCT x.s AS u, y.s AS v FROM pairs x JOIN pairs y ON x.b = y.b),
reach AS (SELECT u, v FROM step UNION SELECT r.u, t.v FROM reach r JOIN step t ON r.v = t.u),
home AS (SELECT u AS s, min(v) AS g FROM reach GROUP BY 1),
entity AS (
  SELECT DISTINCT e.geo2vec_internal_id AS id, e.building_id AS b,
    coalesce(h.g, e.scene_id, (SELECT min(coalesce(h2.g, p.s)) FROM pairs p LEFT JOIN home h2 ON p.s = h2.s WHERE p.b = e.building_id)) AS g
  FROM scene_entities e LEFT JOIN home h ON e.scene_id = h.s
),
split AS (SELECT DISTINCT geo2vec_internal_id AS id, split FROM sdf_samples WHERE split IS NOT NULL),
broken AS (SELECT g FROM entity JOIN split USING (id) WHERE g IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
"""
_VECTORS = """
WITH u AS (
  SELECT geo2vec_internal_id AS id, max(CAST(embedding AS DOUBLE[])) AS v FROM geo2vec_vectors
  WHERE geo_dim = 64 AND len(embedding) = 64 AND list_aggregate(embedding, 'count') = 64 AND isfinite(list_aggregate(CAST(embedding AS DOUBLE[]), 'sum'))
    AND (list_aggregate(embedding, 'max') <> 0 OR list_aggregate(embedding, 'min') <> 0)
  GROUP BY 1
), c AS (SELECT a.id AS id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 7) AS s FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT id, other, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS k FROM c)
"""
_OUTLINES = r"""
WITH split AS (SELECT geo2vec_internal_id AS id, max(split) AS split FROM sdf_samples WHERE split IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT entity_key AS k, building_id AS b, geometry_wkt AS w, split = 0 AS train FROM scene_entities JOIN split ON id = geo2vec_internal_id WHERE entity_key IS NOT NULL),
flat AS (SELECT k, train, unnest(regexp_extract_all(w, '[-+0-9.eE]+\s+[-+0-9.eE]+')) AS p, unnest(range(len(regexp_extract_all(w, '[-+0-9.eE]+\s+[-+0-9.eE]+')))) AS i FROM e WHERE contains(upper(w), 'POLYGON')),
v AS (SELECT k, train, i, round(CAST(regexp_extract(p, '^\S+') AS DOUBLE), 3) AS x, round(CAST(regexp_extract(p, '\S+$') AS DOUBLE), 3) AS y FROM flat),
s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY k ORDER BY i)),
box AS (SELECT k, train, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v GROUP BY 1, 2),
near AS (SELECT a.k AS t, b.k AS e FROM box a JOIN box b ON a.train AND NOT b.train AND abs(a.x0 - b.x0) <= 0.51 AND abs(a.x1 - b.x1) <= 0.51 AND abs(a.y0 - b.y0) <= 0.51 AND abs(a.y1 - b.y1) <= 0.51),
sides AS (SELECT t, e, t AS a, e AS o FROM near UNION ALL SELECT t, e, e, t FROM near),
d AS (
  SELECT t, e, a, i, min(sqrt(pow(x - sx - u * dx, 2) + pow(y - sy - u * dy, 2))) AS d FROM (
    SELECT t, e, a, v.i, v.x, v.y, s.x AS sx, s.y AS sy, s.x2 - s.x AS dx, s.y2 - s.y AS dy,
      greatest(0, least(1, ((v.x - s.x) * (s.x2 - s.x) + (v.y - s.y) * (s.y2 - s.y)) / greatest(pow(s.x2 - s.x, 2) + pow(s.y2 - s.y, 2), 1e-12))) AS u
    FROM sides JOIN v ON v.k = a JOIN s ON s.k = o) GROUP BY 1, 2, 3, 4
),
agree AS (SELECT t, e FROM d GROUP BY 1, 2 HAVING max(d) <= 0.5 + 1e-9),
found AS (SELECT t, e FROM agree UNION SELECT a.k, b.k FROM e a JOIN e b ON a.train AND NOT b.train AND a.b = b.b)
"""
SQL: dict[str, str] = {
    "p7_found": f"{_OUTLINES} SELECT DISTINCT least(t, e) AS entity_key_a, greatest(t, e) AS entity_key_b FROM found WHERE t <> e",
    "p7_report": f"""{_OUTLINES}, ev AS (
  SELECT DISTINCT geo2vec_internal_id, entity_key, source_system, split FROM scene_entities JOIN split ON id = geo2vec_internal_id WHERE split IN (1, 2)
), n AS (SELECT e, count(DISTINCT t) AS n FROM found WHERE t <> e GROUP BY 1)
SELECT split, source_system, count(*) AS entities, count(n) AS overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs FROM ev LEFT JOIN n ON e = entity_key GROUP BY 1, 2""",
    "p3_found": f"{_VECTORS} SELECT DISTINCT least(id, other) AS internal_id_a, greatest(id, other) AS internal_id_b FROM r WHERE k <= 5 AND s >= 0.8",
    "p1_found": f"{_GROUPS} SELECT DISTINCT b AS building_id, g AS group_scene_id FROM entity JOIN broken USING (g) WHERE b IS NOT NULL",
    "p3_nearest": f"{_VECTORS} SELECT id, other FROM r WHERE k <= 5",
}
