"""Queries whose operators work in several steps: reasons, fallbacks, duplicates, acceptance, resumable batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.functions import geo, text
from landmosaic.operators import planar, relational
from landmosaic.operators.samples import affine
from landmosaic.plans.reference import BOX, GRID, LINE, PTS, Tables, _overlap_cells, at_, c, lit, n_, q, r6
from landmosaic.runtime import ranked, shared_dir
from landmosaic.streaming import upserts

# ---- reasons ---------------------------------------------------------------------------------------------------------
_EV = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS pano, 2015 + user_id % 8 AS year, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS metres FROM events)"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", F.when(c("event_id") % 13 != 0, c("user_id")).alias("pano"), (2015 + c("user_id") % 8).alias("year"), F.when(c("event_id") % 17 != 0, c("value")).alias("metres"))


def _rules() -> list:
    return [("is_error", c("event_type") == "error"), ("no_pano", c("pano").isNull()), ("no_distance", c("metres").isNull()), ("too_far", c("metres") > 50), ("too_near", c("metres") < 1), ("too_old", c("year") < 2017), ("signup", c("event_type") == "signup")]


_REASON = "CASE WHEN event_type = 'error' THEN 'is_error' WHEN pano IS NULL THEN 'no_pano' WHEN metres IS NULL THEN 'no_distance' WHEN metres > 50 THEN 'too_far' WHEN metres < 1 THEN 'too_near' WHEN year < 2017 THEN 'too_old' WHEN event_type = 'signup' THEN 'signup' END"
q("P10", f"SELECT event_id, {_REASON} AS reason FROM {_EV}")(lambda t: _events(t).select("event_id", text.first_reason(*_rules()).alias("reason")))
q("P11", "SELECT geo2vec_internal_id, epoch_us(ingested_at) AS at, CASE WHEN building_id IS NULL THEN 'missing_id' WHEN count(*) OVER (PARTITION BY building_id) > 1 THEN 'repeated_id' WHEN geometry_wkt IS NULL OR trim(geometry_wkt) = '' THEN 'empty' WHEN area <= 0 THEN 'invalid' WHEN NOT starts_with(upper(trim(geometry_wkt)), 'POLYGON') THEN 'not_polygon' END AS reason FROM scene_entities")(lambda t: _excluded(t))


def _excluded(t: Tables) -> DataFrame:
    """The first reason to exclude. Repeated ids come from an aggregate that is joined back, so a frequent id is no task of its own."""
    many = t.scene_entities.where("building_id IS NOT NULL").groupBy(c("building_id").alias("b")).agg(n_()).where("n > 1")
    d = t.scene_entities.join(many, c("building_id") == c("b"), "left")
    g = F.upper(F.trim("geometry_wkt"))
    return d.select("geo2vec_internal_id", at_(), text.first_reason(("missing_id", c("building_id").isNull()), ("repeated_id", c("n").isNotNull()), ("empty", c("geometry_wkt").isNull() | (g == "")), ("invalid", c("area") <= 0), ("not_polygon", ~g.startswith("POLYGON"))).alias("reason"))


_MET = f"(SELECT id, kind, 4*pi()*area/pow(2*((xmax-xmin)+(ymax-ymin)), 2) AS comp, area/greatest(xmax-xmin,ymax-ymin) AS aw, sqrt(pow(xmax-xmin, 2)+pow(ymax-ymin, 2)) AS diag, greatest(xmax-xmin,ymax-ymin)/least(xmax-xmin,ymax-ymin) AS asp FROM {BOX})"
_HIT = "comp <= 0.3 AND aw <= 50 AND diag >= 20 AND (asp >= 8 OR comp <= 0.2 OR aw <= 4)"
q("P12", f"SELECT id, CASE WHEN facility AND extreme THEN 'extreme_facility' WHEN facility THEN 'facility' WHEN extreme THEN 'extreme' WHEN hit THEN 'corridor' ELSE 'kept' END AS decision, hit AND NOT (facility AND NOT extreme) AS candidate FROM (SELECT id, {_HIT} AS hit, comp <= 0.15 AND aw <= 3 AND diag >= 30 AS extreme, kind IN ('Brand#1', 'Brand#2') AS facility FROM {_MET})")(lambda t: _decided(t))


def _decided(t: Tables) -> DataFrame:
    """Corridor screen: four measures and a choice of shapes; a stricter screen overrides labels of facilities."""
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    b = t.box.withColumns(planar.shape_metrics(c("area"), 2 * (w + h), w, h))
    comp, aw, diag, asp = c("compactness"), c("approx_width"), c("diagonal"), c("aspect")
    sure = lambda x: F.coalesce(x, lit(False))
    b = b.withColumns({"hit": sure((comp <= 0.3) & (aw <= 50) & (diag >= 20) & ((asp >= 8) | (comp <= 0.2) | (aw <= 4))), "extreme": sure((comp <= 0.15) & (aw <= 3) & (diag >= 30)), "facility": c("kind").isin("Brand#1", "Brand#2")})
    decision = F.when(c("facility") & c("extreme"), "extreme_facility").when(c("facility"), "facility").when(c("extreme"), "extreme").when(c("hit"), "corridor").otherwise("kept")
    return b.select("id", decision.alias("decision"), (c("hit") & ~(c("facility") & ~c("extreme"))).alias("candidate"))


q("P15", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 90000)")(lambda t: t.customer.join(t.orders.where("o_totalprice > 90000").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"))
q("A30", "SELECT event_type, n * 1000 AS target, round(s / n * n * 1000, 4) AS expected FROM (SELECT event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1)")(lambda t: t.events.groupBy("event_type").agg(n_(), F.sum("value").alias("s")).select("event_type", (c("n") * 1000).alias("target"), F.round(c("s") / c("n") * (c("n") * 1000), 4).alias("expected")))
# ---- joins with checks and fallbacks ---------------------------------------------------------------------------------
q("J03", "WITH r AS (SELECT o_custkey AS k FROM orders), s AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 100 = 0) SELECT (SELECT count(*) FROM (SELECT k FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_left, (SELECT count(*) FROM (SELECT k FROM s GROUP BY 1 HAVING count(*) > 1)) AS repeated_right, (SELECT count(*) FROM (SELECT DISTINCT k FROM r) WHERE k NOT IN (SELECT k FROM s)) AS missing_right")(
    lambda t: relational.one_to_one_errors(t.orders.select(c("o_custkey").alias("k")), t.customer.where("c_acctbal > 0").select(c("c_custkey").alias("k")).union(t.customer.where("c_custkey % 100 = 0").select("c_custkey")), "k")
)
_REF = "(SELECT s_suppkey AS ref, CAST((s_suppkey*53)%10000 AS DOUBLE) AS rx, CAST((s_suppkey*29)%10000 AS DOUBLE) AS ry FROM supplier)"


def _suppliers(t: Tables) -> DataFrame:
    x, y = ((c("s_suppkey") * 53) % 10000).cast("double"), ((c("s_suppkey") * 29) % 10000).cast("double")
    return t.supplier.select(c("s_suppkey").alias("ref"), x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


q("J12", f"SELECT p.id, s.ref, round(sqrt(pow(p.x-s.rx, 2)+pow(p.y-s.ry, 2)), 4) AS distance FROM {PTS} p JOIN {_REF} s ON true QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x-s.rx, 2)+pow(p.y-s.ry, 2)), s.ref) = 1")(
    lambda t: planar.nearest_box(t.pts, "id", _suppliers(t), "ref", 400.0).withColumn("distance", F.round("distance", 4))
)
_REG = f"(SELECT id AS region, xmin, ymin, xmin + 150 AS xmax, ymin + 150 AS ymax FROM {BOX})"
_GAP = "sqrt(pow(greatest(0, r.xmin - p.x, p.x - r.xmax), 2) + pow(greatest(0, r.ymin - p.y, p.y - r.ymax), 2))"
q("J13", f"SELECT p.id, r.region, {_GAP} > 0 AS by_nearest FROM {PTS} p JOIN {_REG} r ON true QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {_GAP}, r.region) = 1")(
    lambda t: planar.nearest_box(t.pts, "id", t.box.select(c("id").alias("region"), "xmin", "ymin", (c("xmin") + 150).alias("xmax"), (c("ymin") + 150).alias("ymax")), "region", 150.0).select("id", "region", (c("distance") > 0).alias("by_nearest"))
)
_TRI = [(2000.0, 2000.0), (7000.0, 2500.0), (3500.0, 8000.0)]
q("J14", f"SELECT id FROM {PTS} WHERE (7000 - 2000) * (y - 2000) - (2500 - 2000) * (x - 2000) >= 0 AND (3500 - 7000) * (y - 2500) - (8000 - 2500) * (x - 7000) > 0 AND (2000 - 3500) * (y - 8000) - (2000 - 8000) * (x - 3500) > 0")(
    lambda t: t.pts.where(planar.in_ring(F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in _TRI]), c("x"), c("y"))).select("id")
)
# boxes, some with a smaller one inside, some twice
_NEST = f"(SELECT id, kind, xmin, ymin, xmax, ymax, area FROM {BOX} UNION ALL SELECT id + 1000000, CASE WHEN id % 12 = 0 THEN 'other' ELSE kind END, xmin + 0.25, ymin + 0.25, xmax - 0.25, ymax - 0.25, (xmax - xmin - 0.5) * (ymax - ymin - 0.5) FROM {BOX} WHERE id % 4 = 0 UNION ALL SELECT id + 2000000, kind, xmin, ymin, xmax, ymax, area FROM {BOX} WHERE id % 10 = 1)"


def _nested(t: Tables) -> DataFrame:
    b = t.box
    inner = b.where("id % 4 = 0").select((c("id") + 1000000).alias("id"), F.when(c("id") % 12 == 0, "other").otherwise(c("kind")).alias("kind"), (c("xmin") + 0.25).alias("xmin"), (c("ymin") + 0.25).alias("ymin"), (c("xmax") - 0.25).alias("xmax"), (c("ymax") - 0.25).alias("ymax"))
    inner = inner.withColumn("area", (c("xmax") - c("xmin")) * (c("ymax") - c("ymin")))
    return b.unionByName(inner).unionByName(b.where("id % 10 = 1").withColumn("id", c("id") + 2000000))


_IN = "a.xmin >= b.xmin AND a.ymin >= b.ymin AND a.xmax <= b.xmax AND a.ymax <= b.ymax"
q("J15", f"SELECT DISTINCT a.id FROM {_NEST} a JOIN {_NEST} b ON a.kind = b.kind AND a.id <> b.id AND {_IN} AND b.area > a.area + 1e-6")(lambda t: planar.contained_boxes(_nested(t), "id", ["kind"], 100.0))
q("D06", f"SELECT DISTINCT a.id, 'larger' AS variant FROM {_NEST} a JOIN {_NEST} b ON a.kind = b.kind AND a.id <> b.id AND {_IN} AND b.area > a.area + 1e-6 UNION ALL SELECT DISTINCT a.id, 'as large' FROM {_NEST} a JOIN {_NEST} b ON a.kind = b.kind AND a.id <> b.id AND {_IN} AND b.area >= a.area")(
    lambda t: planar.contained_boxes(_nested(t), "id", ["kind"], 100.0).withColumn("variant", lit("larger")).union(planar.contained_boxes(_nested(t), "id", ["kind"], 100.0, strict=False).withColumn("variant", lit("as large")))
)
q("J16", f"SELECT b.id, coalesce(min(CASE WHEN (b.xmin+b.xmax)/2 >= g.xmin AND (b.xmin+b.xmax)/2 < g.xmax AND (b.ymin+b.ymax)/2 >= g.ymin AND (b.ymin+b.ymax)/2 < g.ymax THEN g.cell_id END), min(g.cell_id)) AS cell_id FROM {BOX} b JOIN {GRID} g ON b.xmax >= g.xmin AND b.xmin < g.xmax AND b.ymax >= g.ymin AND b.ymin < g.ymax WHERE g.cell_id % 3 <> 0 GROUP BY 1")(lambda t: _one_scene(t))


def _one_scene(t: Tables) -> DataFrame:
    """The scene that holds a box's centre, else the first that the box meets; some scenes are missing."""
    m = _overlap_cells(t).where("cell_id % 3 != 0").join(t.box.select("id", ((c("xmin") + c("xmax")) / 2).alias("x"), ((c("ymin") + c("ymax")) / 2).alias("y")), "id")
    home = (planar.cell("x", 500.0) == c("gx")) & (planar.cell("y", 500.0) == c("gy"))
    return m.groupBy("id").agg(F.coalesce(F.min(F.when(home, c("cell_id"))), F.min("cell_id")).alias("cell_id"))


q("J18", f"SELECT row_number() OVER (ORDER BY b.id, g.cell_id) - 1 AS n, CAST(b.id AS VARCHAR) || '__' || CAST(g.cell_id AS VARCHAR) AS entity_key, g.xmin AS scene_xmin, g.ymin AS scene_ymin, g.xmax AS scene_xmax, g.ymax AS scene_ymax FROM {BOX} b JOIN {GRID} g ON b.xmax >= g.xmin AND b.xmin < g.xmax AND b.ymax >= g.ymin AND b.ymin < g.ymax")(
    lambda t: ranked(_overlap_cells(t).select("id", "cell_id", "gx", "gy"), ["id", "cell_id"]).select(
        c("rank0").alias("n"), F.concat_ws("__", c("id").cast("string"), c("cell_id").cast("string")).alias("entity_key"), *[(c(g) * 500 + d).cast("double").alias(f"scene_{s}") for g, d, s in (("gx", 0, "xmin"), ("gy", 0, "ymin"), ("gx", 500, "xmax"), ("gy", 500, "ymax"))]
    )
)
q("U05", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 90000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'difference' AS op, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'either', k FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a))")(lambda t: _sets(t))


def _sets(t: Tables) -> DataFrame:
    """Difference, intersection and symmetric difference from one aggregate over both sets."""
    side = lambda cond, bit: t.orders.where(cond).select(c("o_custkey").alias("k"), lit(bit).alias("s"))
    s = side("o_totalprice > 90000", 1).union(side("o_orderstatus = 'F'", 2)).groupBy("k").agg(F.bit_or("s").alias("s"))
    ops = F.when(c("s") == 3, F.array(lit("both"))).when(c("s") == 1, F.array(lit("difference"), lit("either"))).otherwise(F.array(lit("either")))
    return s.select(F.explode(ops).alias("op"), "k")


q("L01", "SELECT p_partkey, row_number() OVER (ORDER BY p_size > 25 DESC, p_type NULLS LAST, p_partkey) AS place FROM part")(lambda t: ranked(t.part.select("p_partkey", "p_type", "p_size"), [F.desc(c("p_size") > 25), F.asc_nulls_last("p_type"), "p_partkey"]).select("p_partkey", (c("rank0") + 1).alias("place")))
q("L02", "SELECT osm_id, poi_id, row_number() OVER (ORDER BY try_cast(osm_id AS DOUBLE) NULLS LAST, osm_id NULLS LAST, poi_id) AS place FROM (SELECT DISTINCT osm_id, poi_id FROM korea_pois_point)")(
    lambda t: ranked(t.korea_pois_point.select("osm_id", "poi_id").distinct(), [F.asc_nulls_last(F.expr("try_cast(osm_id AS double)")), F.asc_nulls_last("osm_id"), "poi_id"]).select("osm_id", "poi_id", (c("rank0") + 1).alias("place"))
)
q("W10", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS final_rank FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (ORDER BY event_id) <= 100")(
    # the target bounds what passes through the one-task numbering
    lambda t: t.events.where("event_type = 'click'").select("event_id").orderBy("event_id").limit(100).select("event_id", F.row_number().over(Window.partitionBy().orderBy("event_id")).cast("bigint").alias("final_rank"))
)
# ---- duplicates and acceptance ---------------------------------------------------------------------------------------
_FIRST = "row_number() OVER (PARTITION BY coalesce(major_category,'NA') || '|' || coalesce(semantic_type_key,'NA') || '|' || coalesce(geom_hash,'NA') ORDER BY row_id, ingested_at)"
_SIDES = ("area_m2", "xmin", "ymin", "xmax", "ymax")
_NEARKEY = "major_category, semantic_type_key, " + ", ".join(f"round_even({s}, 1)" for s in _SIDES)


def _stages(t: Tables) -> DataFrame:
    """Rows of polygons with the flags exact and near; near is told among the rows that exact leaves."""
    d = t.togieeum_polygon_pois.select("row_id", "ingested_at", "major_category", "semantic_type_key", "geom_hash", *_SIDES)
    order = F.struct("row_id", "ingested_at")
    key = text.pasted("|", "major_category", "semantic_type_key", "geom_hash")
    d = d.withColumns({"_o": order, "_k": key, "_n": F.concat_ws("|", F.coalesce("major_category", lit("NA")), F.coalesce("semantic_type_key", lit("NA")), *[F.coalesce(F.bround(s, 1).cast("string"), lit("NA")) for s in _SIDES])})
    # first rows by aggregates: a frequent key costs one row per task
    first = d.groupBy("_k").agg(F.min(F.struct("_o", "_n")).alias("f")).select("_k", c("f._o").alias("_f"), c("f._n").alias("_fn"))
    near = first.groupBy("_fn").agg(F.min("_f").alias("_g"))
    d = d.join(first.select("_k", "_f"), "_k").withColumn("exact", c("_o") != c("_f"))
    return d.join(near, c("_n") == c("_fn"), "left").withColumn("near", ~c("exact") & (c("_o") != c("_g")))


q("D03", f"SELECT row_id, epoch_us(ingested_at) AS at, {_FIRST} > 1 AS exact_duplicate FROM togieeum_polygon_pois")(lambda t: _stages(t).select("row_id", at_(), c("exact").alias("exact_duplicate")))
q("D04", f"WITH one AS (SELECT * FROM togieeum_polygon_pois QUALIFY {_FIRST} = 1) SELECT row_id FROM one QUALIFY row_number() OVER (PARTITION BY {_NEARKEY} ORDER BY row_id, ingested_at) > 1")(lambda t: _stages(t).where("near").select("row_id"))
q("D07", f"WITH d AS (SELECT *, {_FIRST} > 1 AS exact FROM togieeum_polygon_pois), n AS (SELECT row_id, ingested_at, row_number() OVER (PARTITION BY {_NEARKEY} ORDER BY row_id, ingested_at) > 1 AS near FROM d WHERE NOT exact), k AS (SELECT d.* FROM d JOIN n USING (row_id, ingested_at) WHERE NOT exact AND NOT near), i AS (SELECT DISTINCT a.row_id FROM k a JOIN k b ON a.major_category = b.major_category AND a.semantic_type_key = b.semantic_type_key AND a.row_id <> b.row_id AND {_IN} AND b.area_m2 > a.area_m2 + 1e-6) SELECT count(*) AS rows, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact AND near) AS near, count(*) FILTER (NOT exact AND NOT near AND i.row_id IS NOT NULL) AS nested, count(*) FILTER (NOT exact AND NOT near AND i.row_id IS NULL) AS kept FROM d LEFT JOIN n USING (row_id, ingested_at) LEFT JOIN i ON i.row_id = d.row_id")(lambda t: _chain(t))


def _chain(t: Tables) -> DataFrame:
    """Exact, then near, then nested removal; what no stage flags is kept."""
    s = planar.durable(_stages(t).select("row_id", "major_category", "semantic_type_key", "xmin", "ymin", "xmax", "ymax", c("area_m2").alias("area"), "exact", "near"))
    left = s.where("NOT exact AND NOT near").where("xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL AND area IS NOT NULL")
    inside = planar.contained_boxes(left, "row_id", ["major_category", "semantic_type_key"], 200.0).withColumn("nested", lit(True))
    j = s.join(inside, "row_id", "left")
    nested, sound = c("nested").isNotNull(), ~c("exact") & ~c("near")
    return j.agg(F.count(lit(1)).alias("rows"), F.count_if("exact").alias("exact"), F.count_if("near").alias("near"), F.count_if(sound & nested).alias("nested"), F.count_if(sound & ~nested).alias("kept"))


_OK = f"({_REASON} IS NULL)"
_ACC = f"v AS (SELECT *, coalesce(nullif(event_id % 9000, 0), event_id) * 100000 + event_id AS rank, {_OK} AS ok FROM {_EV}), f AS (SELECT pano, min(rank) AS e FROM v WHERE ok GROUP BY 1), r AS (SELECT pano AS held, e, row_number() OVER (ORDER BY e) AS n FROM f)"
q("D05", f"WITH {_ACC} SELECT event_id, CAST(CASE WHEN rank = e AND ok AND n <= 60 THEN n END AS DOUBLE) AS accepted_rank, CASE WHEN NOT ok THEN {_REASON} WHEN rank = e AND n <= 60 THEN NULL WHEN n <= 60 THEN 'duplicate_pano_id' ELSE 'target_already_met' END AS reason FROM v LEFT JOIN r ON v.pano = r.held")(lambda t: _accepted(t).select("event_id", c("accepted_rank").cast("double").alias("accepted_rank"), "reason"))


def _accepted(t: Tables, target: int = 60) -> DataFrame:
    """Acceptance in order of the rank (the event's own if it is 0), the first valid row of each panorama, up to the target, with the reason of every other row."""
    v = _events(t).withColumn("stateless", text.first_reason(*_rules()))
    rank = F.coalesce(F.nullif(c("event_id") % 9000, lit(0)), c("event_id")) * 100000 + c("event_id")
    out = relational.accept_first(v, "pano", rank, c("stateless").isNull(), target)
    used = out.where("accepted").select(c("pano").alias("_used"))  # at most target rows
    out = out.join(F.broadcast(used), c("pano") == c("_used"), "left")
    reason = F.when(c("stateless").isNotNull(), c("stateless")).when(c("accepted"), lit(None)).when(c("_used").isNotNull(), "duplicate_pano_id").otherwise("target_already_met")
    return out.withColumn("reason", reason)


q("D10", f"WITH {_ACC}, a AS (SELECT v.event_id, v.pano, n FROM v JOIN r ON v.pano = r.held AND v.rank = r.e AND ok WHERE n <= 60) SELECT row_number() OVER (ORDER BY n) AS final_rank, pano FROM a WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (ORDER BY n) <= 25")(lambda t: _manifest(t))


def _manifest(t: Tables) -> DataFrame:
    """Accepted rows with a successful image, in order, the first 25 renumbered."""
    done = t.events.where("event_id % 3 != 0").select("event_id")
    a = _accepted(t).where("accepted").join(done, "event_id").orderBy("accepted_rank").limit(25)
    return a.select(F.row_number().over(Window.partitionBy().orderBy("accepted_rank")).cast("bigint").alias("final_rank"), "pano")


def _resumed(t: Tables) -> DataFrame:
    """Events arrive in files; two runs of batches, the second after more files came, upsert them by user and type."""
    base = f"{shared_dir(t.spark)}/batches-{uuid.uuid4().hex}"
    schema = "user_id bigint, event_type string, event_id bigint, value double"
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("l")).select("user_id", "event_type", "l.*")
    for late in (0, 1):
        last.where(c("user_id") % 2 == late).coalesce(2).write.mode("append").parquet(f"{base}/in")
        upserts.run_batches(t.spark, f"{base}/in", schema, f"{base}/table", f"{base}/progress", ["user_id", "event_type"])
    return t.spark.read.parquet(f"{base}/table").select("user_id", "event_type", "event_id")


q("D09", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")(_resumed)
q("D01", f"WITH RECURSIVE p AS (SELECT id, x, y, row_number() OVER (ORDER BY sha256('3|' || id), id) AS r FROM {PTS}), g AS (SELECT 0::BIGINT AS r, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, NULL::BIGINT AS id UNION ALL SELECT p.r, CASE WHEN len(list_filter(kept, lambda k: pow(k.x - p.x, 2) + pow(k.y - p.y, 2) < 22500)) = 0 THEN list_append(kept, {{'x': p.x, 'y': p.y}}) ELSE kept END, CASE WHEN len(list_filter(kept, lambda k: pow(k.x - p.x, 2) + pow(k.y - p.y, 2) < 22500)) = 0 THEN p.id END FROM g JOIN p ON p.r = g.r + 1) SELECT id FROM g WHERE id IS NOT NULL")(
    lambda t: planar.thin(t.pts.withColumn("p", F.sha2(F.concat(lit("3|"), c("id").cast("string")), 256)), "id", "p", 150.0).select("id")
)
# ---- geometry that needs another engine's formula --------------------------------------------------------------------
_E, _N = geo.sql_5186("lon", "lat")
q("G13", f"SELECT id, round({_E}, 3) AS e, round({_N}, 3) AS n FROM (SELECT id, 126 + x / 5000 AS lon, 34 + y / 2500 AS lat FROM {PTS})")(lambda t: geo.with_5186(t.pts.select("id", (126 + c("x") / 5000).alias("lon"), (34 + c("y") / 2500).alias("lat")), "lon", "lat", "e", "n").select("id", F.round("e", 3).alias("e"), F.round("n", 3).alias("n")))
q("G14", f"SELECT id, NOT (xmax < 4000 OR xmin > 4500 OR ymax < 4000 OR ymin > 4500) AS intersects, xmin BETWEEN 4000 AND 4500 AND xmax BETWEEN 4000 AND 4500 AND ymin BETWEEN 4000 AND 4500 AND ymax BETWEEN 4000 AND 4500 AS within, xmin <= 4000 AND xmax >= 4500 AND ymin <= 4000 AND ymax >= 4500 AS contains FROM {BOX}")(lambda t: _related(t))


def _related(t: Tables) -> DataFrame:
    """Predicates by the corners of one ring in the other and by bounds."""
    ring = planar.rectangle(c("xmin"), c("ymin"), c("xmax"), c("ymax"))
    b = planar.bounds(ring)
    held = F.forall(ring, lambda p: p["x"].between(4000, 4500) & p["y"].between(4000, 4500))
    meets = (b["xmax"] >= 4000) & (b["xmin"] <= 4500) & (b["ymax"] >= 4000) & (b["ymin"] <= 4500)
    covers = (b["xmin"] <= 4000) & (b["xmax"] >= 4500) & (b["ymin"] <= 4000) & (b["ymax"] >= 4500)
    return t.box.select("id", meets.alias("intersects"), held.alias("within"), covers.alias("contains"))


q("G18", f"SELECT kind, min(x0) - 10 AS xmin, min(y0) - 10 AS ymin, max(x1) + 10 AS xmax, max(y1) + 10 AS ymax FROM {LINE} GROUP BY 1")(
    lambda t: t.line.groupBy("kind").agg((F.min("x0") - 10).alias("xmin"), (F.min(F.least("y0", "y1")) - 10).alias("ymin"), (F.max("x1") + 10).alias("xmax"), (F.max(F.greatest("y0", "y1")) + 10).alias("ymax"))
)
_WIN = {"left": (0.05, 0.35), "front": (0.25, 0.55), "right": (0.45, 0.75), "rear": (0.65, 0.95)}
q("G28", "SELECT p_partkey, v AS view, CAST(round_even(lo * w, 0) AS INTEGER) AS px0, CAST(round_even(hi * w, 0) AS INTEGER) AS px1, CAST(round_even(0.3::DOUBLE * h, 0) AS INTEGER) AS py0, CAST(round_even(0.9::DOUBLE * h, 0) AS INTEGER) AS py1 FROM (SELECT p_partkey, 1000 + p_size * 10 AS w, 500 + p_size * 5 AS h FROM part), (SELECT unnest(['left', 'front', 'right', 'rear']) AS v, unnest([0.05::DOUBLE, 0.25, 0.45, 0.65]) AS lo, unnest([0.35::DOUBLE, 0.55, 0.75, 0.95]) AS hi)")(lambda t: _windows(t))


def _windows(t: Tables) -> DataFrame:
    """Pixel boxes of the views in panoramas of differing sizes."""
    views = F.explode(F.array(*[F.struct(lit(v).alias("view"), lit(a).alias("lo"), lit(b).alias("hi")) for v, (a, b) in _WIN.items()]))
    d = t.part.select("p_partkey", (1000 + c("p_size") * 10).alias("w"), (500 + c("p_size") * 5).alias("h"), views.alias("v")).select("p_partkey", "w", "h", "v.*")
    px = lambda share, size, name: F.bround(share * c(size), 0).cast("int").alias(name)
    return d.select("p_partkey", "view", px(c("lo"), "w", "px0"), px(c("hi"), "w", "px1"), px(lit(0.3), "h", "py0"), px(lit(0.9), "h", "py1"))


q("G27", f"SELECT id, round((xmin - x0) / (x1 - x0), 6) AS u, round((ymax - y0) / (y1 - y0), 6) AS v FROM {BOX}, (SELECT min(xmin) AS x0, max(xmax) AS x1, min(ymin) AS y0, max(ymax) AS y1 FROM {BOX})")(lambda t: _unit(t))


def _unit(t: Tables) -> DataFrame:
    b = t.box.join(F.broadcast(t.box.agg(F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1"))))
    u, _ = affine(c("xmin"), c("ymin"), [c(x) for x in ("x0", "y0", "x1", "y1")])
    _, v = affine(c("xmin"), c("ymax"), [c(x) for x in ("x0", "y0", "x1", "y1")])
    return b.select("id", r6(u, "u"), r6(v, "v"))
