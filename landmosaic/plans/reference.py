"""Relational queries over the base tables, and the views that all inventory queries share.

Points, boxes and lines are derived from the keys of customer, part and
orders, so that both engines compute the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmosaic.functions import geo, text
from landmosaic.operators import planar, relational
from landmosaic.runtime import ranked, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def at_() -> Column:
    """Time stamps as whole numbers, which both engines print alike."""
    return F.expr("unix_micros(ingested_at) AS at")


class Tables:
    """The tables of a directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def pts(self) -> DataFrame:
        return self.customer.select(c("c_custkey").alias("id"), ((c("c_custkey") * 37) % 10000).cast("double").alias("x"), ((c("c_custkey") * 91) % 10000).cast("double").alias("y"), c("c_mktsegment").alias("kind"))

    @property
    def box(self) -> DataFrame:
        x, y = (c("p_partkey") * 53) % 9000, (c("p_partkey") * 97) % 9000
        w, h = c("p_size"), 1 + c("p_partkey") % 40
        d = lambda e, n: e.cast("double").alias(n)
        return self.part.select(c("p_partkey").alias("id"), c("p_brand").alias("kind"), d(x, "xmin"), d(y, "ymin"), d(x + w, "xmax"), d(y + h, "ymax"), d(w * h, "area"))

    @property
    def line(self) -> DataFrame:
        k = c("o_orderkey")
        return self.orders.select(k.alias("id"), c("o_orderpriority").alias("kind"), ((k * 13) % 5000).cast("double").alias("x0"), ((k * 7) % 5000).cast("double").alias("y0"), ((k * 13) % 5000 + k % 90).cast("double").alias("x1"), ((k * 7) % 5000).cast("double").alias("y1"))

    @property
    def grid(self) -> DataFrame:
        return planar.square_grid(self.spark, (0.0, 0.0, 9999.0, 9999.0), 500.0, 500.0)


PTS = "(SELECT c_custkey AS id, CAST((c_custkey*37)%10000 AS DOUBLE) AS x, CAST((c_custkey*91)%10000 AS DOUBLE) AS y, c_mktsegment AS kind FROM customer)"
BOX = "(SELECT p_partkey AS id, p_brand AS kind, CAST((p_partkey*53)%9000 AS DOUBLE) AS xmin, CAST((p_partkey*97)%9000 AS DOUBLE) AS ymin, CAST((p_partkey*53)%9000+p_size AS DOUBLE) AS xmax, CAST((p_partkey*97)%9000+1+p_partkey%40 AS DOUBLE) AS ymax, CAST(p_size*(1+p_partkey%40) AS DOUBLE) AS area FROM part)"
LINE = "(SELECT o_orderkey AS id, o_orderpriority AS kind, CAST((o_orderkey*13)%5000 AS DOUBLE) AS x0, CAST((o_orderkey*7)%5000 AS DOUBLE) AS y0, CAST((o_orderkey*13)%5000+o_orderkey%90 AS DOUBLE) AS x1, CAST((o_orderkey*7)%5000 AS DOUBLE) AS y1 FROM orders)"
GRID = "(SELECT gy*21+gx+1 AS cell_id, CAST(gx*500 AS DOUBLE) AS xmin, CAST(gy*500 AS DOUBLE) AS ymin, CAST(gx*500+500 AS DOUBLE) AS xmax, CAST(gy*500+500 AS DOUBLE) AS ymax FROM range(21) a(gx), range(21) b(gy))"


def q(name: str, sql: str | None = None) -> Callable:
    """Register a query under the operator's id."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def n_(e: Column | str = "*") -> Column:
    return F.count(lit(1)).alias("n") if e == "*" else F.count(e).alias("n")


def r6(e: Column, name: str) -> Column:
    return F.round(e, 6).alias(name)


# ---- scans and sinks -------------------------------------------------------------------------------------------------
q("S01", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")(lambda t: t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity"))
q("S02", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")(
    lambda t: t.orders.join(t.customer.where("c_acctbal > 9000").select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")
)
q("S07", "SELECT p_partkey, p_name FROM part WHERE p_type IS NOT NULL ORDER BY p_partkey LIMIT 50")(lambda t: t.part.where("p_type IS NOT NULL").orderBy("p_partkey").limit(50).select("p_partkey", "p_name"))
# ---- projections and predicates --------------------------------------------------------------------------------------
q("P01", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")(lambda t: t.customer.select("c_mktsegment", *[x for x in t.customer.columns if x != "c_mktsegment"]))
q("P02", "SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")(lambda t: t.nation.toDF(*[x.lower().removeprefix("n_") for x in t.nation.columns]))
q("P03", "SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region")(lambda t: t.region.withColumn("note", lit(None).cast("string")))
q("P04", "SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END, 9) AS rank FROM orders")(
    lambda t: t.orders.join(F.broadcast(t.spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2)], "o_orderpriority string, r int")), "o_orderpriority", "left").select("o_orderkey", F.coalesce("r", lit(9)).alias("rank"))
)
q("P05", "SELECT event_type, lower(event_type) IN ('click','view') AS ok FROM (SELECT DISTINCT event_type FROM events)")(lambda t: t.events.select("event_type").distinct().select("event_type", F.coalesce(F.lower("event_type").isin("click", "view"), lit(False)).alias("ok")))
q("P06", "SELECT id FROM " + LINE + " WHERE kind IN ('1-URGENT','2-HIGH','5-LOW') AND kind NOT IN ('5-LOW')")(lambda t: t.line.where(c("kind").isin("1-URGENT", "2-HIGH", "5-LOW") & ~c("kind").isin("5-LOW")).select("id"))
q("P07", "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'BUILD') OR regexp_matches(c_name, '7$')")(lambda t: t.customer.where(c("c_mktsegment").startswith("BUILD") | c("c_name").rlike("7$")).select("c_custkey"))
q("P08", "SELECT geo2vec_internal_id FROM scene_entities WHERE geometry_wkt IS NOT NULL AND trim(geometry_wkt) <> ''")(lambda t: t.scene_entities.where("geometry_wkt IS NOT NULL AND trim(geometry_wkt) <> ''").select("geo2vec_internal_id"))
q("P09", "SELECT scene_id FROM scene_grid WHERE coverage_ratio > 0 AND coverage_ratio <= 1 AND NOT isnan(coverage_ratio)")(lambda t: t.scene_grid.where(text.finite("coverage_ratio") & (c("coverage_ratio") > 0) & (c("coverage_ratio") <= 1)).select("scene_id"))


q("P13", "SELECT row_id, epoch_us(ingested_at) AS at, regexp_matches(coalesce(dgm_nm,'NA') || ' ' || coalesce(lclas_cl,'NA'), '(주차장|공원|NA)') AS facility FROM togieeum_polygon_pois")(
    lambda t: t.togieeum_polygon_pois.select("row_id", at_(), text.pasted(" ", "dgm_nm", "lclas_cl").rlike("(주차장|공원|NA)").alias("facility"))
)
q("P14", "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 40")(lambda t: t.events.orderBy(F.desc("value"), "event_id").limit(40).select("event_id"))
q("P16", "SELECT c_custkey, least(5000.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal)) AS bal FROM customer")(lambda t: t.customer.select("c_custkey", text.clamp(c("c_acctbal"), 0.0, 5000.0).alias("bal")))
# ---- joins -----------------------------------------------------------------------------------------------------------
q("J01", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(lambda t: t.customer.join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name"))  # 25 nations at any size
q("J02", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")(
    lambda t: t.orders.where("o_orderstatus = 'F'").join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")
)
q("J04", "SELECT coalesce(a.k, b.k) AS k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT lang AS k, count(*) AS na FROM documents GROUP BY 1) a FULL JOIN (SELECT source AS k, count(*) AS nb FROM documents GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")(
    lambda t: relational.null_safe_join(t.documents.groupBy(c("lang").alias("k")).agg(F.count(lit(1)).alias("na")), t.documents.groupBy(c("source").alias("k")).agg(F.count(lit(1)).alias("nb")), ["k"], "full").fillna(0, ["na", "nb"]).select("k", "na", "nb")
)
q("J05", "SELECT d.row_id, epoch_us(d.ingested_at) AS at, m.sigungu_nm FROM togieeum_polygon_pois d LEFT JOIN bnd_sigungu m ON d.region_sgg_code = m.sigungu_cd")(
    lambda t: t.togieeum_polygon_pois.select("row_id", "ingested_at", "region_sgg_code").join(t.bnd_sigungu.select("sigungu_cd", "sigungu_nm"), c("region_sgg_code") == c("sigungu_cd"), "left").select("row_id", at_(), "sigungu_nm")
)
q("J06", "SELECT s.s_suppkey, coalesce(c.c_acctbal, s.s_acctbal) AS bal FROM supplier s LEFT JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0")(
    lambda t: t.supplier.join(t.customer.where("c_acctbal > 0"), c("s_suppkey") == c("c_custkey"), "left").select("s_suppkey", F.coalesce("c_acctbal", "s_acctbal").alias("bal"))
)
q("J07", "SELECT a.id, a.kind, b.kind AS image_kind FROM " + PTS + " a LEFT JOIN " + BOX + " b ON a.id = b.id")(lambda t: relational.suffixed_join(t.pts.select("id", "kind"), t.box.select("id", "kind"), "id", "image_").select("id", "kind", "image_kind"))
q("J08", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer")(
    lambda t: t.customer.join(t.orders.select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", lit(True).alias("has")).union(t.customer.join(t.orders.select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", lit(False)))
)
q("J09", "SELECT k, side FROM (SELECT p_partkey AS k, 'missing' AS side FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'extra' FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part))")(
    lambda t: relational.id_difference(t.part.select(c("p_partkey").alias("k")), t.supplier.select(c("s_suppkey").alias("k")), "k")
)
q("J10", "SELECT s_suppkey, CAST(r AS BIGINT) AS place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS r FROM part) JOIN supplier ON p_partkey = s_suppkey")(
    lambda t: ranked(t.part.select("p_name", "p_partkey"), ["p_name", "p_partkey"]).join(t.supplier, c("p_partkey") == c("s_suppkey")).select("s_suppkey", c("rank0").alias("place"))
)


def _cells(t: Tables) -> DataFrame:
    p = t.pts.withColumns({"gx": planar.cell("x", 500.0), "gy": planar.cell("y", 500.0)})
    g = t.grid.select("cell_id", planar.cell("xmin", 500.0).alias("gx"), planar.cell("ymin", 500.0).alias("gy"))
    return p.join(g, ["gx", "gy"], "left")


q("J11", f"SELECT id, cell_id FROM {PTS} p LEFT JOIN {GRID} g ON floor(p.x/500) = floor(g.xmin/500) AND floor(p.y/500) = floor(g.ymin/500)")(lambda t: _cells(t).select("id", "cell_id"))


def _overlap_cells(t: Tables) -> DataFrame:
    b = t.box.withColumn("gx", F.explode(F.sequence(planar.cell("xmin", 500.0), planar.cell("xmax", 500.0)))).withColumn("gy", F.explode(F.sequence(planar.cell("ymin", 500.0), planar.cell("ymax", 500.0))))
    return b.select("id", "gx", "gy").join(t.grid.select("cell_id", planar.cell("xmin", 500.0).alias("gx"), planar.cell("ymin", 500.0).alias("gy")), ["gx", "gy"])


q("J17", f"SELECT b.id, g.cell_id FROM {BOX} b JOIN {GRID} g ON b.xmax >= g.xmin AND b.xmin < g.xmax AND b.ymax >= g.ymin AND b.ymin < g.ymax")(lambda t: _overlap_cells(t).select("id", "cell_id"))
q("J21", f"SELECT a.id, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))), 6) AS distance FROM {PTS} a JOIN {PTS} b ON a.id <> b.id GROUP BY 1")(lambda t: planar.nearest_distance(t.pts, "id", 100.0).withColumn("distance", F.round("distance", 6)))


q("J23", "SELECT d.x AS density, e.x AS epochs FROM (VALUES (200),(400),(800)) d(x), (VALUES (1),(5)) e(x)")(lambda t: t.spark.range(1).select(F.explode(F.array(lit(200), lit(400), lit(800))).alias("density")).select("density", F.explode(F.array(lit(1), lit(5))).alias("epochs")))
q("J24", "SELECT c_custkey, c_mktsegment, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(
    lambda t: relational.attach(t.customer.select("c_custkey", "c_mktsegment", c("c_nationkey").alias("n_nationkey")), t.nation, "n_nationkey").select("c_custkey", "c_mktsegment", "n_name", "n_regionkey")
)
# ---- aggregates ------------------------------------------------------------------------------------------------------
q("A01", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")(lambda t: t.documents.groupBy("lang").agg(n_()))
q("A02", "SELECT l_returnflag, round(sum(l_quantity), 6) AS s, round(avg(l_extendedprice), 4) AS m, min(l_tax) AS lo, max(l_tax) AS hi, median(l_quantity) AS med FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(r6(F.sum("l_quantity"), "s"), F.round(F.avg("l_extendedprice"), 4).alias("m"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.median("l_quantity").alias("med"))
)
q("A03", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.05), 6) AS p05, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.95), 6) AS p95 FROM customer GROUP BY 1")(
    lambda t: t.customer.groupBy("c_mktsegment").agg(F.percentile("c_acctbal", F.array(lit(0.05), lit(0.5), lit(0.95))).alias("p")).select("c_mktsegment", r6(c("p")[0], "p05"), r6(c("p")[1], "p50"), r6(c("p")[2], "p95"))
)
q("A04", "SELECT count(DISTINCT building_id) AS n FROM scene_entities")(lambda t: t.scene_entities.agg(F.countDistinct("building_id").alias("n")))
q("A05", "SELECT event_type, count(*) FILTER (value > 10) AS big FROM events GROUP BY 1")(lambda t: t.events.groupBy("event_type").agg(F.count_if(c("value") > 10).alias("big")))
q("A06", "SELECT p_brand, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")(lambda t: t.part.groupBy("p_brand").agg(n_()).select("p_brand", r6(c("n") / F.sum("n").over(Window.partitionBy()), "share")))
q("A07", f"SELECT kind, count(*) AS features, round(sum(x1 - x0), 6) AS length_m, round(sum(x1 - x0) / sum(sum(x1 - x0)) OVER (), 6) AS share FROM {LINE} GROUP BY 1")(
    lambda t: t.line.groupBy("kind").agg(F.count(lit(1)).alias("features"), F.sum(c("x1") - c("x0")).alias("l")).select("kind", "features", r6(c("l"), "length_m"), r6(c("l") / F.sum("l").over(Window.partitionBy()), "share"))
)
q("A08", "WITH g AS (SELECT CASE WHEN grouping(p_brand) = 1 THEN 'all' ELSE p_brand END AS p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_type))) SELECT p_brand, p_type, n, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS share, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS place FROM g")(lambda t: relational.with_total(t.part, "p_brand", "p_type"))
q("A09", "SELECT p_brand, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1")(lambda t: relational.mode_label(t.part, ["p_brand"], "p_type"))
q("A10", "SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM part GROUP BY 1")(lambda t: t.part.groupBy("p_brand").agg(relational.label_list("p_type").alias("types")))
q("A12", "SELECT source_system, count(*) AS n, min(area_m2) AS lo, max(area_m2) AS hi, count(DISTINCT source_shp) AS files FROM togieeum_polygon_pois GROUP BY 1")(
    lambda t: t.togieeum_polygon_pois.groupBy("source_system").agg(n_(), F.min("area_m2").alias("lo"), F.max("area_m2").alias("hi"), F.countDistinct("source_shp").alias("files"))
)
q("A13", "SELECT p_brand, string_agg(t, '; ' ORDER BY r) AS top FROM (SELECT p_brand, p_type || '=' || count(*) AS t, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r <= 3 GROUP BY 1")(lambda t: relational.top_text(t.part, ["p_brand"], "p_type", 3))
q("A14", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1")(lambda t: t.events.groupBy("event_type").agg(n_()).orderBy(F.desc("n"), "event_type"))
q("A15", "SELECT count(building_id) - count(DISTINCT building_id) AS n FROM scene_entities")(lambda t: t.scene_entities.agg((F.count("building_id") - F.countDistinct("building_id")).alias("n")))
q("A16", "SELECT user_id, round(count(*) FILTER (event_type <> 'error') / greatest(1, count(*)), 6) AS rate FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(r6(F.count_if(c("event_type") != "error") / F.greatest(lit(1), F.count(lit(1))), "rate")))
q("A17", "SELECT * FROM (SELECT 'rows' AS metric, count(*) AS value FROM scene_entities UNION ALL SELECT 'null_ids', count(*) FILTER (building_id IS NULL) FROM scene_entities)")(
    lambda t: t.scene_entities.agg(F.count(lit(1)).alias("rows"), F.count_if(c("building_id").isNull()).alias("null_ids")).unpivot([], ["rows", "null_ids"], "metric", "value")
)
q("A18", f"SELECT id, round((least(xmax, 6000) - greatest(xmin, 3000)) * (least(ymax, 6000) - greatest(ymin, 3000)) / area, 6) AS share FROM {BOX} WHERE least(xmax, 6000) > greatest(xmin, 3000) AND least(ymax, 6000) > greatest(ymin, 3000)")(
    lambda t: t.box.withColumns(planar.clip_box("xmin", "ymin", "xmax", "ymax", (3000.0, 3000.0, 6000.0, 6000.0))).where("xmin IS NOT NULL").select("id", r6((c("xmax") - c("xmin")) * (c("ymax") - c("ymin")) / c("area"), "share"))
)
q("A20", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m, round(stddev_samp(c_acctbal), 4) AS sd, count(*) AS n FROM customer GROUP BY 1")(lambda t: t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("m"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), n_()))
q("A19", "SELECT 'mean' AS stat, round(avg(value), 6) AS v FROM events UNION ALL SELECT 'sd', round(stddev_samp(value), 6) FROM events UNION ALL SELECT 'max', max(value) FROM events")(
    lambda t: t.events.agg(r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "sd"), F.max("value").alias("max")).unpivot([], ["mean", "sd", "max"], "stat", "v")
)
q("A21", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(lit(1))).fillna(0).select("l_returnflag", c("F").alias("f"), c("O").alias("o"))
)
q("A22", "SELECT p_partkey, 'size' AS metric, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")(
    lambda t: t.part.select("p_partkey", c("p_size").cast("double").alias("size"), c("p_retailprice").alias("price")).unpivot(["p_partkey"], ["size", "price"], "metric", "v")
)
q("A23", "SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best FROM part GROUP BY 1")(lambda t: t.part.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -c("p_partkey"))).alias("best")))
q("A24", "SELECT min(n) AS lo, median(n) AS med, max(n) AS hi FROM (SELECT geo2vec_internal_id, count(*) AS n FROM sdf_samples GROUP BY 1)")(lambda t: t.sdf_samples.groupBy("geo2vec_internal_id").agg(n_()).agg(F.min("n").alias("lo"), F.median("n").alias("med"), F.max("n").alias("hi")))
q("A25", "SELECT n, count(*) AS cells FROM (SELECT grid_id, count(*) AS n FROM sample_points GROUP BY 1) GROUP BY 1")(lambda t: t.sample_points.groupBy("grid_id").agg(n_()).groupBy("n").agg(F.count(lit(1)).alias("cells")))
q("A26", "SELECT l_returnflag, count(*) AS n, round(1 - sum((l_extendedprice - l_quantity*3000)*(l_extendedprice - l_quantity*3000)) / (var_pop(l_extendedprice)*count(*)), 6) AS r2, round(sqrt(sum((l_extendedprice - l_quantity*3000)*(l_extendedprice - l_quantity*3000))/count(*)), 6) AS rmse, round(avg(abs(l_extendedprice - l_quantity*3000)), 6) AS mae FROM lineitem GROUP BY 1")(
    lambda t: relational.prediction_errors(t.lineitem.withColumn("guess", c("l_quantity") * 3000), ["l_returnflag"], "l_extendedprice", "guess")
)
q("A27", "SELECT CAST(day AS VARCHAR) AS day, n, CAST(n - lag(n) OVER (ORDER BY day) AS DOUBLE) AS gain FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")(lambda t: t.events.groupBy(F.to_date("ts").alias("day")).agg(n_()).select(c("day").cast("string").alias("day"), "n", (c("n") - F.lag("n").over(Window.partitionBy().orderBy("day"))).cast("double").alias("gain")))
q("A28", "WITH s AS (SELECT p_size, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1) SELECT min(p_size) AS size FROM s WHERE score >= 0.99 * (SELECT max(score) FROM s)")(
    lambda t: (lambda s: s.join(F.broadcast(s.agg(F.max("score").alias("top"))), c("score") >= 0.99 * c("top")).agg(F.min("p_size").alias("size")))(t.part.groupBy("p_size").agg(r6(F.avg("p_retailprice"), "score")))
)
q("A29", "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events) WHERE abs(value - m) > 2 * s")(
    lambda t: t.events.join(F.broadcast(t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))), "event_type").where(F.abs(c("value") - c("m")) > 2 * c("s")).select("event_id")
)
# ---- windows, order, sets --------------------------------------------------------------------------------------------
q("W01", "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS internal_id FROM customer")(lambda t: ranked(t.customer.select("c_name", "c_custkey"), ["c_name", "c_custkey"]).select("c_custkey", c("rank0").alias("internal_id")))
q("W02", "SELECT s_suppkey, CAST(CASE WHEN s_acctbal > 0 THEN row_number() OVER (PARTITION BY s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey) END AS DOUBLE) AS place FROM supplier")(
    lambda t: ranked(t.supplier.where("s_acctbal > 0"), [F.desc("s_acctbal"), "s_suppkey"]).select("s_suppkey", (c("rank0") + 1).cast("double").alias("place")).union(t.supplier.where("NOT coalesce(s_acctbal > 0, false)").select("s_suppkey", lit(None).cast("double")))
)
q("W03", "SELECT p_brand, p_type, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS place FROM part GROUP BY 1, 2")(lambda t: t.part.groupBy("p_brand", "p_type").agg(n_()).select("p_brand", "p_type", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("n"))).cast("bigint").alias("place")))
q("W04", "SELECT p_brand, p_type, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY 1, 2")(lambda t: t.part.groupBy("p_brand", "p_type").agg(n_()).select("p_brand", "p_type", r6(c("n") / F.sum("n").over(Window.partitionBy("p_brand")), "share")))
q("W05", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")(lambda t: relational.keep_first(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id"))
q("W06", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS repeated FROM events")(lambda t: relational.with_repeats(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"], "repeated").select("event_id", "repeated"))


def _bins(t: Tables) -> DataFrame:
    r = ranked(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"])
    return r.join(F.broadcast(r.agg(F.count(lit(1)).alias("n")))).select("s_suppkey", F.floor(c("rank0") * 7 / c("n")).cast("bigint").alias("bin"))


q("W07", "SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) * 7 / count(*) OVER ()) AS BIGINT) AS bin FROM supplier")(_bins)
q("W08", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")(lambda t: t.events.select("event_id", r6(c("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), "step")))
q("W09", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")))
q("W11", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")(
    lambda t: t.customer.join(F.broadcast(t.customer.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s")))).select("c_custkey", r6((c("c_acctbal") - c("m")) / c("s"), "z"))
)
q("L03", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")(lambda t: t.orders.orderBy("o_totalprice", "o_orderkey").limit(25).select("o_orderkey"))
q("L04", f"SELECT id FROM {BOX} WHERE xmax - xmin >= 10 ORDER BY area / (xmax - xmin), id LIMIT 25")(lambda t: t.box.where("xmax - xmin >= 10").orderBy(c("area") / (c("xmax") - c("xmin")), "id").limit(25).select("id"))
q("L05", "SELECT c_custkey, row_number() OVER (ORDER BY sha256('7|' || CAST(c_custkey AS VARCHAR))) AS place FROM customer")(lambda t: ranked(t.customer.select("c_custkey", F.sha2(F.concat(lit("7|"), c("c_custkey").cast("string")), 256).alias("h")), ["h", "c_custkey"]).select("c_custkey", (c("rank0") + 1).alias("place")))
q("L06", "SELECT c_custkey FROM customer ORDER BY sha256('9|' || CAST(c_custkey AS VARCHAR)) LIMIT 100")(lambda t: t.customer.orderBy(F.sha2(F.concat(lit("9|"), c("c_custkey").cast("string")), 256)).limit(100).select("c_custkey"))


def _quota(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_brand", F.sha2(F.concat(lit("3|"), c("p_partkey").cast("string")), 256).alias("h"))
    n = p.groupBy("p_brand").agg(n_())
    n = n.withColumn("quota", F.greatest(lit(1), F.floor(c("n") * 200 / F.sum("n").over(Window.partitionBy()))))
    return ranked(p, ["h"], ["p_brand"]).join(F.broadcast(n), "p_brand").where("rank0 < quota").select("p_partkey")


q("L07", "WITH s AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('3|' || CAST(p_partkey AS VARCHAR))) AS r, count(*) OVER (PARTITION BY p_brand) AS n, count(*) OVER () AS total FROM part) SELECT p_partkey FROM s WHERE r <= greatest(1, floor(n * 200 / total))")(_quota)
q("L10", "SELECT kind, arg_max(id, (area, id)) AS largest, arg_min(id, (area, id)) AS smallest FROM " + BOX + " GROUP BY 1")(lambda t: t.box.groupBy("kind").agg(F.max_by("id", F.struct("area", "id")).alias("largest"), F.min_by("id", F.struct("area", "id")).alias("smallest")))
q("U01", "SELECT n_nationkey AS k, n_name AS name, NULL::DOUBLE AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 1.0 FROM region")(lambda t: t.nation.select(c("n_nationkey").alias("k"), c("n_name").alias("name")).unionByName(t.region.select(c("r_regionkey").alias("k"), c("r_name").alias("name"), lit(1.0).alias("extra")), allowMissingColumns=True))
q("U02", "SELECT coalesce(event_type, 'total') AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")(lambda t: t.events.rollup("event_type").agg(n_()).select(F.coalesce("event_type", lit("total")).alias("event_type"), "n"))
q("U03", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")(lambda t: relational.keep_first(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"]))
q("U04", "SELECT DISTINCT region, grid_type FROM scene_grid")(lambda t: t.scene_grid.select("region", "grid_type").distinct())
# ---- order-dependent -------------------------------------------------------------------------------------------------


q("D08", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")(lambda t: relational.latest(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value"))
q("D11", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 LIMIT 30")(lambda t: t.events.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id")).orderBy("event_id").limit(30))
q("D13", "SELECT poi_id, epoch_us(ingested_at) AS at, CASE WHEN addr_street IS NOT NULL THEN 'addr_street' WHEN phone IS NOT NULL THEN 'phone' WHEN name IS NOT NULL THEN 'name' END AS key, coalesce(addr_street, phone, name) AS value FROM korea_pois_point")(
    lambda t: t.korea_pois_point.select("poi_id", "ingested_at", text.first_tag(["addr_street", "phone", "name"]).alias("t")).select("poi_id", at_(), c("t.key").alias("key"), c("t.value").alias("value"))
)
# ---- geometry --------------------------------------------------------------------------------------------------------


q("G03", f"SELECT id, x1 - x0 AS length FROM {LINE}")(lambda t: t.line.select("id", planar.line_length(F.array(F.struct(c("x0").alias("x"), c("y0").alias("y")), F.struct(c("x1").alias("x"), c("y1").alias("y")))).alias("length")))
q("G04", f"SELECT kind, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM {BOX} GROUP BY 1")(lambda t: t.box.groupBy("kind").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")))
q("G09", f"SELECT id, round(4*pi()*area/pow(2*((xmax-xmin)+(ymax-ymin)), 2), 6) AS compactness, round(greatest(xmax-xmin,ymax-ymin)/least(xmax-xmin,ymax-ymin), 6) AS aspect, round(ln(1+area), 6) AS log_area FROM {BOX} WHERE area > 0")(
    lambda t: t.box.where("area > 0").withColumns(planar.shape_metrics(c("area"), 2 * ((c("xmax") - c("xmin")) + (c("ymax") - c("ymin"))), c("xmax") - c("xmin"), c("ymax") - c("ymin"))).select("id", r6(c("compactness"), "compactness"), r6(c("aspect"), "aspect"), r6(c("log_area"), "log_area"))
)


q("G20", f"SELECT id, round(2*6371008.8*atan2(sqrt(h), sqrt(1-h)), 4) AS metres FROM (SELECT id, pow(sin(radians(y/1000)/2), 2) + cos(radians(y/1000))*pow(sin(radians(x/1000)/2), 2) AS h FROM {PTS})")(
    lambda t: t.pts.select("id", F.round(geo.haversine_m(lit(0.0), lit(0.0), c("x") / 1000, c("y") / 1000), 4).alias("metres"))
)
