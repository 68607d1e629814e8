"""Queries over samples, embeddings, regressions, clusters and scenes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.operators import planar, relational, samples, vectors
from landmosaic.plans.reference import BOX, GRID, Tables, _overlap_cells, c, lit, n_, q, r6
from landmosaic.plans.scalar import _UNIT
from landmosaic.plans.scenes import _ENT, entities
from landmosaic.plans.shapes import holed
from landmosaic.runtime import ranked

_VEC = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def vec(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", c("embedding").cast("array<double>").alias("v"))


# ---- samples ---------------------------------------------------------------------------------------------------------
_SIDE = "greatest(xmax - xmin, ymax - ymin)"
q("E01", f"SELECT id AS entity, 8 AS vertices, 8 AS near, 25 AS grid, CAST(0 AS DOUBLE) AS vertex_sdf, round(least(xmax - xmin, ymax - ymin) / {_SIDE} / 4, 5) AS centre FROM {BOX} WHERE id % 5 <> 0")(lambda t: _sampled(t))


def _sampled(t: Tables) -> DataFrame:
    s = samples.sdf_samples(holed(t).where("id % 5 != 0"), "id", "wkt", 4.0, 1, 5)
    is_ = lambda k: c("sample_kind") == k
    a = s.groupBy("entity").agg(*[F.count_if(is_(k)).cast("int").alias(n) for k, n in ((0, "vertices"), (1, "near"), (3, "grid"))], F.max(F.when(is_(0), F.abs("sdf"))).alias("vertex_sdf"), F.max(F.when(is_(3) & (F.abs("x") < 1e-9) & (F.abs("y") < 1e-9), c("sdf"))).alias("centre"))
    return a.select("entity", "vertices", "near", "grid", F.round("vertex_sdf", 6).alias("vertex_sdf"), F.round("centre", 5).alias("centre"))


q("E02", f"SELECT geo2vec_internal_id, sample_index, CAST(CASE WHEN {_UNIT.format(chr(39) + '7|' + chr(39) + ' || geo2vec_internal_id || ' + chr(39) + '|' + chr(39) + ' || sample_index')} < 0.1 THEN 1 ELSE 0 END AS SMALLINT) AS bit FROM sdf_samples")(
    lambda t: t.sdf_samples.select("geo2vec_internal_id", "sample_index", samples.validation_bit("7", 0.1, "geo2vec_internal_id", "sample_index").alias("bit"))
)
_BND = f"(SELECT min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1 FROM {BOX})"
q("E03", f"SELECT id, round((xmin - x0) / (x1 - x0), 6) AS u, round((ymin - y0) / (y1 - y0), 6) AS v, round((xmin - floor(xmin / 500) * 500) / 500, 6) AS su, round(-((xmax - xmin) / (x1 - x0)) / 2 / greatest((xmax - xmin) / (x1 - x0), (ymax - ymin) / (y1 - y0)), 6) AS shape_u FROM {BOX}, {_BND}")(lambda t: _normalised(t))


def _normalised(t: Tables) -> DataFrame:
    """The lower left corner by the bounds of the table, of the scene, and of the shape itself."""
    bounds = t.box.agg(F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1"))
    b = t.box.join(F.broadcast(bounds))
    whole = [c(x) for x in ("x0", "y0", "x1", "y1")]
    gx, gy = planar.cell("xmin", 500.0) * 500, planar.cell("ymin", 500.0) * 500
    u, v = samples.affine(c("xmin"), c("ymin"), whole)
    su, _ = samples.affine(c("xmin"), c("ymin"), [gx, gy, gx + 500, gy + 500])
    shape, _ = samples.affine(c("xmin"), c("ymin"), whole, [c("xmin"), c("ymin"), c("xmax"), c("ymax")])
    return b.select("id", r6(u, "u"), r6(v, "v"), r6(su, "su"), r6(shape, "shape_u"))


q("E04", "SELECT CAST(geo2vec_internal_id // 200 AS BIGINT) AS shard, count(*) AS rows, count(DISTINCT geo2vec_internal_id) AS entities FROM sdf_samples GROUP BY 1")(lambda t: t.sdf_samples.groupBy(F.floor(c("geo2vec_internal_id") / 200).alias("shard")).agg(F.count(lit(1)).alias("rows"), F.countDistinct("geo2vec_internal_id").alias("entities")))
_IDS = "(SELECT building_id, row_number() OVER (ORDER BY building_id) - 1 AS internal_id FROM (SELECT DISTINCT building_id FROM scene_entities WHERE building_id IS NOT NULL))"
q("E05", f"SELECT building_id, internal_id FROM {_IDS}")(lambda t: ranked(t.scene_entities.where("building_id IS NOT NULL").select("building_id").distinct(), ["building_id"]).select("building_id", c("rank0").alias("internal_id")))
q("E06", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS geo2vec_000, round(CAST(embedding[2] AS DOUBLE), 5) AS geo2vec_001, round(CAST(embedding[3] AS DOUBLE), 5) AS geo2vec_002 FROM embeddings WHERE label % 2 = 0")(
    lambda t: vec(t).where("label % 2 = 0").select("vec_id", *[F.round(c("v")[i].cast("double"), 5).alias(f"geo2vec_{i:03d}") for i in range(3)])
)
q("E07", f"SELECT a.vec_id, CAST(len(list_concat(a.v, b.v)) AS INTEGER) AS dim, round(list_concat(a.v, b.v)[len(a.v) + 1], 5) AS first_of_shape FROM {_VEC} a JOIN {_VEC} b ON b.vec_id = a.vec_id + 1")(
    lambda t: vec(t).join(vec(t).select((c("vec_id") - 1).alias("vec_id"), c("v").alias("shape")), "vec_id").withColumn("full", F.concat("v", "shape")).select("vec_id", F.size("full").alias("dim"), F.round(F.element_at("full", F.size("v") + 1), 5).alias("first_of_shape"))
)
# ---- regressions -----------------------------------------------------------------------------------------------------
_LINE = "(SELECT l_orderkey, l_quantity AS x, l_extendedprice AS y, CAST(l_orderkey % 5 AS INTEGER) AS fold FROM lineitem)"


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", c("l_quantity").alias("x"), c("l_extendedprice").alias("y"), (c("l_orderkey") % 5).cast("int").alias("fold"))


_OLS = f"(SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM {_LINE} WHERE fold <> 4)"
_R2 = "round(1 - sum((y - {0}) * (y - {0})) / sum((y - my) * (y - my)), 6)"
q("E11", f"WITH t AS (SELECT * FROM {_LINE} WHERE fold = 4), s AS (SELECT *, (SELECT avg(y) FROM t) AS my FROM t, {_OLS}) SELECT 'mean' AS model, {_R2.format('m')} AS r2 FROM s UNION ALL SELECT 'ols', {_R2.format('(a + b * x)')} FROM s")(lambda t: _models(t))


def _models(t: Tables) -> DataFrame:
    """The mean and least squares, fitted by sums on four folds and measured on the fifth."""
    d = _lines(t)
    w = vectors.solve_gram(np.array(vectors.gram(d.where("fold != 4"), [], ["x"], "y").first()["g"]))
    test = d.where("fold = 4")
    mean = d.where("fold != 4").agg(F.avg("y").alias("m"))
    both = test.join(F.broadcast(mean)).select("y", F.explode(F.array(F.struct(lit("mean").alias("model"), c("m").alias("guess")), F.struct(lit("ols").alias("model"), (lit(float(w[0])) + lit(float(w[1])) * c("x")).alias("guess")))).alias("p")).select("y", "p.*")
    return relational.prediction_errors(both, ["model"], "y", "guess").select("model", "r2")


_CV = f"(SELECT d.y, a + b * d.x AS guess, d.fold FROM {_LINE} d JOIN (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT unnest([0,1,2,3,4]) AS fold) f JOIN {_LINE} l ON l.fold <> f.fold GROUP BY 1) m ON m.fold = d.fold)"
q("E12", f"SELECT 'pooled' AS fold, round(1 - sum((y - guess) * (y - guess)) / (var_pop(y) * count(*)), 6) AS r2 FROM {_CV} UNION ALL SELECT CAST(fold AS VARCHAR), round(1 - sum((y - guess) * (y - guess)) / (var_pop(y) * count(*)), 6) FROM {_CV} GROUP BY fold")(lambda t: _folds(t))


def _folds(t: Tables) -> DataFrame:
    """Errors of all folds pooled, and of each."""
    p = vectors.cross_validated(_lines(t), "fold", ["x"], "y").withColumn("name", F.explode(F.array(lit("pooled"), c("fold").cast("string"))))
    return relational.prediction_errors(p, ["name"], "y", "guess").select(c("name").alias("fold"), "r2")


def _boosted(t: Tables) -> DataFrame:
    """Boosted trees that stop early on a tenth held out by hash; metrics on the last fold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(_lines(t)).withColumn("held", samples.validation_bit("5", 0.1, "l_orderkey") == 1)
    model = GBTRegressor(labelCol="y", maxIter=20, maxDepth=3, seed=5, validationIndicatorCol="held").fit(d.where("fold != 4"))
    return relational.prediction_errors(model.transform(d.where("fold = 4")).withColumnRenamed("prediction", "guess"), [], "y", "guess")


q("E13")(_boosted)


def _axes(t: Tables) -> DataFrame:
    """The first two principal axes: their shares of the spread and, for comparison, the spread itself."""
    _, _, share = vectors.principal_axes(vec(t), "v", 2)
    total = vectors.sums(vec(t), [], "v").select(F.aggregate(F.zip_with("s", "ss", lambda s, x: (x - s * s / c("n")) / (c("n") - 1)), lit(0.0), lambda a, x: a + x).alias("v"))
    return total.select(F.round("v", 4).alias("variance"), lit(bool(1 >= share[0] >= share[1] > 0)).alias("ordered"))


q("E14", f"SELECT round(sum(v), 4) AS variance, true AS ordered FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM {_VEC}) GROUP BY i)")(_axes)
# ---- nearest vectors and clusters ------------------------------------------------------------------------------------
_STD = f"(SELECT vec_id, label, list(z ORDER BY i) AS v FROM (SELECT vec_id, label, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM {_VEC})) GROUP BY 1, 2)"
_NN = f"(SELECT a.vec_id, b.vec_id AS other, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS place FROM {_STD} a, {_STD} b)"
q("J20", f"SELECT vec_id, other, CAST(place AS INTEGER) AS place, round(distance, 4) AS distance FROM {_NN} WHERE place <= 6")(lambda t: _knn(t).select("vec_id", "other", "place", F.round("distance", 4).alias("distance")))


def _knn(t: Tables) -> DataFrame:
    v = vectors.standardized(vec(t), "v")
    return vectors.nearest_in_blocks(v, v, "vec_id", "v", 6)


q("E16", f"SELECT vec_id, count(*) FILTER (la = lb) AS same_label, round(avg(distance), 4) AS mean_distance FROM {_NN} WHERE place BETWEEN 2 AND 6 GROUP BY 1")(lambda t: _retrieved(t))


def _retrieved(t: Tables) -> DataFrame:
    """How many of a vector's five nearest share its label."""
    label = lambda k, n: t.embeddings.select(c("vec_id").alias(k), c("label").alias(n))
    j = _knn(t).where("place > 1").join(label("vec_id", "la"), "vec_id").join(label("other", "lb"), "other")
    return j.groupBy("vec_id").agg(F.count_if(c("la") == c("lb")).alias("same_label"), F.round(F.avg("distance"), 4).alias("mean_distance"))


_FLAT = f"(SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM {_VEC})"
_MEAN = f"(SELECT label, i, avg(x) AS m FROM {_FLAT} GROUP BY 1, 2)"
q("E17", f"WITH w AS (SELECT sum((x - m) * (x - m)) AS within FROM {_FLAT} JOIN {_MEAN} USING (label, i)), t AS (SELECT sum(v) AS total FROM (SELECT var_pop(x) * count(*) AS v FROM {_FLAT} GROUP BY i)) SELECT round(within, 3) AS within, round(total - within, 3) AS between, round((total - within) / total, 6) AS ratio FROM w, t")(lambda t: _spread(t))


def _spread(t: Tables) -> DataFrame:
    """Sums of squares within and between given clusters."""
    w = vectors.cluster_spread(vec(t), "label", "v").agg(F.sum("within").alias("within"))
    a = vectors.cluster_spread(vec(t).withColumn("one", lit(1)), "one", "v").select(c("within").alias("total"))
    return w.join(F.broadcast(a)).select(F.round("within", 3).alias("within"), F.round(c("total") - c("within"), 3).alias("between"), r6((c("total") - c("within")) / c("total"), "ratio"))


def _kmeans(t: Tables) -> DataFrame:
    """k-means for several k: sums of squares within and between, by the JVM's implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = vec(t).select("vec_id", "v", array_to_vector("v").alias("features")).cache()
    out = None
    for k in (5, 10, 15, 20):
        p = KMeans(k=k, seed=7).fit(d).transform(d)
        s = vectors.cluster_spread(p, "prediction", "v").agg(lit(k).alias("k"), F.count(lit(1)).alias("clusters"), F.round(F.sum("within"), 3).alias("within"))
        out = s if out is None else out.union(s)
    return out


q("E17_kmeans")(_kmeans)
q("E18", f"WITH d AS (SELECT vec_id, label, sum((x - m) * (x - m)) AS d FROM {_FLAT} JOIN {_MEAN} USING (label, i) GROUP BY 1, 2) SELECT label, count(*) AS n, arg_min(vec_id, (round(d, 9), vec_id)) AS representative, round(avg(d), 4) AS spread FROM d GROUP BY 1")(lambda t: _clusters(t))


def _to_centre(t: Tables) -> DataFrame:
    m = vectors.mean_vectors(vec(t), ["label"], "v").select("label", c("v").alias("m"))
    d = F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), lit(0.0), lambda s, x: s + x)
    return vec(t).join(F.broadcast(m), "label").select("vec_id", "label", d.alias("d"))


def _clusters(t: Tables) -> DataFrame:
    """Size, nearest member to the centre and mean squared distance of each cluster."""
    return _to_centre(t).groupBy("label").agg(n_(), F.min_by("vec_id", F.struct(F.round("d", 9), c("vec_id"))).alias("representative"), F.round(F.avg("d"), 4).alias("spread"))


q("L09", f"SELECT label, vec_id FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(sum((x - m) * (x - m)), 9), vec_id) AS r FROM {_FLAT} JOIN {_MEAN} USING (label, i) GROUP BY 1, 2) WHERE r <= 3")(
    lambda t: _to_centre(t).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.round("d", 9), "vec_id"))).where("r <= 3").select("label", "vec_id")
)
_PAIR = f"(SELECT a.vec_id, a.label, b.label AS lb, sum(pow(list_distance(a.v, b.v), 2)) AS s, count(*) AS n FROM {_VEC} a JOIN {_VEC} b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3)"
q("E19", f"SELECT vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 4) AS silhouette FROM (SELECT vec_id, max(s / n) FILTER (label = lb) AS a, min(s / n) FILTER (label <> lb) AS b FROM {_PAIR} GROUP BY 1)")(lambda t: vectors.silhouettes(vec(t), "vec_id", "label", "v").select("vec_id", F.round("silhouette", 4).alias("silhouette")))
# ---- tables of training runs and verdicts ----------------------------------------------------------------------------
q("E21", "SELECT event_type, user_id % 4 AS shard, count(*) AS rows, round(arg_max(value, (ts, event_id)), 6) AS last_value, round(count(*) / greatest(1, date_diff('second', min(ts), max(ts))), 8) AS per_second FROM events GROUP BY 1, 2")(
    lambda t: t.events.groupBy("event_type", (c("user_id") % 4).alias("shard")).agg(F.count(lit(1)).alias("rows"), r6(F.max_by("value", F.struct("ts", "event_id")), "last_value"), F.round(F.count(lit(1)) / F.greatest(lit(1), F.expr("timestampdiff(SECOND, min(ts), max(ts))")), 8).alias("per_second"))
)
q("E22", "SELECT user_id, CASE WHEN m >= 15 AND lo < 1 THEN 'strong' WHEN m >= 10 THEN 'moderate' ELSE 'weak' END AS verdict FROM (SELECT user_id, avg(value) AS m, min(value) AS lo FROM events GROUP BY 1)")(
    lambda t: t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.min("value").alias("lo")).select("user_id", F.when((c("m") >= 15) & (c("lo") < 1), "strong").when(c("m") >= 10, "moderate").otherwise("weak").alias("verdict"))
)
_EPOCH = "(SELECT p_brand AS run, p_size AS epoch, round(avg(p_retailprice) / 2000, 6) AS score FROM part GROUP BY 1, 2)"
q("E24", f"WITH e AS (SELECT *, max(score) OVER (PARTITION BY run) AS top, score - lag(score) OVER (PARTITION BY run ORDER BY epoch) AS gain, max(epoch) OVER (PARTITION BY run) AS last FROM {_EPOCH}), g AS (SELECT run, coalesce(max(gain) FILTER (epoch = last), 1) < 0.005 AS flat FROM e GROUP BY 1) SELECT e.run, CASE WHEN flat THEN min(epoch) FILTER (score >= top - 0.005) ELSE min(epoch) FILTER (score = top) END AS epoch FROM e JOIN g USING (run) GROUP BY e.run, flat")(lambda t: _epoch(t))


def _epoch(t: Tables) -> DataFrame:
    """The best epoch of a run, or, where the last one gained next to nothing, the first that is close to the best."""
    e = t.part.groupBy(c("p_brand").alias("run"), c("p_size").alias("epoch")).agg(r6(F.avg("p_retailprice") / 2000, "score"))
    w = Window.partitionBy("run")
    e = e.withColumns({"top": F.max("score").over(w), "gain": c("score") - F.lag("score").over(w.orderBy("epoch")), "last": F.max("epoch").over(w)})
    g = e.groupBy("run").agg(F.coalesce(F.max(F.when(c("epoch") == c("last"), c("gain"))), lit(1.0)).alias("g"), F.min(F.when(c("score") >= c("top") - 0.005, c("epoch"))).alias("near"), F.min(F.when(c("score") == c("top"), c("epoch"))).alias("best"))
    return g.select("run", F.when(c("g") < 0.005, c("near")).otherwise(c("best")).alias("epoch"))


# ---- sampling before modelling ---------------------------------------------------------------------------------------
q("L08", "WITH s AS (SELECT c_custkey, c_custkey % 5 = 0 AS test, row_number() OVER (PARTITION BY c_custkey % 5 = 0 ORDER BY sha256('11|' || c_custkey)) AS r FROM customer) SELECT c_custkey, test FROM s WHERE r <= CASE WHEN test THEN 100 ELSE 400 END")(
    lambda t: ranked(t.customer.select("c_custkey", (c("c_custkey") % 5 == 0).alias("test"), F.sha2(F.concat(lit("11|"), c("c_custkey").cast("string")), 256).alias("h")), ["h", "c_custkey"], ["test"]).where(c("rank0") < F.when(c("test"), 100).otherwise(400)).select("c_custkey", "test")
)
# ---- scenes ----------------------------------------------------------------------------------------------------------
_MEMBER = f"(SELECT b.id, b.kind, b.area, g.cell_id FROM {BOX} b JOIN {GRID} g ON b.xmax >= g.xmin AND b.xmin < g.xmax AND b.ymax >= g.ymin AND b.ymin < g.ymax)"
q("V01", f"SELECT cell_id, 'box' AS layer, id FROM {_MEMBER} UNION ALL SELECT cell_id, 'point', p.id FROM {GRID} g JOIN (SELECT c_custkey AS id, CAST((c_custkey*37)%10000 AS DOUBLE) AS x, CAST((c_custkey*91)%10000 AS DOUBLE) AS y FROM customer) p ON floor(p.x/500) = floor(g.xmin/500) AND floor(p.y/500) = floor(g.ymin/500)")(lambda t: _members(t))


def _cell_of(x: Column | str, y: Column | str, t: Tables, d: DataFrame) -> DataFrame:
    g = t.grid.select("cell_id", planar.cell("xmin", 500.0).alias("gx"), planar.cell("ymin", 500.0).alias("gy"))
    return d.withColumns({"gx": planar.cell(x, 500.0), "gy": planar.cell(y, 500.0)}).join(g, ["gx", "gy"])


def _members(t: Tables) -> DataFrame:
    """Objects of several layers in each scene."""
    boxes = _overlap_cells(t).select("cell_id", lit("box").alias("layer"), "id")
    return boxes.union(_cell_of("x", "y", t, t.pts).select("cell_id", lit("point").alias("layer"), "id"))


q("V02", f"SELECT a.cell_id, a.id AS a, b.id AS b, CASE WHEN a.kind = b.kind THEN 'same_class' ELSE 'near' END AS relation FROM {_MEMBER} a JOIN {_MEMBER} b ON a.cell_id = b.cell_id AND a.id < b.id JOIN {BOX} p ON p.id = a.id JOIN {BOX} r ON r.id = b.id WHERE sqrt(pow((p.xmin+p.xmax-r.xmin-r.xmax)/2, 2) + pow((p.ymin+p.ymax-r.ymin-r.ymax)/2, 2)) <= 200")(lambda t: _relations(t))


def _relations(t: Tables) -> DataFrame:
    """Pairs of a scene's objects whose centres lie within 200 m. They meet on cells of that size, by scene, so no scene is paired as a whole."""
    size = 200.0
    x, y = (c("xmin") + c("xmax")) / 2, (c("ymin") + c("ymax")) / 2
    m = _overlap_cells(t).select("id", "cell_id").join(t.box.select("id", "kind", x.alias("x"), y.alias("y")), "id")
    a = m.select("cell_id", c("id").alias("a"), c("kind").alias("ka"), c("x").alias("xa"), c("y").alias("ya"), planar.cell("x", size).alias("ix"), planar.cell("y", size).alias("iy"))
    near = lambda k, v: F.explode(F.sequence(planar.cell(v, size) - 1, planar.cell(v, size) + 1)).alias(k)
    b = m.select("cell_id", c("id").alias("b"), c("kind").alias("kb"), c("x").alias("xb"), c("y").alias("yb"), near("ix", "x")).select("*", near("iy", "yb"))
    j = a.join(b, ["cell_id", "ix", "iy"]).where((c("a") < c("b")) & (F.hypot(c("xa") - c("xb"), c("ya") - c("yb")) <= size))
    return j.select("cell_id", "a", "b", F.when(c("ka") == c("kb"), "same_class").otherwise("near").alias("relation"))


_POOL = f"(SELECT cell_id, count(*) AS n, avg(ln(1 + area)) AS a, avg(CASE WHEN area > 200 THEN 1.0 ELSE 0.0 END) AS b, count(DISTINCT kind) / 25.0 AS k FROM {_MEMBER} GROUP BY 1)"
q("V03", f"SELECT cell_id, n, round(a, 6) AS a, round(b, 6) AS b, round(k, 6) AS k FROM {_POOL}")(lambda t: _pooled(t).select("cell_id", "n", r6(c("v")[0], "a"), r6(c("v")[1], "b"), r6(c("v")[2], "k")))


def _pooled(t: Tables) -> DataFrame:
    """Scenes as vectors: means of their objects' features."""
    m = _overlap_cells(t).select("id", "cell_id").join(t.box.select("id", "kind", "area"), "id")
    return m.groupBy("cell_id").agg(n_(), F.array(F.avg(F.log1p("area")), F.avg(F.when(c("area") > 200, 1.0).otherwise(0.0)), F.countDistinct("kind") / 25.0).alias("v"))


q("V04", f"SELECT cell_id, other, CAST(place AS INTEGER) AS place FROM (SELECT x.cell_id, y.cell_id AS other, row_number() OVER (PARTITION BY x.cell_id ORDER BY round(1 - list_cosine_similarity([x.a, x.b, x.k], [y.a, y.b, y.k]), 9), y.cell_id) AS place FROM {_POOL} x JOIN {_POOL} y ON true) WHERE place <= 4")(
    lambda t: (lambda p: vectors.nearest_in_blocks(p, p, "cell_id", "v", 4, cosine=True).select("cell_id", "other", "place"))(_pooled(t).withColumn("cell_id", c("cell_id").cast("bigint")))
)
_DONG = "(SELECT region, min(centroid_x) AS x0, max(centroid_x) AS x1, min(centroid_y) AS y0, max(centroid_y) AS y1 FROM scene_grid GROUP BY 1)"
q("J19", f"SELECT id, min(CASE WHEN centroid_x BETWEEN x0 AND x1 AND centroid_y BETWEEN y0 AND y1 THEN region END) AS region FROM {_ENT}, {_DONG} GROUP BY 1")(lambda t: _districts(t))


def _districts(t: Tables) -> DataFrame:
    """The first district whose bounds hold a point; null outside of all. Districts are few: a row per region, broadcast after counting."""
    d = t.scene_grid.groupBy("region").agg(F.min("centroid_x").alias("x0"), F.max("centroid_x").alias("x1"), F.min("centroid_y").alias("y0"), F.max("centroid_y").alias("y1"))
    lattice = 5000.0
    span = lambda a, b: F.explode(F.sequence(planar.cell(a, lattice), planar.cell(b, lattice)))
    d = d.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))
    e = entities(t).select("id", "centroid_x", "centroid_y").withColumns({"gx": planar.cell("centroid_x", lattice), "gy": planar.cell("centroid_y", lattice)})
    hit = e.join(d, ["gx", "gy"]).where(c("centroid_x").between(c("x0"), c("x1")) & c("centroid_y").between(c("y0"), c("y1"))).groupBy("id").agg(F.min("region").alias("region"))
    return e.select("id").distinct().join(hit, "id", "left")


q("J22", "WITH p AS (SELECT n_nationkey AS id, CAST((n_nationkey*37)%100 AS DOUBLE) AS x, CAST((n_nationkey*91)%100 AS DOUBLE) AS y FROM nation) SELECT count(*) AS pairs, round(min(sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2))), 6) AS least FROM p a JOIN p b ON a.id < b.id")(lambda t: _all_pairs(t))


def _all_pairs(t: Tables) -> DataFrame:
    """All distances among the points of a table that has 25 rows at any size."""
    p = t.nation.select(c("n_nationkey").alias("id"), F.struct(((c("n_nationkey") * 37) % 100).cast("double").alias("x"), ((c("n_nationkey") * 91) % 100).cast("double").alias("y")).alias("p"))
    every = p.agg(F.collect_list(F.struct("id", "p")).alias("all"))
    j = p.join(F.broadcast(every)).select("id", "p", F.explode("all").alias("o")).where("id < o.id")
    return j.agg(F.count(lit(1)).alias("pairs"), r6(F.min(F.hypot(c("p.x") - c("o.p.x"), c("p.y") - c("o.p.y"))), "least"))


q("A11", "SELECT p_brand, arg_min(p_type, (-n, p_type)) AS label, count(*) AS variants, string_agg(p_type, ';' ORDER BY p_type) AS labels FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")(
    lambda t: relational.mode_label(t.part, ["p_brand"], "p_type").withColumnRenamed("p_type", "label").join(t.part.groupBy("p_brand").agg(F.countDistinct("p_type").alias("variants"), relational.label_list("p_type").alias("labels")), "p_brand")
)
