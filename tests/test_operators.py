"""Hand-computed cases, nulls and empty tables of the operators that queries are built from."""

import json
import sqlite3
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic import config
from landmosaic.functions import text
from landmosaic.operators import grids, planar, quality, relational, samples, shapes, vectors
from landmosaic.plans import storage
from landmosaic.sources import files, sinks
from landmosaic.streaming import upserts

HOLED = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0), (0.25 0.25, 0.75 0.25, 0.75 0.75, 0.25 0.75, 0.25 0.25))"


def test_measures_of_a_square_with_a_hole():
    s = shapes.parse(HOLED)
    assert shapes.area(s.parts) == pytest.approx(0.75) and shapes.perimeter(s.parts) == pytest.approx(6)
    assert sum(map(len, s.rings)) == 8 and shapes.fault(s) is None and shapes.centroid(s.parts) == pytest.approx((0.5, 0.5))
    assert shapes.signed_distance(s.parts, np.array([[0.5, 0.5], [0.1, 0.5]])) == pytest.approx([0.25, -0.1])
    x, y = shapes.point_on_surface(s.parts)
    assert shapes.signed_distance(s.parts, np.array([[x, y]]))[0] < 0
    # of two parts the nearer outline counts, so a point inside one can come out positive
    two = shapes.parse("MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10)), ((10.5 0, 12 0, 12 10, 10.5 10)))")
    assert shapes.signed_distance(two.parts, np.array([[9.8, 5.0], [10.4, 5.0]])) == pytest.approx([-0.2, 0.1])


def test_wkt_in_every_form():
    assert shapes.parse(None) is None and shapes.parse("POLYGON ((0 0") is None and shapes.parse("nonsense") is None and shapes.parse("") is None
    assert shapes.parse("POLYGON EMPTY").parts == [] and shapes.fault(shapes.parse("POLYGON EMPTY")) == "empty"
    assert len(shapes.parse("polygon z ((0 0 5, 1 0 5, 1 1 5, 0 0 5))").parts) == 1
    assert len(shapes.parse("MULTIPOINT (1 2, 3 4)").points) == 1 and len(shapes.parse("MULTIPOINT ((1 2), (3 4))").points) == 2
    c = shapes.parse("GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1), POLYGON ((0 0, 1e1 0, 10 10, 0 0)))")
    assert (len(c.points), len(c.lines), len(c.parts)) == (1, 1, 1) and shapes.area(c.parts) == 50
    assert shapes.fault(shapes.parse("POINT (1 2)")) == "not a polygon"
    assert shapes.parse(shapes.polygon_wkt(shapes.parse(HOLED).parts)).rings[1].tolist() == shapes.parse(HOLED).rings[1].tolist()


def test_validity_repair_and_clipping():
    bow = shapes.parse("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))")
    assert shapes.fault(bow) == "self-crossing" and shapes.repaired(bow) == []
    twice = shapes.parse("POLYGON ((0 0, 2 0, 2 0, 2 2, 0 2, 0 0))")
    assert shapes.fault(twice) == "repeated point" and shapes.area(shapes.repaired(twice)) == 4
    cut = shapes.clip(shapes.parse("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))").parts, (2.0, 0.0, 9.0, 9.0))
    assert shapes.area(cut) == pytest.approx(6) and shapes.clip(bow.parts, (5.0, 5.0, 6.0, 6.0)) == []
    rnd = np.random.default_rng(3)
    h = shapes.hull(rnd.random((400, 2)))
    assert 0.9 < abs(shapes.signed_area(h)) < 1
    assert shapes.simplify(np.array([[0, 0], [1, 0.1], [2, 0], [2, 5.0]]), 0.5).tolist() == [[0, 0], [2, 0], [2, 5]]
    at, p = shapes.regular_points(np.array([[0, 0], [4.0, 0]]), 10.0)
    assert len(at) == 0
    at, p = shapes.regular_points(np.array([[0, 0], [10.0, 0], [10, 5]]), 10.0)
    assert at.tolist() == [5, 15] and p.tolist() == [[5, 0], [10, 5]]


def test_shape_columns_take_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, HOLED), (2, None), (3, "x"), (4, "POINT (9 9)"), (5, "POLYGON EMPTY")], "id long, wkt string").withColumn("area", F.lit("clash"))
    got = {r["id"]: r["m"] for r in df.select("id", shapes.measures("wkt").alias("m")).collect()}
    assert got[1]["area"] == 0.75 and got[1]["fault"] is None and [got[i]["fault"] for i in (2, 3, 4, 5)] == ["unreadable", "unreadable", "not a polygon", "empty"]
    assert {r["id"] for r in shapes.region_cut(df, "wkt", (0.5, 0.0, 20.0, 20.0)).collect()} == {1, 4}
    assert df.limit(0).select(shapes.measures("wkt")).count() == 0 and shapes.region_cut(df.limit(0), "wkt", (0.0, 0.0, 1.0, 1.0)).count() == 0
    assert [r[0] for r in df.orderBy("id").select(shapes.made_valid("wkt")).collect()][1:] == [None] * 4
    s = samples.sdf_samples(df, "id", "wkt", 4.0, 1, 3)
    n = {r["sample_kind"]: r["count"] for r in s.groupBy("sample_kind").count().collect()}
    assert n[0] == n[1] == 8 and n[2] == 24 and n[3] == 9 and s.select("entity").distinct().count() == 1
    assert s.orderBy("sample_index").collect() == samples.sdf_samples(df.where("id = 1"), "id", "wkt", 4.0, 1, 3).orderBy("sample_index").collect()


def test_scene_grid_of_a_box(spark):
    b = spark.createDataFrame([(120.0, 0.0, 1130.0, 499.0)], "xmin double, ymin double, xmax double, ymax double")
    assert grids.snapped(spark, grids.total_bounds(b), 500.0, 500.0).count() == 8 and grids.scene_grid(b, "r", 500.0, 500.0).count() == 3
    assert grids.snapped(spark, grids.total_bounds(b), 500.0, 250.0).count() == 18
    g = {r["scene_id"]: r["coverage_ratio"] for r in grids.scene_grid(b, "r", 500.0, 500.0).collect()}
    assert g["r_nonoverlap_000001"] == pytest.approx(380 * 499 / 250000) and g["r_nonoverlap_000002"] == pytest.approx(499 / 500)
    assert grids.scene_grid(b.limit(0), "r", 500.0, 500.0).count() == 0 and grids.boundary_grid(b.limit(0), 500.0).count() == 0


def test_road_sample_of_four_roads(spark):
    rows = [(i, k, None, 0.0, y, 1000.0, y) for i, (k, y) in enumerate([("primary", 100.0), ("residential", 250.0), ("residential", 400.0), ("service", 700.0)])] + [(9, "primary", "yes", 0.0, 5.0, 1000.0, 5.0), (10, None, None, 0.0, 9.0, 10.0, 9.0)]
    roads = spark.createDataFrame(rows, "source_road_id int, highway_class string, tunnel string, x0 double, y0 double, x1 double, y1 double")
    box = (0.0, 0.0, 1000.0, 1000.0)
    c = grids.road_candidates(grids.road_network(roads, box), 25.0).collect()
    assert len(c) == 120 and min(r["x"] for r in c) == 12.5 and max(r["x"] for r in c) == 987.5 and sorted(r["candidate_id"] for r in c) == list(range(1, 121))
    s = grids.sample_roads(roads, box, 25.0, 100.0, 1000, 7, 500.0).collect()
    assert all((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 >= 1e4 for i, a in enumerate(s) for b in s[i + 1 :]) and sorted(r["point_id"] for r in s) == list(range(1, len(s) + 1))
    assert s == grids.sample_roads(roads.orderBy(F.desc("source_road_id")), box, 25.0, 100.0, 1000, 7, 500.0).collect()
    assert grids.road_network(roads, (0.0, 0.0, 500.0, 300.0)).agg(F.sum("length_m")).first()[0] == 1000
    assert grids.sample_roads(roads.limit(0), box, 25.0, 100.0, 10, 7, 500.0).count() == 0


def test_folds(spark):
    f = grids.balanced_folds(spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 2)], "g string, n long"), "g", "n", 2)
    assert {r["g"]: r["fold"] for r in f.collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2}
    assert spark.range(1).select(F.lit("b1").alias("k")).select(grids.hash_fold("20260610", 5, "k")).first()[0] == 2
    assert grids.chunked(spark.createDataFrame([("x", 7), ("y", 0), ("z", None)], "k string, n long"), ["k"], "n", 3).orderBy("chunk").collect()[-1]["last"] == 7


def test_nested_boxes_and_nearest_boxes(spark):
    box = lambda i, k, c, s: (i, k, c - s / 2, c - s / 2, c + s / 2, c + s / 2, s * s)
    df = spark.createDataFrame([box(1, "a", 50.0, 10.0), box(2, "a", 50.0, 4.0), box(3, "a", 50.0, 2.0), box(4, "b", 50.0, 1.0), box(5, "c", 9.0, 3.0), box(6, "c", 9.0, 3.0), (7, None, None, None, None, None, None)], "id int, k string, xmin double, ymin double, xmax double, ymax double, area double")
    assert {r["id"] for r in planar.contained_boxes(df, "id", ["k"], 20.0).collect()} == {2, 3}
    assert {r["id"] for r in planar.contained_boxes(df, "id", ["k"], 20.0, strict=False).collect()} == {2, 3, 5, 6}
    pts = spark.createDataFrame([(1, 50.0, 50.0), (2, 20.0, 9.0), (3, 900.0, 900.0)], "p int, x double, y double")
    got = {r["p"]: (r["id"], round(r["distance"], 3)) for r in planar.nearest_box(pts, "p", df.where("id != 7"), "id", 5.0).collect()}
    assert got == {1: (1, 0.0), 2: (5, 9.5), 3: (1, round(845 * 2**0.5, 3))}
    assert planar.nearest_box(pts, "p", df.limit(0), "id", 400.0).where("id IS NULL").count() == 3


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 5)) * [1, 2, 3, 4, 0] + 7
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(500, 0, None)], "k long, label int, v array<double>")
    z = np.array([r["v"] for r in vectors.standardized(df, "v").where("v IS NOT NULL").orderBy("k").collect()])
    assert np.allclose(z[:, :4].std(axis=0), 1) and np.allclose(z.mean(axis=0), 0) and (z[:, 4] == 0).all()
    got = {(r["k"], r["other"]) for r in vectors.nearest_in_blocks(df, df, "k", "v", 4).collect()}
    d = ((x[:, None] - x) ** 2).sum(-1).round(9)
    assert got == {(i, int(j)) for i in range(120) for j in np.lexsort((np.arange(120), d[i]))[:4]}
    mean, axes, share = vectors.principal_axes(df, "v", 2)
    val = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(share, val[:2] / val.sum()) and np.allclose(axes.T @ axes, np.eye(2))
    s = {r["k"]: r["silhouette"] for r in vectors.silhouettes(df, "k", "label", "v").collect()}
    lab, i = np.arange(120) % 3, 17
    a = d[i][(lab == lab[i]) & (np.arange(120) != i)].mean()
    b = min(d[i][lab == o].mean() for o in range(3) if o != lab[i])
    assert s[i] == pytest.approx((b - a) / max(a, b), abs=1e-6) and len(s) == 120
    assert vectors.nearest_in_blocks(df.limit(0), df, "k", "v", 4).count() == 0 and vectors.silhouettes(df.limit(0), "k", "label", "v").count() == 0 and vectors.standardized(df.limit(0), "v").count() == 0


def test_cross_validation_equals_a_fit_without_the_fold(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 2))
    y = 3 + x @ [2, -1] + rng.standard_normal(200)
    df = spark.createDataFrame([(i % 4, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))] + [(0, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0)], "fold int, a double, b double, y double")
    got = vectors.cross_validated(df, "fold", ["a", "b"], "y").where("fold = 2").orderBy("a").select("a", "guess").collect()
    m = np.arange(200) % 4
    w = np.linalg.lstsq(np.c_[np.ones(200), x][m != 2], y[m != 2], rcond=None)[0]
    want = sorted((a, w[0] + w[1] * a + w[2] * b) for a, b in x[m == 2])
    assert np.allclose(np.array([tuple(r) for r in got]), want)


def test_quality_checks(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (1, "a|b"), (None, "")], "k int, t string")
    assert {r["rule"]: r["violations"] for r in quality.contract(df, "k", ["k", "gone"], df.where("k = 0")).collect()} == {"missing_columns": 1, "null_keys": 1, "repeated_keys": 1, "only_in_first": 1, "only_in_second": 0}
    assert quality.dense_ids(df, "k").first()["dense"] is False and quality.dense_ids(df.where("t IS NULL OR k = 0"), "k").first()["dense"] is True and quality.dense_ids(df.limit(0), "k").first()["dense"] is False
    assert quality.violations(df, "k", {"empty": F.col("t") == ""}).collect()[0]["k"] is None
    assert {(r["k"], r["state"]) for r in quality.completeness(df, df.where("k IS NULL"), ["k"]).collect()} == {(0, "missing"), (1, "missing")}
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, float("nan")]), (3, None), (4, [float("inf")])], "k int, v array<double>")
    assert {r["dim"]: (r["n"], r["nulls"], r["not_finite"], r["all_zero"]) for r in quality.vector_audit(v, "v").collect()} == {2: (2, 0, 1, 1), -1: (1, 1, 0, 0), 1: (1, 0, 1, 0)}
    assert "a\\|b" in sinks.markdown_table(df)


def test_first_rows_and_repeats(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4), ("b", None), ("b", 1)], "k string, v int")
    assert sorted((str(r["k"]), r["v"]) for r in relational.keep_first(df, ["k"], ["v"]).collect()) == [("None", 3), ("a", 1), ("b", None)]
    assert sorted((str(r["k"]), r["v"]) for r in relational.with_repeats(df, ["k"], ["v"], "again").where("again").collect()) == [("None", 4), ("a", 2), ("b", 1)]
    assert relational.keep_first(df.limit(0), ["k"], ["v"]).count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a/b/Some file.SHP", "x_11680_y", 123456.0), (None, "none", 0.0), ("", None, None)], "p string, q string, x double")
    r = df.select(text.base_name("p").alias("b"), text.stem("p").alias("s"), text.extension("p").alias("e"), text.safe_name("p").alias("n"), text.sub_first("q", r"_(\d{5})").alias("q"), text.signif("x", 3).alias("x"), text.listed("q", "_").alias("l")).collect()
    assert tuple(r[0]) == ("Some file.SHP", "Some file", "shp", "a_b_Some_file.SHP", "11680", 123000.0, ["x", "11680", "y"])
    assert tuple(r[1])[4:6] == ("none", 0.0) and r[2]["x"] is None and r[2]["q"] is None and r[1]["b"] is None
    f = spark.createDataFrame([(True, None), (None, None), (False, True)], "a boolean, b boolean")
    assert [x[0] for x in f.select(text.first_true([F.col("a"), F.col("b")])).collect()] == [1, None, 2]


def test_files_read_back(spark, tmp_path):
    rows = [(1, 0.0, 0.0, 4.0, 2.0), (7, 5.0, 5.0, 6.0, 9.0)]
    shp, shx, dbf = storage._shapefile(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for ext, b in (("shp", shp), ("shx", shx), ("dbf", dbf)):
            z.writestr(f"UPIS_UQW110_11680.{ext}", b)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    a = files.binary_files(spark, str(tmp_path), "*.zip")
    m = files.archive_members(a).collect()
    assert len([r for r in m if r["member"]]) == 3 and len([r for r in m if r["error"]]) == 1
    assert {r["layer"] for r in files.archive_members(a).where("member IS NOT NULL").withColumns(files.name_parts("member")).collect()} == {"UQW110"}
    assert files.index_counts(files.archive_content(a, "shx$")).first()["features"] == 2
    got = files.shapefile_records(files.archive_content(a, "shp$")).orderBy("feature").collect()
    assert [shapes.area(shapes.parse(r["wkt"]).parts) for r in got] == [8.0, 4.0]
    d = files.dbase_rows(files.archive_content(a, "dbf$")).orderBy("feature").collect()
    assert [r["values"] for r in d] == [{"ID": "1", "이름": "건물1"}, {"ID": "7", "이름": "건물0"}]
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.executescript("CREATE TABLE gpkg_geometry_columns (table_name, column_name, geometry_type_name, srs_id, z, m); INSERT INTO gpkg_geometry_columns VALUES ('t', 'g', 'POINT', 4326, 0, 0); CREATE TABLE t (fid INTEGER PRIMARY KEY, g BLOB, n TEXT)")
    db.execute("INSERT INTO t VALUES (3, ?, '가')", (b"GP\0\1" + (4326).to_bytes(4, "little") + b"\1" + (1).to_bytes(4, "little") + np.array([1.5, 2.5]).tobytes(),))
    db.execute("INSERT INTO t VALUES (4, NULL, NULL)")
    db.commit()
    db.close()
    g = files.geopackage_features(files.binary_files(spark, str(tmp_path), "*.gpkg")).orderBy("fid").collect()
    assert (g[0]["wkt"], g[0]["epsg"], json.loads(g[0]["attributes"])) == ("POINT (1.5 2.5)", 4326, {"fid": 3, "n": "가"}) and g[1]["wkt"] is None
    assert files.geopackage_features(files.binary_files(spark, str(tmp_path), "*.gpkg"), "n = '가'").count() == 1
    empty = a.limit(0)
    assert files.archive_members(empty).count() == files.shapefile_records(empty).count() == files.geopackage_features(empty).count() == 0


def test_sinks_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    p = str(tmp_path / "t")
    assert sinks.write_table(df, p) and not sinks.write_table(df, p, "skip")
    with pytest.raises(FileExistsError):
        sinks.write_table(df, p)
    sinks.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), p, ["k"])
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_table(df.limit(0), p, "backup")
    assert spark.read.parquet(p).count() == 0 and spark.read.parquet(p + ".bak").count() == 3
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in ([(1, "x"), (2, "y")], [(2, "z")], [(2, "z")]):
        spark.createDataFrame(batch, "k int, v string").coalesce(1).write.mode("append").parquet(src)
        upserts.run_batches(spark, src, "k int, v string", table, str(tmp_path / "progress"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "x"), (2, "z")]
    assert upserts.until(spark, table, lambda t: t.where("k > 1"), 1, lambda: False).count() == 1


def test_settings():
    @dataclass
    class S:
        region: str = "all"
        cells: int = 5
        force: bool = False

    s = config.parsed(S, ["--cells=7", "--force"], {"X_REGION": "seoul"}, "X_")
    assert (s.region, s.cells, s.force) == ("seoul", 7, True)
    with pytest.raises(ValueError):
        config.parsed(S, ["--other=1"], {})
    p = config.Paths({"grid": ["/a", "/b"]})
    assert p.get("grid", lambda x: x == "/b", {}) == "/b" and p.get("grid", lambda x: False, {}) == "/a" and p.get("grid", bool, {"LAND_GRID": "/c"}) == "/c"
    assert config.waits(4, 1, 3) == [1, 2, 3] and config.waits(0) == []


def test_thinning_keeps_points_at_the_very_distance(spark):
    pts = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 2.0, 10.0, 0.0), (3, 3.0, 19.9, 0.0)], "k int, p double, x double, y double")
    assert {r["k"] for r in planar.thin(pts, "k", "p", 10.0).collect()} == {1, 2}
    assert planar.thin(pts.limit(0), "k", "p", 10.0).count() == 0


def test_nearest_distance_in_a_crowd_and_at_one_place(spark, monkeypatch):
    monkeypatch.setattr(planar, "CELL_PLACES", 4)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random((80, 2)), [[5, 5], [5, 5], [900, 900]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(500, None, 1.0)], "k int, x double, y double")
    d = np.hypot(*(x[:, None] - x).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    got = {r["k"]: r["distance"] for r in planar.nearest_distance(df, "k", 10.0).collect()}
    assert got.pop(500) is None and np.allclose([got[i] for i in range(len(x))], d.min(axis=1))
    assert planar.nearest_distance(df.limit(0), "k", 10.0).count() == 0 and planar.nearest_distance(df.where("k = 1"), "k", 10.0).first()["distance"] is None


def test_dissolved_boxes(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0), ("a", 5.0, 5.0, 15.0, 15.0), ("a", 5.0, 5.0, 15.0, 15.0), (None, 0.0, 0.0, 1.0, 1.0), ("b", None, 0.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, 5.0)], "g string, xmin double, ymin double, xmax double, ymax double")
    assert {r["g"]: r["area"] for r in planar.dissolved_area(df, "g", 4.0).collect()} == {"a": 175.0, None: 1.0}
    assert planar.dissolved_area(df.limit(0), "g", 4.0).count() == 0


def test_osm_files(spark, tmp_path):
    _field, _varint, _zag = storage._field, storage._varint, storage._zag
    words = ["", "amenity", "cafe", "name", "가게", "highway", "primary"]
    ids, lat, lon = [10, 12, 15], [375000000, 375000100, -10], [1270000000, 1269999900, 5]
    dense = _field(1, _zag(np.diff([0, *ids]))) + _field(8, _zag(np.diff([0, *lat]))) + _field(9, _zag(np.diff([0, *lon]))) + _field(10, b"".join(map(_varint, [1, 2, 3, 4, 0, 0, 3, 4, 0])))
    way = _field(1, 77) + _field(2, _varint(5)) + _field(3, _varint(6)) + _field(8, _zag(np.diff([0, 12, 10, 15])))
    block = _field(1, b"".join(_field(1, w.encode()) for w in words)) + _field(2, _field(2, dense)) + _field(2, _field(3, way))
    data = b""
    for kind, raw in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = _field(2, len(raw)) + _field(3, zlib.compress(raw))
        head = _field(1, kind) + _field(3, len(blob))
        data += len(head).to_bytes(4, "big") + head + blob
    (tmp_path / "x.osm.pbf").write_bytes(data)
    got = {(r["kind"], r["osm_id"]): r for r in files.osm_objects(files.binary_files(spark, str(tmp_path), "*.pbf"), ["amenity", "highway"]).collect()}
    assert set(got) == {("node", 10), ("way", 77)} and got["way", 77]["refs"] == [12, 10, 15] and got["node", 10]["tags"] == {"amenity": "cafe", "name": "가게"}
    assert (got["node", 10]["lon"], got["node", 10]["lat"]) == pytest.approx((127.0, 37.5))


def test_nearest_boxes_ask_for_a_place_once(spark, monkeypatch):
    rows, durable = [], planar.durable
    monkeypatch.setattr(planar, "durable", lambda d: (o := durable(d), rows.append(o.count()))[0])
    pts = spark.createDataFrame([(i, float(i % 4) * 50, 1.0) for i in range(400)] + [(900, None, 1.0)], "p int, x double, y double")
    box = spark.createDataFrame([(i, float(i % 3) * 50, 0.0, float(i % 3) * 50 + 10, 2.0) for i in range(300, 0, -1)], "id int, xmin double, ymin double, xmax double, ymax double")
    got = {r["p"]: (r["id"], r["distance"]) for r in planar.nearest_box(pts, "p", box, "id", 5.0).collect()}
    near = {0: (3, 0.0), 1: (1, 0.0), 2: (2, 0.0), 3: (2, 40.0)}
    assert got == {i: near[i % 4] for i in range(400)} | {900: (None, None)} and max(rows) <= 5


def test_thinning_takes_batches_of_crowded_points(spark, monkeypatch):
    import random

    rows, durable, rnd = [], planar.durable, random.Random(4)
    monkeypatch.setattr(planar, "durable", lambda d: (o := durable(d), rows.append(o.count()))[0])
    pts = [(i, rnd.random(), rnd.random() * 60, rnd.random() * 60) for i in range(1500)] + [(2000 + i, rnd.random(), 500.0, 500.0) for i in range(500)] + [(3000, 0.5, None, 1.0)]
    got = {r["k"] for r in planar.thin(spark.createDataFrame(pts, "k int, p double, x double, y double"), "k", "p", 20.0).collect()}
    kept = []
    for k, _, x, y in sorted((p for p in pts if p[2] is not None), key=lambda r: (r[1], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 400 for _, a, b in kept):
            kept.append((k, x, y))
    assert got == {k for k, _, _ in kept} | {3000} and max(rows) < 1000


def test_candidates_of_roads_with_one_id_take_turns(spark):
    rows = [(1, 0.0, 35.0), (2, 0.0, 20.0), (2, 100.0, 140.0), (None, 0.0, 10.0), (3, 0.0, 10.0), (None, 50.0, 60.0)]
    net = spark.createDataFrame([(i, a, 5.0, b, 5.0) for i, a, b in rows], "source_road_id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["candidate_id"], r["source_road_id"] or 0, r["distance"]) for r in grids.road_candidates(net, 10.0).collect())
    want = sorted((i or 0, (j + 0.5) * 10) for i, a, b in rows for j in range(int((b - a) / 10 + 0.5)))
    assert got == [(n + 1, i, d) for n, (i, d) in enumerate(want)]


def _crowded_roads(spark):
    import random

    rnd, at = random.Random(9), lambda: float(rnd.randrange(-20, 420))
    rows = [(rnd.choice([None, *range(i, i + 3)]) if i % 7 == 0 else i, "primary", None, x, y, x + rnd.random() * 120, y + rnd.choice([0.0, 0.0, 50.0])) for i in range(120) for x, y in [(at(), at())]]
    return spark.createDataFrame(rows, "source_road_id int, highway_class string, tunnel string, x0 double, y0 double, x1 double, y1 double"), (0.0, 0.0, 400.0, 400.0)


@pytest.mark.parametrize("most", [10_000, 20])
def test_road_sample_equals_the_sequential_pass(spark, monkeypatch, most):
    roads, box = _crowded_roads(spark)
    c = grids.road_candidates(grids.road_network(roads, box), 2.0).select("candidate_id", "x", "y", text.unit_hash("7", "candidate_id").alias("u")).collect()
    assert sorted(r["candidate_id"] for r in c) == list(range(1, len(c) + 1)) and len(c) > 2000
    kept = []
    for r in sorted(c, key=lambda r: (r["u"], r["candidate_id"])):
        if all((r["x"] - a) ** 2 + (r["y"] - b) ** 2 >= 400 for a, b in kept):
            kept.append((r["x"], r["y"]))
    cuts, durable = [], planar.durable
    for m in (planar, grids):
        monkeypatch.setattr(m, "durable", lambda d: (cuts.append(1), durable(d))[1])
    for name, value in (("TILE", 3), ("RIM", 2)):
        monkeypatch.setattr(planar, name, value, raising=False)
    monkeypatch.setattr(grids, "TILE_FILL", 20, raising=False)
    got = sorted((r["point_id"], r["x"], r["y"]) for r in grids.sample_roads(roads, box, 2.0, 20.0, most, 7, 500.0).collect())
    assert got == [(i + 1, *p) for i, p in enumerate(kept[:most])] and len(kept) > 20
    assert len(cuts) < 25  # few rounds, though these tiles are small and filled little


def test_points_of_roads_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(grids, "PIECE", 7)
    roads, _ = grids._numbered(spark.createDataFrame([(1, 0.0, 35.0), (2, 0.0, 4.0), (3, 0.0, 250.0)], "source_road_id int, x0 double, x1 double").selectExpr("*", "0D AS y0", "x1 * 0.3D AS y1"), 10.0)
    b = roads.orderBy("source_road_id").toArrow().combine_chunks().to_batches()[0]
    got = [(int(k), x, y) for _, ks, xs, ys in grids._drawn(b, 10.0) for k, x, y in zip(ks, xs.tolist(), ys.tolist())]
    want = planar.line_points(roads, "x0", "y0", "x1", "y1", 10.0).orderBy("source_road_id", "distance").collect()
    assert got == [(i + 1, r["x"], r["y"]) for i, r in enumerate(want)] and len(got) > 25


def test_near_points_on_a_torus(monkeypatch):
    monkeypatch.setattr(planar.Near, "SIDE", 8)
    g = np.random.default_rng(3)
    kept = np.array([(a * 12.0 + g.random(), b * 12.0) for a in range(-9, 9) for b in range(-4, 20)])
    x, y = g.random(3000) * 300 - 150, g.random(3000) * 300 - 60
    near = planar.Near(kept[:, 0], kept[:, 1], 8.0)
    assert len(near.layers) > 1 and near.others(x, y).tolist() == [i for i in range(3000) if not ((x[i] - kept[:, 0]) ** 2 + (y[i] - kept[:, 1]) ** 2 < 64).any()]
    assert planar.Near(np.empty(0), np.empty(0), 8.0).others(x, y).tolist() == list(range(3000))


def test_filters_of_road_cuts_stay_short(spark):
    roads, box = _crowded_roads(spark)
    assert grids.road_network(roads, box)._jdf.queryExecution().optimizedPlan().toString().count("least(") < 10


def test_road_sample_takes_few_cuts(spark, monkeypatch):
    cuts, durable = [], planar.durable
    for m in (planar, grids):
        monkeypatch.setattr(m, "durable", lambda d: (cuts.append(1), durable(d))[1])
    rows = [(i, "primary", None, 0.0, i * 3.0, 90.0, i * 3.0) for i in range(40)]
    roads = spark.createDataFrame(rows, "source_road_id int, highway_class string, tunnel string, x0 double, y0 double, x1 double, y1 double")
    assert grids.sample_roads(roads, (0.0, 0.0, 100.0, 100.0), 3.0, 20.0, 1000, 7, 500.0).count() > 10 and len(cuts) <= 6
