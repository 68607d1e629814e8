import math
import random
import time

from pyspark.sql import functions as F

from landmosaic.functions import geo, text
from landmosaic.operators import keyed, planar, proximity, relational
from landmosaic.runtime import durable, ranked


def test_ranked_matches_a_window_with_ties_nulls_and_one_heavy_group(spark):
    rows = [("a" if i % 3 else None, i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = {r["k"]: r["rank0"] for r in ranked(df, ["v", "k"], ["g"]).collect()}
    for g in ("a", None):
        want = sorted((v, k) for gg, v, k in rows if gg == g)
        assert [got[k] for _, k in want] == list(range(len(want)))
    assert ranked(df.limit(0), ["v"], ["g"]).count() == 0


def test_balanced_totals_count_repeats_once_and_split_a_heavy_key(spark):
    rows = [("A ", "x", i, 1.0) for i in range(300)] * 2 + [(" a", "X", 300 + i, 2.0) for i in range(5)] + [(None, "x", 900, None), ("b", None, None, 3.0), ("b", None, 901, float("nan"))]
    df = spark.createDataFrame(rows, "m string, s string, id long, v double").withColumn("n_ids", F.lit(7))
    df = df.withColumns({"m": keyed.canonical_code("m"), "s": keyed.canonical_code("s")})
    got = {(r["m"], r["s"]): (r["n_rows"], r["n_ids"], r["total"]) for r in keyed.balanced_key_totals(df, ("m", "s"), "id", "v", 6).collect()}
    assert got == {("A", "X"): (605, 305, 310.0), (None, "X"): (1, 1, 0.0), ("B", None): (2, 1, 0.0)}
    assert keyed.balanced_key_totals(df.limit(0), ("m", "s"), "id", "v").count() == 0
    heavy = keyed.heavy_keys(keyed.balanced_key_totals(df, ("m", "s"), "id", "v"), ("m", "s"), 0.04)
    assert [tuple(r)[:2] for r in heavy.collect()] == [("A", "X")]


def test_radius_pairs_are_complete(spark, monkeypatch):
    monkeypatch.setattr(proximity, "PLACES_PER_PIVOT", 20)
    rnd = random.Random(5)
    pts = {(round(124.8 + rnd.random() * 0.01, 6), round(36.2 + rnd.random() * 0.01, 6)) for _ in range(500)} | {(124.8, 36.2), (124.8 + 1e-5, 36.2)}
    pts = sorted(pts)
    df = spark.createDataFrame([*pts, (None, 36.2), (float("nan"), 1.0)], "lon double, lat double")
    got = {tuple(r) for r in proximity.radius_pairs(df, "lon", "lat", 60.0).collect()}

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(*a, *b) for i, a in enumerate(pts) for b in pts[i + 1 :] if metres(a, b) <= 60}
    assert got == want and want
    assert proximity.radius_pairs(df.limit(0), "lon", "lat", 60.0).count() == 0


def test_squares_are_half_open(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 10.0), (3, 499.9, 499.9), (4, None, 1.0)], "id int, x double, y double")
    s = spark.createDataFrame([("a", 250.0, 250.0, 500.0), ("b", 750.0, 250.0, 500.0), ("c", 0.0, 0.0, None)], "sid string, cx double, cy double, side double")
    got = sorted((r["id"], r["sid"]) for r in proximity.place_in_square(p, "x", "y", s, "sid", "cx", "cy", "side").collect())
    assert got == [(1, "a"), (2, "b"), (3, "a")]


def test_thinning_equals_the_sequential_pass(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.random(), rnd.random() * 1000, rnd.random() * 1000) for i in range(250)]
    got = {r["k"] for r in planar.thin(spark.createDataFrame(pts, "k int, p double, x double, y double"), "k", "p", 80.0).collect()}
    kept = []
    for k, p, x, y in sorted(pts, key=lambda r: (r[1], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 80**2 for _, a, b in kept):
            kept.append((k, x, y))
    assert got == {k for k, _, _ in kept}


def test_line_points_and_nearest(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (2, 0.0, 0.0, 5.0, 0.0), (3, 0.0, 0.0, 15.0, 0.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["id"], r["distance"]) for r in planar.line_points(lines, "x0", "y0", "x1", "y1", 10.0).collect())
    assert got == [(2, 5.0), (3, 5.0), (3, 15.0)]
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 900.0, 0.0)], "k int, x double, y double")
    assert {r["k"]: r["distance"] for r in planar.nearest_distance(pts, "k", 10.0).collect()} == {1: 5.0, 2: 5.0, 3: math.hypot(897, 4)}


def test_acceptance_takes_the_first_valid_row_of_each_key(spark):
    rows = [(1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, "C")]
    df = spark.createDataFrame(rows, "rank int, pano string")
    got = {r["rank"]: r["accepted_rank"] for r in relational.accept_first(df, "pano", F.col("rank"), F.lit(True), 2).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: None, 5: None}


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a\n", None), ("  ", "x"), ("NA", "y")], "a string, b string")
    assert [r[0] for r in df.select(text.clean("a", ("NA",))).collect()] == ["a", None, None]
    assert [r[0] for r in df.select(text.pasted("|", "a", "b")).collect()][0] == " a\n|NA"
    row = spark.range(1).select(F.lit("20260610").alias("s"), F.lit("b1").alias("k")).select(text.unit_hash("20260610", "k").alias("u")).first()
    assert abs(row["u"] - 0.3303397793844538) < 1e-15


def test_upsert_and_null_safe_join(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c", 1)], "k int, v string, w int")
    assert sorted((str(r["k"]), r["v"]) for r in relational.upsert(old, new, ["k"]).collect()) == [("1", "a"), ("None", "c")]
    assert relational.null_safe_join(old, new.select("k", "w"), ["k"]).where("w = 1").count() == 1


def test_a_durable_cut_leaves_no_shuffle_files(spark):
    jvm, disk = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    size = lambda: sum(f.length() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_"))
    had = size()
    cut = durable(spark.range(200_000).select("id", F.expr("uuid()").alias("u")).repartition(4, "u"))
    for _ in range(50):  # another thread removes them
        if size() < had + 1_000_000:
            break
        time.sleep(0.1)
    assert size() < had + 1_000_000 and cut.count() == 200_000
