"""Cases that a bound on rows, a threshold or a subset once left out."""

import numpy as np

from landmosaic.llm import encoding, linkage, neighbours, overlap, plans, residue, splits


def test_linkage_keeps_crowded_blocks_whole(spark, monkeypatch):
    monkeypatch.setattr(linkage, "CROWD", 3)
    monkeypatch.setattr(linkage, "NAME_CROWD", 3)
    s = "id string, name string, kind string, x double, y double, addr string, tel string"
    towns = ["벌터", "뫼울", "담빛", "내결", "실골", "달해", "봄별", "새한", "너른", "구름"]
    # ten branches of one chain, of which the second list has no places
    a = [(f"c{i}", f"둥근너뫼 커피 {t}지점", "cafe", 3000.0 * i, 0.0, None, None) for i, t in enumerate(towns)]
    b = [(f"d{i}", f"둥근너뫼 커피 {t}지점", "커피", None, None, None, None) for i, t in enumerate(towns)]
    # a telephone that many share; of two records that also stand close one has no name
    a += [(f"t{i}", None if i == 0 else f"{t} 약국", "pharmacy", 90000.0 + 500 * i, 9.0, None, "031-111-2222") for i, t in enumerate(towns)]
    b += [(f"u{i}", f"{t} 약국", "약국", 90000.0 + 500 * i, 9.0, None, "031-111-2222") for i, t in enumerate(towns)]
    # a name of two letters, of which there are two triples
    a.append(("s", "GX", "cafe", 50000.0, 50000.0, None, None))
    b.append(("r", "gx", "커피", 50001.0, 50000.0, None, None))
    # what teaches the kinds
    a += [(f"k{i}", f"{'가나다라마'[i % 5]}{'벌뫼담내실'[i // 5]}여 커피", "cafe", 5000.0 + 300 * i, 9000.0, None, None) for i in range(25)]
    b += [(f"l{i}", f"{'가나다라마'[i % 5]}{'벌뫼담내실'[i // 5]}여 커피", "커피", 5000.0 + 300 * i, 9000.0, None, None) for i in range(25)]
    got = {(r["a"], r["b"]) for r in linkage.matches(spark.createDataFrame(a, s), spark.createDataFrame(b, s)).collect()}
    assert {(f"c{i}", f"d{i}") for i in range(10)} <= got
    assert {(f"t{i}", f"u{i}") for i in range(10)} <= got
    assert ("s", "r") in got


def _letters():
    body = [f"The survey of block {i} found {2 + i % 90} wells and {3 + i * 7 % 90} sheds near the old road. The road is {i} metres long and closes at night." for i in range(600)]
    slots = ["{{addr}}", "${street}", "<%= region %>", "[contact]", "__ADDRESS__", "{% area %}", "@@NAME@@", "{{site}}"]
    rows = [*enumerate(body), *((1000 + i, f"The office at {slots[i % 8]} will answer. {body[i]}") for i in range(40))]
    rows += [(2000 + i, f"Error 50{i % 5}: Bad Gateway\nThe page is temporarily unavailable.") for i in range(20)]
    return rows, body


def test_a_form_letter_is_found_however_often_it_occurs(spark):
    rows, _ = _letters()
    rows += [(3000 + i, f"Dear {{{{name}}}}, the office will answer you.{' The road is closed at night.' * (i % 3)}") for i in range(9)]
    got = {r["k"] for r in residue.residue_records(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect()}
    assert {3000 + i for i in range(9)} <= got and not any(k < 1000 for k in got)


def test_a_long_error_page_is_found(spark):
    rows, body = _letters()
    rows += [(4000, "Home\nAbout\nError 503: Bad Gateway\n" + "\n".join(["The page is temporarily unavailable."] * 9)), (4001, "\n".join(body[:5]) + "\nError 503: Bad Gateway")]
    got = {r["k"] for r in residue.residue_records(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect()}
    assert 4000 in got and 4001 not in got and not any(k < 1000 for k in got)


def test_every_vector_has_its_nearest(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    x = np.random.default_rng(5).standard_normal((200, 64)).astype(np.float32)
    x[150:153] = x[0]
    spark.createDataFrame([(i, 64, v.tolist()) for i, v in enumerate(x)], "geo2vec_internal_id long, geo_dim int, embedding array<float>").write.parquet(f"{tmp_path}/geo2vec_vectors.parquet")
    got = {(r["id"], r["other"]) for r in plans.p3_nearest(spark, str(tmp_path)).collect()}
    m = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -2)
    assert got == {(i, int(j)) for i in range(200) for j in np.lexsort((np.arange(200), -s[i].round(9)))[:5]}


def test_rare_labels_have_their_shares(spark):
    rows = [(f"g{i}", f"author {i % 3000}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "group string, label string")
    n = {r["split"]: r["count"] for r in splits.assign_splits(df, "label").groupBy("split").count().collect()}
    assert sum(n.values()) == 30_000 and abs(n[0] - 24_000) < 300 and abs(n[1] - 3000) < 300 and abs(n[2] - 3000) < 300
    alone = spark.createDataFrame([(f"g{i}", f"author {i}") for i in range(3000)], "group string, label string")
    n = {r["split"]: r["count"] for r in splits.assign_splits(alone, "label").groupBy("split").count().collect()}
    assert abs(n[0] - 2400) < 30 and abs(n[1] - 300) < 30


def test_one_misread_run_among_many_is_restored(spark):
    names = [f"{a}{b}구 {c}{d}동" for a in "봄해달별새" for b in "내벌담뫼" for c in "가나다" for d in "솔실"]
    right = " ".join(f"{names[i]} {i}" for i in range(0, 60, 6))
    run = names[18].split(" ")[0]
    bad = right.replace(run, run.encode().decode("latin-1"), 1)
    assert bad != right
    df = spark.createDataFrame([("f", f"s{i % 7}", n) for i, n in enumerate(names)] + [("f", "s0", bad)], "field string, source string, value string")
    got = {r["value"]: r["restored"] for r in encoding.misread_values(df).collect()}
    assert got == {bad: right}


def _ring(points):
    return "POLYGON ((" + ", ".join(f"{x:.3f} {y:.3f}" for x, y in [*points, points[0]]) + "))"


def test_outlines_with_other_corners_are_found(spark):
    circle = lambda x, y, turn: _ring([(x + 10 * np.cos((i + turn) * np.pi / 12), y + 10 * np.sin((i + turn) * np.pi / 12)) for i in range(24)])
    notched = _ring([(100, 0), (109, 0), (109, 0.45), (111, 0.45), (111, 0), (120, 0), (120, 20), (100, 20)])
    two = lambda a, b: f"MULTIPOLYGON ((({a})), (({b})))"
    p, q = "200 0, 205 0, 205 5, 200 5, 200 0", "300 0, 306 0, 306 6, 300 6, 300 0"
    rows = [("t1", "b1", circle(0, 0, 0), 0), ("e1", None, circle(0, 0, 0.5), 1), ("t2", "b2", _ring([(100, 0), (120, 0), (120, 20), (100, 20)]), 0), ("e2", "b1", notched, 2)]
    rows += [("t3", "b3", two(p, q), 0), ("e3", "b3", two(q, p), 1), ("e4", None, circle(0.6, 0, 0), 1), ("t4", "b3", None, 0)]
    df = spark.createDataFrame(rows, "key string, b string, wkt string, split int")
    got = {tuple(r) for r in overlap.split_overlaps(df, "key", "b", "wkt", "split").collect()}
    assert got == {("t1", "e1"), ("t2", "e2"), ("t1", "e2"), ("t3", "e3"), ("t4", "e3")}
    counts = {r["eval"]: r["partners"] for r in overlap.overlap_counts(df, "key", "b", "wkt", "split").collect()}
    assert counts == {"e1": 1, "e2": 2, "e3": 2}
    assert overlap.overlap_counts(df.limit(0), "key", "b", "wkt", "split").count() == 0


def test_the_solver_finds_the_least_loss(spark):
    rng = np.random.default_rng(12)
    pairs = [("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")]
    bodies = np.where(rng.random((4, 13)) < 0.4, 0.0, rng.random((4, 13)))
    bodies[:, 6:] *= 0.4
    bodies[:, 12] = 1.0
    bodies[:, :2] = 0.9
    df = spark.createDataFrame([(a, b, v.tolist()) for (a, b), v in zip(pairs, bodies)], "a string, b string, bodies array<double>")
    got = {(r["a"], r["b"]): r["truth"] for r in linkage.solve(df, 200, 1e-3).collect()}
    m = np.array([got.get(p, 0.0) for p in pairs])
    w = linkage._WEIGHTS

    def loss(m):
        return (w[:6] * np.maximum(0, bodies[:, :6] - m[..., None])).sum((-1, -2)) + (w[6:] * np.maximum(0, m[..., None] - (1 - bodies[:, 6:]))).sum((-1, -2))

    grid = np.linspace(0, 1, 26)
    every = np.stack(np.meshgrid(grid, grid, grid, grid, indexing="ij"), axis=-1).reshape(-1, 4)
    allowed = every[(every[:, 0] + every[:, 1] <= 1) & (every[:, 1] + every[:, 2] <= 1)]
    assert m[0] + m[1] <= 1.01 and m[1] + m[2] <= 1.01 and loss(m) <= loss(allowed).min() + 0.1 and m.max() > 0.5
    assert linkage.solve(df.limit(0)).count() == 0


def test_batched_similarity_equals_the_single_one():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeg "), n)).strip() or "a" for n in rng.choice([1, 3, 6, 12, 25, 63, 64, 90], 400)]
    p, q = words, [w[1:] + w[:1] if i % 3 else w[: len(w) // 2] + "x" + w[len(w) // 2 :] if i % 2 else words[-i] for i, w in enumerate(words)]
    assert (linkage.form_similarities(p, q) == [linkage.form_similarity(a, b) for a, b in zip(p, q)]).all()
    assert (linkage._edits(p, q) == [linkage._edit(a, b) for a, b in zip(p, q)]).all() and len(linkage._edits([], [])) == 0
