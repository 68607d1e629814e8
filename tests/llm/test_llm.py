import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.llm import encoding, linkage, mixing, neighbours, overlap, residue, splits, tokens


def test_groups_follow_ties_in_steps(spark):
    rows = [(i, f"b{i}", f"s{i:02d}") for i in range(30)] + [(100 + i, f"b{i}", f"s{i + 1:02d}") for i in range(20)] + [(200, "b0", None), (201, None, None), (202, "b99", None), (202, "b99", None)]
    df = spark.createDataFrame(rows, "id long, b string, s string").withColumn("label", F.lit("clash"))
    got = {r["id"]: r["group"] for r in splits.record_groups(df, "id", "b", "s").collect()}
    assert got[0] == got[119] == got[200] == "s:s00" and got[25] == "s:s25" and got[202] == "b:b99" and got[201] == "r:201"
    by = spark.createDataFrame([(0, 0), (119, 1), (25, 0)], "id long, split int")
    broken = splits.broken_groups(df, by, "id", "b", "s").collect()
    assert {r["group_place"] for r in broken} == {"s00"} and len(broken) == 21
    assert splits.broken_groups(df.limit(0), by, "id", "b", "s").count() == 0


def test_splits_have_their_shares(spark):
    rnd = random.Random(2)
    rows = [(f"g{rnd.randint(0, 400)}", rnd.choice(["x", "x", "y", None])) for _ in range(4000)] + [("big", "x")] * 600
    df = spark.createDataFrame(rows, "group string, label string")
    out = df.join(splits.assign_splits(df, "label"), "group")
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 4600 and abs(n[0] / 4600 - 0.8) < 0.04 and abs(n[1] / 4600 - 0.1) < 0.04
    assert splits.assign_splits(df.limit(0), "label").count() == 0


def _box(x, y, w, h, turn=0, extra=False, flip=False):
    r = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    if extra:
        r.insert(1, (x + w / 2, y))
    r = r[turn:] + r[:turn]
    r = r[::-1] if flip else r
    return "POLYGON ((" + ", ".join(f"{a:.3f} {b:.3f}" for a, b in [*r, r[0]]) + "))"


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rnd.random() * 200, rnd.random() * 200
        rows.append((f"t{i}", f"b{i}", _box(x, y, 8, 12), 0))
        d = rnd.choice([0, 0.2, 0.45, 0.6, 1.5])
        rows.append((f"e{i}", None, _box(x + d, y, 8, 12, turn=i % 4, extra=i % 3 == 0, flip=i % 2 == 0), 1 + i % 2))
    rows += [("n1", None, None, 0), ("n2", None, "POLYGON EMPTY", 1), ("n3", None, _box(0, 0, 5, 5), None), (None, None, _box(0, 0, 5, 5), 1), ("same", "b0", None, 2), ("same", "b0", None, 2)]
    df = spark.createDataFrame(rows, "key string, b string, wkt string, split int").withColumn("cls", F.lit("clash"))
    got = {tuple(r) for r in overlap.split_overlaps(df, "key", "b", "wkt", "split").collect()}
    ring = {k: [overlap.canonical_ring(r) for r in overlap.parse_rings(w)] for k, _, w, _ in rows if k}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] and b[0] and a[3] == 0 and b[3] in (1, 2) and ((a[1] and a[1] == b[1]) or (ring[a[0]] and ring[b[0]] and overlap.outlines_agree(ring[a[0]], ring[b[0]])))}
    assert got == want and len(want) > 20
    assert overlap.split_overlaps(df.limit(0), "key", "b", "wkt", "split").count() == 0


def test_encoding_equals_the_library(spark):
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", "   ", "\n \n x", "It's 서울시 2024!! don't", "a" * 3000, "ab" * 2000, "<|endoftext|>", "안녕" * 300, "\U0001f600é", "x" * 20000 + " y"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "k long, text string").withColumn("ids", F.lit("clash"))
    got = {r["k"]: r["ids"] for r in tokens.encode(df, "k", "text").collect()}
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)) and got[len(texts)] == []
    assert tokens.encode(df.limit(0), "k", "text").count() == 0


def test_mixing_reaches_shares_within_repeats(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaab") if i % 50 else None, rnd.randint(0, 400)) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "k long, src string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.0, 3)], "src string, target_share double, max_repeats int")
    out = mixing.draw(sizes, targets, "k", "src")
    assert out.agg(F.max(F.when(F.col("src") == "a", F.col("copies")))).first()[0] == 1 and out.agg(F.max("copies")).first()[0] <= 2
    share = {r["src"]: r["reached_share"] for r in mixing.reached_shares(out, targets, "src").collect()}
    assert abs(share["a"] - 0.5) < 0.01 and share["none"] == 0
    assert mixing.draw(sizes.limit(0), targets, "k", "src").count() == 0


def test_nearest_recall_with_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # so that buckets are cut into blocks
    rng = np.random.default_rng(6)
    base = rng.standard_normal((80, 64))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.2, 0.3, 0.4)]).astype(np.float32)
    rows = [(i, 64, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, 64, x[0].tolist()) for i in range(8)] + [(5000, 64, [0.0] * 64), (5001, 64, None), (5002, 3, [1.0] * 3), (5003, 64, [float("nan")] * 64), (None, 64, x[1].tolist())]
    df = spark.createDataFrame(rows, "k long, dim int, e array<float>").withColumn("v", F.lit("clash"))
    got = {(r["id"], r["other"]) for r in neighbours.nearest(neighbours.usable(df, "k", "dim", "e", 64), "k").collect()}
    keys = np.array([r[0] for r in rows[: 320 + 8]])
    m = np.array([r[2] for r in rows[: 320 + 8]], dtype=float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -1)
    want = {(keys[i], keys[j]) for i in range(len(m)) for j in np.lexsort((keys, -s[i].round(6)))[:5] if s[i, j] >= 0.8}
    assert len(got & want) / len(want) > 0.9 and max(map(len, [[1 for a, _ in got if a == 0]])) == 5
    assert neighbours.nearest(neighbours.usable(df.limit(0), "k", "dim", "e", 64), "k").count() == 0


def test_misread_text_is_found_and_restored(spark):
    clean = [f"{a}{b}구_교통시설_{n}.shp" for a in "봄해달별새" for b in "내벌담뫼" for n in (1, 2)] + ["relevé_1_Ø2.shp", "해구_新設_漢1.shp", "달구_新設_漢2.shp", "가구·문화–3"]
    bad = {"솔담구_교통시설_7.shp".encode("cp949").decode("latin-1"): "솔담구_교통시설_7.shp", "솔내구_교통시설_8.shp".encode().decode("latin-1"): "솔내구_교통시설_8.shp", "봄담시_공간시설_9".encode("cp949").decode("gb18030"): "봄담시_공간시설_9"}
    lost = "달벌구_교통".encode("cp949").decode("utf-8", "replace")
    rows = [("f", "s", v) for v in [*clean, *bad, lost, "", None, "plain ascii"]]
    df = spark.createDataFrame(rows, "field string, source string, value string").withColumn("p", F.lit("clash"))
    got = {r["value"]: r["restored"] for r in encoding.misread_values(df).collect()}
    assert got == {**bad, lost: None}
    assert encoding.misread_values(df.limit(0)).count() == 0


def test_linkage_matches_names_across_scripts(spark):
    s = "id string, name string, kind string, x double, y double, addr string, tel string"
    a = [("p1", "둥근너뫼 커피", "cafe", 0.0, 0.0, None, None), ("p2", "Malgeundabeol Optics", "optician", 500.0, 0.0, "봄로 3", None), ("p3", None, None, None, None, None, "+82 31 123 4567"), ("p4", "새터 약국", "pharmacy", 900.0, 0.0, None, None), ("p5", None, None, None, None, None, None)]
    b = [("r1", "(주)둥근너뫼커피", "커피", 10.0, 5.0, None, None), ("r2", "맑은다벌 안경원", "안경점", 505.0, 0.0, "봄로 3 1층", None), ("r3", "가벌 마트", "슈퍼", 1.0, 1.0, None, "031)123-4567"), ("r4", "별내 약국", "약국", 905.0, 0.0, None, None), ("r5", None, None, float("nan"), None, "", "")]
    filler = [(f"{i}", f"{'가나다라마'[i % 5]}{'벌뫼담내실'[i // 5 % 5]}{'터울빛결골'[i // 25]}여 커피", "cafe", 5000.0 + 300 * i, 9.0, None, None) for i in range(60)]
    da = spark.createDataFrame(a + [("p" + f[0] + "x", *f[1:]) for f in filler], s)
    db = spark.createDataFrame(b + [("r" + f[0] + "x", f[1], "커피", *f[3:]) for f in filler] * 2, s)
    got = {(r["a"], r["b"]) for r in linkage.matches(da, db).collect()}
    assert {("p1", "r1"), ("p2", "r2"), ("p3", "r3")} <= got and not any(x == "p4" or x == "p5" for x, _ in got)
    assert sum(x.endswith("x") for x, _ in got) >= 55 and len({x for x, _ in got}) == len(got)
    assert linkage.matches(da.limit(0), db).count() == 0


def test_residue_is_told_from_quotes(spark):
    rnd = random.Random(8)
    who = ["주민", "통장", "상인", "조사원"]
    rows = []
    for i in range(600):
        body = [f"{rnd.choice(who)}은 {rnd.randint(1, 30)}일에 담장을 두 번 재었다.", f"면적은 약 {rnd.randint(100, 999)}이고 둘레는 {rnd.randint(10, 99)}m로 기록되었다.", f"건물 {rnd.randint(1, 99)}동은 두 장면에 걸쳐 있어 따로 표시하였다.", "도로 폭은 좁고 길이는 길며 담장은 오래되어 다시 세워야 한다고 적혀 있다."]
        if i % 10 == 0:
            body.append("문서 틀의 {{이름}} 같은 표기는 발행 전에 모두 채워진다.")
        rows.append((i, " ".join(body * 2)))
    slots = ["{{주소}}", "${street}", "<%= region %>", "[contact]", "__ADDRESS__", "【면적】", "{% area_m2 %}", "@@NAME@@"]
    rows += [(1000 + i, f"안녕하십니까, {slots[i % 8]} 님. {rows[i][1]}") for i in range(40)]
    rows += [(2000 + i, f"Error 50{i % 5}: Bad Gateway\nThe page is temporarily unavailable.") for i in range(20)]
    rows += [(3000 + i, "Lorem ipsum dolor mirelo fugit. " * (1 + i % 3)) for i in range(10)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (4003, "\n".join(r[1] for r in rows[1:300]))]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("slot", F.lit("clash"))
    got = {r["k"]: r["kind"] for r in residue.residue_records(df, "k", "text").collect()}
    assert {k for k in got if k < 1000 or k >= 4000} == set()
    assert all(1000 + i in got for i in range(40)) and all(2000 + i in got for i in range(20)) and all(3000 + i in got for i in range(10))
    assert residue.residue_records(df.limit(0), "k", "text").count() == 0


def test_neighbours_in_waves_are_those_of_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 64))
    x = np.concatenate([x, x + rng.standard_normal(x.shape) * 0.2]).astype(np.float32)
    df = neighbours.usable(spark.createDataFrame([(i, 64, v.tolist()) for i, v in enumerate(x)] + [(3, 64, [9.0] * 64)], "k long, dim int, e array<float>"), "k", "dim", "e", 64)
    v = {r["k"]: r["v"] for r in df.collect()}
    assert set(v) == set(range(120)) and v[3] == pytest.approx([0.125] * 64)  # of two vectors of a key the greatest
    got = []
    for wave in (3, 4000):
        monkeypatch.setattr(neighbours, "WAVE", wave)
        got.append(sorted(map(tuple, neighbours.nearest(df, "k").collect())))
    assert got[0] == got[1] and len(got[0]) > 100
    monkeypatch.setattr(neighbours, "CROWDED_SENT", 0)  # repeated keys and equal vectors by shuffles
    assert sorted(map(tuple, neighbours.nearest(df, "k").collect())) == got[0]
