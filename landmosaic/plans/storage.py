"""Queries over readers and writers. Files are made in memory or in the shared folder and read back."""

from __future__ import annotations

import io
import sqlite3
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.operators import shapes
from landmosaic.plans.reference import BOX, PTS, Tables, c, lit, n_, q
from landmosaic.runtime import shared_dir
from landmosaic.sources import files, sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _shapefile(ids: np.ndarray, boxes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """.shp, .shx and .dbf of rectangles."""
    shp, shx, at = b"", b"", 50
    for n, (x0, y0, x1, y1) in enumerate(boxes, 1):
        ring = [x0, y0, x0, y1, x1, y1, x1, y0, x0, y0]
        body = struct.pack("<i4d2ii10d", 5, x0, y0, x1, y1, 1, 5, 0, *ring)
        shp += struct.pack(">2i", n, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 5, *boxes[:, :2].min(0), *boxes[:, 2:].max(0), 0, 0, 0, 0)
    field = lambda name, width: name.encode("cp949").ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    rows = b"".join(b" " + str(i).encode().ljust(10) + f"건물{i % 7}".encode("cp949").ljust(12) for i in ids)
    dbf = struct.pack("<B3BIHH20x", 3, 26, 1, 1, len(ids), 32 + 64 + 1, 23) + field("ID", 10) + field("이름", 12) + b"\r" + rows
    return head(100 + len(shp)) + shp, head(100 + len(shx)) + shx, dbf


def _archives(t: Tables) -> DataFrame:
    """A zip of a shapefile for each kind of box."""

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        kind = d["kind"].iloc[0].replace("#", "")
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for ext, b in zip(("shp", "shx", "dbf"), _shapefile(d["id"].to_numpy(), d[["xmin", "ymin", "xmax", "ymax"]].to_numpy())):
                z.writestr(f"UPIS_UQ{len(kind):03d}_11680/{kind}.{ext}", b)
        return pd.DataFrame({"path": [f"{kind}.zip"], "content": [buffer.getvalue()]})

    return t.box.select("id", "kind", "xmin", "ymin", "xmax", "ymax").groupBy("kind").applyInPandas(pack, "path string, content binary")


_KIND = "replace(kind, '#', '')"
q("S08", f"SELECT {_KIND} || '.zip' AS path, e AS ext, 'UQ' || printf('%03d', len({_KIND})) AS folder, {_KIND} AS stem FROM (SELECT DISTINCT kind FROM {BOX}), (SELECT unnest(['shp', 'shx', 'dbf']) AS e)")(
    lambda t: files.archive_members(_archives(t)).withColumns(files.name_parts("member")).select("path", "ext", F.regexp_extract("member", r"(UQ\d+)", 1).alias("folder"), "stem")
)
q("S09", f"SELECT {_KIND} AS kind, count(*) AS features, min(xmin) AS xmin, max(ymax) AS ymax FROM {BOX} GROUP BY 1")(lambda t: _counted(t))


def _counted(t: Tables) -> DataFrame:
    """Feature counts of index files joined to the headers of their shapefiles."""
    a = _archives(t)
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("kind")
    n = files.index_counts(files.archive_content(a, r"\.shx$")).select(stem, "features")
    return n.join(files.shapefile_headers(files.archive_content(a, r"\.shp$")).select(stem, "xmin", "ymax"), "kind", "left")


def _geopackage(t: Tables) -> DataFrame:
    """A GeoPackage of the boxes of each kind."""

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('boxes', 'geom', 'POLYGON', 5186, 0, 0)")
        db.execute("CREATE TABLE boxes (fid INTEGER PRIMARY KEY, geom BLOB, kind TEXT)")
        for i, k, x0, y0, x1, y1 in d[["id", "kind", "xmin", "ymin", "xmax", "ymax"]].itertuples(index=False):
            blob = b"GP\0\1" + struct.pack("<i", 5186) + struct.pack("<BIII10d", 1, 3, 1, 5, x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)
            db.execute("INSERT INTO boxes VALUES (?, ?, ?)", (int(i), blob, k))
        db.commit()
        return pd.DataFrame({"path": [d["kind"].iloc[0] + ".gpkg"], "content": [db.serialize()]})

    return t.box.select("id", "kind", "xmin", "ymin", "xmax", "ymax").groupBy("kind").applyInPandas(pack, "path string, content binary")


q("S04", f"SELECT id, kind, 5186 AS epsg, area FROM {BOX} UNION ALL SELECT id, replace(kind, '#', ''), 0, area FROM {BOX}")(lambda t: _vector_files(t))


def _vector_files(t: Tables) -> DataFrame:
    """The same boxes read from GeoPackages, and from shapefiles with dBase attributes."""
    size = lambda: F.round(shapes.measures("wkt")["area"], 6).alias("area")
    g = files.geopackage_features(_geopackage(t)).select(c("fid").alias("id"), F.get_json_object("attributes", "$.kind").alias("kind"), "epsg", size())
    a = _archives(t)
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("kind")
    s = files.shapefile_records(files.archive_content(a, r"\.shp$")).select(stem, "feature", size())
    d = files.dbase_rows(files.archive_content(a, r"\.dbf$")).select(stem, "feature", c("values")["ID"].cast("bigint").alias("id"))
    return g.unionByName(s.join(d, ["kind", "feature"]).select("id", "kind", lit(0).alias("epsg"), "area"))


q("S10", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5186 WHEN p_partkey % 3 = 1 THEN 5174 ELSE 4326 END AS epsg FROM part")(
    lambda t: t.part.select("p_partkey", files.preferred_epsg(F.concat("p_name", lit(' PROJCRS ID["EPSG",9122] '), F.when(c("p_partkey") % 3 == 0, 'AUTHORITY["EPSG","5186"] ').when(c("p_partkey") % 3 == 1, 'ID["EPSG",5174] ').otherwise(""), lit('EPSG:4326')), [5186, 5174, 5179]).alias("epsg"))
)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | bytes) -> bytes:
    """A field of a protocol buffer."""
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _zag(values: list) -> bytes:
    return b"".join(_varint((int(v) << 1) ^ (int(v) >> 63)) for v in values)


def _openstreetmap(t: Tables) -> DataFrame:
    """Points as nodes of PBF files, one for each kind; every third has a tag."""

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        step = lambda v: _zag(np.diff([0, *v]))
        tags = b"".join(b"\1\2\0" if i % 3 == 0 else b"\0" for i in d["id"])
        dense = _field(1, step(d["id"])) + _field(8, step(d["y"].astype(int) * 1000)) + _field(9, step(1_270_000_000 + d["x"].astype(int) * 1000)) + _field(10, tags)
        block = _field(1, b"".join(_field(1, w.encode()) for w in ("", "shop", d["kind"].iloc[0]))) + _field(2, _field(2, dense))
        blob = _field(2, len(block)) + _field(3, zlib.compress(block))
        head = _field(1, b"OSMData") + _field(3, len(blob))
        return pd.DataFrame({"path": [d["kind"].iloc[0] + ".osm.pbf"], "content": [len(head).to_bytes(4, "big") + head + blob]})

    return t.pts.groupBy("kind").applyInPandas(pack, "path string, content binary")


q("S13", f"SELECT id AS osm_id, kind AS shop, round(127 + x / 10000, 6) AS lon, round(y / 10000, 6) AS lat FROM {PTS} WHERE id % 3 = 0")(
    lambda t: files.osm_objects(_openstreetmap(t), ["shop"]).select("osm_id", c("tags")["shop"].alias("shop"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
)


def _cp949(t: Tables) -> DataFrame:
    """CSV bytes in CP949, decoded column by column in Arrow batches, two of three columns kept."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": ["x.csv"] * bool(len(b)), "content": [b.to_csv(index=False, header=False).encode("cp949", "replace")] * bool(len(b))})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.read_csv(io.BytesIO(bytes(content)), encoding="cp949", header=None, names=["sigungu_cd", "sigungu_nm", "sido_cd"], usecols=["sigungu_cd", "sigungu_nm"], dtype=str)

    d = t.bnd_sigungu.where("sigungu_nm RLIKE '^[가-힣 ]+$'").select("sigungu_cd", F.trim("sigungu_nm").alias("sigungu_nm"), "sido_cd")
    return d.mapInPandas(write, "path string, content binary").mapInPandas(read, "sigungu_cd string, sigungu_nm string")


q("S11", "SELECT sigungu_cd, trim(sigungu_nm) AS sigungu_nm FROM bnd_sigungu WHERE regexp_full_match(sigungu_nm, '[가-힣 ]+')")(_cp949)


def _codebook(t: Tables) -> DataFrame:
    """A spreadsheet of the nations on two sheets, searched for a word on one of them."""

    def sheet(rows: list[tuple]) -> str:
        cell = lambda r, i, v: f'<c r="{"ABC"[i]}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        return '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(r, i, v) for i, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        d, buffer = d.sort_values("n_nationkey"), io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet(list(d[["n_nationkey", "n_name"]].itertuples(index=False))))
            z.writestr("xl/worksheets/sheet2.xml", sheet([("other", "NATION_1")]))
        return pd.DataFrame({"path": ["codes.xlsx"], "content": [buffer.getvalue()]})

    book = t.nation.withColumn("one", lit(1)).groupBy("one").applyInPandas(pack, "path string, content binary")  # 25 rows at any size
    cells = files.spreadsheet_cells(book).where("sheet = 1")
    return cells.where(F.concat_ws(" ", "cells").rlike("(?i)nation_1")).select(c("cells")[0].cast("int").alias("code"), c("cells")[1].alias("label"))


q("S12", "SELECT n_nationkey AS code, n_name AS label FROM nation WHERE regexp_matches(n_name, '(?i)nation_1')")(_codebook)
q("S03", "SELECT CAST(column_index AS INTEGER) AS place, column_name AS name, (SELECT count(*) FROM orders) AS rows FROM (SELECT 0 AS column_index, 'o_orderkey' AS column_name UNION ALL SELECT 1, 'o_custkey' UNION ALL SELECT 2, 'o_orderstatus' UNION ALL SELECT 3, 'o_totalprice' UNION ALL SELECT 4, 'o_orderdate' UNION ALL SELECT 5, 'o_orderpriority')")(lambda t: files.schema_of(t.orders).select("place", "name", "rows"))


def _lines(t: Tables) -> DataFrame:
    """Events as JSON lines, read with a schema; the last row of each user counts."""
    from landmosaic.operators.relational import latest

    path = _folder(t, "jsonl")
    t.events.select("user_id", "event_id", "event_type").write.json(path)
    return latest(t.spark.read.json(path, "user_id bigint, event_id bigint, event_type string"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


q("S15", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")(_lines)


def _parts(t: Tables) -> DataFrame:
    """Parts of a table in the order of a manifest, which must cover all ids once."""
    base = _folder(t, "parts")
    for i, odd in enumerate(("vec_id % 2 = 0", "vec_id % 2 = 1")):
        t.embeddings.where(odd).select("vec_id", "label").write.parquet(f"{base}/part-{i}")
    manifest = [(1, f"{base}/part-1"), (0, f"{base}/part-0")]
    paths = [p for _, p in sorted(manifest)]
    d = t.spark.read.parquet(*paths)
    return d.agg(n_(), (F.count("vec_id") - F.countDistinct("vec_id")).alias("repeats"), F.sum("label").alias("labels"))


q("S16", "SELECT count(*) AS n, 0::BIGINT AS repeats, CAST(sum(label) AS BIGINT) AS labels FROM embeddings")(_parts)


def _range(t: Tables) -> DataFrame:
    """Rows 100 to 349 in order of the key: a distributed top-k, so only these pass through one task."""
    top = t.orders.select("o_orderkey").orderBy("o_orderkey").limit(350)
    return top.exceptAll(t.orders.select("o_orderkey").orderBy("o_orderkey").limit(100))


q("S06", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 100 AND r <= 350")(_range)


def _boxed(t: Tables) -> DataFrame:
    """Boxes laid out by cell when written, so that a bounded scan skips files by their minimum and maximum."""
    path = _folder(t, "boxes")
    t.box.repartitionByRange(8, F.floor(c("xmin") / 3000), F.floor(c("ymin") / 3000), "id").sortWithinPartitions("xmin", "ymin").write.parquet(path)
    return t.spark.read.parquet(path).where("xmin < 3000 AND xmax > 1000 AND ymin < 3000 AND ymax > 1000").select("id", "kind")


q("S05", f"SELECT id, kind FROM {BOX} WHERE xmin < 3000 AND xmax > 1000 AND ymin < 3000 AND ymax > 1000")(_boxed)


def _answers(t: Tables) -> DataFrame:
    """Metadata requests through a client that fails now and then; here one that answers by arithmetic."""
    seen: dict[str, int] = {}

    def get(r: str) -> tuple[int, str]:
        seen[r] = seen.get(r, 0) + 1
        i = int(r.rsplit("=", 1)[1])
        if i % 10 == 3 and seen[r] == 1:
            raise ConnectionError("reset")
        return (404, "not json") if i % 10 == 7 else (503, "") if i % 10 == 9 else (200, f'{{"status":"OK","pano":{i}}}')

    d = t.customer.select("c_custkey", F.concat(lit("https://example.org/meta?id="), c("c_custkey")).alias("r"))
    out = files.fetched(d, "c_custkey", "r", get)
    return out.select("c_custkey", "code", "attempts", F.get_json_object("body", "$.status").alias("status"))


q("S14", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 7 THEN 404 WHEN c_custkey % 10 = 9 THEN 503 ELSE 200 END AS code, CASE c_custkey % 10 WHEN 3 THEN 2 WHEN 9 THEN 3 ELSE 1 END AS attempts, CASE WHEN c_custkey % 10 NOT IN (7, 9) THEN 'OK' END AS status FROM customer")(_answers)


def _fallbacks(t: Tables) -> DataFrame:
    """A chain of addresses: another panorama, another zoom, another end point; the first that answers counts."""

    def get(r: str) -> tuple[int, str]:
        i, step = (int(x) for x in r.rsplit("=", 1)[1].split("-"))
        return (200, "x") if i % 4 == step else (404, "")

    d = t.customer.select("c_custkey", F.array(*[F.concat(lit("https://example.org/?id="), c("c_custkey"), lit(f"-{i}")) for i in range(3)]).alias("r"))
    return files.fetched(d, "c_custkey", "r", get).select("c_custkey", "place", "code", "attempts")


q("D12", "SELECT c_custkey, CAST(least(c_custkey % 4 + 1, 3) AS INTEGER) AS place, CASE WHEN c_custkey % 4 < 3 THEN 200 ELSE 404 END AS code, CAST(least(c_custkey % 4 + 1, 3) AS INTEGER) AS attempts FROM customer")(_fallbacks)


# ---- sinks: written, read back ---------------------------------------------------------------------------------------
def _written(t: Tables) -> DataFrame:
    path = _folder(t, "table")
    sinks.write_table(t.customer, path)
    return t.spark.read.parquet(path).select("c_custkey", "c_name")


q("K01", "SELECT c_custkey, c_name FROM customer")(_written)


def _upserted(t: Tables) -> DataFrame:
    path = _folder(t, "upsert")
    sinks.upsert_table(t.customer.select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v")), path, ["k"])
    new = t.customer.where("c_custkey % 3 = 0").select(F.explode(F.array(c("c_custkey"), c("c_custkey") + 100000000)).alias("k"), lit("new").alias("v"))
    sinks.upsert_table(new, path, ["k"])
    return t.spark.read.parquet(path)


q("K02", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT c_custkey + 100000000, 'new' FROM customer WHERE c_custkey % 3 = 0")(_upserted)


def _two(t: Tables) -> DataFrame:
    path = _folder(t, "split")
    sinks.write_split(t.box.select("id", "kind", F.format_string("POINT (%.0f %.0f)", "xmin", "ymin").alias("wkt")), path, "id", "wkt")
    return t.spark.read.parquet(f"{path}/geometry").join(t.spark.read.parquet(f"{path}/attributes"), "id")


q("K03", f"SELECT id, kind, 'POINT (' || CAST(xmin AS BIGINT) || ' ' || CAST(ymin AS BIGINT) || ')' AS wkt FROM {BOX}")(_two)


def _lineage(t: Tables) -> DataFrame:
    path = _folder(t, "wkt")
    sinks.write_table(sinks.with_lineage(t.pts.select("id", F.format_string("POINT (%.0f %.0f)", "x", "y").alias("geometry_wkt")), "r1", "customer.parquet", "points"), path)
    return t.spark.read.parquet(path).select("id", "geometry_wkt", "geometry_format", "region", "source_path", "method", (F.length("created_at") == 20).alias("dated"))


q("K04", f"SELECT id, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS geometry_wkt, 'WKT_EPSG_5186' AS geometry_format, 'r1' AS region, 'customer.parquet' AS source_path, 'points' AS method, true AS dated FROM {PTS}")(_lineage)


def _merged(t: Tables) -> DataFrame:
    """Chunks with differing columns, written apart and merged by name."""
    base = _folder(t, "chunks")
    t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name")).write.parquet(f"{base}/c=1")
    t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("bal")).write.parquet(f"{base}/c=2")
    sinks.write_table(t.spark.read.option("mergeSchema", "true").parquet(base).drop("c"), f"{base}.merged")
    return t.spark.read.parquet(f"{base}.merged").select("id", "name", "bal")


q("K05", "SELECT p_partkey AS id, p_name AS name, NULL::DOUBLE AS bal FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")(_merged)


def _shards(t: Tables) -> DataFrame:
    """Shards written twice, the second time with one shard changed: the others are resumed."""
    path = _folder(t, "shards")
    d = t.orders.select("o_orderkey", "o_custkey", F.floor(c("o_orderkey") / 3000).alias("shard"))
    sinks.write_shards(d, path, "shard", ["o_orderkey", "o_custkey"])
    m = sinks.write_shards(d.withColumn("o_custkey", F.when(c("o_orderkey") == 4000, lit(0)).otherwise(c("o_custkey"))), path, "shard", ["o_orderkey", "o_custkey"])
    back = t.spark.read.parquet(f"{path}/data").groupBy(c("shard").cast("bigint").alias("shard")).agg(F.count(lit(1)).alias("read"), F.sum("o_custkey").alias("custkeys"))
    return m.join(back, "shard").select("shard", "rows", "resumed", "read", "custkeys")


q("K06", "SELECT CAST(o_orderkey // 3000 AS BIGINT) AS shard, count(*) AS rows, o_orderkey // 3000 <> 4000 // 3000 AS resumed, count(*) AS read, CAST(sum(CASE WHEN o_orderkey = 4000 THEN 0 ELSE o_custkey END) AS BIGINT) AS custkeys FROM orders GROUP BY 1, 3")(_shards)


def _reports(t: Tables) -> DataFrame:
    """Reports of a small table in three formats, read back."""
    base = _folder(t, "report")
    d = t.region.select("r_regionkey", F.concat("r_name", lit("|x")).alias("name"))
    for kind in ("json", "csv", "md"):
        sinks.write_report(d, f"{base}.{kind}", kind)
    md = t.spark.read.text(f"{base}.md").where(c("value").rlike(r"^\| \d")).select(lit("md").alias("kind"), F.regexp_replace(F.regexp_extract("value", r"\| \d+ \| (.*) \|", 1), r"\\\|", "|").alias("name"))
    return md.union(t.spark.read.json(f"{base}.json").select(lit("json"), "name")).union(t.spark.read.option("header", "true").csv(f"{base}.csv").select(lit("csv"), "name"))


q("K07", "SELECT k AS kind, r_name || '|x' AS name FROM region, (SELECT unnest(['json', 'csv', 'md']) AS k)")(_reports)


def _guarded(t: Tables) -> DataFrame:
    """What each guard leaves: refuse, skip, keep a backup."""
    path = _folder(t, "guard")
    d = lambda v: t.region.select("r_regionkey", lit(v).alias("v"))
    sinks.write_table(d("first"), path)
    try:
        sinks.write_table(d("second"), path)
        refused = False
    except FileExistsError:
        refused = True
    skipped = not sinks.write_table(d("third"), path, "skip")
    sinks.write_table(d("fourth"), path, "backup")
    return t.spark.read.parquet(path).join(t.spark.read.parquet(path + ".bak").withColumnRenamed("v", "kept"), "r_regionkey").select("r_regionkey", "v", "kept", lit(refused).alias("refused"), lit(skipped).alias("skipped"))


q("K08", "SELECT r_regionkey, 'fourth' AS v, 'first' AS kept, true AS refused, true AS skipped FROM region")(_guarded)


def _aliased(t: Tables) -> DataFrame:
    sinks.alias_tables(t.spark, {"nation": f"{t.dir}/nation.parquet", "region": f"{t.dir}/region.parquet"}, "whole")
    return t.spark.sql("SELECT n_nationkey, r_name FROM whole_nation JOIN whole_region ON n_regionkey = r_regionkey")


q("K09", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(_aliased)


_FEATURE = "'{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(x + 0.5::DOUBLE AS VARCHAR) || ',' || CAST(y + 0.5::DOUBLE AS VARCHAR) || ']}}'"


def _layers(t: Tables) -> DataFrame:
    """Two layers of a map, each with its own bound."""
    p = t.pts.withColumns({"x": c("x") + 0.5, "y": c("y") + 0.5})
    return sinks.map_features(p, "all", "id", "x", "y", 100).union(sinks.map_features(p.where("kind = 'BUILDING'"), "building", "id", "x", "y", 30))


q("K10", f"SELECT * FROM (SELECT 'all' AS layer, id AS key, {_FEATURE} AS feature FROM {PTS} ORDER BY id LIMIT 100) UNION ALL SELECT * FROM (SELECT 'building', id, {_FEATURE} FROM {PTS} WHERE kind = 'BUILDING' ORDER BY id LIMIT 30)")(_layers)
