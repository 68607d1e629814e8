"""Archives, shapefiles, GeoPackages, dBase and spreadsheet files.

Every reader takes a DataFrame with ``path`` and ``content``, as
``spark.read.format("binaryFile")`` gives it, and decodes each file in the
task that holds it. So files are read in parallel, from any file system, and
columns that aren't asked for are never sent. A file that can't be read gives
one row with ``error``, where the reader has that column, and else none.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.operators.shapes import polygon_wkt, signed_area


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _each(files: DataFrame, rows: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                found = rows(path, bytes(content))
                for start in range(0, len(found), 10_000):
                    yield pd.DataFrame(found[start : start + 10_000], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, size, error): the list of each zip archive, names in CP949 or UTF-8."""

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            out = []
            for i in zipfile.ZipFile(io.BytesIO(content)).infolist():
                name = i.filename
                if not i.flag_bits & 0x800:  # not marked as UTF-8, so read as CP437
                    try:
                        name = name.encode("cp437").decode("cp949")
                    except UnicodeError:
                        pass
                out.append((path, name, i.file_size, None))
            return out
        except (zipfile.BadZipFile, ValueError) as e:
            return [(path, None, None, str(e))]

    return _each(files, rows, "path string, member string, size bigint, error string")


def archive_content(files: DataFrame, pattern: str) -> DataFrame:
    """(path, content) of the members whose name matches, as files of their own: ``archive!member``."""

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            return [(f"{path}!{n}", z.read(n)) for n in z.namelist() if re.search(pattern, n)]
        except zipfile.BadZipFile:
            return []

    return _each(files, rows, "path string, content binary")


def name_parts(c: str) -> dict[str, Column]:
    """Extension, layer code, region code and stem of a file name."""
    base = F.regexp_replace(c, r"^.*[/!\\]", "")
    return {"ext": F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1)), "layer": F.regexp_extract(F.upper(base), r"(U[A-Z]{2}\d+)", 1), "region": F.regexp_extract(base, r"(?<!\d)(\d{5})(?!\d)", 1), "stem": F.regexp_replace(base, r"\.[^.]*$", "")}


_SHAPES = {0: "NULL", 1: "POINT", 3: "LINESTRING", 5: "POLYGON", 8: "MULTIPOINT", 11: "POINT", 13: "LINESTRING", 15: "POLYGON"}


def index_counts(files: DataFrame) -> DataFrame:
    """(path, features): from the length in a .shx file's header, (length - 100) / 8."""
    return _each(files, lambda path, b: [(path, (2 * struct.unpack(">i", b[24:28])[0] - 100) // 8)] if len(b) >= 100 else [], "path string, features bigint")


def shapefile_headers(files: DataFrame) -> DataFrame:
    """(path, kind, xmin, ymin, xmax, ymax) of .shp files."""
    return _each(files, lambda path, b: [(path, _SHAPES.get(struct.unpack("<i", b[32:36])[0]), *struct.unpack("<4d", b[36:68]))] if len(b) >= 100 else [], "path string, kind string, xmin double, ymin double, xmax double, ymax double")


def _record(b: bytes) -> str | None:
    kind = struct.unpack("<i", b[:4])[0] % 10
    if kind == 1:
        return "POINT ({:.12g} {:.12g})".format(*struct.unpack("<2d", b[4:20]))
    if kind not in (3, 5):
        return None
    n, m = struct.unpack("<2i", b[36:44])
    at = [*struct.unpack(f"<{n}i", b[44 : 44 + 4 * n]), m]
    xy = np.frombuffer(b, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2)
    rings = [xy[i:j] for i, j in zip(at, at[1:])]
    if kind == 3:
        return "MULTILINESTRING (" + ", ".join("(" + ", ".join(f"{x:.12g} {y:.12g}" for x, y in r) + ")" for r in rings) + ")"
    parts: list[list[np.ndarray]] = []
    for r in (r[:-1] for r in rings):  # outer rings run clockwise, their holes follow
        if signed_area(r) <= 0 or not parts:
            parts.append([r])
        else:
            parts[-1].append(r)
    return polygon_wkt(parts)


def shapefile_records(files: DataFrame) -> DataFrame:
    """(path, feature, wkt) of .shp files; points, lines and polygons, Z and M left out."""

    def rows(path: str, b: bytes) -> list[tuple]:
        out, at = [], 100
        while at + 8 <= len(b):
            number, words = struct.unpack(">2i", b[at : at + 8])
            out.append((path, number, _record(b[at + 8 : at + 8 + 2 * words])))
            at += 8 + 2 * words
        return out

    return _each(files, rows, "path string, feature int, wkt string")


def dbase_rows(files: DataFrame, encoding: str = "cp949") -> DataFrame:
    """(path, feature, values map<string,string>) of .dbf files; empty fields are null."""

    def rows(path: str, b: bytes) -> list[tuple]:
        n, head, size = struct.unpack("<IHH", b[4:12])
        fields, at = [], 32
        while b[at] != 0x0D:
            fields.append((b[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), b[at + 16]))
            at += 32
        out = []
        for i in range(n):
            r, at, values = b[head + i * size : head + (i + 1) * size], 1, []
            for name, width in fields:
                values.append((name, r[at : at + width].decode(encoding, "replace").strip() or None))
                at += width
            out.append((path, i + 1, values))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p, i, dict(v)) for p, i, v in rows(path, bytes(content))], columns=["path", "feature", "values"])

    return files.select("path", "content").mapInPandas(run, "path string, feature int, values map<string,string>")


def _well_known(b: bytes, at: int = 0) -> tuple[str, int]:
    """(text, end) of a WKB geometry at ``at``; Z and M left out."""
    o = "<" if b[at] else ">"
    kind = struct.unpack(o + "I", b[at + 1 : at + 5])[0]
    kind, dims = kind & 0xFF if kind < 1000 else kind % 1000, 2 + bool(kind & 0x80000000) + (kind // 1000 in (1, 3)) if kind < 1000 or kind & 0x80000000 else 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    at += 5

    def points(n: int) -> tuple[str, int]:
        xy = np.frombuffer(b, o + "f8", n * dims, at).reshape(n, dims)[:, :2]
        return ", ".join(f"{x:.12g} {y:.12g}" for x, y in xy), at + 8 * n * dims

    def count() -> int:
        nonlocal at
        n = struct.unpack(o + "I", b[at : at + 4])[0]
        at += 4
        return n

    if kind == 1:
        text, at = points(1)
        return f"POINT ({text})", at
    if kind == 2:
        text, at = points(count())
        return f"LINESTRING ({text})", at
    if kind == 3:
        rings = []
        for _ in range(count()):
            text, at = points(count())
            rings.append(f"({text})")
        return f"POLYGON ({', '.join(rings)})", at
    parts = []
    for _ in range(count()):
        text, at = _well_known(b, at)
        parts.append(text)
    name = {4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}[kind]
    if name != "GEOMETRYCOLLECTION":
        parts = [p.split(" ", 1)[1] for p in parts]
    return f"{name} ({', '.join(parts)})", at


def geopackage_features(files: DataFrame, where: str = "1 = 1") -> DataFrame:
    """(path, layer, fid, epsg, wkt, attributes): the features of all layers; attributes as JSON. ``where`` is pushed into each layer's scan."""

    def rows(path: str, content: bytes) -> list[tuple]:
        db = sqlite3.connect(":memory:")
        db.deserialize(content)
        out = []
        for layer, column, srs in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall():
            cur = db.execute(f'SELECT rowid, * FROM "{layer}" WHERE {where}')
            names = [d[0] for d in cur.description]
            g = names.index(column)
            for r in cur:
                wkt = None
                if r[g] is not None:
                    head = 8 + (0, 32, 48, 48, 64)[r[g][3] >> 1 & 7]
                    wkt = _well_known(bytes(r[g]), head)[0]
                out.append((path, layer, r[0], srs, wkt, json.dumps({n: v for i, (n, v) in enumerate(zip(names, r)) if i and i != g}, ensure_ascii=False, sort_keys=True)))
        db.close()
        return out

    return _each(files, rows, "path string, layer string, fid bigint, epsg int, wkt string, attributes string")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def spreadsheet_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, line, cells array<string>) of .xlsx files; sheets by number, empty cells as null."""

    def rows(path: str, content: bytes) -> list[tuple]:
        z = zipfile.ZipFile(io.BytesIO(content))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in i.iter(f"{{{_NS['m']}}}t")) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        out = []
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in ElementTree.fromstring(z.read(name)).iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for cell in row.findall("m:c", _NS):
                    at = 0
                    for ch in re.match(r"[A-Z]+", cell.get("r", "A")).group():
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - 1 - len(cells))
                    v = cell.find("m:v", _NS)
                    text = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) if v is None else v.text
                    cells.append(shared[int(text)] if cell.get("t") == "s" and text else text or None)
                out.append((path, int(re.search(r"\d+", name).group()), int(row.get("r", 0)), cells))
        return out

    return _each(files, rows, "path string, sheet int, line int, cells array<string>")


def preferred_epsg(text: str | Column, order: list[int]) -> Column:
    """The first of ``order`` among the EPSG codes that a layer's description names; else its last code; null without one."""
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"EPSG[\"',: ]+(\d+)"), F.lit(1))
    best = F.element_at(F.filter(F.array(*[F.lit(str(o)) for o in order]), lambda o: F.array_contains(found, o)), 1)
    return F.coalesce(F.when(F.exists(F.array(*[F.lit(str(o)) for o in order]), lambda o: F.array_contains(found, o)), best), F.try_element_at(found, F.lit(-1))).cast("int")


def schema_of(df: DataFrame) -> DataFrame:
    """(place, name, type, rows): the columns and, from the footers alone, the number of rows."""
    n = df.select().groupBy().count().select(F.col("count").alias("rows"))
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "place int, name string, type string")
    return names.join(F.broadcast(n))


def attempted(get: Callable[[str], tuple[int, str]], request: str, tries: int, wait: Callable[[int], None] | None) -> tuple[int | None, str | None, str | None, int]:
    """(code, body, error, attempts) of one address; again after an error or a code of 429 or 500 and above."""
    code, body, error, n = None, None, None, 0
    for n in range(1, tries + 1):
        try:
            code, body, error = *get(request), None
        except Exception as e:  # noqa: BLE001 - whatever the client raises is a failed attempt
            code, body, error = None, None, str(e)
        if code is not None and code < 500 and code != 429:
            break
        if wait and n < tries:
            wait(n)
    return code, body, error, n


def fetched(df: DataFrame, key: str, requests: str, get: Callable[[str], tuple[int, str]], tries: int = 3, wait: Callable[[int], None] | None = None) -> DataFrame:
    """(key, place, code, body, error, attempts): the first address of an array, or the one address, that answers with 200; else what the last one gave.

    ``get`` is given by the caller, who decides on the client; ``wait`` is
    called with the number of the attempt before another one, for back-off. A
    row without addresses has place 0 and nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, r in zip(b[key], b[requests]):
                got, place, total = (None, None, None, 0), 0, 0
                for place, one in enumerate([] if r is None else [r] if isinstance(r, str) else r, 1):
                    got = attempted(get, one, tries, wait)
                    total += got[3]
                    if got[0] == 200:
                        break
                out.append((k, place, *got[:3], total))
            yield pd.DataFrame(out, columns=[key, "place", "code", "body", "error", "attempts"]).astype({"code": "Int32", "place": "int32", "attempts": "int32"})

    return df.select(key, requests).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, place int, code int, body string, error string, attempts int")


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer: integers and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            x = b[at]
            at += 1
            n |= (x & 127) << shift
            if x < 128:
                return n
            shift += 7

    while at < len(b):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, b[at : at + size]
            at += size
        else:
            at += 8 if tag & 7 == 1 else 4


def _packed(b: bytes, signed: bool) -> np.ndarray:
    """The integers of a packed field."""
    x = np.frombuffer(b, np.uint8).astype(np.int64)
    ends = np.flatnonzero(x < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    shift = 7 * (np.arange(len(x)) - np.repeat(starts, ends - starts + 1))
    n = np.add.reduceat((x & 127) << shift, starts) if len(ends) else np.zeros(0, np.int64)
    return (n >> 1) ^ -(n & 1) if signed else n


def osm_objects(files: DataFrame, tags: list[str]) -> DataFrame:
    """(path, kind, osm_id, lon, lat, refs, tags) of the nodes and ways of .osm.pbf files that carry one of ``tags``.

    Ways have the ids of their nodes in ``refs``; nodes without such a tag are
    left out. Blocks are compressed with zlib, as is usual, or not at all.
    """
    wanted = set(tags)

    def block(b: bytes) -> Iterator[tuple]:
        scale, groups, words, shift = 100, [], [], [0, 0]
        for k, v in _fields(b):
            if k == 1:
                words = [w.decode("utf-8", "replace") for _, w in _fields(v)]
            elif k == 2:
                groups.append(v)
            elif k == 17:
                scale = v
            elif k in (19, 20):
                shift[k - 19] = v
        degree = lambda n, i: (shift[i] + scale * int(n)) * 1e-9
        for kind, v in (f for g in groups for f in _fields(g)):
            if kind == 1 or kind == 3:
                m: dict[int, int | bytes] = dict(_fields(v))
                t = {words[a]: words[z] for a, z in zip(_packed(m.get(2, b""), False), _packed(m.get(3, b""), False))}
                if wanted & t.keys():
                    zag = lambda n: (n >> 1) ^ -(n & 1)
                    if kind == 1:
                        yield "node", zag(m[1]), degree(zag(m[9]), 1), degree(zag(m[8]), 0), None, t
                    else:
                        yield "way", m[1], None, None, np.cumsum(_packed(m.get(8, b""), True)).tolist(), t
            elif kind == 2:
                m = dict(_fields(v))
                ids, lat, lon = (np.cumsum(_packed(m.get(i, b""), True)) for i in (1, 8, 9))
                pairs, at = _packed(m.get(10, b""), False), 0
                for i in range(len(ids)):
                    t = {}
                    while at < len(pairs) and pairs[at]:
                        t[words[pairs[at]]] = words[pairs[at + 1]]
                        at += 2
                    at += 1
                    if wanted & t.keys():
                        yield "node", int(ids[i]), degree(lon[i], 1), degree(lat[i], 0), None, t

    def rows(path: str, b: bytes) -> list[tuple]:
        out, at = [], 0
        while at + 4 <= len(b):
            n = struct.unpack(">I", b[at : at + 4])[0]
            head = dict(_fields(b[at + 4 : at + 4 + n]))
            at += 4 + n
            blob = dict(_fields(b[at : at + head[3]]))
            at += head[3]
            if head[1] == b"OSMData":
                out += [(path, *r) for r in block(blob[1] if 1 in blob else zlib.decompress(blob[3]))]
        return out

    return _each(files, rows, "path string, kind string, osm_id bigint, lon double, lat double, refs array<bigint>, tags map<string,string>")
