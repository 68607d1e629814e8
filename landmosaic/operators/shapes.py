"""Polygons with holes and several parts: WKT, measures, validity, clipping. Arrow batches in, columns out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = np.ndarray
Part = list[Ring]  # the outer ring and its holes, open
_TOKEN = re.compile(r"[A-Z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_DIM = {"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1, "POLYGON": 2, "MULTIPOLYGON": 2}


class Shape:
    """Points, lines and polygon parts of a geometry. Rings are kept as written, without their last point if it closes them."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.points: list[np.ndarray] = []
        self.lines: list[np.ndarray] = []
        self.parts: list[Part] = []
        self.unclosed = False

    @property
    def rings(self) -> list[Ring]:
        return [r for p in self.parts for r in p]


_AREAL = re.compile(r"\s*(MULTI)?POLYGON\s*(\(.*\))\s*", re.I | re.S)
_SIGNS = re.compile(r"\s*([(),])\s*")


def _areal(wkt: str) -> Shape | None:
    """Polygons of two coordinates by splitting at brackets, most texts by far; None where that doesn't do."""
    m = _AREAL.fullmatch(wkt)
    if not m:
        return None
    body, depth = _SIGNS.sub(r"\1", m.group(2)), 3 if m.group(1) else 2
    if not body.startswith("(" * depth) or not body.endswith(")" * depth):
        return None
    shape = Shape()
    shape.kinds.append("MULTIPOLYGON" if m.group(1) else "POLYGON")
    inner = body[depth:-depth]
    for part in inner.split(")),((") if m.group(1) else [inner]:
        rings = []
        for text in part.split("),("):
            words = text.replace(",", " ").split()
            if "(" in text or ")" in text or len(words) != 2 * (text.count(",") + 1):
                return None
            try:
                r = np.array(words, dtype=float).reshape(-1, 2)
            except ValueError:
                return None
            if len(r) > 1 and r[0, 0] == r[-1, 0] and r[0, 1] == r[-1, 1]:
                r = r[:-1]
            else:
                shape.unclosed = True
            rings.append(r)
        shape.parts.append(rings)
    return shape


def parse(wkt: str | None) -> Shape | None:
    """The shape of a WKT text; None for null and for what isn't WKT. EMPTY gives a shape without content."""
    if wkt is None:
        return None
    if quick := _areal(wkt):
        return quick
    t = _TOKEN.findall(wkt.upper())
    at = 0
    shape = Shape()

    def numbers() -> np.ndarray:
        nonlocal at
        rows, row = [], []
        while t[at] not in "()":
            if t[at] == ",":
                rows.append(row[:2])
                row = []
            else:
                row.append(float(t[at]))
            at += 1
        rows.append(row[:2])
        return np.array(rows, dtype=float)

    def nested(depth: int) -> list:
        nonlocal at
        if t[at] != "(":
            raise ValueError
        at += 1
        out = []
        while True:
            if depth == 0:
                out = numbers()
            else:
                out.append(nested(depth - 1))
            if t[at] == ",":
                at += 1
            elif t[at] == ")":
                at += 1
                return out
            else:
                raise ValueError

    def ring(r: np.ndarray) -> Ring:
        if len(r) > 1 and np.array_equal(r[0], r[-1]):
            return r[:-1]
        shape.unclosed = True
        return r

    def one() -> None:
        nonlocal at
        kind = t[at]
        at += 1
        while at < len(t) and t[at] in ("Z", "M", "ZM"):
            at += 1
        shape.kinds.append(kind)
        if at < len(t) and t[at] == "EMPTY":
            at += 1
        elif kind == "GEOMETRYCOLLECTION":
            at += 1
            while True:
                one()
                at += 1
                if t[at - 1] == ")":
                    return
        elif kind == "POINT":
            shape.points.append(nested(0))
        elif kind == "MULTIPOINT":
            shape.points += nested(1) if t[at + 1] == "(" else [nested(0)]
        elif kind == "LINESTRING":
            shape.lines.append(nested(0))
        elif kind == "MULTILINESTRING":
            shape.lines += nested(1)
        elif kind == "POLYGON":
            shape.parts.append([ring(r) for r in nested(1)])
        elif kind == "MULTIPOLYGON":
            shape.parts += [[ring(r) for r in p] for p in nested(2)]
        else:
            raise ValueError

    try:
        one()
    except (ValueError, IndexError):
        return None
    return shape if at == len(t) else None


def _text(points: np.ndarray) -> str:
    return ", ".join(f"{x:.12g} {y:.12g}" for x, y in points)


def polygon_wkt(parts: list[Part]) -> str | None:
    """MULTIPOLYGON text; None without parts."""
    if not parts:
        return None
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(f"({_text(np.concatenate([r, r[:1]]))})" for r in p) + ")" for p in parts) + ")"


def signed_area(r: Ring) -> float:
    if len(r) < 3:
        return 0.0
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def area(parts: list[Part]) -> float:
    """Outer rings less holes."""
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in parts)


def perimeter(parts: list[Part]) -> float:
    """The length of all rings, holes included."""
    return float(sum(np.hypot(*(r - np.roll(r, -1, axis=0)).T).sum() for p in parts for r in p))


def centroid(parts: list[Part]) -> tuple[float, float] | None:
    """Weighted by area."""
    total, cx, cy = 0.0, 0.0, 0.0
    for p in parts:
        for i, r in enumerate(p):
            a = signed_area(r)
            if a == 0:
                continue
            o = r[0]
            x, y = r[:, 0] - o[0], r[:, 1] - o[1]
            xn, yn = np.roll(x, -1), np.roll(y, -1)
            w = x * yn - xn * y
            g = abs(a) * (-1 if i else 1)
            cx += g * (o[0] + float(((x + xn) * w).sum() / (6 * a)))
            cy += g * (o[1] + float(((y + yn) * w).sum() / (6 * a)))
            total += g
    return (cx / total, cy / total) if total > 0 else None


def _crossings(parts: list[Part], y: float) -> np.ndarray:
    out = []
    for r in (r for p in parts for r in p):
        a, b = r, np.roll(r, -1, axis=0)
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        out.append(a[hit, 0] + (y - a[hit, 1]) / (b[hit, 1] - a[hit, 1]) * (b[hit, 0] - a[hit, 0]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0)


def point_on_surface(parts: list[Part]) -> tuple[float, float] | None:
    """The middle of the widest inner run on a horizontal line through the middle of the bounds; the line moves to between vertices if it meets none."""
    if not parts:
        return None
    ys = np.unique(np.concatenate([r[:, 1] for p in parts for r in p]))
    for y in [(ys[0] + ys[-1]) / 2, *((ys[:-1] + ys[1:]) / 2)]:
        x = _crossings(parts, float(y))
        width = x[1::2] - x[: len(x) // 2 * 2 : 2]
        if len(width) and width.max() > 0:
            i = int(width.argmax())
            return float((x[2 * i] + x[2 * i + 1]) / 2), float(y)
    return None


def inside(part: Part, pts: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings of a part."""
    hit = np.zeros(len(pts), bool)
    for r in part:
        a, b = r, np.roll(r, -1, axis=0)
        span = (a[None, :, 1] > pts[:, None, 1]) != (b[None, :, 1] > pts[:, None, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (pts[:, None, 1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        hit ^= (span & (pts[:, None, 0] < x)).sum(axis=1) % 2 == 1
    return hit


def outline_distance(part: Part, pts: np.ndarray) -> np.ndarray:
    a = np.concatenate(part)
    d = np.concatenate([np.roll(r, -1, axis=0) for r in part]) - a
    t = np.clip(((pts[:, None] - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    gap = pts[:, None] - (a + t[..., None] * d)
    return np.sqrt((gap * gap).sum(-1)).min(axis=1)


def signed_distance(parts: list[Part], pts: np.ndarray) -> np.ndarray:
    """Negative inside, positive outside and in holes; of several parts the distance with the least absolute value counts."""
    if not parts:
        return np.full(len(pts), np.nan)
    each = np.stack([np.where(inside(p, pts), -1.0, 1.0) * outline_distance(p, pts) for p in parts])
    return each[np.abs(each).argmin(axis=0), np.arange(len(pts))]


def hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull, by monotone chains."""
    p = np.unique(pts, axis=0)
    if len(p) < 3:
        return p

    def chain(q: np.ndarray) -> list:
        out: list = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _crosses(r: Ring) -> bool:
    """Whether two edges of a ring that aren't neighbours meet."""
    a, b = r, np.roll(r, -1, axis=0)
    n = len(r)

    def side(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])

    for i in range(n - 2):
        j = np.arange(i + 2, n - 1 if i == 0 else n)
        if len(j):
            s, e, u, v = a[i], b[i], a[j], b[j]
            if ((side(s, e, u) * side(s, e, v) <= 0) & (side(u, v, s) * side(u, v, e) <= 0) & (np.minimum(s, e) <= np.maximum(u, v)).all(-1) & (np.minimum(u, v) <= np.maximum(s, e)).all(-1)).any():
                return True
    return False


def fault(s: Shape | None) -> str | None:
    """Why a polygon is invalid; None if it is valid."""
    if s is None:
        return "unreadable"
    if not s.parts:
        return "empty" if not (s.points or s.lines) else "not a polygon"
    for r in s.rings:
        if not np.isfinite(r).all():
            return "not finite"
        if len(r) < 3:
            return "too few points"
    if s.unclosed:
        return "not closed"
    for r in s.rings:
        if (r == np.roll(r, 1, axis=0)).all(axis=1).any():
            return "repeated point"
        if _crosses(r):
            return "self-crossing"
    return None


def repaired(s: Shape | None) -> list[Part]:
    """The parts with rings closed, repeated points and spikes left out; rings that cross themselves or have no area are dropped, and holes with their outer ring."""
    out = []
    for p in s.parts if s else []:
        rings = []
        for i, r in enumerate(p):
            r = r[np.isfinite(r).all(axis=1)]
            while len(r) >= 3:
                a, b = np.roll(r, 1, axis=0), np.roll(r, -1, axis=0)
                bad = (r == a).all(axis=1) | (a == b).all(axis=1)
                if not bad.any():
                    break
                r = np.delete(r, int(bad.argmax()), axis=0)
            good = len(r) >= 3 and abs(signed_area(r)) > 0 and not _crosses(r)
            if good:
                rings.append(r)
            elif i == 0:
                rings = []
                break
        if rings:
            out.append(rings)
    return out


def clip_ring(r: Ring, box: tuple[float, float, float, float]) -> Ring:
    """A ring cut to a box, side by side."""
    for axis, bound, keep in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(r):
            break
        d = keep * (r[:, axis] - bound)
        nxt, dn = np.roll(r, -1, axis=0), np.roll(d, -1)
        out = []
        for p, q, u, v in zip(r, nxt, d, dn):
            if u >= 0:
                out.append(p)
            if (u > 0 > v) or (u < 0 < v):
                out.append(p + (q - p) * (u / (u - v)))
        r = np.array(out).reshape(-1, 2)
    return r


def clip(parts: list[Part], box: tuple[float, float, float, float]) -> list[Part]:
    """Parts cut to a box; those without area left are dropped."""
    out = []
    for p in parts:
        rings = [clip_ring(r, box) for r in p]
        if len(rings[0]) >= 3 and abs(signed_area(rings[0])) > 1e-9:
            out.append([rings[0], *[h for h in rings[1:] if len(h) >= 3 and abs(signed_area(h)) > 1e-9]])
    return out


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker: the points without which the line would be off by more than ``tolerance``."""
    if len(line) < 3:
        return line
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = line[i], line[j] - line[i]
        p = line[i + 1 : j] - a
        t = np.clip((p * d).sum(1) / max(float((d * d).sum()), 1e-300), 0, 1)
        off = np.hypot(*(p - t[:, None] * d).T)
        m = int(off.argmax())
        if off[m] > tolerance:
            k = i + 1 + m
            keep[k] = True
            todo += [(i, k), (k, j)]
    return line[keep]


def regular_points(line: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """(distances, points) at s/2, 3s/2, ... along a line with any number of bends, up to its end."""
    step = np.hypot(*np.diff(line, axis=0).T) if len(line) > 1 else np.zeros(0)
    along = np.concatenate([[0.0], np.cumsum(step)])
    n = int(np.floor(along[-1] / spacing + 0.5))
    at = (np.arange(n) + 0.5) * spacing
    at = at[at <= along[-1] + 1e-9]
    return at, np.stack([np.interp(at, along, line[:, 0]), np.interp(at, along, line[:, 1])], axis=1)


MEASURES = "kinds string, parts int, vertices int, area double, perimeter double, cx double, cy double, px double, py double, hull_area double, xmin double, ymin double, xmax double, ymax double, fault string"


def measures(wkt: str | Column) -> Column:
    """A struct of MEASURES of a WKT column. Null and unreadable texts have a fault and nulls. Vertices don't count closing points."""

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = parse(t)
            if s is None or not s.parts:
                rows.append((None if s is None else ",".join(s.kinds), 0, None, None, None, None, None, None, None, None, None, None, None, None, fault(s)))
                continue
            pts = np.concatenate(s.rings)
            c, o = centroid(s.parts) or (None, None), point_on_surface(s.parts) or (None, None)
            rows.append((",".join(s.kinds), len(s.parts), len(pts), area(s.parts), perimeter(s.parts), *c, *o, abs(signed_area(hull(pts))), *pts.min(axis=0), *pts.max(axis=0), fault(s)))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURES.split(", ")])
        return out.astype({"parts": "Int32", "vertices": "Int32"})

    return run(F.col(wkt) if isinstance(wkt, str) else wkt)


def distance_to(wkt: str, x: Column, y: Column) -> Column:
    """The signed distance of a point to a WKT polygon."""

    @F.pandas_udf("double")
    def run(texts: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([float(signed_distance(s.parts, np.array([[a, b]]))[0]) if (s := parse(t)) and s.parts else None for t, a, b in zip(texts, xs, ys)], dtype="float64")

    return run(F.col(wkt), x, y)


def made_valid(wkt: str) -> Column:
    """MULTIPOLYGON text of the repaired parts; null where nothing is left. Points and lines of collections are left out."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: polygon_wkt(repaired(parse(t))), na_action="ignore")

    return run(F.col(wkt))


def region_cut(df: DataFrame, wkt: str, box: tuple[float, float, float, float]) -> DataFrame:
    """What of each feature lies in a region's box: points that it holds; covered features as they are; others cut to it. Adds ``covered``; what lies outside is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x0, y0, x1, y1 = box
        within = lambda p: ((p[:, 0] >= x0) & (p[:, 0] <= x1) & (p[:, 1] >= y0) & (p[:, 1] <= y1)).all()
        for b in batches:
            texts, covered = [], []
            for t in b[wkt]:
                s = parse(t)
                pts = np.concatenate([*[np.atleast_2d(p) for p in s.points], *s.lines, *s.rings]) if s and (s.points or s.lines or s.parts) else None
                whole = pts is not None and bool(within(pts))
                texts.append(t if whole else polygon_wkt(clip(s.parts, box)) if s else None)
                covered.append(whole)
            yield b.assign(**{wkt: texts, "covered": covered})[lambda d: d[wkt].notna()]

    # features whose bounds miss the box are few to tell by text, so every text is read; where bounds are columns, filter on them first
    from pyspark.sql.types import BooleanType, StructField, StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("covered", BooleanType())]))
