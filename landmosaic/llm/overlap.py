"""Records of evaluation splits that also stand in the training split."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.runtime import durable

#: Outlines agree if each vertex of either lies so near the other's outline.
AGREE_M = 0.5
#: Vertices match as symbols up to this distance: two edges, each AGREE_M off, move a right-angled corner 0.71 m.
SYMBOL_M = 0.75
#: Edits (vertices left out or put in) that the segment join allows.
EDITS = 2
#: Symbols of an extent string, those of its segment that is looked up, and the size of their cells.
DIRECTIONS, SEGMENT, _EXTENT_CELL = 16, [0, 4, 8, 12], 4.0
_CELL = 3.0
_SPAN = 4.0
_FLAT = 0.3
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")


def parse_rings(wkt: str | None) -> list[np.ndarray]:
    """The rings of a POLYGON or MULTIPOLYGON text, each open (n, 2); [] for anything else."""
    if not wkt or "POLYGON" not in wkt.upper():
        return []
    out = []
    for part in re.findall(r"\(([^()]+)\)", wkt):
        words = part.replace(",", " ").split()
        try:
            if len(words) == 2 * (part.count(",") + 1):
                ring = np.array(words, dtype=float).reshape(-1, 2)
            else:
                ring = np.array([[float(v) for v in _NUMBER.findall(p)[:2]] for p in part.split(",")], dtype=float).reshape(-1, 2)
        except ValueError:
            return []
        if len(ring) > 1 and np.array_equal(ring[0], ring[-1]):
            ring = ring[:-1]
        keep = np.any(ring != np.roll(ring, 1, axis=0), axis=1)
        if keep.any():
            ring = ring[keep]
        if len(ring) >= 3 and np.isfinite(ring).all():
            out.append(ring)
    return out


def canonical_ring(ring: np.ndarray) -> np.ndarray:
    """Counter-clockwise from the least vertex, in millimetres' accuracy."""
    r = np.round(ring, 3) + 0.0
    x, y = r[:, 0], r[:, 1]
    if np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) < 0:
        r = r[::-1]
    return np.roll(r, -int(np.lexsort((r[:, 1], r[:, 0]))[0]), axis=0)


def corners(ring: np.ndarray) -> np.ndarray:
    """The ring without vertices that lie on the line of their neighbours (within _FLAT)."""
    r = ring
    while len(r) > 3:
        a, b = np.roll(r, 1, axis=0), np.roll(r, -1, axis=0)
        d = b - a
        length = np.hypot(d[:, 0], d[:, 1])
        off = np.where(length > 0, np.abs(d[:, 0] * (r[:, 1] - a[:, 1]) - d[:, 1] * (r[:, 0] - a[:, 0])) / np.maximum(length, 1e-9), np.hypot(*(r - a).T))
        i = int(np.argmin(off))
        if off[i] > _FLAT:
            break
        r = np.delete(r, i, axis=0)
    return r


def _off(points: np.ndarray, rings: list[np.ndarray]) -> float:
    """The greatest distance of a point to the outline."""
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    d = b - a
    t = np.clip(((points[:, None] - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-12), 0, 1)
    gap = points[:, None] - (a + t[..., None] * d)
    return float(np.sqrt((gap * gap).sum(-1)).min(axis=1).max())


def outlines_agree(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """The exact check: each vertex of either within AGREE_M of the other's outline."""
    return _off(np.concatenate(a), b) <= AGREE_M + 1e-9 and _off(np.concatenate(b), a) <= AGREE_M + 1e-9


def banded_distance(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Edit distance of two vertex strings, by dynamic programming in a band of width 2 k + 1; k + 1 stands for more."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    same = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) <= SYMBOL_M
    row = {j: j for j in range(min(m, k) + 1)}
    for i in range(1, n + 1):
        new = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            best = row.get(j, k + 1) + 1
            if j:
                best = min(best, new.get(j - 1, k + 1) + 1, row.get(j - 1, k + 1) + (not same[i - 1, j - 1]))
            new[j] = min(best, k + 1)
        row = new
    return row.get(m, k + 1)


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a string of n symbols, or n single ones."""
    parts = min(k + 1, n)
    edge = [i * n // parts for i in range(parts + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(parts)]


def _near(v: float, cell: float, slack: float) -> list[int]:
    return list(range(int(np.floor((v - slack) / cell)), int(np.floor((v + slack) / cell)) + 1))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, wkt, train in zip(b["key"], b["wkt"], b["train"]):
            rings = [canonical_ring(r) for r in parse_rings(wkt)]
            if rings:
                rings.sort(key=lambda r: (-len(r), r.tobytes()))
                cls = hashlib.md5(b"|".join(r.tobytes() for r in rings), usedforsecurity=False).hexdigest()
                rows.append((key, train, cls, [r.ravel() for r in rings]))
        yield pd.DataFrame(rows, columns=["key", "train", "cls", "rings"])


def _grams(training: bool):
    """Index keys of outlines: all substrings of one or two symbols of a training outline, or the segments of an evaluation outline with the cells that their vertices may have moved to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cls, rings in zip(b["cls"], b["rings"]):
                full = np.array(rings[0], dtype=float).reshape(-1, 2)
                c = corners(full)
                w, h = np.ptp(full, axis=0)
                n = len(c)
                cells = np.floor(c / _CELL).astype(int)
                if training:
                    span = f"{int(w // _SPAN)},{int(h // _SPAN)}"
                    for p in range(n):
                        one = f"{cells[p, 0]},{cells[p, 1]}"
                        q = (p + 1) % n
                        out += [(f"{span};{one}", cls, p), (f"{span};{one};{cells[q, 0]},{cells[q, 1]}", cls, p)]
                else:
                    spans = [f"{i},{j}" for i in _near(w, _SPAN, 2 * AGREE_M) for j in _near(h, _SPAN, 2 * AGREE_M)]
                    for p, length in _segments(n, EDITS):
                        keys = [""]
                        for s in range(p, p + min(2, length)):
                            keys = [f"{k};{x},{y}" for k in keys for x in _near(c[s, 0], _CELL, SYMBOL_M) for y in _near(c[s, 1], _CELL, SYMBOL_M)]
                        out += [(s + k, cls, p) for s in spans for k in keys]
            yield pd.DataFrame(out, columns=["key", "cls", "pos"])

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for t, e, shifts, rt, re_ in zip(b["t"], b["e"], b["shifts"], b["rings_t"], b["rings_e"]):
            rt = [np.array(r, dtype=float).reshape(-1, 2) for r in rt]
            re_ = [np.array(r, dtype=float).reshape(-1, 2) for r in re_]
            ct, ce = corners(rt[0]), corners(re_[0])
            # the segment matched after a turn of the training string; edits before it may move that by up to EDITS
            turns = {(int(s) + d) % len(ct) for s in shifts for d in range(-EDITS, EDITS + 1)}
            if any(banded_distance(np.roll(ct, -s, axis=0), ce, EDITS) <= EDITS for s in sorted(turns)) and outlines_agree(rt, re_):
                rows.append((t, e))
        yield pd.DataFrame(rows, columns=["t", "e"])


def _extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cls, s): the string of an outline's extents in DIRECTIONS directions, over all its rings."""
    turn = np.arange(DIRECTIONS) * 2 * np.pi / DIRECTIONS
    way = np.stack([np.cos(turn), np.sin(turn)])
    for b in batches:
        if not len(b):
            continue
        flat = [np.concatenate([np.asarray(r, dtype=float) for r in rings]) for rings in b["rings"]]
        at = np.cumsum([0, *[len(f) // 2 for f in flat[:-1]]])
        high = np.maximum.reduceat(np.concatenate(flat).reshape(-1, 2) @ way, at, axis=0)
        yield pd.DataFrame({"cls": b["cls"], "s": list(high)})


def _extent_keys(training: bool):
    """Index keys of extent strings: the first segment's cells of a training outline, and all cells that those of an evaluation outline may have moved to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            s = np.stack(b["s"].to_numpy())[:, SEGMENT]
            rows, keys = np.arange(len(s)), [np.zeros(len(s), np.int64)]
            for j in range(s.shape[1]):
                low = np.floor((s[:, j] - (0 if training else AGREE_M + 1e-6)) / _EXTENT_CELL).astype(np.int64)
                high = low if training else np.floor((s[:, j] + AGREE_M + 1e-6) / _EXTENT_CELL).astype(np.int64)
                n = (high - low + 1)[rows]
                more = np.repeat(np.arange(len(rows)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                with np.errstate(over="ignore"):
                    keys = [keys[0][more] * np.int64(1_000_003) + low[rows[more]] + step]
                rows = rows[more]
            yield pd.DataFrame({"key": keys[0], "cls": b["cls"].to_numpy()[rows]})

    return run


def _verify_outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for t, e, rt, re_ in zip(b["t"], b["e"], b["rings_t"], b["rings_e"]):
            if outlines_agree([np.asarray(r, dtype=float).reshape(-1, 2) for r in rt], [np.asarray(r, dtype=float).reshape(-1, 2) for r in re_]):
                rows.append((t, e))
        yield pd.DataFrame(rows, columns=["t", "e"])


def _vertex_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes (t, e) by the segment join of vertex strings."""
    index = classes.where("t").select("cls", "rings").mapInPandas(_grams(True), "key string, cls string, pos int")
    probe = classes.where("e").select("cls", "rings").mapInPandas(_grams(False), "key string, cls string, pos int")
    hits = index.withColumnsRenamed({"cls": "t", "pos": "pt"}).join(probe.withColumnsRenamed({"cls": "e", "pos": "pe"}), "key").where("t != e")
    hits = hits.groupBy("t", "e").agg(F.collect_set(F.col("pt") - F.col("pe")).alias("shifts"))  # a set of at most EDITS + 1 times as many turns as vertices
    return _with_rings(hits, classes).mapInPandas(_verify, "t string, e string")


def _extent_candidates(classes: DataFrame) -> DataFrame:
    """All pairs of different classes (t, e) of which no extent differs by more than AGREE_M, by the segment join of extent strings."""
    strings = durable(classes.mapInPandas(_extents, "cls string, s array<double>").join(classes.select("cls", "t", "e"), "cls"))
    index = strings.where("t").select("cls", "s").mapInPandas(_extent_keys(True), "key bigint, cls string").withColumnRenamed("cls", "t")
    probe = strings.where("e").select("cls", "s").mapInPandas(_extent_keys(False), "key bigint, cls string").withColumnRenamed("cls", "e")
    hits = index.join(probe, "key").where("t != e").select("t", "e").distinct()
    hits = hits.join(strings.select(F.col("cls").alias("t"), F.col("s").alias("st")), "t").join(strings.select(F.col("cls").alias("e"), F.col("s").alias("se")), "e")
    near = F.forall(F.zip_with("st", "se", lambda x, y: F.abs(x - y)), lambda d: d <= AGREE_M + 1e-6)
    return hits.where(near).select("t", "e")


def _with_rings(hits: DataFrame, classes: DataFrame) -> DataFrame:
    return hits.join(classes.select(F.col("cls").alias("t"), F.col("rings").alias("rings_t")), "t").join(classes.select(F.col("cls").alias("e"), F.col("rings").alias("rings_e")), "e")


def outline_classes(entities: DataFrame, key: str, wkt: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(members (key, train, cls), pairs (t, e) of classes whose outlines agree within AGREE_M).

    An outline is a string of vertices, turned to start at its least vertex.
    Equal strings form one class; all work is on classes that occur in
    training (split 0) and in evaluation (split 1 or 2). An evaluation string
    is cut into EDITS + 1 segments; at most EDITS edits leave one segment
    whole, so it must occur in the training string, whose substrings are
    indexed at all positions (a ring may start anywhere). A symbol is the grid
    cell of a vertex; an evaluation vertex also probes the cells within
    SYMBOL_M, so no match is lost at cell borders. Long segments are looked up
    by their first two symbols. The key also holds the outline's width and
    height, so that crowded spots split up. Candidates are verified by banded
    dynamic programming at the matched turn and then by the exact distance of
    the outlines.

    Outlines drawn with other corners can agree without such a string. So
    every outline also has a string of fixed length: its extents in DIRECTIONS
    directions. Where outlines agree, no extent differs by more than AGREE_M:
    these strings match without an edit, and one segment of them tells the
    candidates of all pairs that agree. Only classes with such a candidate go
    into the join of vertex strings, and candidates that it doesn't confirm
    are measured too. So nothing is lost, whatever the number or the place of
    the corners, and several rings are covered too.

    Entities with a null key, null split or unreadable outline pair with
    nothing; repeated rows count once.
    """
    e = entities.where(F.col(key).isNotNull() & F.col(wkt).isNotNull() & F.col(split).isin(0, 1, 2))
    e = durable(e.select(F.col(key).alias("key"), F.col(wkt).alias("wkt"), (F.col(split) == 0).alias("train")).distinct())
    members = durable(e.mapInPandas(_read, "key string, train boolean, cls string, rings array<array<double>>"))
    classes = durable(members.groupBy("cls").agg(F.first("rings").alias("rings"), F.max("train").alias("t"), F.max(~F.col("train")).alias("e")))
    likely = durable(_extent_candidates(classes))
    sides = likely.select(F.explode(F.array(F.struct(F.col("t").alias("cls"), F.lit(True).alias("t"), F.lit(False).alias("e")), F.struct(F.col("e").alias("cls"), F.lit(False).alias("t"), F.lit(True).alias("e")))).alias("s")).select("s.*")
    sides = sides.groupBy("cls").agg(F.max("t").alias("t"), F.max("e").alias("e"))
    found = durable(_vertex_pairs(durable(classes.select("cls", "rings").join(sides, "cls"))))
    rest = _with_rings(likely.join(found, ["t", "e"], "left_anti"), classes).mapInPandas(_verify_outlines, "t string, e string")
    pairs = durable(found.unionByName(rest).unionByName(classes.where("t AND e").select(F.col("cls").alias("t"), F.col("cls").alias("e"))))
    return members.select("key", "train", "cls").distinct(), pairs


def outline_overlaps(entities: DataFrame, key: str, wkt: str, split: str) -> DataFrame:
    """Pairs (train, eval) of entities whose outlines agree within AGREE_M; see :func:`outline_classes`."""
    members, pairs = outline_classes(entities, key, wkt, split)
    train = members.where("train").select(F.col("cls").alias("t"), F.col("key").alias("train"))
    held = members.where(~F.col("train")).select(F.col("cls").alias("e"), F.col("key").alias("eval"))
    return pairs.join(train, "t").join(held, "e").select("train", "eval")


def overlap_counts(entities: DataFrame, key: str, entity: str, wkt: str, split: str) -> DataFrame:
    """(eval, partners): for each evaluation entity the number of training entities that :func:`split_overlaps` pairs it with; entities with none are left out.

    Counted per class of outlines and per ``entity`` value, without spelling
    out pairs: partners by outline, plus partners by value, less those by
    both. A key must have one split and one value.
    """
    members, pairs = outline_classes(entities, key, wkt, split)
    e = entities.where(F.col(key).isNotNull() & F.col(split).isin(0, 1, 2))
    value = durable(e.groupBy(F.col(key).alias("key")).agg(F.max(F.col(entity)).alias("value"), (F.min(split) == 0).alias("train")))
    of_class = durable(value.join(members.select("key", "cls"), "key", "left"))
    train, held = of_class.where("train"), of_class.where(~F.col("train"))
    near = pairs.join(train.groupBy(F.col("cls").alias("t")).agg(F.count(F.lit(1)).alias("n")), "t").groupBy(F.col("e").alias("cls")).agg(F.sum("n").alias("by_outline"))
    equal = train.where("value IS NOT NULL").groupBy("value").agg(F.countDistinct("key").alias("by_value"))
    both = pairs.join(train.where("value IS NOT NULL").groupBy(F.col("cls").alias("t"), "value").agg(F.count(F.lit(1)).alias("n")), "t").groupBy(F.col("e").alias("cls"), "value").agg(F.sum("n").alias("by_both"))
    out = held.join(near, "cls", "left").join(equal, "value", "left").join(both, ["cls", "value"], "left")
    n = F.coalesce("by_outline", F.lit(0)) + F.coalesce("by_value", F.lit(0)) - F.coalesce("by_both", F.lit(0))
    return out.select(F.col("key").alias("eval"), n.alias("partners")).where("partners > 0")


def equal_overlaps(entities: DataFrame, key: str, value: str, split: str) -> DataFrame:
    """Pairs (train, eval) of entities with the same ``value``: the segment join with no edits, where the one segment is the whole string."""
    e = entities.where(F.col(key).isNotNull() & F.col(value).isNotNull() & F.col(split).isin(0, 1, 2)).select(key, value, split).distinct()
    train = e.where(F.col(split) == 0).select(F.col(key).alias("train"), value).distinct()
    held = e.where(F.col(split) != 0).select(F.col(key).alias("eval"), value).distinct()
    return train.join(held, value).select("train", "eval")


def split_overlaps(entities: DataFrame, key: str, entity: str, wkt: str, split: str) -> DataFrame:
    """All distinct pairs (train, eval) by equal ``entity`` or agreeing outlines; an entity never pairs with itself."""
    both = equal_overlaps(entities, key, entity, split).unionByName(outline_overlaps(entities, key, wkt, split))
    return both.where("train != eval").distinct()
