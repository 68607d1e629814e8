"""Signed-distance samples of polygons, seeded per entity."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.functions.text import unit_hash
from landmosaic.operators import shapes

SCHEMA = "entity bigint, x double, y double, sdf double, sample_kind smallint, sample_index int"


def sdf_samples(df: DataFrame, key: str, wkt: str, per_unit: float, per_point: int, grid: int, band: float = 0.08, reach: float = 0.6) -> DataFrame:
    """Samples of each shape, moved to its bounds' centre and scaled by their longer side: vertices (kind 0), ``per_point`` near each vertex (1), ``per_unit`` times the outline's length in a band around it (2), a grid over +-reach (3).

    Each entity has its own generator, seeded by a hash of its key, so samples
    don't depend on the batch or its order. Shapes without a polygon have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["entity"], b["wkt"]):
                s = shapes.parse(text)
                if s is None or not s.parts:
                    continue
                pts = np.concatenate(s.rings)
                low, high = pts.min(axis=0), pts.max(axis=0)
                middle, side = (low + high) / 2, max(float((high - low).max()), 1e-9)
                parts = [[(r - middle) / side for r in p] for p in s.parts]
                rnd = random.Random(int.from_bytes(hashlib.sha256(f"sdf|{k}".encode()).digest()[:8], "little"))
                at = [(x, y, 0) for p in parts for r in p for x, y in r]
                at += [(x + rnd.gauss(0, band), y + rnd.gauss(0, band), 1) for x, y, _ in list(at) for _ in range(per_point)]
                for r in (r for p in parts for r in p):
                    for a, z in zip(r, np.roll(r, -1, axis=0)):
                        d = z - a
                        length = float(np.hypot(*d))
                        for _ in range(int(length * per_unit)):
                            t, off = rnd.random(), rnd.uniform(-band, band)
                            at.append((a[0] + t * d[0] - off * d[1] / length, a[1] + t * d[1] + off * d[0] / length, 2))
                line = np.linspace(-reach, reach, grid) if grid else []
                at += [(x, y, 3) for y in line for x in line]
                xy = np.array([(x, y) for x, y, _ in at])
                sdf = shapes.signed_distance(parts, xy)
                out.append(pd.DataFrame({"entity": k, "x": xy[:, 0], "y": xy[:, 1], "sdf": sdf, "sample_kind": np.array([v for *_, v in at], "int16"), "sample_index": np.arange(len(at), dtype="int32")}))
            yield pd.concat(out) if out else pd.DataFrame({"entity": [], "x": [], "y": [], "sdf": [], "sample_kind": [], "sample_index": []})

    return df.where(F.col(wkt).isNotNull()).select(F.col(key).cast("bigint").alias("entity"), F.col(wkt).alias("wkt")).mapInPandas(run, SCHEMA)


def validation_bit(seed: str, ratio: float, *cs: str) -> Column:
    """1 for validation, 0 for training, by the unit hash of the columns."""
    return F.when(unit_hash(seed, *cs) < ratio, 1).otherwise(0).cast("smallint")


def affine(x: Column, y: Column, bounds: list[Column], entity: list[Column] | None = None) -> tuple[Column, Column]:
    """Coordinates in the unit square of ``bounds`` (xmin..ymax). With an entity's bounds: its shape, moved to its centre there and divided by its longer side."""
    span = [F.greatest(bounds[2] - bounds[0], F.lit(1e-9)), F.greatest(bounds[3] - bounds[1], F.lit(1e-9))]
    u, v = (x - bounds[0]) / span[0], (y - bounds[1]) / span[1]
    if entity is None:
        return u, v
    a, b = (entity[0] - bounds[0]) / span[0], (entity[2] - bounds[0]) / span[0]
    c, d = (entity[1] - bounds[1]) / span[1], (entity[3] - bounds[1]) / span[1]
    side = F.greatest(b - a, d - c, F.lit(1e-9))
    return (u - (a + b) / 2) / side, (v - (c + d) / 2) / side
