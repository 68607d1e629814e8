"""Map projection and great-circle expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8

# Fixed values of EPSG:5186 (GRS 80 ellipsoid, central belt).
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257222101
LON_0, LAT_0, FALSE_EASTING, FALSE_NORTHING = 127.0, 38.0, 200000.0, 600000.0

_F = 1 / INVERSE_FLATTENING
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RECT = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def _xi0() -> float:
    p = math.radians(LAT_0)
    t = math.sinh(math.atanh(math.sin(p)) - _E * math.atanh(_E * math.sin(p)))
    x = math.atan(t)
    return x + sum(a * math.sin(2 * (j + 1) * x) for j, a in enumerate(_ALPHA))


def to_5186(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:5186 metres (Krueger series, third order, below 0.1 mm here)."""
    p, dl = F.radians(lat), F.radians(lon - F.lit(LON_0))
    s = F.sin(p)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(FALSE_EASTING) + F.lit(_RECT) * x, F.lit(FALSE_NORTHING) + F.lit(_RECT) * (y - F.lit(_xi0()))


def with_5186(df: DataFrame, lon: str, lat: str, x: str, y: str) -> DataFrame:
    """``df`` with EPSG:5186 metres as ``x`` and ``y``, by :func:`to_5186` in steps.

    Each step is a column of its own, so that nothing is computed twice, and
    the result goes through a one-row generator: filters and join keys on it
    are not pushed below, where they would repeat the whole series.
    """
    s = df.withColumn("_s", F.sin(F.radians(lat))).withColumn("_dl", F.radians(F.col(lon) - F.lit(LON_0)))
    s = s.withColumn("_t", F.sinh(F.atanh("_s") - F.lit(_E) * F.atanh(F.lit(_E) * F.col("_s"))))
    s = s.withColumns({"_xi": F.atan2("_t", F.cos("_dl")), "_eta": F.atanh(F.sin("_dl") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    e, n = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(_ALPHA, 1):
        e = e + F.lit(a) * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
        n = n + F.lit(a) * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
    at = F.struct((F.lit(FALSE_EASTING) + F.lit(_RECT) * e).alias("x"), (F.lit(FALSE_NORTHING) + F.lit(_RECT) * (n - F.lit(_xi0()))).alias("y"))
    done = s.select(*df.columns, F.explode(F.array(at)).alias("_at"))
    return done.select(*df.columns, F.col("_at.x").alias(x), F.col("_at.y").alias(y))


def sql_5186(lon: str, lat: str) -> tuple[str, str]:
    """The projection of :func:`to_5186` as two SQL expressions, for comparison in another engine."""
    p, dl = f"radians({lat})", f"radians({lon} - {LON_0})"
    t = f"sinh(atanh(sin({p})) - {_E!r} * atanh({_E!r} * sin({p})))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    e = " + ".join([eta, *[f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)]])
    n = " + ".join([xi, *[f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)]])
    return f"({FALSE_EASTING} + {_RECT!r} * ({e}))", f"({FALSE_NORTHING} + {_RECT!r} * ({n} - {_xi0()!r}))"


def to_4326(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:5186 metres to EPSG:4326 degrees."""
    xi = (y - F.lit(FALSE_NORTHING)) / F.lit(_RECT) + F.lit(_xi0())
    eta = (x - F.lit(FALSE_EASTING)) / F.lit(_RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.lit(LON_0) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
