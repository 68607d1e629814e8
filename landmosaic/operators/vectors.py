"""Vectors in array columns: moments, scaling, nearest in blocks, clusters, regression by sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Base rows that one task compares with a block of queries, and queries in a block.
BASE_BLOCK, QUERY_BLOCK = 16_384, 4096


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def sums(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(by, n, s, ss): rows, sums and sums of squares per group and dimension as arrays. Summed per batch before the shuffle; null vectors are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, g in b.groupby(by, dropna=False, sort=False) if by else [((), b)]:
                x = np.stack(g[vec].to_numpy()).astype(float) if len(g) else np.zeros((0, 0))
                rows.append((*(key if isinstance(key, tuple) else (key,)), len(g), x.sum(axis=0), (x * x).sum(axis=0)))
            yield pd.DataFrame(rows, columns=[*by, "n", "s", "ss"])

    kinds = dict(df.dtypes)
    part = df.where(F.col(vec).isNotNull()).select(*by, vec).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n bigint", "s array<double>", "ss array<double>"]))
    flat = part.where("n > 0").select(*by, "n", F.posexplode(F.arrays_zip("s", "ss")).alias("i", "x"))
    per = flat.groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.ss").alias("ss"))
    put = F.array_sort(F.collect_list(F.struct("i", "s", "ss")))
    return per.groupBy(*by).agg(F.max("n").alias("n"), put.alias("d")).select(*by, "n", F.transform("d", lambda x: x["s"]).alias("s"), F.transform("d", lambda x: x["ss"]).alias("ss"))


def standardized(df: DataFrame, vec: str, ddof: int = 0) -> DataFrame:
    """``df`` with ``vec`` scaled to mean 0 and deviation 1 per dimension; dimensions without spread become 0."""
    r = sums(df, [], vec).first()
    if r is None or not r["n"]:
        return df
    n, s, ss = r["n"], np.array(r["s"]), np.array(r["ss"])
    mean = s / n
    sd = np.sqrt(np.maximum(ss - n * mean * mean, 0) / max(1, n - ddof))
    m, inv = F.array(*map(F.lit, mean.tolist())), F.array(*map(F.lit, np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-12), 0.0).tolist()))
    return df.withColumn(vec, F.zip_with(F.zip_with(vec, m, lambda x, y: x - y), inv, lambda x, y: x * y))


def nearest_in_blocks(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, cosine: bool = False) -> DataFrame:
    """(key, other, distance): the k rows of ``base`` next to each query, itself included if it is one.

    Both sides are cut into blocks by a hash of their keys, every pair of
    blocks is one task, and the k best per block are merged, so the work is
    queries times base and no task grows with either. Euclidean distance, or
    1 - cosine. Ties go to the lesser key.
    """
    nb, nq = max(1, math.ceil(base.count() / BASE_BLOCK)), max(1, math.ceil(queries.count() / QUERY_BLOCK))
    part = lambda d, n: d.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("p"))
    b = part(base, nb).select("k", "v", F.col("p").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("j"), F.lit(False).alias("q"))
    a = part(queries, nq).select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("i"), F.col("p").alias("j"), F.lit(True).alias("q"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        x, y = d[d["q"]], d[~d["q"]].sort_values("k")
        if not len(x) or not len(y):
            return pd.DataFrame({"k": [], "other": [], "distance": []})
        u, v = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        if cosine:
            u, v = (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) for w in (u, v))
        keys, others, dist = [], [], []
        for s in range(0, len(u), 256):
            c = u[s : s + 256] @ v.T
            d2 = 1 - c if cosine else np.maximum((u[s : s + 256] ** 2).sum(1)[:, None] + (v**2).sum(1) - 2 * c, 0)
            m = min(k, d2.shape[1])
            # what ties with the m-th within rounding is kept and measured again
            i, j = np.nonzero(d2 <= np.partition(d2, m - 1, axis=1)[:, m - 1 : m] + 1e-9)
            gap = 1 - (u[s + i] * v[j]).sum(1) if cosine else np.sqrt(((u[s + i] - v[j]) ** 2).sum(1))
            keys.append(x["k"].to_numpy()[s + i])
            others.append(y["k"].to_numpy()[j])
            dist.append(gap)
        return pd.DataFrame({"k": np.concatenate(keys), "other": np.concatenate(others), "distance": np.concatenate(dist)})

    found = a.unionByName(b).groupBy("i", "j").applyInPandas(run, f"k {dict(queries.dtypes)[key]}, other {dict(base.dtypes)[key]}, distance double")
    w = Window.partitionBy("k").orderBy(F.round("distance", 9), "other")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(F.col("k").alias(key), "other", "distance", F.col("r").cast("int").alias("place"))


def cluster_spread(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, n, within): the sum of squared distances to the mean of each cluster."""
    s = sums(df, [label], vec)
    dot = F.aggregate(F.transform("s", lambda x: x * x), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    return s.select(label, "n", (F.aggregate("ss", F.lit(0.0), lambda a, x: a + x) - dot).alias("within"))


def silhouettes(df: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    """(key, label, a, b, silhouette) with squared distances: the mean to the own cluster's others and the least mean to another cluster.

    A mean of squared distances to a cluster needs only its size, sum and sum
    of squares, so the work is rows times clusters; these sums (one row per
    cluster) are broadcast. A row alone in its cluster has a = 0 and
    silhouette 0.
    """
    s = sums(df, [label], vec).collect()
    if not s:
        return df.select(key, label, *[F.lit(None).cast("double").alias(c) for c in ("a", "b", "silhouette")]).limit(0)
    labels, n = [r[label] for r in s], np.array([r["n"] for r in s], float)
    total, square = np.array([r["s"] for r in s]), np.array([sum(r["ss"]) for r in s])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {v: i for i, v in enumerate(labels)}
        for b in batches:
            x = np.stack(b[vec].to_numpy()).astype(float) if len(b) else np.zeros((0, total.shape[1]))
            own = np.array([at[v] for v in b[label]], int)
            rows = np.arange(len(b))
            all_ = np.maximum((x * x).sum(1)[:, None] * n + square - 2 * x @ total.T, 0)
            a = np.where(n[own] > 1, all_[rows, own] / np.maximum(n[own] - 1, 1), 0.0)
            mean = all_ / n
            mean[rows, own] = np.inf
            low = mean.min(axis=1) if len(labels) > 1 else np.full(len(b), np.nan)
            top = np.maximum(a, low)
            yield pd.DataFrame({key: b[key], label: b[label], "a": a, "b": low, "silhouette": np.where((n[own] > 1) & (top > 0), (low - a) / np.where(top > 0, top, 1), 0.0)})

    kinds = dict(df.dtypes)
    return df.where(F.col(vec).isNotNull()).select(key, label, vec).mapInPandas(run, f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, a double, b double, silhouette double")


def gram(df: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Per group the sums that a linear fit needs: (by, n, g) with g the products of (1, features, target) as one array. Rows with a null or NaN are left out."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    m = len(cols)
    ok = None
    for x in cols[1:]:
        ok = (x.isNotNull() & ~F.isnan(x)) if ok is None else ok & x.isNotNull() & ~F.isnan(x)
    products = [F.sum(cols[i] * cols[j]).alias(f"_{i}_{j}") for i in range(m) for j in range(m)]
    return df.where(ok).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *products).select(*by, "n", F.array(*[F.col(f"_{i}_{j}") for i in range(m) for j in range(m)]).alias("g"))


def solve_gram(g: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients (intercept first) of least squares from summed products; the intercept isn't shrunk."""
    m = int(round(math.sqrt(g.size)))
    a = g.reshape(m, m)
    penalty = ridge * np.eye(m - 1)
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(a[:-1, :-1] + penalty, a[:-1, -1], rcond=None)[0]


def cross_validated(df: DataFrame, fold: str, features: list[str], target: str, ridge: float = 0.0) -> DataFrame:
    """``df`` with ``guess``: each row predicted by the fit on all other folds.

    One pass gives the sums of every fold; a fit without a fold is the total
    less its sums. The driver holds one small matrix per fold.
    """
    rows = gram(df, [fold], features, target).collect()
    total = sum((np.array(r["g"]) for r in rows), np.zeros((len(features) + 2) ** 2))
    fits = [(r[fold], solve_gram(total - np.array(r["g"]), ridge).tolist()) for r in rows]
    model = df.sparkSession.createDataFrame(fits, f"`{fold}` {dict(df.dtypes)[fold]}, _w array<double>")
    guess = F.col("_w")[0]
    for i, f in enumerate(features, 1):
        guess = guess + F.col("_w")[i] * F.col(f)
    return df.join(F.broadcast(model), fold).withColumn("guess", guess).drop("_w")


def principal_axes(df: DataFrame, vec: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes (dim x k), explained shares) by the covariance matrix, which is summed batch by batch. Each axis' largest entry is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), b.num_rows)
                n, s, g = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if g is None else g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "s", "g"])

    parts = df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "n bigint, s array<double>, g array<double>").toPandas()  # one row for each task
    n, s, g = parts["n"].sum(), np.sum(np.stack(parts["s"]), axis=0), np.sum(np.stack(parts["g"]), axis=0)
    mean = s / n
    cov = (g.reshape(len(s), len(s)) - n * np.outer(mean, mean)) / max(1, n - 1)
    val, axes = np.linalg.eigh(cov)
    order = np.argsort(-val)[:k]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return mean, axes, val[order] / val.sum()


def mean_vectors(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(by, n, v): the mean vector of each group."""
    return sums(df, by, vec).select(*by, "n", F.transform("s", lambda x: x / F.col("n")).alias("v"))
