"""The most similar vectors of every vector, by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.runtime import durable

#: Vectors that the rotations are learnt from, at most: those with the least hash. All vectors are indexed.
FIT_ROWS = 20_000
#: Learned rotations; each gives 64 bits, one for each of 64 dimensions.
ROTATIONS = 2
#: Vectors that share a substring on average; sets its length.
BUCKET = 1024
#: Share of the pairs at the least cosine asked for that should share a substring; sets the number of substrings. Closer pairs share one more often.
TARGET = 0.95
#: Rows of the sample whose pairs tell how many bits differ at the least cosine, and how many such pairs tell enough.
PROBE_ROWS, ENOUGH_PAIRS = 2000, 200
#: Crowded buckets, repeated keys or equal vectors that are broadcast; more are joined by a shuffle.
CROWDED_SENT = 100_000
#: Substrings that are shuffled at once, with the vectors, at least; and such waves at most.
WAVE, WAVES = 2, 32
#: Rows of a bucket that are compared in one block; larger buckets are cut into blocks and all pairs of blocks are compared.
BLOCK = 8192


@dataclass(frozen=True)
class Codes:
    """Centre, rotations (dim x bits), for each substring its bit positions, and the Hamming radius."""

    centre: np.ndarray
    rotation: np.ndarray
    substrings: list[np.ndarray]
    radius: int


def usable(df: DataFrame, key: str, dim_column: str, vector: str, dim: int) -> DataFrame:
    """(key, v) with v of ``dim`` finite elements, not all zero, scaled to length 1. One row per key: of several, the greatest. Null keys are left out."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            right = pa.array(size == dim)
            keys, lists = b.column(0).filter(right), lists.filter(right)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null elements become NaN
            top = np.abs(x).max(axis=1, initial=0.0)
            good = np.isfinite(top) & (top > 0)
            x = x[good] / top[good, None]
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(good)), v], names=["k", "v"])

    slim = df.where(F.col(key).isNotNull() & (F.col(dim_column) == dim)).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<float>").alias("v"))
    scaled = slim.mapInArrow(scale, "k bigint, v array<float>")
    greatest = lambda d: d.groupBy("k").agg(F.max("v").alias("v"))
    # few keys are repeated, and only their vectors are shuffled
    several = durable(scaled.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    if several.limit(CROWDED_SENT + 1).count() > CROWDED_SENT:
        one = greatest(scaled)
    else:
        several = F.broadcast(several)
        one = scaled.join(several, "k", "left_anti").unionByName(greatest(scaled.join(several, "k", "left_semi")))
    return one.withColumnRenamed("k", key)


def learn_codes(sample: np.ndarray, n: int, least: float, rotations: int = ROTATIONS, rounds: int = 25, seed: int = 11) -> Codes:
    """Iterative quantisation: rotations for which the signs lose least of the vectors, each from another start.

    How many bits differ between vectors at the cosine ``least`` is measured
    on pairs of the sample (where it has few, the angle tells it). The Hamming
    radius is their mean and three standard deviations. Substrings are as long
    as it takes for n vectors to share one with about BUCKET others, and so
    many that such a pair misses all of them with probability 1 - TARGET, at
    any n. The first ones are disjoint; when the bits are used up, further
    ones take other combinations of bits.
    """
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    x = sample - centre
    dim = x.shape[1]
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(x) >= dim else 0):
            u, _, w = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ w).T
        parts.append(r)
    rotation = np.concatenate(parts, axis=1)
    bits = rotation.shape[1]
    flips = _flips_at(sample, (x @ rotation) > 0, least)
    if len(flips) < ENOUGH_PAIRS:
        p = math.acos(min(1.0, max(-1.0, least))) / math.pi
        flips = np.clip(rng.binomial(bits, p, 4000), 0, bits)
    radius = min(bits, int(flips.mean() + 3 * flips.std()))
    length = int(min(24, max(4, round(math.log2(max(2, n) / BUCKET)))))
    miss = 1 - (1 - flips / bits) ** length
    count = 4
    while count < 4096 and (miss**count).mean() > 1 - TARGET:
        count += 1
    substrings, pool = [], np.zeros(0, int)
    for _ in range(count):
        if len(pool) < length:
            pool = rng.permutation(bits)
        substrings.append(np.sort(pool[:length]))
        pool = pool[length:]
    return Codes(centre, rotation, substrings, radius)


def _flips_at(sample: np.ndarray, bit: np.ndarray, least: float, band: float = 0.05) -> np.ndarray:
    """Numbers of differing bits of the sample's pairs with a cosine from ``least`` to ``least`` + ``band``."""
    out = []
    for start in range(0, min(len(sample), PROBE_ROWS), 250):
        cos = sample[start : start + 250] @ sample.T
        i, j = np.nonzero((cos >= least) & (cos < least + band))
        keep = i + start < j
        out.append((bit[i[keep] + start] != bit[j[keep]]).sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0, int)


def _postings(vectors: DataFrame, key: str, codes: Codes, wave: range, whole: bool = True) -> DataFrame:
    """(t, s, id, h0, h1, ..., v) for each vector and substring of the wave: number, value, key, the whole code, and the vector's bytes; only (t, s) if not ``whole``."""
    words = codes.rotation.shape[1] // 64 if whole else 0
    held = vectors.sparkSession.sparkContext.broadcast(codes)
    names = ["t", "s"] + ["id", *[f"h{w}" for w in range(words)], "v"] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(n, -1)
            bit = ((v.astype(np.float64) - c.centre) @ c.rotation) > 0
            rest = []
            if whole:
                packed = [np.packbits(bit[:, 64 * w : 64 * w + 64], axis=1).view(">i8").astype(np.int64).ravel() for w in range(words)]
                ends = np.arange(0, v.nbytes + 1, v.itemsize * v.shape[1], dtype=np.int32)
                rest = [b.column(0), *map(pa.array, packed), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(v)])]
            for t in wave:
                at = c.substrings[t]
                s = bit[:, at] @ (1 << np.arange(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(s.astype(np.int32)), *rest], names=names)

    schema = "t int, s int" + (", id bigint, " + "".join(f"h{w} bigint, " for w in range(words)) + "v binary") * whole
    return vectors.select(key, "v").mapInArrow(run, schema)


def _compare(codes: Codes, least: float):
    """All pairs within the Hamming radius and with a cosine of at least ``least`` in a group of buckets or a pair of blocks.

    A pair is given by the first substring that it shares, so none comes twice.
    """
    words, radius = codes.rotation.shape[1] // 64, codes.radius
    masks = []
    for at in codes.substrings:
        m = np.zeros(words * 64, dtype=np.uint8)
        m[at] = 1
        masks.append(np.packbits(m).view(">u8").astype(np.uint64))

    def pairs(h: np.ndarray, v: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, t: int, same: bool) -> list:
        out = []
        for start in range(0, len(left), 256):
            p = left[start : start + 256]
            x = [h[p, w][:, None] ^ h[right, w][None] for w in range(words)]
            d = np.bitwise_count(x[0]).astype(np.int16)
            for w in range(1, words):
                d += np.bitwise_count(x[w])
            i, j = np.nonzero(d <= radius)
            if same:
                keep = i + start < j
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            diff = [x[w][i, j] for w in range(words)]
            first = np.ones(len(i), bool)
            for u in range(t):
                hit = np.ones(len(i), bool)
                for w in range(words):
                    hit &= (diff[w] & masks[u][w]) == 0
                first &= ~hit
            i, j = p[i[first]], right[j[first]]
            cos = np.einsum("ij,ij->i", v[i].astype(np.float64), v[j].astype(np.float64))
            near = cos >= least - 1e-7
            a, b = ids[i[near]], ids[j[near]]
            out.append((np.minimum(a, b), np.maximum(a, b), cos[near]))
        return out

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        h = np.stack([df[f"h{w}"].to_numpy() for w in range(words)], axis=1).view(np.uint64)  # bits of a signed number are those of its absolute value
        ids, s, part = df["id"].to_numpy(), df["s"].to_numpy(), df["part"].to_numpy()
        v = np.frombuffer(b"".join(df["v"]), np.float32).reshape(len(df), -1)
        t, i, j = int(key[0]), int(key[2]), int(key[3])
        found: list = []
        order = np.argsort(s, kind="stable")
        for bucket in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
            if i == j:
                found += pairs(h, v, ids, bucket, bucket, t, True)
            else:
                found += pairs(h, v, ids, bucket[part[bucket] == i], bucket[part[bucket] == j], t, False)
        a, b, cos = (np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"a": a, "b": b, "cosine": cos})

    return run


def _members(vectors: DataFrame, key: str) -> DataFrame:
    """(id, c): the class of each vector, named by the least id of the equal ones. Vectors are equal if 128 bits of hashes are; only these are shuffled."""
    flat = vectors.select(F.col(key).cast("bigint").alias("id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    twins = flat.groupBy("h1", "h2").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return durable(flat.join(twins, ["h1", "h2"], "left").select("id", F.coalesce("c", "id").alias("c")))


def _classes(vectors: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """(id, v): the vectors that name a class."""
    rest = durable(members.where("id != c").select("id"))
    flat = vectors.select(F.col(key).cast("bigint").alias("id"), "v")
    if rest.limit(CROWDED_SENT + 1).count() > CROWDED_SENT:
        return durable(flat.join(rest, "id", "left_anti"))
    return flat.join(F.broadcast(rest), "id", "left_anti")


def nearest(vectors: DataFrame, key: str, k: int = 5, least: float = 0.8, dim: int = 64) -> DataFrame:
    """The k most similar others of every vector with a cosine of at least ``least``.

    ``vectors`` has (key bigint, v array<float> of length 1). Equal vectors
    are one class, named by its least key; classes are compared, and at the
    end each class gives its members. Learned rotations turn a vector into a
    binary code; the code is cut into substrings, each indexed. Codes in a
    Hamming radius r of each other share one of r + 1 disjoint substrings, and
    most pairs share one much sooner. Codes that share a substring are
    compared whole, and pairs within the radius are measured by their floats,
    which travel with the postings; a few substrings are shuffled at a time,
    and their files go before the next, so that disk holds one wave, not all.
    Probing all substrings near a substring, which alone would be certain to
    meet every code within the radius, is not done: at the radius of such a
    cosine it would look up thousands of buckets for each vector. Instead
    there are so many substrings that equal ones meet a pair at ``least`` with
    probability TARGET (see :func:`learn_codes`). The work per vector is
    BUCKET code comparisons per substring at any size. A
    bucket with more than BLOCK codes is cut into blocks and every pair of
    blocks is a task of its own, so nothing is capped.

    Ties in the cosine go to the lesser key. Returns (id, other, cosine).
    """
    spark = vectors.sparkSession
    members = _members(vectors, key)
    cls = _classes(vectors, key, members)
    n = members.where("id = c").count()
    empty = spark.createDataFrame([], "id bigint, other bigint, cosine double")
    if not n:
        return empty
    sample = np.array([r["v"] for r in cls.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()], dtype=np.float64)
    codes = learn_codes(sample, n, least)
    bits, count = codes.rotation.shape[1], len(codes.substrings)

    crowd = _postings(cls, "id", codes, range(count), whole=False).groupBy("t", "s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowd = durable(crowd.select("t", "s", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    if crowd.limit(CROWDED_SENT + 1).count() <= CROWDED_SENT:
        crowd = F.broadcast(crowd)
    # plain buckets travel in groups of neighbours; crowded ones as pairs of blocks
    tasks = F.when(F.col("parts").isNull(), F.array(F.struct(F.shiftright("s", 3).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda o: F.struct((-1 - F.col("s")).alias("g"), F.least("part", o).cast("int").alias("i"), F.greatest("part", o).cast("int").alias("j")))
    )
    step = max(WAVE, math.ceil(count / WAVES))
    scored = None
    for first in range(0, count, step):
        posted = _postings(cls, "id", codes, range(first, min(count, first + step)))
        posted = posted.join(crowd, ["t", "s"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
        blocks = posted.withColumn("task", F.explode(tasks)).select("t", "s", "id", "part", "task.*", *[f"h{w}" for w in range(bits // 64)], "v")
        found = durable(blocks.groupBy("t", "g", "i", "j").applyInPandas(_compare(codes, least), "a bigint, b bigint, cosine double"))
        scored = found if scored is None else scored.unionByName(found)
    both = scored.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("d"), "cosine"), F.struct(F.col("b").alias("c"), F.col("a").alias("d"), "cosine"))).alias("x")).select("x.*")
    return _lists(members, both, k)


def _top(k: int):
    """In a pair of blocks, the k best of the other block for every vector, and those that tie with the k-th."""

    def half(x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray, same: bool) -> list:
        out = []
        for start in range(0, len(x), 512):
            sims = x[start : start + 512] @ y.T
            if same:
                sims[np.arange(len(sims)), start + np.arange(len(sims))] = -np.inf
            at = max(0, sims.shape[1] - k)
            # rounding of float32 must not decide: what is near the k-th is kept and measured again
            i, j = np.nonzero((sims >= np.partition(sims, at, axis=1)[:, at, None] - 1e-5) & np.isfinite(sims))
            out.append((xi[start + i], yi[j], np.einsum("ij,ij->i", x[start + i].astype(np.float64), y[j].astype(np.float64))))
        return out

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x, ids, part = np.stack(df["v"].to_numpy()).astype(np.float32), df["id"].to_numpy(), df["part"].to_numpy()
        i, j = (int(v) for v in key)
        l, r = part == i, part == j
        found = half(x[l], x[r], ids[l], ids[r], i == j) if l.any() and r.any() else []
        if i != j and l.any() and r.any():
            found += half(x[r], x[l], ids[r], ids[l], False)
        c, d, cos = (np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"c": c, "d": d, "cosine": cos})

    return run


def nearest_of_all(vectors: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most similar others of every vector, however small the cosine, by comparing all pairs.

    Classes of equal vectors are compared in pairs of blocks of BLOCK, each a
    task of its own, so the work grows with the square of the classes. Ties
    in the cosine go to the lesser key. Returns (id, other, cosine).
    """
    members = _members(vectors, key)
    cls = durable(_classes(vectors, key, members))
    parts = max(1, math.ceil(cls.count() / BLOCK))
    placed = cls.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    tasks = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    pairs = placed.withColumn("task", F.explode(tasks)).select("id", "v", "part", "task.*")
    return _lists(members, durable(pairs.groupBy("i", "j").applyInPandas(_top(k), "c bigint, d bigint, cosine double")), k)


def _lists(members: DataFrame, both: DataFrame, k: int) -> DataFrame:
    """(id, other, cosine): the k best of every vector, from the similar classes (c, d, cosine)."""
    # of a class only its k + 1 least members can be anyone's nearest, as they tie
    few = durable(_least_members(members, k + 1))
    others = both.join(few.select(F.col("c").alias("d"), "m"), "d").select("c", "cosine", F.explode(F.slice("m", 1, k)).alias("other"))
    best = others.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k).select("c", "other", "cosine")
    own = few.where(F.size("m") > 1).select("c", F.explode("m").alias("other"), F.lit(1.0).alias("cosine"))
    lists = best.unionByName(own)
    lists = lists.groupBy("c").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other")).alias("l"))  # at most 2 k + 1 entries
    per = members.join(lists, "c").select("id", F.slice(F.array_sort(F.filter("l", lambda e: e["other"] != F.col("id"))), 1, k).alias("l"))
    return per.select("id", F.explode("l").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.far")).alias("cosine"))


def _least_members(members: DataFrame, k: int) -> DataFrame:
    """(c, m): the k least ids of each class. Salted first, so that a class with a great share of all rows is ranked in many tasks; AQE's rank limit keeps k per salt."""
    def top(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k).drop("r")

    salted = top(members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))), ["c", "salt"]).drop("salt")
    return top(salted, ["c"]).groupBy("c").agg(F.array_sort(F.collect_list("id")).alias("m"))
