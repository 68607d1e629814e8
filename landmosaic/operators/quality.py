"""Checks of tables as tables: counts of violations, one row per rule or per offending record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.functions.text import finite


def contract(df: DataFrame, key: str, columns: list[str], other: DataFrame | None = None) -> DataFrame:
    """(rule, violations): missing columns, null keys, repeated keys, and keys that only one of two parts of a split table has. All rules come out, also those without violations."""
    lacking = [c for c in columns if c not in df.columns]
    out = [df.sparkSession.range(1).select(F.lit("missing_columns").alias("rule"), F.lit(len(lacking)).cast("bigint").alias("violations"))]
    a = df.agg(F.count_if(F.col(key).isNull()).alias("null_keys"), (F.count(key) - F.countDistinct(key)).alias("repeated_keys"))
    out.append(a.unpivot([], ["null_keys", "repeated_keys"], "rule", "violations"))
    if other is not None:
        x, y = df.select(key).where(F.col(key).isNotNull()).distinct(), other.select(key).where(F.col(key).isNotNull()).distinct()
        for name, d in (("only_in_first", x.join(y, key, "left_anti")), ("only_in_second", y.join(x, key, "left_anti"))):
            out.append(d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations"))
    return reduce(DataFrame.union, out)


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, nulls, repeats, least and greatest id, and whether ids are 0..n-1."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"), (F.count(key) - F.countDistinct(key)).alias("repeats"), F.min(key).alias("low"), F.max(key).alias("high"))
    return a.withColumn("dense", F.coalesce((F.col("nulls") == 0) & (F.col("repeats") == 0) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1), F.lit(False)))


def violations(df: DataFrame, key: str, rules: dict[str, Column], most: int | None = None) -> DataFrame:
    """(key, rule) for each rule that a record breaks; a rule that is null isn't broken. With ``most``, the first so many by rule and key."""
    hit = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    out = df.select(key, F.explode(hit).alias("rule"))
    return out if most is None else out.orderBy("rule", key).limit(most)


def completeness(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state) of what is expected but missing and what is there but not expected; null keys match."""
    x, y = expected.select(*keys).distinct(), got.select(*keys).distinct()
    on = reduce(lambda a, b: a & b, [x[k].eqNullSafe(y[k]) for k in keys])
    return x.join(y, on, "left_anti").withColumn("state", F.lit("missing")).union(y.join(x, on, "left_anti").withColumn("state", F.lit("extra")))


def samples_by_shard(samples: DataFrame, key: str, value: str, split: str, per_shard: int, known: DataFrame) -> DataFrame:
    """Per shard: rows, values that aren't finite, rows of each split, entities, and entities that ``known`` lacks."""
    ids = known.select(F.col(key).alias("_k")).distinct()
    s = samples.join(ids, F.col(key) == F.col("_k"), "left").withColumn("shard", F.floor(F.col(key) / per_shard))
    return s.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~finite(value)).alias("not_finite"), F.count_if(F.col(split) == 0).alias("train"), F.count_if(F.col(split) == 1).alias("validation"),
        F.countDistinct(key).alias("entities"), F.countDistinct(F.when(F.col("_k").isNull(), F.col(key))).alias("unknown"),
    )


def same_content(a: DataFrame, b: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, state): shards of two runs that are equal, differ, or are in one run only."""
    j = a.select(key, F.col(checksum).alias("_a")).join(b.select(key, F.col(checksum).alias("_b")), key, "full")
    return j.select(key, F.when(F.col("_a").isNull(), "second only").when(F.col("_b").isNull(), "first only").when(F.col("_a") == F.col("_b"), "same").otherwise("differs").alias("state"))


def vector_audit(df: DataFrame, vec: str) -> DataFrame:
    """(dim, n, nulls, not_finite, all_zero): vectors by length; -1 stands for null ones."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vec, lambda x: x == 0)
    return df.groupBy(F.coalesce(F.size(vec), F.lit(-1)).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(vec).isNull()).alias("nulls"), F.count_if(bad).alias("not_finite"), F.count_if(zero).alias("all_zero"))


def tag_report(df: DataFrame, tags: list[str]) -> DataFrame:
    """(tag, present, filled, distinct_values) of each text column, in one pass."""
    a = df.agg(*[x for t in tags for x in (F.count(t).alias(f"{t}|present"), F.count(F.when(F.trim(t) != "", 1)).alias(f"{t}|filled"), F.countDistinct(t).alias(f"{t}|distinct_values"))])
    per = [F.struct(F.lit(t).alias("tag"), *[F.col(f"{t}|{k}").alias(k) for k in ("present", "filled", "distinct_values")]) for t in tags]
    return a.select(F.explode(F.array(*per)).alias("r")).select("r.*")


def frame_difference(df: DataFrame, group: str, frame: str, pixels: str) -> DataFrame:
    """(group, least, edge): the least mean absolute difference of two frames of a group, and the greatest jump between neighbouring pixels.

    A group has a frame per view, of which there are few by design; frames meet within their group.
    """
    mean = F.aggregate(F.zip_with("_p", "_q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("_p")
    a = df.select(group, F.col(frame).alias("_f"), F.col(pixels).alias("_p"))
    pairs = a.join(df.select(group, F.col(frame).alias("_g"), F.col(pixels).alias("_q")), group).where("_f < _g").groupBy(group).agg(F.min(mean).alias("least"))
    n = F.size("_p") - 1
    jump = F.array_max(F.zip_with(F.slice("_p", 1, n), F.slice("_p", 2, n), lambda x, y: F.abs(x - y)))
    return a.groupBy(group).agg(F.max(jump).alias("edge")).join(pairs, group, "left").select(group, "least", "edge")
