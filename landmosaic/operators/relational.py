"""Joins, deduplication and summaries with the semantics that spatial tables need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key in ascending order, nulls first; null keys match each other. An aggregate: a frequent key costs one row per task."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_f")).select("_f.*")


def latest(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Last write wins. An aggregate, not a window: it combines before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_l")).select(*keys, "_l.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old``; columns that either lacks are null."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, "_s").drop("_s")


def with_repeats(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: true for all but the first row of each key; rows that tie in ``order`` with the first are first too. Null keys match each other.

    First rows come from an aggregate that is joined back, so a frequent key is spread over tasks.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return null_safe_join(df, first, keys).withColumn(name, F.struct(*order) != F.col("_first")).drop("_first")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which null keys match; the keys come out once, the left ones first."""
    renamed = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    out = a.join(renamed, on, how)
    if how in ("full", "right", "outer"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_k_{k}")) for k in keys})
    return out.drop(*[f"_k_{k}" for k in keys]) if "semi" not in how and "anti" not in how else out


def attach(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that brings only columns which ``df`` lacks."""
    return df.join(other.select(key, *[c for c in other.columns if c not in df.columns]), key, "left")


def suffixed_join(df: DataFrame, other: DataFrame, key: str, prefix: str) -> DataFrame:
    """Left join in which colliding columns of ``other`` get a prefix."""
    return df.join(other.withColumnsRenamed({c: prefix + c for c in other.columns if c != key and c in df.columns}), key, "left")


def one_to_one_errors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(repeated_left, repeated_right, missing_right): what forbids a one-to-one left join."""
    rep = lambda d, n: d.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias(n))
    missing = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("missing_right"))
    return rep(a, "repeated_left").crossJoin(rep(b, "repeated_right")).crossJoin(missing)  # three one-row results


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids that only one of the tables has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("extra")))


def mode_label(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label per group, the alphabetically first of equals. Counts combine before the shuffle."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label))


def label_list(c: str, sep: str = ";") -> Column:
    """Distinct labels, sorted, as one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def with_total(df: DataFrame, source: str, value: str) -> DataFrame:
    """Counts by source and value and over all sources, with share and rank, in one pass."""
    g = df.groupingSets([[F.col(source), F.col(value)], [F.col(value)]], F.col(source), F.col(value)).agg(F.count(F.lit(1)).alias("n"), F.grouping(source).alias("_all"))
    g = g.withColumn(source, F.when(F.col("_all") == 1, "all").otherwise(F.col(source))).drop("_all")
    w = Window.partitionBy(source)
    return g.withColumns({"share": F.round(F.col("n") / F.sum("n").over(w), 6), "place": F.rank().over(w.orderBy(F.desc("n"))).cast("bigint")})


def top_text(df: DataFrame, by: list[str], label: str, k: int) -> DataFrame:
    """Per group the k most frequent labels as 'label=n; ...'."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), label)
    n = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return n.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.format_string("%s=%d", F.col(label), F.col("_n")).alias("t")))), lambda s: s["t"]), "; ").alias("top"))


def accept_first(df: DataFrame, key: str, rank: Column, ok: Column, target: int) -> DataFrame:
    """Accept, in order of rank, the first valid row of each key until ``target`` are accepted.

    Adds accepted_rank (null if not accepted) and accepted. Each key's first
    valid row is found first; these are numbered in order. Only valid keys go
    through the global order, and only as many as are needed.
    """
    v = df.withColumns({"_rank": rank, "_ok": F.coalesce(ok, F.lit(False))})
    first = v.where("_ok").groupBy(key).agg(F.min("_rank").alias("_first"))
    top = first.orderBy("_first").limit(target)  # a distributed top-k, not a global sort
    top = top.withColumn("accepted_rank", F.row_number().over(Window.partitionBy().orderBy("_first")).cast("bigint")).select(F.col(key).alias("_k"), "_first", "accepted_rank")
    out = v.join(top, (F.col(key) == F.col("_k")) & (F.col("_rank") == F.col("_first")) & F.col("_ok"), "left")
    return out.withColumn("accepted", F.col("accepted_rank").isNotNull()).drop("_rank", "_ok", "_k", "_first")


def prediction_errors(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """R2 (null without spread), RMSE and MAE over finite pairs, in one aggregate."""
    from landmosaic.functions.text import finite

    y, p = F.col(truth), F.col(guess)
    d = df.where(finite(truth) & finite(guess))
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("_e"), F.var_pop(y).alias("_v"), F.avg(F.abs(y - p)).alias("mae"))
    tot = F.col("_v") * F.col("n")
    return a.select(*by, "n", F.when(tot > 0, F.round(1 - F.col("_e") / tot, 6)).alias("r2"), F.round(F.sqrt(F.col("_e") / F.col("n")), 6).alias("rmse"), F.round("mae", 6).alias("mae"))
