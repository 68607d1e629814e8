"""Session plumbing shared by the operators: tables, durable lineage cuts, distributed ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediate data, shared by all executors.

    It is ``spark.checkpoint.dir`` where that is set. Only a local-mode session
    without one falls back to a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="landmosaic-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there. The shuffle files that led to it are removed at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read when a query is planned
    finally:
        spark.conf.set(_CLEANUP, before)


def width(df: DataFrame) -> int:
    """The session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), name: str = "rank0") -> DataFrame:
    """Number the rows of each group from 0 in the given order without a one-task window.

    Rows are range-partitioned by (groups, order), so a group of any size is
    spread over many partitions. Each row knows its place within its partition;
    one small aggregate per (partition, group) gives the offsets to add. Ties
    in ``order`` are numbered in an arbitrary order, so end it with a key.
    Null group values form a group of their own. An empty input gives no rows.
    """
    groups = list(groups)
    keys = [F.col(c) for c in groups] + [F.col(c) if isinstance(c, str) else c for c in order]
    at = F.monotonically_increasing_id()
    placed = durable(df.repartitionByRange(width(df), *keys).sortWithinPartitions(*keys).withColumn("_at", at))
    pid, idx = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"_pid": pid, "_idx": idx})
    runs = placed.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    # one row per partition and group that meets it: at most partitions + groups rows
    w = "PARTITION BY " + ", ".join(f"`{g}`" for g in groups) if groups else ""
    runs = runs.withColumn("_base", F.expr(f"coalesce(sum(_n) OVER ({w} ORDER BY _pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    runs = runs.select(F.col("_pid").alias("_rp"), *[F.col(g).alias(f"_r_{g}") for g in groups], "_first", "_base")
    on = F.col("_pid") == F.col("_rp")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    out = placed.join(runs, on, "left").withColumn(name, (F.col("_base") + F.col("_idx") - F.col("_first")).cast("bigint"))
    return out.drop("_at", "_pid", "_idx", "_rp", "_first", "_base", *[f"_r_{g}" for g in groups])
