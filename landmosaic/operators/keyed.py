"""Aggregation per key when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.runtime import durable, width


def canonical_code(c: str | Column) -> Column:
    """Upper case without surrounding white space (Unicode's, so U+3000 too). Null stays null."""
    return F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", ""))


_STATE = "k1 string, k2 string, n_rows bigint, n_ids bigint, total double"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of the runs of equal (k1, k2) in a partition sorted by (k1, k2, id).

    An id that repeats within its key counts once, with the value of its first
    row. The last row is carried from batch to batch.
    """
    last: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k1, k2, ids = (b.column(i) for i in range(3))
        value = np.nan_to_num(b.column(3).to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=0.0, neginf=0.0)

        def changes(col: pa.Array) -> np.ndarray:
            a, z = col.slice(1), col.slice(0, n - 1)
            same = pc.or_kleene(pc.equal(a, z), pc.and_(pc.is_null(a), pc.is_null(z)))
            return ~pc.fill_null(same, False).to_numpy(zero_copy_only=False).astype(bool)

        key = np.concatenate([[True], changes(k1) | changes(k2)])
        new = key | np.concatenate([[True], changes(ids)])
        head = (k1[0].as_py(), k2[0].as_py(), ids[0].as_py())
        if last is not None and head == last:
            new[0] = False
        known = ~pc.is_null(ids).to_numpy(zero_copy_only=False).astype(bool)
        last = (k1[n - 1].as_py(), k2[n - 1].as_py(), ids[n - 1].as_py())
        new &= known
        at = np.flatnonzero(key)
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [
                k1.take(take),
                k2.take(take),
                pa.array(np.diff(np.append(at, n)), pa.int64()),
                pa.array(np.add.reduceat(new.astype(np.int64), at), pa.int64()),
                pa.array(np.add.reduceat(np.where(new, value, 0.0), at), pa.float64()),
            ],
            names=["k1", "k2", "n_rows", "n_ids", "total"],
        )


def balanced_key_totals(df: DataFrame, keys: tuple[str, str], order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Rows, distinct ``order`` values and the sum of ``value`` per key pair, evenly spread.

    Rows are range-partitioned on (key, key, order) by sampled quantiles, so
    that a heavy key covers several whole partitions and no task gets more
    than its share; equal (key, order) rows, copies of one record, always lie
    together. Each partition is scanned in order and gives one state per run;
    the states of a key that crosses partition boundaries are then stitched
    (summed). What is shuffled the second time is one row per key and
    partition.

    Null keys are keys. Rows with a null ``order`` value count in n_rows only.
    A null, NaN or infinite ``value`` adds nothing. Of rows repeated under one
    ``order`` value the smallest value counts. An empty input gives no rows;
    other columns, whatever they are called, aren't read.

    Returns the two key columns, n_rows, n_ids, total.
    """
    slim = df.select(F.col(keys[0]).alias("k1"), F.col(keys[1]).alias("k2"), F.col(order).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"))
    spread = slim.repartitionByRange(partitions or width(df), "k1", "k2", "id").sortWithinPartitions("k1", "k2", "id", F.col("value").asc_nulls_last())
    states = spread.mapInArrow(_runs, _STATE)
    return states.groupBy("k1", "k2").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"), F.sum("total").alias("total")).toDF(*keys, "n_rows", "n_ids", "total")


def heavy_keys(totals: DataFrame, keys: tuple[str, str], share: float) -> DataFrame:
    """The rows of :func:`balanced_key_totals` whose key, without nulls, has at least ``share`` of all ids."""
    kept = durable(totals)
    everything = kept.agg(F.sum("n_ids")).first()[0] or 0
    return kept.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & (F.col("n_ids") >= F.lit(share * everything)) & (F.col("n_ids") > 0))
