"""Resumable batches: new files are upserted into a keyed table, which a rule then reads whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landmosaic.sources.sinks import exists, upsert_table


def run_batches(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: list[str], files_per_batch: int = 1) -> None:
    """Read the Parquet files that ``source`` has gained, some at a time, and upsert each batch into ``table``.

    What was read is kept in ``checkpoint``, so a run that broke off goes on
    where it was, and a batch that comes again changes nothing. Ends when no
    file is left. Late rows are fine: what depends on order is computed from
    the whole table afterwards.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, _: upsert_table(batch.dropDuplicates(keys), table, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def until(spark: SparkSession, table: str, rule: Callable[[DataFrame], DataFrame], enough: int, batch: Callable[[], bool]) -> DataFrame:
    """Run batches until ``rule`` of the table has ``enough`` rows or ``batch`` says that none is left; the rule's rows come out."""
    while True:
        more = batch()
        if exists(spark, table):
            got = rule(spark.read.parquet(table))
            if not more or got.limit(enough).count() >= enough:
                return got
        elif not more:
            raise FileNotFoundError(table)
