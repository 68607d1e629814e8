"""Writing tables: atomic, guarded, split, sharded with a manifest, upserted; small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.functions.text import row_checksum
from landmosaic.operators.relational import upsert


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Move a finished folder into place; what was there goes only once the new one stands complete beside it."""
    fs, p = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(path + ".old")
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), p):
        raise OSError(f"can't move {new} to {path}")
    fs.delete(old, True)


def write_table(df: DataFrame, path: str, if_exists: str = "error") -> bool:
    """Parquet with zstd, written beside ``path`` and then moved there. If that exists: ``error``, ``skip``, ``replace`` or ``backup`` (the old one is kept as .bak). Tells whether it wrote."""
    spark = df.sparkSession
    if exists(spark, path):
        if if_exists == "error":
            raise FileExistsError(path)
        if if_exists == "skip":
            return False
        if if_exists == "backup":
            fs, p = _fs(spark, path)
            bak = spark._jvm.org.apache.hadoop.fs.Path(path + ".bak")
            fs.delete(bak, True)
            fs.rename(p, bak)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path + ".new")
    replace(spark, path + ".new", path)
    return True


def upsert_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of ``df`` replace those of the table with the same key; the table is made if there is none."""
    spark = df.sparkSession
    write_table(upsert(spark.read.parquet(path), df, keys) if exists(spark, path) else df, path, "replace")


def write_split(df: DataFrame, path: str, key: str, geometry: str) -> None:
    """Two tables that share the key: geometry, and attributes without it."""
    write_table(df.select(key, geometry), f"{path}/geometry", "replace")
    write_table(df.drop(geometry), f"{path}/attributes", "replace")


def with_lineage(df: DataFrame, region: str, source: str, method: str) -> DataFrame:
    return df.withColumns({"geometry_format": F.lit("WKT_EPSG_5186"), "region": F.lit(region), "source_path": F.lit(source), "method": F.lit(method), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def write_shards(df: DataFrame, path: str, shard: str, keys: list[str]) -> DataFrame:
    """Write one folder per shard and return its manifest: (shard, rows, checksum, resumed).

    Shards that the manifest on disk already has with the same checksum are
    left as they are, so that a run that broke off goes on. The checksum is a
    sum of row hashes and doesn't depend on the order of rows.
    """
    spark = df.sparkSession
    new = df.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_checksum(*keys)).alias("checksum"))
    done = spark.read.parquet(f"{path}/manifest").select(F.col(shard), F.col("checksum").alias("_c")) if exists(spark, f"{path}/manifest") else new.select(shard, F.col("checksum").alias("_c")).limit(0)
    state = new.join(done, shard, "left").select(shard, "rows", "checksum", F.coalesce(F.col("checksum") == F.col("_c"), F.lit(False)).alias("resumed"))
    write_table(state, f"{path}/manifest.next", "replace")
    state = spark.read.parquet(f"{path}/manifest.next")
    todo = df.join(F.broadcast(state.where("NOT resumed").select(shard)), shard, "left_semi")  # a row per shard
    todo.repartition(shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(shard).parquet(f"{path}/data")
    write_table(state, f"{path}/manifest", "replace")
    return spark.read.parquet(f"{path}/manifest")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table; bars in cells are escaped. For small results: at most ``most`` rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A small result as one JSON, CSV or Markdown file in a folder of that name."""
    one = df.coalesce(1).write.mode("overwrite")
    if kind == "json":
        one.json(path)
    elif kind == "csv":
        one.option("header", "true").csv(path)
    else:
        df.sparkSession.createDataFrame([(markdown_table(df),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def alias_tables(spark: SparkSession, tables: dict[str, str], prefix: str) -> list[str]:
    """Temporary views over the tables of another region's folder, in place of links."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in tables]


def map_features(df: DataFrame, layer: str, key: str, lon: str, lat: str, most: int) -> DataFrame:
    """(layer, key, feature): GeoJSON points for a map, at most ``most`` of a layer, the first by key, as a viewer draws no more."""
    top = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).orderBy(key).limit(most)
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 5), F.round(lat, 5)).alias("coordinates"))
    return top.select(F.lit(layer).alias("layer"), F.col(key).alias("key"), F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"))).alias("feature"))
