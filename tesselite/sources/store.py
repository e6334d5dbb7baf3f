"""The tile store: a table partitioned by version, dimension and zoom, so that a key's look-up reads one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["version", "dimension", "zoom"]
SCHEMA = "x bigint, y bigint, png binary, version string, dimension string, zoom int"


def write_tiles(tiles: DataFrame, path: str, version: str) -> None:
    """Publishes whole partitions: Spark's commit puts them in place when all tasks are done.  Rows of one partition
    are brought together first, so that it has few files."""
    out = tiles.withColumn("version", F.lit(version)).select("x", "y", "png", *PARTITIONS)
    out.repartition(*[F.col(c) for c in PARTITIONS], F.pmod(F.xxhash64("x", "y"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def upsert_tiles(fresh: DataFrame, path: str, version: str, staging: str) -> None:
    """Puts single tiles into a stored version: only the (dimension, zoom) partitions that get one are read, merged and
    written anew.  What will be there is written to ``staging`` first, as a table can't be replaced while it is read; of
    several fresh rows for one tile the last by its bytes stays.  A failure before the second write leaves the store as it was."""
    spark = fresh.sparkSession
    key = ["dimension", "zoom", "x", "y"]
    new = fresh.groupBy(*key).agg(F.max("png").alias("png"))
    touched = new.select("dimension", "zoom").distinct()
    old = all_tiles(spark, path).filter(F.col("version") == version).join(F.broadcast(touched), ["dimension", "zoom"], "left_semi").select(*key, "png")
    merged(old, new.select(*key, "png")).write.mode("overwrite").parquet(staging)
    write_tiles(spark.read.schema("dimension string, zoom int, x bigint, y bigint, png binary").parquet(staging), path, version)


def all_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_tile(spark: SparkSession, path: str, version: str, dimension: str, zoom: int, x: int, y: int) -> DataFrame:
    """The tile's row, or none."""
    at = (F.col("version") == version) & (F.col("dimension") == dimension) & (F.col("zoom") == zoom) & (F.col("x") == x) & (F.col("y") == y)
    return all_tiles(spark, path).filter(at)


def existing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored, ["dimension", "zoom", "x", "y"], "left_semi")


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored, ["dimension", "zoom", "x", "y"], "left_anti")


def merged(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored tiles with fresh ones in their place."""
    return missing(stored, fresh).unionByName(fresh)


def without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored tiles but for deleted ones, to be written back."""
    return missing(stored, gone)


def write_document(document: DataFrame, path: str, column: str = "value") -> None:
    document.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def world_identity(spark: SparkSession, path: str, fallback: str) -> str:
    """A world's id from where it is kept; drawn and kept where there is none, or the fallback if it can't be kept."""
    import uuid

    try:
        rows = spark.read.text(path).head(1)
        if rows and rows[0][0].strip():
            return str(uuid.UUID(rows[0][0].strip()))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, ValueError):
            return fallback
    fresh = str(uuid.uuid4())
    try:
        spark.createDataFrame([(fresh,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    except Exception:
        return fallback
    return fresh
