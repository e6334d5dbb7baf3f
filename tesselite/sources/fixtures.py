"""Views of the supplied tables as worlds, changes, positions and requests.  These projections are a convention of this
library for tables that hold no world."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Moment at which the queries look at positions.
NOW_MS = 1_706_659_200_000
DIMENSION = "minecraft:overworld"
MIN_BUILD = 0

_REGISTRY_COLUMNS = "material int, name string, is_air boolean, fluid boolean, shape_empty boolean, bottom double, top double, solid_render boolean, leaves boolean, can_occlude boolean, map_color int, fluid_color int, sturdy_top boolean"
# The blocks of the view's world.
_REGISTRY = [
    (0, "air", True, False, True, None, None, False, False, False, 0, 0, False),
    (1, "grass", False, False, False, 0.0, 1.0, True, False, True, 1, 1, True),
    (2, "stone", False, False, False, 0.0, 1.0, True, False, True, 11, 11, True),
    (3, "dirt", False, False, False, 0.0, 1.0, True, False, True, 10, 10, True),
    (4, "water", False, True, True, None, None, False, False, False, 12, 12, False),
    (5, "lava", False, True, True, None, None, False, False, False, 4, 4, False),
    (6, "glass", False, False, False, 0.0, 1.0, False, False, False, 0, 0, True),
    (7, "stained glass", False, False, False, 0.0, 1.0, False, False, False, 8, 8, True),
    (8, "ice", False, False, False, 0.0, 1.0, False, False, False, 5, 5, True),
    (9, "leaves", False, False, False, 0.0, 1.0, False, True, False, 7, 7, False),
    (10, "carpet", False, False, False, 0.0, 0.0625, False, False, True, 8, 8, False),
    (11, "snow layer", False, False, False, 0.0, 0.125, False, False, True, 8, 8, False),
    (12, "torch", False, False, True, None, None, False, False, False, 0, 0, False),
    (13, "slab", False, False, False, 0.0, 0.5, False, False, True, 11, 11, False),
    (14, "kelp", False, True, False, 0.0, 1.0, False, False, False, 12, 12, False),
    (15, "waterlogged slab", False, True, False, 0.0, 0.5, False, False, True, 11, 12, False),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REGISTRY, _REGISTRY_COLUMNS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("long")).withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def block_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id"), F.lit(DIMENSION).alias("dimension"), (F.col("user_id") * 37 - 2750).alias("block_x"), (F.col("k") * 53 - 2600).alias("block_z"), "ts_ms",
        F.when(F.col("k") % 10 != 0, F.col("k") % 16).alias("previous_state"), F.when(F.col("event_type") == "view", F.col("k") % 16).otherwise(F.col("k") % 16 + 16).alias("state"),
        (F.col("k") % 4).alias("previous_block"), F.when(F.col("event_type") == "view", F.col("k") % 4).otherwise(F.col("user_id") % 4).alias("block"), (F.col("event_type") == "signup").alias("is_new"),
    )


def dirty_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type <> 'view'")
    return e.select(F.lit(DIMENSION).alias("dimension"), (F.col("user_id") % 8 - 4).alias("chunk_x"), (F.col("k") % 8 - 4).alias("chunk_z"), "ts_ms")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One material for each (x, y, z).  Two chunks and some columns of others hold nothing."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = F.col("l_partkey") % 64, F.col("l_suppkey") % 64
    li = li.filter(~((F.floor(a / 16) * 3 + F.floor(b / 16)) % 13 == 3) & ~((a % 7 == 3) & (b % 5 == 2)))
    return li.groupBy((F.col("l_partkey") % 64 - 32).alias("x"), F.col("l_quantity").cast("long").alias("y"), (F.col("l_suppkey") % 64 - 32).alias("z")).agg(F.max(F.col("l_orderkey") % 16).cast("int").alias("material")).withColumn("dimension", F.lit(DIMENSION))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    uuid = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(
        uuid.alias("uuid"), F.concat(F.lit("Player "), F.col("user_id").cast("string")).alias("name"), F.when(F.col("k") % 4 == 0, "minecraft:the_nether").otherwise(DIMENSION).alias("dimension"),
        (F.col("user_id") * F.lit(11.5) - F.lit(800.0)).alias("x"), (F.col("k") * F.lit(7.25) - F.lit(300.0)).alias("z"), F.col("ts_ms").alias("updated_at"),
        (F.col("event_type") == "view").alias("spectator"), (F.col("k") == 13).alias("invisible"),
    )


def tps_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the order of (at, id)."""
    return _events(spark, sf_dir).select(F.col("ts_ms").alias("at"), F.col("event_id").alias("id"), ((F.lit(1700) + F.col("k") * 3) / F.lit(100.0)).alias("tps"))


def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.lit(DIMENSION).alias("dimension"), (F.col("k") % 9).cast("int").alias("zoom"), (F.col("user_id") - 75).alias("x"), (F.col("k") - 50).alias("y"), "ts_ms")


def stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lit(DIMENSION).alias("dimension"), (F.col("o_orderkey") % 9).cast("int").alias("zoom"), (F.col("o_custkey") % 150 - 75).alias("x"), (F.col("o_orderkey") % 100 - 50).alias("y")).distinct()


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block boxes, half open."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, z = F.col("o_custkey") % 2000 - 1000, F.col("o_orderkey") % 2000 - 1000
    return o.select(F.col("o_orderkey").alias("box_id"), F.lit(DIMENSION).alias("dimension"), x.alias("min_x"), z.alias("min_z"), (x + F.col("o_orderkey") % 500 + 1).alias("max_x"), (z + F.col("o_custkey") % 300 + 1).alias("max_z"))
