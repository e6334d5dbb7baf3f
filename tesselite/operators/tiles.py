"""Generators and lookups of tiles.  Box-overlaps-tile questions become equi-joins on computed tile numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselite.functions import grid as g
from tesselite.plans.spec import Grid


def bbox_tiles(boxes: DataFrame, grid: Grid, zoom: int) -> DataFrame:
    """A row for every tile that a half-open box (min_x, min_z, max_x, max_z) overlaps, row by row from the top; an empty
    box has none."""
    x0, y0 = g.tile_of(grid, zoom, F.col("min_x"), F.col("min_z"))
    x1, y1 = g.tile_of(grid, zoom, F.col("max_x") - 1, F.col("max_z") - 1)
    some = (F.col("max_x") > F.col("min_x")) & (F.col("max_z") > F.col("min_z"))
    none = F.array().cast("array<bigint>")
    rows = boxes.withColumn("tile_y", F.explode(F.when(some, F.sequence(y0, y1)).otherwise(none)))
    return rows.withColumn("tile_x", F.explode(F.sequence(x0, x1))).withColumn("zoom", F.lit(zoom))


def chunk_tiles(chunks: DataFrame, grid: Grid) -> DataFrame:
    """Tiles of the highest zoom that a chunk's 16 by 16 blocks overlap."""
    x, z = F.col("chunk_x") * 16, F.col("chunk_z") * 16
    boxes = chunks.withColumns({"min_x": x, "min_z": z, "max_x": x + 16, "max_z": z + 16})
    return bbox_tiles(boxes, grid, grid.max_zoom).drop("min_x", "min_z", "max_x", "max_z")


def with_metatile(tiles: DataFrame, size: int) -> DataFrame:
    """Start of the square of tiles to which a tile belongs."""
    return tiles.withColumns({"start_x": g.metatile_start(F.col("tile_x"), size), "start_y": g.metatile_start(F.col("tile_y"), size)})


def job_tiles(jobs: DataFrame, count: int) -> DataFrame:
    """The tiles of each job (start_x, start_y), row by row."""
    rows = jobs.withColumn("tile_y", F.explode(F.sequence(F.col("start_y"), F.col("start_y") + count - 1)))
    return rows.withColumn("tile_x", F.explode(F.sequence(F.col("start_x"), F.col("start_x") + count - 1)))


def job_bounds(grid: Grid, zoom: int, count: int, padding: int = 0) -> tuple[Column, Column, Column, Column]:
    return g.tile_bounds(grid, zoom, F.col("start_x"), F.col("start_y"), count, padding)


def ancestors(tiles: DataFrame, min_zoom: int) -> DataFrame:
    """Every tile above each tile (zoom, x, y), nearest first: ancestor_zoom, ancestor_x, ancestor_y, step."""
    zooms = F.when(F.col("zoom") > min_zoom, F.sequence(F.col("zoom") - 1, F.lit(min_zoom), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = tiles.select("*", F.posexplode(zooms).alias("step", "ancestor_zoom"))
    size = F.pow(F.lit(2.0), F.col("zoom") - F.col("ancestor_zoom")).cast("long")
    return rows.withColumns({"ancestor_x": g.floordiv(F.col("x"), size), "ancestor_y": g.floordiv(F.col("y"), size)})


def parent(min_zoom: int) -> Column:
    """Struct of the tile above (zoom, x, y); null at the lowest zoom."""
    up = F.struct((F.col("zoom") - 1).cast("int").alias("zoom"), g.floordiv(F.col("x"), 2).alias("x"), g.floordiv(F.col("y"), 2).alias("y"))
    return F.when(F.col("zoom") > min_zoom, up)


def children(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """The four tiles below each tile in the order left to right, top to bottom; none at the highest zoom."""
    four = F.array(*[F.struct((F.col("x") * 2 + q % 2).alias("x"), (F.col("y") * 2 + q // 2).alias("y")) for q in range(4)])
    rows = tiles.filter(F.col("zoom") < max_zoom).select("*", F.posexplode(four).alias("quadrant", "_c"))
    return rows.withColumns({"child_zoom": (F.col("zoom") + 1).cast("int"), "child_x": F.col("_c.x"), "child_y": F.col("_c.y")}).drop("_c")


def signed_extent(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """One row: least and greatest tile of the highest zoom, all 0 where there is none."""
    shown = tiles.filter(F.col("zoom") == max_zoom)
    zero = F.lit(0).cast("long")
    return shown.agg(*[F.coalesce(f(c), zero).alias(n) for n, f, c in (("min_x", F.min, "x"), ("min_y", F.min, "y"), ("max_x", F.max, "x"), ("max_y", F.max, "y"))])


def normalized(tiles: DataFrame, extent: DataFrame) -> DataFrame:
    """Tiles shifted so that the extent starts at zero.  The extent is one row, read as scalar subqueries."""
    return tiles.withColumns({"normal_x": F.col("x") - extent.select("min_x").scalar(), "normal_y": F.col("y") - extent.select("min_y").scalar()})


def denormalized(tiles: DataFrame, extent: DataFrame) -> DataFrame:
    return tiles.withColumns({"x": F.col("normal_x") + extent.select("min_x").scalar(), "y": F.col("normal_y") + extent.select("min_y").scalar()})
