"""Zoom levels made from the level below.

A pixel that isn't there is clear, so missing tiles need no rows, and a tile none of
whose children exists never comes about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselite.functions import color as c
from tesselite.functions import grid as g
from tesselite.operators import tiles as t
from tesselite.plans.spec import Grid

#: Tiles that one miss visits at most.
MOST_VISITS = 256


def halve(pixels: DataFrame) -> DataFrame:
    """(dimension, px, py, argb) at half the size: four pixels' mean on premultiplied channels, rounded half up."""
    p = F.col("argb")
    a = c.channel(p, 24)
    sums = [F.sum(F.floor((a * c.channel(p, s) + 127) / 255)).alias(n) for n, s in (("r", 16), ("g", 8), ("b", 0))]
    met = pixels.groupBy("dimension", g.floordiv(F.col("px"), 2).alias("px"), g.floordiv(F.col("py"), 2).alias("py")).agg(F.sum(a).alias("a"), *sums)
    alpha = F.floor((F.col("a") + 2) / 4)
    full = lambda n: F.least(F.lit(255).cast("long"), F.floor((F.floor((F.col(n) + 2) / 4) * 255 + F.floor(alpha / 2)) / F.greatest(alpha, F.lit(1).cast("long"))))
    return met.select("dimension", "px", "py", F.when(alpha == 0, F.lit(0).cast("long")).otherwise(c.pack(alpha, full("r"), full("g"), full("b"))).alias("argb"))


def pyramid(leaves: DataFrame, grid: Grid, top: int | None = None) -> DataFrame:
    """All levels from the highest zoom's pixels up to ``top``: zoom, dimension, px, py, argb.  A level is a quarter of
    the one below; there are at most 19."""
    if grid.tile_size % 2:
        raise ValueError("an odd tile size can't be halved")
    level = leaves.select("dimension", "px", "py", "argb")
    out = level.withColumn("zoom", F.lit(grid.max_zoom))
    for zoom in range(grid.max_zoom - 1, (grid.min_zoom if top is None else top) - 1, -1):
        level = halve(level)
        out = out.unionByName(level.withColumn("zoom", F.lit(zoom)))
    return out


def refresh(stored: DataFrame, fresh: DataFrame, grid: Grid, top: int | None = None) -> DataFrame:
    """Pixels of the tiles above changed ones, made anew from stored levels: stored holds all levels' pixels (zoom, dimension,
    px, py, argb), fresh the changed tiles of the highest zoom, whole.  Level by level only the children of dirty tiles are read:
    those that were made anew from there, the others from the store.  (zoom, dimension, px, py, argb) of fresh and all that is above."""
    size = grid.tile_size
    tile = {"tile_x": g.floordiv(F.col("px"), size), "tile_y": g.floordiv(F.col("py"), size)}
    key = ["dimension", "tile_x", "tile_y"]
    level = fresh.select("dimension", "px", "py", "argb")
    out = level.withColumn("zoom", F.lit(grid.max_zoom))
    for zoom in range(grid.max_zoom - 1, (grid.min_zoom if top is None else top) - 1, -1):
        made = level.withColumns(tile)
        changed = made.select(*key).distinct()
        parents = changed.select("dimension", g.floordiv(F.col("tile_x"), 2).alias("up_x"), g.floordiv(F.col("tile_y"), 2).alias("up_y")).distinct()
        below = stored.filter(F.col("zoom") == zoom + 1).select("dimension", "px", "py", "argb").withColumns(tile).join(changed, key, "left_anti")
        below = below.withColumns({"up_x": g.floordiv(F.col("tile_x"), 2), "up_y": g.floordiv(F.col("tile_y"), 2)}).join(parents, ["dimension", "up_x", "up_y"], "left_semi")
        level = halve(made.select("dimension", "px", "py", "argb").unionByName(below.select("dimension", "px", "py", "argb")))
        out = out.unionByName(level.withColumn("zoom", F.lit(zoom)))
    return out


def dirty_ancestors(changed: DataFrame, min_zoom: int) -> DataFrame:
    """Each tile above a changed one, once."""
    up = t.ancestors(changed.select("dimension", "zoom", "x", "y"), min_zoom)
    return up.select("dimension", F.col("ancestor_zoom").alias("zoom"), F.col("ancestor_x").alias("x"), F.col("ancestor_y").alias("y")).distinct()


def by_priority(dirty: DataFrame, budget: int | None = None) -> DataFrame:
    """Deepest zoom first, then by place; as many as the budget."""
    ordered = dirty.distinct().orderBy(F.desc("zoom"), "x", "y")
    return ordered if budget is None else ordered.limit(budget)


def expand_misses(roots: DataFrame, stored: DataFrame, max_zoom: int, most: int = MOST_VISITS) -> DataFrame:
    """Tiles that a missing tile (root_id, dimension, zoom, x, y) leads to, breadth first: those at the highest zoom are
    rendered, those above are marked, and children that are stored are left out.  (root_id, dimension, zoom, x, y,
    visit, action); at most ``most`` for each root, so that each of the few passes holds as many rows a root."""
    there = stored.select("dimension", F.col("zoom").alias("child_zoom"), F.col("x").alias("child_x"), F.col("y").alias("child_y"))
    now = roots.select("root_id", "dimension", "zoom", "x", "y", F.lit(1).cast("long").alias("visit"), F.lit(1).cast("long").alias("so_far"))
    out = now
    for _ in range(max_zoom):
        below = t.children(now, max_zoom).join(there, ["dimension", "child_zoom", "child_x", "child_y"], "left_anti")
        order = Window.partitionBy("root_id").orderBy("visit", "quadrant")
        ranked = below.withColumn("next", F.col("so_far") + F.row_number().over(order)).filter(F.col("next") <= most)
        now = ranked.select("root_id", "dimension", F.col("child_zoom").alias("zoom"), F.col("child_x").alias("x"), F.col("child_y").alias("y"), F.col("next").alias("visit"), F.max("next").over(Window.partitionBy("root_id")).alias("so_far"))
        out = out.unionByName(now)
    return out.drop("so_far").withColumn("action", F.when(F.col("zoom") >= max_zoom, "render").otherwise("mark"))
