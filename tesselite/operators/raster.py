"""From column samples to shaded pixels.

Shading looks at the pixel to the north, so it runs over whole pixel columns of
a dimension instead of padded squares: no halo is copied, and a job's padding only
says which rows must be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselite.functions import color as c
from tesselite.functions import grid as g
from tesselite.plans.spec import Grid

LOW, NORMAL, HIGH = 0, 1, 2


def lattice(grid: Grid, zoom: int, start_x: Column, start_y: Column, count: int, padding_blocks: int) -> dict[str, Column]:
    """Padding in pixels, pixels a side, and the origin block of a padded square of tiles."""
    pad = grid.padding_pixels(zoom, padding_blocks)
    box = g.tile_bounds(grid, zoom, start_x, start_y, count)
    back = max(1, grid.first_block(zoom, pad))
    return {"pad": F.lit(pad).cast("long"), "total": F.lit(grid.tile_size * count + 2 * pad).cast("long"), "origin_x": box[0] - back, "origin_z": box[1] - back}


def pixels(samples: DataFrame, grid: Grid, zoom: int) -> DataFrame:
    """Samples of blocks become pixels (dimension, px, py) of one zoom.

    Where a pixel covers several blocks: the most frequent colour, the one met first among equals
    going down each x in turn; the mean height; the mean fluid depth without its fraction; the last
    overlay that there is and the last kind.  Where a block covers several pixels, each gets the sample."""
    bpt = grid.blocks_per_tile(zoom)
    rel_x, rel_z = F.col("x") - grid.origin_x, F.col("z") - grid.origin_z
    if bpt <= grid.tile_size:
        per = grid.tile_size // bpt
        side = lambda v: F.explode(F.sequence(v * per, v * per + per - 1))
        one = samples.select("dimension", rel_x.alias("_x"), rel_z.alias("_z"), F.col("color").cast("int").alias("color"), F.col("y").cast("float").alias("height"), "depth", "overlay", "kind")
        return one.withColumn("px", side(F.col("_x"))).withColumn("py", side(F.col("_z"))).select("dimension", "px", "py", "color", "height", "depth", "overlay", "kind")
    bpp = bpt // grid.tile_size
    at = samples.select("dimension", g.floordiv(rel_x, bpp).alias("px"), g.floordiv(rel_z, bpp).alias("py"), F.struct("x", "z").alias("place"), "color", "y", "depth", "overlay", "kind")
    key = ["dimension", "px", "py"]
    # two partial aggregations: blocks of one colour, then a pixel's colours
    by_color = at.groupBy(*key, "color").agg(
        F.count("*").alias("n"), F.min("place").alias("first"), F.sum("y").alias("y"), F.sum("depth").alias("depth"),
        F.max(F.when(F.col("overlay") != 0, F.struct("place", "overlay"))).alias("overlay"), F.max(F.struct("place", "kind")).alias("kind"),
    )
    area = F.sum("n")
    return by_color.groupBy(*key).agg(
        F.min_by("color", F.struct(-F.col("n"), F.col("first"))).cast("int").alias("color"), (F.sum("y") / area).cast("float").alias("height"),
        F.floor(F.sum("depth") / area).cast("long").alias("depth"), F.coalesce(F.max("overlay")["overlay"], F.lit(0).cast("long")).alias("overlay"), F.max("kind")["kind"].alias("kind"),
    )


def odd(px: Column, py: Column) -> Column:
    """Whether a pixel is dark in the chequered pattern."""
    return F.pmod(px + py, F.lit(2).cast("long")).cast("double")


def slope(delta: Column, bpp: int, parity: Column) -> Column:
    s = delta * F.lit(4.0) / F.lit(bpp + 4.0) + (parity - F.lit(0.5)) * F.lit(0.4)
    return F.when(s > F.lit(0.6), HIGH).when(s < F.lit(-0.6), LOW).otherwise(NORMAL)


def water(depth: Column, parity: Column) -> Column:
    s = depth.cast("double") * F.lit(0.1) + parity * F.lit(0.2)
    return F.when(s < F.lit(0.5), HIGH).when(s > F.lit(0.9), LOW).otherwise(NORMAL)


def shade(raster: DataFrame, blocks_per_pixel: int) -> DataFrame:
    """Pixels with brightness and argb; a pixel compares with the one right to its north, and with itself where there is none."""
    north = Window.partitionBy("dimension", "px").orderBy("py")
    height = F.col("height").cast("double")
    beside = F.when(F.col("py") - F.lag("py", 1).over(north) == 1, F.lag(height, 1).over(north))
    delta = height - F.coalesce(beside, height)
    parity = odd(F.col("px"), F.col("py"))
    shaded = raster.withColumn("delta", delta).withColumn("brightness", F.when(F.col("color") == c.WATER, water(F.col("depth"), parity)).otherwise(slope(F.col("delta"), blocks_per_pixel, parity)))
    return shaded.withColumn("argb", c.blend(F.col("overlay"), c.argb(F.col("color"), F.col("brightness"))))


def cut(shaded: DataFrame, grid: Grid, zoom: int) -> DataFrame:
    """Tile of each pixel, and the pixel's place in it."""
    t = grid.tile_size
    return shaded.withColumns({"zoom": F.lit(zoom), "tile_x": g.floordiv(F.col("px"), t), "tile_y": g.floordiv(F.col("py"), t), "in_x": F.pmod("px", F.lit(t)), "in_y": F.pmod("py", F.lit(t))})


def sliced(raster: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Part of a raster, shifted to start at zero."""
    if width <= 0 or height <= 0:
        raise ValueError("a slice must have an area")
    inside = F.col("px").between(x, x + width - 1) & F.col("py").between(y, y + height - 1)
    return raster.filter(inside).withColumns({"px": F.col("px") - x, "py": F.col("py") - y})


def pending(grid: Grid) -> Column:
    """A clear tile's pixels."""
    return F.array_repeat(F.lit(0).cast("long"), grid.tile_size * grid.tile_size)
