"""Arithmetic of blocks, pixels and tiles.  All numbers are long; divisions round down, also below zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselite.plans.spec import Extent, Grid

Number = Column | int


def as_long(x: Number) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def floordiv(a: Number, b: Number) -> Column:
    """Division that rounds down; exact, as the remainder is taken off first."""
    a, b = as_long(a), as_long(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def blocks_per_tile(grid: Grid, zoom: Number) -> Column:
    if isinstance(zoom, int):
        return F.lit(grid.blocks_per_tile(zoom)).cast("long")
    table = F.array(*[F.lit(grid.blocks_per_tile(z)).cast("long") for z in range(grid.max_zoom + 1)])
    return F.when(zoom < 0, F.lit(grid.blocks_at_max).cast("long") * F.pow(F.lit(2.0), F.lit(grid.max_zoom) - zoom).cast("long")).otherwise(F.element_at(table, (F.least(F.greatest(zoom, F.lit(0)), F.lit(grid.max_zoom)) + 1).cast("int")))


def blocks_per_pixel(grid: Grid, zoom: Number) -> Column:
    return F.greatest(F.lit(1).cast("long"), floordiv(blocks_per_tile(grid, zoom), grid.tile_size))


def exact_blocks_per_pixel(grid: Grid, zoom: Number) -> Column:
    return blocks_per_tile(grid, zoom).cast("double") / F.lit(float(grid.tile_size))


def first_block(grid: Grid, zoom: Number, pixel: Number) -> Column:
    """First block of a pixel, from the origin."""
    return floordiv(as_long(pixel) * blocks_per_tile(grid, zoom), grid.tile_size)


def block_span(grid: Grid, zoom: Number, pixel: Number) -> Column:
    return F.greatest(F.lit(1).cast("long"), first_block(grid, zoom, as_long(pixel) + 1) - first_block(grid, zoom, pixel))


def pixel_at_max(grid: Grid, x: Column, z: Column) -> tuple[Column, Column]:
    ppb = F.lit(float(grid.pixels_per_block))
    return (x - grid.origin_x).cast("double") * ppb, (z - grid.origin_z).cast("double") * ppb


def tile_of(grid: Grid, zoom: Number, x: Column, z: Column) -> tuple[Column, Column]:
    size = blocks_per_tile(grid, zoom)
    return floordiv(as_long(x) - grid.origin_x, size), floordiv(as_long(z) - grid.origin_z, size)


def tile_key(grid: Grid, dimension: Column, zoom: Number, x: Column, z: Column) -> Column:
    tx, ty = tile_of(grid, zoom, x, z)
    return F.struct(dimension.alias("dimension"), (F.lit(zoom) if isinstance(zoom, int) else zoom).cast("int").alias("zoom"), tx.alias("x"), ty.alias("y"))


def tile_bounds(grid: Grid, zoom: Number, x: Column, y: Column, tiles: Number = 1, padding: int = 0) -> tuple[Column, Column, Column, Column]:
    """Block box of a square of tiles: least x and z, and x and z behind the greatest."""
    size = blocks_per_tile(grid, zoom)
    n = as_long(tiles)
    return (
        as_long(x) * size + grid.origin_x - padding, as_long(y) * size + grid.origin_z - padding,
        (as_long(x) + n) * size + grid.origin_x + padding, (as_long(y) + n) * size + grid.origin_z + padding,
    )


def contains(bounds: tuple[Column, Column, Column, Column], x: Column, z: Column) -> Column:
    return (x >= bounds[0]) & (x < bounds[2]) & (z >= bounds[1]) & (z < bounds[3])


def to_normalized(extent: Extent, x: Column, y: Column) -> tuple[Column, Column]:
    return as_long(x) - extent.min_x, as_long(y) - extent.min_y


def to_signed(extent: Extent, x: Column, y: Column) -> tuple[Column, Column]:
    return as_long(x) + extent.min_x, as_long(y) + extent.min_y


def metatile_start(tile: Column, size: int) -> Column:
    return floordiv(tile, size) * size


def client_pixel(grid: Grid, x: Column, z: Column) -> tuple[Column, Column]:
    """Pixels of the client's map, whose y grows upwards."""
    px, py = pixel_at_max(grid, x, z)
    return px, -py


def client_block(grid: Grid, px: Column, py: Column) -> tuple[Column, Column]:
    ppb = F.lit(float(grid.pixels_per_block))
    return px / ppb + grid.origin_x, -py / ppb + grid.origin_z


def client_tile_y(y: Column) -> Column:
    """Between rows counted upwards and downwards; applied twice it changes nothing."""
    return -as_long(y) - 1


def resolutions(grid: Grid) -> Column:
    return F.transform(F.sequence(F.lit(grid.min_zoom), F.lit(grid.max_zoom)), lambda z: F.pow(F.lit(2.0), F.lit(grid.max_zoom) - z))


def client_extent(grid: Grid, extent: Extent) -> Column:
    """Least x and y, greatest x and y in the client's pixels."""
    t = grid.tile_size
    return F.array(*[F.lit(float(v)) for v in (extent.min_x * t, -(extent.max_y + 1) * t, (extent.max_x + 1) * t, -extent.min_y * t)])
