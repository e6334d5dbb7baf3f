"""Map colours as 32-bit ARGB in non-negative longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base colours of the game's map palette by id, as RGB numbers.
BASE_COLORS = (
    0, 8368696, 16247203, 13092807, 16711680, 10526975, 10987431, 31744, 16777215, 10791096,
    9923917, 7368816, 4210943, 9402184, 16776437, 14188339, 11685080, 6724056, 15066419, 8375321,
    15892389, 5000268, 10066329, 5013401, 8339378, 3361970, 6704179, 6717235, 10040115, 1644825,
    16445005, 6085589, 4882687, 55610, 8476209, 7340544, 13742497, 10441252, 9787244, 7367818,
    12223780, 6780213, 10505550, 3746083, 8874850, 5725276, 8014168, 4996700, 4993571, 5001770,
    9321518, 2430480, 12398641, 9715553, 6035741, 1474182, 3837580, 5647422, 1356933, 6579300,
    14200723, 8365974,
)
# Brightness ids and their share of 255.
BRIGHTNESS = {"LOW": (0, 180), "NORMAL": (1, 220), "HIGH": (2, 255), "LOWEST": (3, 135)}
NONE, GRASS, DIRT, STONE, WATER = 0, 1, 10, 11, 12
OPAQUE, HALF = 0xFF000000, 0x80000000


def base_rgb(color: Column) -> Column:
    """RGB of a colour id, 0 where there is none."""
    table = F.array(*[F.lit(c).cast("long") for c in BASE_COLORS])
    return F.when((color > 0) & (color < len(BASE_COLORS)), F.element_at(table, (F.least(F.greatest(color, F.lit(0)), F.lit(len(BASE_COLORS) - 1)) + 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def modifier(brightness: Column) -> Column:
    """Share of 255 for a brightness id; unknown ids are normal."""
    out = F.lit(BRIGHTNESS["NORMAL"][1])
    for i, m in BRIGHTNESS.values():
        out = F.when(brightness == i, m).otherwise(out)
    return out.cast("long")


def channel(argb: Column, shift: int) -> Column:
    return F.shiftright(argb, shift).bitwiseAND(F.lit(255).cast("long"))


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    return a * (1 << 24) + r * (1 << 16) + g * (1 << 8) + b


def argb(color: Column, brightness: Column) -> Column:
    rgb, m = base_rgb(color), modifier(brightness)
    scaled = [F.floor(channel(rgb, s) * m / 255) for s in (16, 8, 0)]
    return F.when((color > 0) & (color < len(BASE_COLORS)), pack(F.lit(255).cast("long"), *scaled)).otherwise(F.lit(0).cast("long"))


def packed_id(color: Column, brightness: Column) -> Column:
    return (color * 4 + brightness.bitwiseAND(F.lit(3))).cast("long")


def argb_of_packed(packed: Column) -> Column:
    return argb(F.shiftright(packed, 2), packed.bitwiseAND(F.lit(3).cast("long")))


def translucent(color: Column) -> Column:
    """Half-opaque base colour, 0 for none, null for null."""
    return F.when(color.isNull(), F.lit(None).cast("long")).when(color == NONE, F.lit(0).cast("long")).otherwise(base_rgb(color) + HALF)


def blend(over: Column, base: Column) -> Column:
    """An overlay over a base: as it is where it is clear or opaque, else rounded half up with an opaque result."""
    part = channel(over, 24).cast("double") / F.lit(255.0)
    mixed = [F.floor(channel(over, s) * part + channel(base, s) * (F.lit(1.0) - part) + F.lit(0.5)) for s in (16, 8, 0)]
    alpha = channel(over, 24)
    return F.when(alpha == 0, base).when(alpha == 255, over).otherwise(pack(F.lit(255).cast("long"), *mixed))
