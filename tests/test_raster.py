from pyspark.sql import functions as F

from tesselite.functions import color as c
from tesselite.operators import png, pyramid, raster
from tesselite.plans.spec import Grid

SAMPLE = "dimension string, x long, z long, y long, color int, kind string, depth long, overlay long"
PIXEL = "dimension string, px long, py long, color int, height float, depth long, overlay long, kind string"


def test_palette_values(spark):
    one = spark.range(1)
    argb = lambda color, b: one.select(c.argb(F.lit(color), F.lit(b))).first()[0]
    assert [f"{argb(11, b):08x}" for b in (0, 1, 2, 3)] == ["ff4f4f4f", "ff606060", "ff707070", "ff3b3b3b"]
    assert [f"{argb(12, b):08x}" for b in (0, 1, 2, 3)] == ["ff2d2db4", "ff3737dc", "ff4040ff", "ff212187"]
    assert argb(0, 1) == argb(62, 1) == argb(-1, 1) == 0
    assert one.select(c.argb_of_packed(c.packed_id(F.lit(11), F.lit(2)))).first()[0] == argb(11, 2)
    assert one.select(c.argb(F.lit(11), F.lit(9))).first()[0] == argb(11, 1)


def test_blending(spark):
    rows = spark.createDataFrame([(0x80FFFFFF, 0xFF606060), (0, 7), (0xFF123456, 7), (0x80FFFFFF, 0)], "o long, b long")
    got = [f"{r[0]:08x}" for r in rows.select(c.blend(F.col("o"), F.col("b"))).collect()]
    assert got[:3] == ["ffb0b0b0", "00000007", "ff123456"] and got[3] == "ff808080"


def test_slopes_and_water(spark):
    rows = spark.createDataFrame([(d, p) for d in (-12.0, -1.0, 0.0, 1.0, 12.0) for p in (0.0, 1.0)], "d double, p double")
    got = [r[0] for r in rows.select(raster.slope(F.col("d"), 1, F.col("p"))).collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2, 2, 2, 2]
    deep = spark.createDataFrame([(0, 0.0), (7, 0.0), (7, 1.0), (12, 0.0), (3, 1.0)], "d long, p double")
    assert [r[0] for r in deep.select(raster.water(F.col("d"), F.col("p"))).collect()] == [2, 1, 0, 0, 1]


def test_shade_looks_north(spark):
    rows = [("d", 0, 0, 11, 20.0, 0, 0, "k"), ("d", 0, 1, 11, 8.0, 0, 0, "k"), ("d", 0, 2, 11, 20.0, 0, 0, "k"), ("d", 1, 0, 4, 1.0, 30, 0, "k"), ("d", 1, 1, 12, 1.0, 30, 0, "k")]
    got = {(r.px, r.py): r.brightness for r in raster.shade(spark.createDataFrame(rows, PIXEL), 1).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (0, 2): 2, (1, 0): 1, (1, 1): 0}


def test_pixels_of_many_blocks(spark):
    grid = Grid(tile_size=16, max_zoom=2, pixels_per_block=1)
    rows = [("d", 0, 0, 3, 5, "A", 1, 9), ("d", 0, 1, 4, 7, "B", 1, 0), ("d", 1, 0, 5, 7, "C", 1, 8), ("d", 1, 1, 5, 5, "D", 0, 0), ("d", -1, 0, 1, 2, "E", 0, 0)]
    got = {(r.px, r.py): (r.color, r.height, r.depth, r.overlay, r.kind) for r in raster.pixels(spark.createDataFrame(rows, SAMPLE), grid, 1).collect()}
    # two blocks of either colour: the one met first stays
    assert got == {(0, 0): (5, 4.25, 0, 8, "D"), (-1, 0): (2, 1.0, 0, 0, "E")}


def test_blocks_of_many_pixels(spark):
    grid = Grid(tile_size=16, max_zoom=2, pixels_per_block=2)
    got = raster.pixels(spark.createDataFrame([("d", -1, 2, 3, 5, "A", 1, 9)], SAMPLE), grid, 2).collect()
    assert {(r.px, r.py) for r in got} == {(-2, 4), (-1, 4), (-2, 5), (-1, 5)}


def _halve(spark, four):
    rows = [("d", q % 2, q // 2, v) for q, v in enumerate(four) if v is not None]
    return [r.argb for r in pyramid.halve(spark.createDataFrame(rows, "dimension string, px long, py long, argb long")).collect()]


def test_halving(spark):
    assert _halve(spark, [0xFFFF0000, None, None, None]) == [0x40FF0000]
    assert _halve(spark, [0xFFFF0000, 0, 0, 0]) == [0x40FF0000]
    assert _halve(spark, [0xFF000001, 0xFF000002, 0xFF000002, 0xFF000002]) == [0xFF000002]
    assert _halve(spark, [0, 0, 0, 0]) == [0]


def test_pyramid_has_no_tile_without_children(spark):
    grid = Grid(tile_size=4, max_zoom=3, pixels_per_block=1)
    leaves = spark.createDataFrame([("d", x, 0, 0xFF00FF00) for x in range(4)], "dimension string, px long, py long, argb long")
    got = pyramid.pyramid(leaves, grid).groupBy("zoom").count().collect()
    assert {r.zoom: r["count"] for r in got} == {3: 4, 2: 2, 1: 1, 0: 1}


def test_priority_and_expansion(spark):
    dirty = spark.createDataFrame([("d", z, 0, 0) for z in (0, 3, 1, 3)], "dimension string, zoom int, x long, y long")
    assert [r.zoom for r in pyramid.by_priority(dirty).collect()] == [3, 1, 0]
    root = spark.createDataFrame([(1, "d", 0, 0, 0)], "root_id int, dimension string, zoom int, x long, y long")
    stored = spark.createDataFrame([("d", 1, 0, 0)], "dimension string, zoom int, x long, y long")
    got = pyramid.expand_misses(root, stored, 8).collect()
    assert len(got) == 256 and {r.visit for r in got} == set(range(1, 257))
    assert (1, 0, 0) not in {(r.zoom, r.x, r.y) for r in got} and all(r.action == "mark" for r in got)
    small = pyramid.expand_misses(root, stored, 2).orderBy("visit").collect()
    assert [(r.zoom, r.x, r.y) for r in small[:4]] == [(0, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)] and len(small) == 16


def test_png_round_trip(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    for image in (np.zeros((4, 4), np.int64), rnd.integers(0, 5, (16, 16)) + 0xFF000000, rnd.integers(0, 1 << 32, (32, 32))):
        data = png.encode(image.astype(np.int64))
        assert (png.decode(data) == image).all() and data[:4] == b"\x89PNG"


def test_slices_and_pending(spark):
    rows = spark.createDataFrame([("d", x, y, 1, 0.0, 0, 0, "k") for x in range(4) for y in range(4)], PIXEL)
    got = {(r.px, r.py) for r in raster.sliced(rows, 1, 2, 2, 1).collect()}
    assert got == {(0, 0), (1, 0)}
    assert spark.range(1).select(raster.pending(Grid(tile_size=4, pixels_per_block=1))).first()[0] == [0] * 16


def test_shade_passes_over_gaps(spark):
    rows = [("d", 0, y, 11, h, 0, 0, "k") for y, h in ((0, 90.0), (500, 10.0), (501, 90.0), (503, 10.0))]
    got = {r.py: (r.delta, r.brightness) for r in raster.shade(spark.createDataFrame(rows, PIXEL), 1).collect()}
    assert got == {0: (0.0, 1), 500: (0.0, 1), 501: (80.0, 2), 503: (0.0, 1)}


def test_a_bad_tile_does_not_stop_the_others(spark):
    rows = [("d", 1, 0, 0, x, 0, 0xFF000001) for x in range(4)] + [("d", 1, 1, 0, 9, 0, 5)]
    got = {r.tile_x: r for r in png.encode_tiles(spark.createDataFrame(rows, "dimension string, zoom int, tile_x long, tile_y long, in_x int, in_y int, argb long"), 4).collect()}
    assert got[0].png is not None and got[0].message is None and got[1].png is None and "IndexError" in got[1].message
    cut = spark.createDataFrame(rows, "dimension string, zoom int, tile_x long, tile_y long, in_x int, in_y int, argb long")
    assert png.decode_tiles(png.encode_tiles(cut, 4)).count() == 16


def test_refresh_equals_a_whole_pyramid(spark):
    import random

    rnd = random.Random(3)
    grid = Grid(tile_size=4, max_zoom=3, pixels_per_block=1)
    old = {(x, y): rnd.randrange(1 << 32) for x in range(-16, 16) for y in range(-16, 16) if rnd.random() < 0.9}
    new = {(x, y): rnd.randrange(1 << 32) for tx, ty in ((0, 0), (-1, 3), (-4, -4)) for x in range(4 * tx, 4 * tx + 4) for y in range(4 * ty, 4 * ty + 4)}
    frame = lambda d: spark.createDataFrame([("d", x, y, v) for (x, y), v in d.items()], "dimension string, px long, py long, argb long")
    stored = pyramid.pyramid(frame(old), grid)
    want = {(r.zoom, r.px, r.py): r.argb for r in pyramid.pyramid(frame(old | new), grid).collect()}
    got = {(r.zoom, r.px, r.py): r.argb for r in pyramid.refresh(stored, frame(new), grid).collect()}
    assert got.items() <= want.items()
    before = {(r.zoom, r.px, r.py): r.argb for r in stored.collect()}
    assert before | got == want and len(got) < len(want) / 2
