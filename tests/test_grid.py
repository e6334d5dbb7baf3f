import pytest
from pyspark.sql import functions as F

from tesselite.functions import grid as g
from tesselite.operators import tiles as t
from tesselite.plans.spec import Extent, Grid

GRID = Grid()
PROBES = [(0, 0), (1, 1), (-1, -1), (127, 127), (128, 128), (-128, -128), (-129, -129), (513, -129), (-10000, -10000), (23456, -7891)]


def test_floor_division(spark):
    rows = [(a, n) for a in (-129, -128, -1, 0, 1, 127, 128, 2**52 + 1, -(2**52) - 1) for n in (1, 2, 16, 128)]
    got = spark.createDataFrame(rows, "a long, n long").select("a", "n", g.floordiv(F.col("a"), F.col("n")).alias("q")).collect()
    assert all(r.q == r.a // r.n for r in got)


def test_tile_borders(spark):
    df = spark.createDataFrame([(v,) for v in (-1, -128, -129, 0, 127, 128)], "v long")
    x, _ = g.tile_of(GRID, 8, F.col("v"), F.col("v"))
    assert [r[0] for r in df.select(x).collect()] == [-1, -1, -2, 0, 0, 1]


@pytest.mark.parametrize("grid", [GRID, Grid(origin_x=-512, origin_z=384), Grid(max_zoom=4)])
def test_round_trips_at_every_zoom(spark, grid):
    df = spark.createDataFrame(PROBES, "x long, z long").withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(grid.max_zoom))))
    tx, ty = g.tile_of(grid, F.col("zoom"), F.col("x"), F.col("z"))
    at = df.withColumns({"tx": tx, "ty": ty})
    inside = g.contains(g.tile_bounds(grid, F.col("zoom"), F.col("tx"), F.col("ty")), F.col("x"), F.col("z"))
    assert at.filter(~inside).count() == 0
    e = Extent(-183, -96, 220, 144)
    nx, ny = g.to_normalized(e, F.col("tx"), F.col("ty"))
    back = g.to_signed(e, nx, ny)
    assert at.filter((back[0] != F.col("tx")) | (back[1] != F.col("ty"))).count() == 0
    px, py = g.client_pixel(grid, F.col("x"), F.col("z"))
    bx, bz = g.client_block(grid, px, py)
    assert df.filter((bx != F.col("x")) | (bz != F.col("z"))).count() == 0


def test_zoom_columns_equal_python(spark):
    df = spark.range(0, 12).select(F.col("id").cast("int").alias("zoom"))
    for r in df.select("zoom", g.blocks_per_tile(GRID, F.col("zoom")).alias("b"), g.exact_blocks_per_pixel(GRID, F.col("zoom")).alias("e")).collect():
        assert r.b == GRID.blocks_per_tile(r.zoom) and r.e == GRID.exact_blocks_per_pixel(r.zoom)


def test_boxes_and_chunks(spark):
    box = spark.createDataFrame([(0, 0, 512, 384), (5, 5, 5, 9)], "min_x long, min_z long, max_x long, max_z long")
    got = [(r.tile_x, r.tile_y) for r in t.bbox_tiles(box, GRID, 8).collect()]
    assert got == [(x, y) for y in range(3) for x in range(4)]
    chunk = spark.createDataFrame([("d", -1, -1)], "dimension string, chunk_x long, chunk_z long")
    r = t.with_metatile(t.chunk_tiles(chunk, GRID), 4).first()
    assert (r.tile_x, r.tile_y, r.start_x, r.start_y) == (-1, -1, -4, -4)


def test_ancestors_parents_children(spark):
    leaf = spark.createDataFrame([("d", 4, 12, 9), ("d", 0, 5, 5)], "dimension string, zoom int, x long, y long")
    up = [(r.ancestor_zoom, r.ancestor_x, r.ancestor_y) for r in t.ancestors(leaf, 0).orderBy("step").collect()]
    assert len(up) == 4 and up[0] == (3, 6, 4) and up[-1] == (0, 0, 0)
    assert [r.p and (r.p.zoom, r.p.x, r.p.y) for r in leaf.select(t.parent(0).alias("p")).collect()] == [(3, 6, 4), None]
    down = t.children(spark.createDataFrame([("d", 2, 3, -2), ("d", 8, 0, 0)], leaf.schema), 8).orderBy("quadrant").collect()
    assert [(r.child_zoom, r.child_x, r.child_y) for r in down] == [(3, 6, -4), (3, 7, -4), (3, 6, -3), (3, 7, -3)]


def test_extent_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "zoom int, x long, y long")
    assert tuple(t.signed_extent(none, 8).first()) == (0, 0, 0, 0)


def test_client_extent_and_rows(spark):
    one = spark.range(1)
    assert one.select(g.client_extent(GRID, Extent(-2, -1, 3, 4))).first()[0] == [-512.0, -1280.0, 1024.0, 256.0]
    y = g.client_tile_y(g.client_tile_y(F.col("id")))
    assert one.select(g.client_tile_y(F.lit(5)).alias("a"), y.alias("b")).first()[:] == (-6, 0)
    assert one.select(g.resolutions(Grid(max_zoom=3))).first()[0] == [8.0, 4.0, 2.0, 1.0]


def test_normalized_tiles_come_back(spark):
    tiles = spark.createDataFrame([("d", 8, -3, 4), ("d", 8, 2, -5)], "dimension string, zoom int, x long, y long")
    e = t.signed_extent(tiles, 8)
    n = t.normalized(tiles, e)
    assert {(r.normal_x, r.normal_y) for r in n.collect()} == {(0, 9), (5, 0)}
    assert {(r.x, r.y) for r in t.denormalized(n.drop("x", "y"), e).collect()} == {(-3, 4), (2, -5)}
