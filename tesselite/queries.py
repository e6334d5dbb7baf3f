"""Queries of the map engine over the supplied tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.functions import color as c
from tesselite.functions import grid as g
from tesselite.functions import text as x
from tesselite.operators import jobs as j
from tesselite.operators import markers as m
from tesselite.operators import png, publish, pyramid, raster, surface
from tesselite.operators import tiles as t
from tesselite.plans.spec import Extent, Grid, MarkerPolicy, Profile, Scheduling, ServerMode, Settings
from tesselite.sources import fixtures as fx

#: Grid of tile queries, and of the raster queries, whose world is 64 blocks wide.
GRID = Grid()
MAP = Grid(tile_size=16, min_zoom=0, max_zoom=4, pixels_per_block=2)
PROFILE = Profile()
WORLD = "world"
DEBOUNCE_MS = 3 * 3_600_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- SQL that several oracles share ---------------------------------------------------------------------------------

EVENTS = "ev AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms FROM events)"
CHANGES = EVENTS + """, ch AS (
  SELECT event_id, user_id * 37 - 2750 AS bx, k * 53 - 2600 AS bz, ts_ms, CASE WHEN k % 10 <> 0 THEN k % 16 END AS ps,
    CASE WHEN event_type = 'view' THEN k % 16 ELSE k % 16 + 16 END AS s, k % 4 AS pb, CASE WHEN event_type = 'view' THEN k % 4 ELSE user_id % 4 END AS b, event_type = 'signup' AS is_new FROM ev
)"""
MARKS = EVENTS + ", mk AS (SELECT user_id % 8 - 4 AS chunk_x, k % 8 - 4 AS chunk_z, ts_ms FROM ev WHERE event_type <> 'view')"
VOXELS = """reg(material, is_air, fluid, shape_empty, bottom, top, solid, leaves, occl, color, fcolor, sturdy) AS (VALUES
  (0,true,false,true,NULL,NULL,false,false,false,0,0,false),(1,false,false,false,0.0,1.0,true,false,true,1,1,true),(2,false,false,false,0.0,1.0,true,false,true,11,11,true),(3,false,false,false,0.0,1.0,true,false,true,10,10,true),
  (4,false,true,true,NULL,NULL,false,false,false,12,12,false),(5,false,true,true,NULL,NULL,false,false,false,4,4,false),(6,false,false,false,0.0,1.0,false,false,false,0,0,true),(7,false,false,false,0.0,1.0,false,false,false,8,8,true),
  (8,false,false,false,0.0,1.0,false,false,false,5,5,true),(9,false,false,false,0.0,1.0,false,true,false,7,7,false),(10,false,false,false,0.0,0.0625,false,false,true,8,8,false),(11,false,false,false,0.0,0.125,false,false,true,8,8,false),
  (12,false,false,true,NULL,NULL,false,false,false,0,0,false),(13,false,false,false,0.0,0.5,false,false,true,11,11,false),(14,false,true,false,0.0,1.0,false,false,false,12,12,false),(15,false,true,false,0.0,0.5,false,false,true,11,12,false)
), kinds AS (
  SELECT *, CASE WHEN is_air THEN NULL WHEN fluid THEN 'FLUID_SURFACE' WHEN shape_empty THEN 'DECORATION_VISUAL' WHEN bottom <= 1e-6 AND top <= 0.25 THEN 'THIN_OVERLAY'
    WHEN solid THEN CASE WHEN leaves THEN 'FOLIAGE_SURFACE' ELSE 'OPAQUE_SURFACE' END WHEN leaves THEN 'FOLIAGE_SURFACE' WHEN top >= 1 - 1e-6 AND NOT occl THEN 'TRANSPARENT_STRUCTURE' ELSE 'UNKNOWN_FALLBACK' END AS kind,
    CASE WHEN fluid AND NOT sturdy THEN fcolor ELSE color END AS seen FROM reg
), vox AS (
  SELECT l_partkey % 64 - 32 AS x, CAST(l_quantity AS BIGINT) AS y, l_suppkey % 64 - 32 AS z, CAST(max(l_orderkey % 16) AS INTEGER) AS material FROM lineitem
  WHERE NOT ((l_partkey % 64 // 16) * 3 + l_suppkey % 64 // 16) % 13 = 3 AND NOT (l_partkey % 64 % 7 = 3 AND l_suppkey % 64 % 5 = 2) GROUP BY 1, 2, 3
)"""
_RGB = ", ".join(map(str, c.BASE_COLORS))
COLORS = f"pal AS (SELECT [{_RGB}] AS p)"
SURFACES = VOXELS + ", " + COLORS + """, seen AS (SELECT v.*, k.kind, k.fluid, k.color, k.seen FROM vox v JOIN kinds k USING (material) WHERE k.kind IS NOT NULL
), srf AS (
  SELECT x, z, max(y) AS top, arg_max({'y': y, 'kind': kind, 'color': color, 'seen': seen}, y) FILTER (kind NOT IN ('THIN_OVERLAY', 'DECORATION_VISUAL')) AS s, max(color) FILTER (y = 0) AS at_min FROM seen GROUP BY x, z
), low AS (
  SELECT seen.*, srf.s.y AS sy, srf.s.kind AS skind FROM seen JOIN srf USING (x, z)
), run AS (
  SELECT x, z, count(*) FILTER (sy - y = rn) AS depth FROM (SELECT x, z, y, sy, row_number() OVER (PARTITION BY x, z ORDER BY y DESC) AS rn FROM low WHERE fluid AND y < sy) GROUP BY x, z
), aside AS (
  SELECT x, z, arg_max(color, y) FILTER (kind = 'THIN_OVERLAY' AND color <> 0 AND (sy IS NULL OR y > sy)) AS thin,
    arg_max({'kind': kind, 'color': color}, y) FILTER (skind = 'TRANSPARENT_STRUCTURE' AND kind NOT IN ('TRANSPARENT_STRUCTURE', 'DECORATION_VISUAL') AND y < sy) AS b FROM low GROUP BY x, z
), colm AS (
  SELECT x, z, CASE WHEN top <= 0 OR s IS NULL THEN 0 ELSE s.y END AS y,
    CASE WHEN top <= 0 THEN 11 WHEN s IS NULL THEN coalesce(at_min, 0) WHEN s.kind = 'TRANSPARENT_STRUCTURE' AND b.color <> 0 THEN b.color ELSE s.seen END AS color,
    CASE WHEN top <= 0 THEN 'OPAQUE_SURFACE' WHEN s IS NULL THEN 'UNKNOWN_FALLBACK' WHEN s.kind = 'TRANSPARENT_STRUCTURE' AND b.color <> 0 THEN b.kind ELSE s.kind END AS kind,
    CASE WHEN top > 0 AND s.kind = 'FLUID_SURFACE' THEN coalesce(depth, 0) ELSE 0 END AS depth,
    CASE WHEN top <= 0 THEN 0 WHEN s.kind = 'TRANSPARENT_STRUCTURE' THEN CASE WHEN s.color = 0 THEN 0 ELSE 2147483648 + p[s.color + 1] END ELSE coalesce(CASE WHEN thin = 0 THEN 0 ELSE 2147483648 + p[thin + 1] END, 0) END AS overlay
  FROM srf LEFT JOIN run USING (x, z) JOIN aside USING (x, z), pal
)"""
DENSE = SURFACES + """, chk AS (SELECT DISTINCT CAST(floor(x / 16.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(z / 16.0::DOUBLE) AS BIGINT) AS cz FROM vox
), den AS (
  SELECT a.x, a.z, coalesce(y, 0) AS y, coalesce(color, 11) AS color, coalesce(kind, 'OPAQUE_SURFACE') AS kind, coalesce(depth, 0) AS depth, coalesce(overlay, 0) AS overlay
  FROM (SELECT cx * 16 + i AS x, cz * 16 + k AS z FROM chk, generate_series(0, 15) s(i), generate_series(0, 15) t(k)) a LEFT JOIN colm USING (x, z)
)"""
SHADED = DENSE + """, pix AS (
  SELECT 2 * x + i AS px, 2 * z + k AS py, color, CAST(CAST(y AS FLOAT) AS DOUBLE) AS h, depth, overlay FROM den, generate_series(0, 1) a(i), generate_series(0, 1) b(k)
), dlt AS (SELECT *, h - coalesce(CASE WHEN py - lag(py) OVER w = 1 THEN lag(h) OVER w END, h) AS d, ((px + py) % 2 + 2) % 2 AS o FROM pix WINDOW w AS (PARTITION BY px ORDER BY py)
), brt AS (
  SELECT *, CASE WHEN color = 12 THEN CASE WHEN depth * 0.1::DOUBLE + o * 0.2::DOUBLE < 0.5::DOUBLE THEN 2 WHEN depth * 0.1::DOUBLE + o * 0.2::DOUBLE > 0.9::DOUBLE THEN 0 ELSE 1 END
    ELSE CASE WHEN d * 4.0::DOUBLE / 5.0::DOUBLE + (o::DOUBLE - 0.5::DOUBLE) * 0.4::DOUBLE > 0.6::DOUBLE THEN 2 WHEN d * 4.0::DOUBLE / 5.0::DOUBLE + (o::DOUBLE - 0.5::DOUBLE) * 0.4::DOUBLE < -0.6::DOUBLE THEN 0 ELSE 1 END END AS br FROM dlt
), bas AS (
  SELECT *, CASE WHEN color > 0 AND color < 62 THEN p[color + 1] END AS rgb, CASE br WHEN 0 THEN 180 WHEN 1 THEN 220 ELSE 255 END AS md FROM brt, pal
), rgbs AS (
  SELECT *, coalesce((rgb >> 16) & 255, 0) * md // 255 AS r0, coalesce((rgb >> 8) & 255, 0) * md // 255 AS g0, coalesce(rgb & 255, 0) * md // 255 AS b0, (overlay >> 24) & 255 AS oa FROM bas
), shd AS (
  SELECT px, py, br, CAST(CASE WHEN oa = 0 THEN CASE WHEN rgb IS NULL THEN 0 ELSE 4278190080 + r0 * 65536 + g0 * 256 + b0 END
    ELSE 4278190080 + CAST(floor(((overlay >> 16) & 255) * (oa::DOUBLE / 255.0::DOUBLE) + r0 * (1.0::DOUBLE - oa::DOUBLE / 255.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) * 65536
      + CAST(floor(((overlay >> 8) & 255) * (oa::DOUBLE / 255.0::DOUBLE) + g0 * (1.0::DOUBLE - oa::DOUBLE / 255.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) * 256
      + CAST(floor((overlay & 255) * (oa::DOUBLE / 255.0::DOUBLE) + b0 * (1.0::DOUBLE - oa::DOUBLE / 255.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) END AS BIGINT) AS argb
  FROM rgbs
)"""


# --- spatial algebra -------------------------------------------------------------------------------------------------


@query(f"WITH {CHANGES} SELECT CAST(z AS INTEGER) AS zoom, CAST(floor(bx / CAST(128 * (1 << CAST(8 - z AS INTEGER)) AS DOUBLE)) AS BIGINT) AS x, CAST(floor(bz / CAST(128 * (1 << CAST(8 - z AS INTEGER)) AS DOUBLE)) AS BIGINT) AS y, count(*) AS n FROM ch, generate_series(0, 8) s(z) GROUP BY 1, 2, 3")
def block_to_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each tile of every zoom."""
    rows = fx.block_changes(spark, sf_dir).withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(8))))
    tx, ty = g.tile_of(GRID, F.col("zoom"), F.col("block_x"), F.col("block_z"))
    return rows.groupBy("zoom", tx.alias("x"), ty.alias("y")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT CAST(o_orderkey % 11 AS INTEGER) AS zoom, o_custkey % 600 - 300 AS pixel FROM orders), b AS (SELECT *, CAST(128 * (1 << greatest(8 - zoom, 0)) AS BIGINT) AS bpt FROM p)
SELECT zoom, pixel, bpt, greatest(1, bpt // 256) AS bpp, bpt / 256.0::DOUBLE AS exact, CAST(floor(pixel * bpt / 256.0::DOUBLE) AS BIGINT) AS first_block,
  greatest(1, CAST(floor((pixel + 1) * bpt / 256.0::DOUBLE) AS BIGINT) - CAST(floor(pixel * bpt / 256.0::DOUBLE) AS BIGINT)) AS span FROM b""")
def pixel_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pixels at every zoom, also above the highest."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = o.select((F.col("o_orderkey") % 11).cast("int").alias("zoom"), (F.col("o_custkey") % 600 - 300).alias("pixel")).distinct()
    z, px = F.col("zoom"), F.col("pixel")
    return p.select("zoom", "pixel", g.blocks_per_tile(GRID, z).alias("bpt"), g.blocks_per_pixel(GRID, z).alias("bpp"), g.exact_blocks_per_pixel(GRID, z).alias("exact"), g.first_block(GRID, z, px).alias("first_block"), g.block_span(GRID, z, px).alias("span"))


BOXES = "bx AS (SELECT o_orderkey AS box_id, o_custkey % 2000 - 1000 AS x0, o_orderkey % 2000 - 1000 AS z0, o_custkey % 2000 - 1000 + o_orderkey % 500 + 1 AS x1, o_orderkey % 2000 - 1000 + o_custkey % 300 + 1 AS z1 FROM orders)"


@query(f"WITH {BOXES} SELECT box_id, tx AS tile_x, ty AS tile_y FROM bx, LATERAL (SELECT unnest(generate_series(CAST(floor(x0 / 128.0::DOUBLE) AS BIGINT), CAST(floor((x1 - 1) / 128.0::DOUBLE) AS BIGINT))) AS tx) a, LATERAL (SELECT unnest(generate_series(CAST(floor(z0 / 128.0::DOUBLE) AS BIGINT), CAST(floor((z1 - 1) / 128.0::DOUBLE) AS BIGINT))) AS ty) b")
def bbox_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bbox_tiles(fx.boxes(spark, sf_dir), GRID, GRID.max_zoom).select("box_id", "tile_x", "tile_y")


@query(f"WITH {BOXES}, tl AS (SELECT box_id, x0, z0, CAST(floor(x0 / 128.0::DOUBLE) AS BIGINT) AS tx, CAST(floor(z0 / 128.0::DOUBLE) AS BIGINT) AS ty FROM bx) SELECT box_id, tx AS tile_x, ty AS tile_y, tx * 128 AS min_x, ty * 128 AS min_z, tx * 128 + 128 AS max_x, ty * 128 + 128 AS max_z, true AS inside, CAST(x0 * 2 AS DOUBLE) AS pixel_x, CAST(z0 * 2 AS DOUBLE) AS pixel_y FROM tl")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box's first block, its tile, that tile's box, and whether it holds the block."""
    b = fx.boxes(spark, sf_dir)
    tx, ty = g.tile_of(GRID, 8, F.col("min_x"), F.col("min_z"))
    box = g.tile_bounds(GRID, 8, tx, ty)
    px, py = g.pixel_at_max(GRID, F.col("min_x"), F.col("min_z"))
    return b.select("box_id", tx.alias("tile_x"), ty.alias("tile_y"), *[v.alias(n) for v, n in zip(box, ("min_x", "min_z", "max_x", "max_z"), strict=True)], g.contains(box, F.col("min_x"), F.col("min_z")).alias("inside"), px.alias("pixel_x"), py.alias("pixel_y"))


REQUESTS = EVENTS + ", rq AS (SELECT event_id AS request_id, CAST(k % 9 AS INTEGER) AS zoom, user_id - 75 AS x, k - 50 AS y, ts_ms FROM ev)"
STORED = "st AS (SELECT DISTINCT CAST(o_orderkey % 9 AS INTEGER) AS zoom, o_custkey % 150 - 75 AS x, o_orderkey % 100 - 50 AS y FROM orders)"


@query(f"WITH {REQUESTS} SELECT DISTINCT CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 4 AS start_x, CAST(floor(y / 4.0::DOUBLE) AS BIGINT) * 4 AS start_y, CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 512 AS min_x, CAST(floor(y / 4.0::DOUBLE) AS BIGINT) * 512 AS min_z, CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 512 + 512 AS max_x, CAST(floor(y / 4.0::DOUBLE) AS BIGINT) * 512 + 512 AS max_z, CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 512 - 2 AS padded_x, CAST(1028 AS BIGINT) AS total, CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 512 - 1 AS origin_x FROM rq WHERE zoom = 8")
def metatiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of tiles that requests of the highest zoom fall into, with their boxes and lattice."""
    r = fx.tile_requests(spark, sf_dir).filter("zoom = 8").withColumnsRenamed({"x": "tile_x", "y": "tile_y"})
    s = t.with_metatile(r, 4).select("start_x", "start_y").distinct()
    box, padded = t.job_bounds(GRID, 8, 4), t.job_bounds(GRID, 8, 4, 2)
    grid = raster.lattice(GRID, 8, F.col("start_x"), F.col("start_y"), 4, 2)
    return s.select("start_x", "start_y", *[v.alias(n) for v, n in zip(box, ("min_x", "min_z", "max_x", "max_z"), strict=True)], padded[0].alias("padded_x"), grid["total"].alias("total"), grid["origin_x"].alias("origin_x"))


@query(f"WITH {REQUESTS}, s AS (SELECT DISTINCT CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 4 AS sx, CAST(floor(y / 4.0::DOUBLE) AS BIGINT) * 4 AS sy FROM rq WHERE zoom = 8) SELECT sx AS start_x, sy AS start_y, sx + i AS tile_x, sy + k AS tile_y FROM s, generate_series(0, 3) a(i), generate_series(0, 3) b(k)")
def job_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.tile_requests(spark, sf_dir).filter("zoom = 8").withColumnsRenamed({"x": "tile_x", "y": "tile_y"})
    return t.job_tiles(t.with_metatile(r, 4).select("start_x", "start_y").distinct(), 4)


@query(f"WITH {STORED} SELECT zoom, x, y, CAST(zoom - az - 1 AS INTEGER) AS step, CAST(az AS INTEGER) AS ancestor_zoom, CAST(floor(x / CAST(1 << CAST(zoom - az AS INTEGER) AS DOUBLE)) AS BIGINT) AS ancestor_x, CAST(floor(y / CAST(1 << CAST(zoom - az AS INTEGER) AS DOUBLE)) AS BIGINT) AS ancestor_y FROM st, generate_series(0, 7) s(az) WHERE az < zoom")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.ancestors(fx.stored_tiles(spark, sf_dir).drop("dimension"), 0)


@query(f"WITH {STORED} SELECT zoom, x, y, CASE WHEN zoom > 0 THEN zoom - 1 END AS parent_zoom, CASE WHEN zoom > 0 THEN CAST(floor(x / 2.0::DOUBLE) AS BIGINT) END AS parent_x, CASE WHEN zoom > 0 THEN CAST(floor(y / 2.0::DOUBLE) AS BIGINT) END AS parent_y FROM st")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = t.parent(0)
    return fx.stored_tiles(spark, sf_dir).select("zoom", "x", "y", up["zoom"].alias("parent_zoom"), up["x"].alias("parent_x"), up["y"].alias("parent_y"))


@query(f"WITH {STORED} SELECT zoom, x, y, CAST(q AS INTEGER) AS quadrant, zoom + 1 AS child_zoom, 2 * x + q % 2 AS child_x, 2 * y + q // 2 AS child_y FROM st, generate_series(0, 3) s(q) WHERE zoom < 8")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.children(fx.stored_tiles(spark, sf_dir).drop("dimension"), 8)


@query(f"WITH {STORED}, e AS (SELECT coalesce(min(x), 0) AS mx, coalesce(min(y), 0) AS my, coalesce(max(x), 0) AS gx, coalesce(max(y), 0) AS gy FROM st WHERE zoom = 8) SELECT zoom, x, y, x - mx AS normal_x, y - my AS normal_y, gx - mx AS width, gy - my AS height FROM st, e")
def normalized_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stored_tiles(spark, sf_dir)
    e = t.signed_extent(s, 8)
    size = {"width": e.select(F.col("max_x") - F.col("min_x")).scalar(), "height": e.select(F.col("max_y") - F.col("min_y")).scalar()}
    return t.normalized(s, e).withColumns(size).select("zoom", "x", "y", "normal_x", "normal_y", "width", "height")


@query(f"WITH {BOXES} SELECT box_id, CAST(x0 * 2 AS DOUBLE) AS px, CAST(-z0 * 2 AS DOUBLE) AS py, CAST(x0 AS DOUBLE) AS back_x, CAST(z0 AS DOUBLE) AS back_z, -z0 - 1 AS flipped FROM bx")
def client_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as the client's pixels and back, and rows counted upwards."""
    px, py = g.client_pixel(GRID, F.col("min_x"), F.col("min_z"))
    bx, bz = g.client_block(GRID, px, py)
    return fx.boxes(spark, sf_dir).select("box_id", px.alias("px"), py.alias("py"), bx.alias("back_x"), bz.alias("back_z"), g.client_tile_y(F.col("min_z")).alias("flipped"))


@query("SELECT CAST(z AS INTEGER) AS zoom, CAST(1 << CAST(8 - z AS INTEGER) AS DOUBLE) AS resolution FROM generate_series(0, 8) s(z)")
def client_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(g.resolutions(GRID)).alias("zoom", "resolution"))


# --- changes and jobs ------------------------------------------------------------------------------------------------

EFFECTIVE = CHANGES + ", ef AS (SELECT CAST(floor(bx / 16.0::DOUBLE) AS BIGINT) AS chunk_x, CAST(floor(bz / 16.0::DOUBLE) AS BIGINT) AS chunk_z, ts_ms FROM ch WHERE (ps IS NOT NULL AND ps <> s AND pb <> b) OR is_new)"


@query(f"WITH {EFFECTIVE} SELECT chunk_x, chunk_z, count(*) AS n, max(ts_ms) AS last_ms FROM ef GROUP BY 1, 2")
def effective_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.effective_changes(fx.block_changes(spark, sf_dir)).groupBy("chunk_x", "chunk_z").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))


@query(f"WITH {MARKS}, l AS (SELECT chunk_x, chunk_z, max(ts_ms) AS last_ms FROM mk GROUP BY 1, 2) SELECT * FROM l WHERE {fx.NOW_MS} - last_ms >= {DEBOUNCE_MS}")
def settled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.settled(fx.dirty_marks(spark, sf_dir), fx.NOW_MS, DEBOUNCE_MS).select("chunk_x", "chunk_z", "last_ms")


@query(f"""WITH {MARKS}, gp AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {DEBOUNCE_MS} THEN 0 ELSE 1 END AS st FROM mk WINDOW w AS (PARTITION BY chunk_x, chunk_z ORDER BY ts_ms)),
il AS (SELECT *, sum(st) OVER (PARTITION BY chunk_x, chunk_z ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS island FROM gp)
SELECT chunk_x, chunk_z, CAST(island AS BIGINT) AS island, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS marks, max(ts_ms) + {DEBOUNCE_MS} AS ready_ms FROM il GROUP BY 1, 2, 3""")
def debounce_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.debounce_islands(fx.dirty_marks(spark, sf_dir), DEBOUNCE_MS).drop("dimension")


@query(f"WITH {EFFECTIVE} SELECT DISTINCT CAST(floor(chunk_x / 32.0::DOUBLE) AS BIGINT) * 4 AS start_x, CAST(floor(chunk_z / 32.0::DOUBLE) AS BIGINT) * 4 AS start_y FROM ef")
def dirty_metatiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of tiles that changes make necessary."""
    chunks = j.effective_changes(fx.block_changes(spark, sf_dir)).select("dimension", "chunk_x", "chunk_z").distinct()
    return j.metatile_jobs(chunks, PROFILE).select("start_x", "start_y")


@query(f"WITH {MARKS} SELECT DISTINCT chunk_x, chunk_z, CAST(floor(chunk_x / 8.0::DOUBLE) AS BIGINT) AS tile_x, CAST(floor(chunk_z / 8.0::DOUBLE) AS BIGINT) AS tile_y FROM mk")
def chunk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.dirty_marks(spark, sf_dir).select("dimension", "chunk_x", "chunk_z").distinct()
    return t.chunk_tiles(chunks, GRID).select("chunk_x", "chunk_z", "tile_x", "tile_y")


@query(f"""WITH {REQUESTS}, s AS (SELECT request_id, CAST(floor(x / 4.0::DOUBLE) AS BIGINT) * 4 AS start_x, CAST(floor(y / 4.0::DOUBLE) AS BIGINT) * 4 AS start_y FROM rq),
n AS (SELECT *, row_number() OVER (PARTITION BY start_x, start_y ORDER BY request_id) AS nth FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY nth = 1 ORDER BY request_id) AS place FROM n)
SELECT request_id, start_x, start_y, CASE WHEN nth > 1 THEN 'duplicate' WHEN place <= 512 THEN 'accepted' ELSE 'dropped' END AS outcome FROM q""")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.with_metatile(fx.tile_requests(spark, sf_dir).withColumnsRenamed({"x": "tile_x", "y": "tile_y"}), 4).select("request_id", "start_x", "start_y")
    return j.bounded_queue(r, 512, ["start_x", "start_y"], ["request_id"])


@query(f"""WITH {EVENTS}, sm AS (SELECT event_id AS id, ts_ms AS tm, (1700 + k * 3) / 100.0::DOUBLE AS tps FROM ev)
SELECT id, tps, coalesce(last_value(CASE WHEN tps < 18.5::DOUBLE THEN true WHEN tps >= 19.2::DOUBLE THEN false END IGNORE NULLS) OVER (ORDER BY tm, id ROWS UNBOUNDED PRECEDING), false) AS paused FROM sm""")
def tps_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.throttle(fx.tps_samples(spark, sf_dir), Scheduling(), ["at", "id"]).select("id", "tps", "paused")


@query(f"WITH {EVENTS} SELECT event_id, least(20.0::DOUBLE, 1e9::DOUBLE / ((k * 1000003)::DOUBLE + 1.0::DOUBLE)) AS tps FROM ev")
def tps_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks a second from the mean time of a tick."""
    return fx._events(spark, sf_dir).select("event_id", j.tps(F.lit(20.0), (F.col("k") * 1_000_003).cast("double")).alias("tps"))


@query("SELECT CAST(i AS INTEGER) AS side, [-768.0::DOUBLE, -1536.0::DOUBLE, 2304.0::DOUBLE, 512.0::DOUBLE][i] AS bound FROM generate_series(1, 4) s(i)")
def client_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of a published extent in the client's pixels."""
    return spark.range(1).select(F.posexplode(g.client_extent(GRID, Extent(-3, -2, 8, 5))).alias("i", "bound")).select((F.col("i") + 1).alias("side"), "bound")


@query(f"""WITH {STORED}, up AS (SELECT DISTINCT CAST(az AS INTEGER) AS zoom, CAST(floor(x / CAST(1 << CAST(zoom - az AS INTEGER) AS DOUBLE)) AS BIGINT) AS x, CAST(floor(y / CAST(1 << CAST(zoom - az AS INTEGER) AS DOUBLE)) AS BIGINT) AS y FROM st, generate_series(0, 7) s(az) WHERE az < zoom)
SELECT * FROM up ORDER BY zoom DESC, x, y LIMIT 64""")
def ancestor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next tiles above changed ones, deepest first, as many as one pass takes."""
    return pyramid.by_priority(pyramid.dirty_ancestors(fx.stored_tiles(spark, sf_dir), 0), 64).select("zoom", "x", "y")


@query(f"""WITH RECURSIVE {STORED}, roots AS (SELECT o_custkey AS root_id, 0 AS zoom, o_custkey % 3 - 1 AS x, o_custkey % 5 - 2 AS y FROM (SELECT DISTINCT o_custkey FROM orders)),
lv(root_id, zoom, x, y, rnk) AS (
  SELECT root_id, zoom, x, y, CAST(1 AS BIGINT) FROM roots
  UNION ALL
  SELECT root_id, zoom, x, y, row_number() OVER (PARTITION BY root_id ORDER BY rnk, q) FROM (
    SELECT l.root_id, l.zoom + 1 AS zoom, 2 * l.x + q % 2 AS x, 2 * l.y + q // 2 AS y, l.rnk, q FROM lv l, generate_series(0, 3) s(q) WHERE l.zoom < 5
  ) k WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.zoom = k.zoom AND st.x = k.x AND st.y = k.y)
), vis AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY zoom, rnk) AS visit FROM lv)
SELECT root_id, zoom, x, y, visit, CASE WHEN zoom >= 5 THEN 'render' ELSE 'mark' END AS action FROM vis WHERE visit <= 256""")
def miss_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_custkey")
    roots = o.select(k.alias("root_id"), F.lit(fx.DIMENSION).alias("dimension"), F.lit(0).alias("zoom"), (k % 3 - 1).alias("x"), (k % 5 - 2).alias("y")).distinct()
    return pyramid.expand_misses(roots, fx.stored_tiles(spark, sf_dir), 5).drop("dimension")


@query(f"""WITH {REQUESTS}, {STORED}, v AS (SELECT *, CASE WHEN request_id % 10 = 0 THEN 'old' ELSE 'now' END AS version, CASE WHEN request_id % 15 = 0 THEN 'other' ELSE 'world' END AS world FROM rq), w AS (
SELECT v.*, st.zoom IS NOT NULL AS hit, version <> 'now' OR world <> 'world' AS wrong FROM v LEFT JOIN st USING (zoom, x, y))
SELECT request_id, zoom, x, y, version, world, CASE WHEN wrong THEN 404 ELSE 200 END AS status, CASE WHEN NOT wrong AND hit THEN 'public, max-age=31536000, immutable' ELSE 'no-store' END AS cache_control,
  CASE WHEN wrong THEN 'gone' WHEN hit THEN 'ready' ELSE 'pending' END AS state, CASE WHEN NOT wrong AND NOT hit THEN 1 END AS retry_after, CASE WHEN NOT wrong AND NOT hit THEN CAST(1000 AS BIGINT) END AS retry_ms FROM w""")
def tile_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.tile_requests(spark, sf_dir)
    i = F.col("request_id")
    r = r.select("request_id", "dimension", "zoom", "x", "y", F.when(i % 10 == 0, "old").otherwise("now").alias("version"), F.when(i % 15 == 0, "other").otherwise("world").alias("world"))
    out = j.serve(r, fx.stored_tiles(spark, sf_dir), version="now", world="world", retry_ms=1500)
    return out.withColumn("retry_ms", j.retry_delay(F.col("state"), F.col("retry_after"), 1500)).drop("dimension")


@query(f"WITH {REQUESTS}, {STORED} SELECT r.request_id, st.zoom IS NOT NULL AS stored FROM rq r LEFT JOIN st USING (zoom, x, y)")
def tile_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose tile is stored, and those whose isn't, by semi and anti join."""
    from tesselite.sources import store

    r, s = fx.tile_requests(spark, sf_dir), fx.stored_tiles(spark, sf_dir)
    return store.existing(r, s).select("request_id", F.lit(True).alias("stored")).unionByName(store.missing(r, s).select("request_id", F.lit(False).alias("stored")))


@query(f"WITH {REQUESTS}, {STORED}, gn AS (SELECT zoom, x, y FROM rq WHERE request_id % 10 = 0), fr AS (SELECT DISTINCT zoom, x, y FROM rq WHERE request_id % 10 = 1) SELECT zoom, x, y, false AS fresh FROM st ANTI JOIN gn USING (zoom, x, y) ANTI JOIN fr USING (zoom, x, y) UNION ALL SELECT zoom, x, y, true FROM fr")
def changed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tiles after some were deleted and others put in their place."""
    from tesselite.sources import store

    r, key = fx.tile_requests(spark, sf_dir), ["dimension", "zoom", "x", "y"]
    tiles = lambda rows, fresh: rows.select(*key).distinct().withColumn("fresh", F.lit(fresh))
    left = store.without(tiles(fx.stored_tiles(spark, sf_dir), False), r.filter("request_id % 10 = 0"))
    return store.merged(left, tiles(r.filter("request_id % 10 = 1"), True)).drop("dimension")


# --- surface and raster ----------------------------------------------------------------------------------------------


@query(f"WITH {VOXELS} SELECT v.x, v.z, k.kind, count(*) AS n, bool_and(k.kind NOT IN ('THIN_OVERLAY', 'DECORATION_VISUAL')) AS ends FROM vox v JOIN kinds k USING (material) WHERE k.kind IS NOT NULL GROUP BY 1, 2, 3")
def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surface.classified(fx.voxels(spark, sf_dir), fx.registry(spark))
    return rows.groupBy("x", "z", "kind").agg(F.count("*").alias("n"), F.bool_and(surface.ends_walk(F.col("kind"))).alias("ends"))


@query(f"WITH {SURFACES} SELECT x, z, CAST(y AS BIGINT) AS y, color, kind, CAST(depth AS BIGINT) AS depth, CAST(overlay AS BIGINT) AS overlay FROM colm")
def surface_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.surfaces(fx.voxels(spark, sf_dir), fx.registry(spark), fx.MIN_BUILD).drop("dimension")


@query(f"WITH {VOXELS}, h AS (SELECT x, z, max(y) AS height FROM vox GROUP BY 1, 2) SELECT x, z, height, (x % 16 + 16) % 16 AS local_x, (z % 16 + 16) % 16 AS local_z FROM h")
def surface_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.surface_heights(fx.voxels(spark, sf_dir)).drop("dimension")


@query(f"WITH {VOXELS} SELECT CAST(floor(x / 16.0::DOUBLE) AS BIGINT) AS chunk_x, CAST(floor(z / 16.0::DOUBLE) AS BIGINT) AS chunk_z, count(*) AS blocks, max(y) AS highest FROM vox GROUP BY 1, 2")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.chunks_of(fx.voxels(spark, sf_dir)).drop("dimension")


@query(f"WITH {VOXELS}, {EVENTS}, p AS (SELECT event_id, user_id % 80 - 40 AS x, k % 60 AS y, event_id % 80 - 40 AS z FROM ev) SELECT event_id, p.x, p.y, p.z, coalesce(material, 0) AS material FROM p LEFT JOIN vox USING (x, y, z)")
def voxel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx._events(spark, sf_dir).select("event_id", F.lit(fx.DIMENSION).alias("dimension"), (F.col("user_id") % 80 - 40).alias("x"), (F.col("k") % 60).alias("y"), (F.col("event_id") % 80 - 40).alias("z"))
    return surface.lookup(e, fx.voxels(spark, sf_dir)).select("event_id", "x", "y", "z", "material")


@query(f"""WITH {VOXELS}, c AS (SELECT DISTINCT CAST(floor(x / 16.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(z / 16.0::DOUBLE) AS BIGINT) AS cz FROM vox), jb AS (SELECT a * 10 + b AS job_id, a * 24 - 60 AS x0, b * 24 - 60 AS z0 FROM generate_series(0, 4) s(a), generate_series(0, 4) t(b)),
w AS (SELECT job_id, i, k FROM jb, LATERAL (SELECT unnest(generate_series(CAST(floor(x0 / 16.0::DOUBLE) AS BIGINT), CAST(floor((x0 + 31) / 16.0::DOUBLE) AS BIGINT))) AS i) u, LATERAL (SELECT unnest(generate_series(CAST(floor(z0 / 16.0::DOUBLE) AS BIGINT), CAST(floor((z0 + 31) / 16.0::DOUBLE) AS BIGINT))) AS k) v)
SELECT job_id, count(*) AS chunks, count(c.cx) AS present, count(*) = count(c.cx) AS complete FROM w LEFT JOIN c ON c.cx = i AND c.cz = k GROUP BY 1""")
def complete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.complete_jobs(_jobs(spark), surface.chunks_of(fx.voxels(spark, sf_dir)))


def _jobs(spark: SparkSession) -> DataFrame:
    """Boxes that overlap, some of them beyond the world's edge."""
    a = spark.range(5).select(F.col("id").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    x0, z0 = F.col("a") * 24 - 60, F.col("b") * 24 - 60
    return a.select((F.col("a") * 10 + F.col("b")).alias("job_id"), F.lit(fx.DIMENSION).alias("dimension"), x0.alias("min_x"), z0.alias("min_z"), (x0 + 32).alias("max_x"), (z0 + 32).alias("max_z"))


@query(f"""WITH {BOXES}, d AS (SELECT DISTINCT x0 AS x, z0 AS z FROM bx), h1 AS (SELECT *, (((x + ((z % 2097152 + 2097152) % 2097152) * 231871) % 2097152) + 2097152) % 2097152 AS h FROM d),
h2 AS (SELECT *, ((h * h % 2097152) * (31287121 % 2097152) + h * 11) % 2097152 AS k FROM h1) SELECT x, z, CASE WHEN (k >> 20) & 1 = 0 THEN 10 ELSE 11 END AS color FROM h2""")
def ceiling_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = fx.boxes(spark, sf_dir).select("dimension", F.col("min_x").alias("x"), F.col("min_z").alias("z")).distinct()
    return surface.ceiling(cols).select("x", "z", "color")


@query(f"""WITH {SURFACES}, f AS (SELECT CAST(floor(x / 4.0::DOUBLE) AS BIGINT) AS px, CAST(floor(z / 4.0::DOUBLE) AS BIGINT) AS py, (x + 1000) * 10000 + z AS place, * FROM colm),
cc AS (SELECT px, py, color, count(*) AS n, min(place) AS first FROM f GROUP BY 1, 2, 3), dc AS (SELECT px, py, arg_min(color, n * -1000000000 + first) AS color FROM cc GROUP BY 1, 2)
SELECT px, py, any_value(dc.color) AS color, CAST(CAST(sum(y) / count(*)::DOUBLE AS FLOAT) AS DOUBLE) AS height, CAST(floor(sum(depth) / count(*)::DOUBLE) AS BIGINT) AS depth,
  CAST(coalesce(arg_max(overlay, place) FILTER (overlay <> 0), 0) AS BIGINT) AS overlay, arg_max(kind, place) AS kind FROM f JOIN dc USING (px, py) GROUP BY 1, 2""")
def pixel_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of four by four blocks."""
    s = surface.surfaces(fx.voxels(spark, sf_dir), fx.registry(spark), fx.MIN_BUILD)
    return raster.pixels(s, MAP, 1).select("px", "py", "color", F.col("height").cast("double").alias("height"), "depth", "overlay", "kind")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all columns of the chunks that are there."""
    v = fx.voxels(spark, sf_dir)
    return surface.dense(surface.chunk_columns(surface.chunks_of(v)), surface.surfaces(v, fx.registry(spark), fx.MIN_BUILD), fx.MIN_BUILD)


@query(f"WITH {DENSE} SELECT x, z, CAST(y AS BIGINT) AS y, color, kind, CAST(depth AS BIGINT) AS depth, CAST(overlay AS BIGINT) AS overlay FROM den")
def dense_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).drop("dimension")


_JOBS = "jb AS (SELECT a * 10 + b AS job_id, a * 24 - 60 AS x0, b * 24 - 60 AS z0 FROM generate_series(0, 4) s(a), generate_series(0, 4) t(b))"


@query(f"""WITH {DENSE}, {_JOBS}, wnt AS (SELECT job_id, i, k FROM jb, LATERAL (SELECT unnest(generate_series(CAST(floor(x0 / 16.0::DOUBLE) AS BIGINT), CAST(floor((x0 + 31) / 16.0::DOUBLE) AS BIGINT))) AS i) u, LATERAL (SELECT unnest(generate_series(CAST(floor(z0 / 16.0::DOUBLE) AS BIGINT), CAST(floor((z0 + 31) / 16.0::DOUBLE) AS BIGINT))) AS k) v),
whl AS (SELECT job_id FROM wnt LEFT JOIN chk ON cx = i AND cz = k GROUP BY 1 HAVING count(*) = count(cx))
SELECT job_id, x, z, CAST(y AS BIGINT) AS y, color FROM jb JOIN whl USING (job_id) JOIN den ON x >= x0 AND x < x0 + 32 AND z >= z0 AND z < z0 + 32""")
def complete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the jobs that may be rendered, because all of their chunks are there."""
    chunks = surface.chunks_of(fx.voxels(spark, sf_dir))
    return surface.in_complete_jobs(_dense(spark, sf_dir), _jobs(spark), chunks).select("job_id", "x", "z", "y", "color")


def _shaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _dense(spark, sf_dir)
    return raster.shade(raster.pixels(s, MAP, MAP.max_zoom), MAP.blocks_per_pixel(MAP.max_zoom))


@query(f"WITH {SHADED} SELECT px, py, br AS brightness, argb FROM shd")
def shaded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaded(spark, sf_dir).select("px", "py", "brightness", "argb")


@query(f"WITH {SHADED} SELECT CAST(floor(px / 16.0::DOUBLE) AS BIGINT) AS tile_x, CAST(floor(py / 16.0::DOUBLE) AS BIGINT) AS tile_y, count(*) AS pixels, count(DISTINCT argb) AS colors, CAST(sum(argb * (((px % 16 + 16) % 16) * 16 + (py % 16 + 16) % 16 + 1)) AS BIGINT) AS checksum FROM shd GROUP BY 1, 2")
def shaded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished tiles of the highest zoom: pixels, colours and a sum over places."""
    cut = raster.cut(_shaded(spark, sf_dir), MAP, MAP.max_zoom)
    return cut.groupBy("tile_x", "tile_y").agg(F.count("*").alias("pixels"), F.count_distinct("argb").alias("colors"), F.sum(F.col("argb") * (F.col("in_x") * 16 + F.col("in_y") + 1)).alias("checksum"))


@query(f"WITH {SHADED} SELECT px + 20 AS px, py + 9 AS py, br AS brightness, argb FROM shd WHERE px >= -20 AND px < 17 AND py >= -9 AND py < 30")
def sliced_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a shaded raster, counted from its own corner."""
    return raster.sliced(_shaded(spark, sf_dir), -20, -9, 37, 39).select("px", "py", "brightness", "argb")


@query("SELECT n_nationkey AS tile, i AS place, CAST(0 AS BIGINT) AS argb FROM nation, (SELECT CAST(unnest(generate_series(0, 255)) AS INTEGER) AS i)")
def pending_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clear tile that stands for each one that isn't rendered yet."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("tile"), F.posexplode(raster.pending(MAP)).alias("place", "argb"))


_LEVEL = """SELECT CAST(floor(px / 2.0::DOUBLE) AS BIGINT) AS px, CAST(floor(py / 2.0::DOUBLE) AS BIGINT) AS py, sum((argb >> 24) & 255) AS a, sum(((((argb >> 24) & 255) * ((argb >> 16) & 255)) + 127) // 255) AS r, sum(((((argb >> 24) & 255) * ((argb >> 8) & 255)) + 127) // 255) AS g, sum(((((argb >> 24) & 255) * (argb & 255)) + 127) // 255) AS b FROM {src} GROUP BY 1, 2"""
_DONE = """SELECT px, py, CAST(CASE WHEN (a + 2) // 4 = 0 THEN 0 ELSE ((a + 2) // 4) * 16777216 + least(255, (((r + 2) // 4) * 255 + (a + 2) // 4 // 2) // ((a + 2) // 4)) * 65536 + least(255, (((g + 2) // 4) * 255 + (a + 2) // 4 // 2) // ((a + 2) // 4)) * 256 + least(255, (((b + 2) // 4) * 255 + (a + 2) // 4 // 2) // ((a + 2) // 4)) END AS BIGINT) AS argb FROM ({inner})"""
_LEVELS = ", ".join(f"l{z} AS ({_DONE.format(inner=_LEVEL.format(src='shd' if z == 3 else f'l{z + 1}'))})" for z in (3, 2, 1, 0))


@query(f"WITH {SHADED}, {_LEVELS} SELECT 4 AS zoom, px, py, argb FROM shd UNION ALL SELECT 3, px, py, argb FROM l3 UNION ALL SELECT 2, px, py, argb FROM l2 UNION ALL SELECT 1, px, py, argb FROM l1 UNION ALL SELECT 0, px, py, argb FROM l0")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.pyramid(_shaded(spark, sf_dir), MAP).select("zoom", "px", "py", "argb")


@query(f"WITH {COLORS}, b(brightness, m) AS (VALUES (0, 180), (1, 220), (2, 255), (3, 135)), g AS (SELECT CAST(i AS BIGINT) AS color, brightness, m, CASE WHEN i > 0 AND i < 62 THEN p[i + 1] END AS rgb FROM generate_series(-1, 63) s(i), b, pal) SELECT color, brightness, color * 4 + brightness AS packed, CAST(CASE WHEN rgb IS NULL THEN 0 ELSE 4278190080 + ((rgb >> 16) & 255) * m // 255 * 65536 + ((rgb >> 8) & 255) * m // 255 * 256 + (rgb & 255) * m // 255 END AS BIGINT) AS argb FROM g")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(-1, 64).select(F.col("id").alias("color"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("brightness"))
    return rows.select("color", "brightness", c.packed_id(F.col("color"), F.col("brightness")).alias("packed"), c.argb(F.col("color"), F.col("brightness")).alias("argb"))


@query(f"""WITH {SHADED}, sq AS (SELECT CAST(floor(px / 16.0::DOUBLE) AS BIGINT) AS tile_x, CAST(floor(py / 16.0::DOUBLE) AS BIGINT) AS tile_y, (px % 16 + 16) % 16 AS in_x, (py % 16 + 16) % 16 AS in_y, argb FROM shd),
tl AS (SELECT tile_x, tile_y, count(*) AS n FROM sq GROUP BY 1, 2)
SELECT tile_x, tile_y, CAST(sum(argb * (in_x * 16 + in_y + 1)) AS BIGINT) AS checksum, count(DISTINCT argb) + CASE WHEN any_value(n) < 256 AND NOT bool_or(argb = 0) THEN 1 ELSE 0 END AS colors, 'image/png' AS mime FROM sq JOIN tl USING (tile_x, tile_y) GROUP BY 1, 2""")
def encoded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as PNG and read back: their colours, media type and the read pixels' sum over places."""
    made = png.encode_tiles(raster.cut(_shaded(spark, sf_dir), MAP, MAP.max_zoom), MAP.tile_size)
    key = ["dimension", "zoom", "tile_x", "tile_y"]
    sums = png.decode_tiles(made).groupBy(*key).agg(F.sum(F.col("argb") * (F.col("in_x") * 16 + F.col("in_y") + 1)).alias("checksum"))
    return made.select(*key, "colors", x.mime_type(F.col("png")).alias("mime")).join(sums, key).select("tile_x", "tile_y", "checksum", "colors", "mime")


# --- positions -------------------------------------------------------------------------------------------------------

POSITIONS = EVENTS + """, ps AS (SELECT 'u' || user_id AS uuid, 'Player ' || user_id AS name, CASE WHEN k % 4 = 0 THEN 'minecraft:the_nether' ELSE 'minecraft:overworld' END AS dimension, user_id * 11.5::DOUBLE - 800.0::DOUBLE AS x, k * 7.25::DOUBLE - 300.0::DOUBLE AS z, ts_ms AS updated_at FROM ev WHERE event_type <> 'view' AND k <> 13)"""
LATEST = ", lt AS (SELECT uuid, arg_max(name, updated_at) AS name, arg_max(dimension, updated_at) AS dimension, arg_max(x, updated_at) AS x, arg_max(z, updated_at) AS z, max(updated_at) AS updated_at FROM {src} GROUP BY uuid)"
HALF_DAY = 43_200


@query(f"WITH {POSITIONS}{LATEST.format(src='ps')} SELECT * FROM lt")
def markers_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everybody's latest position on a server that builds, where nothing is held back."""
    policy = MarkerPolicy(ServerMode.BUILDING, "exact")
    return m.published(m.latest(m.visible_positions(fx.positions(spark, sf_dir))), policy, fx.NOW_MS)


@query(f"WITH {POSITIONS}{LATEST.format(src='ps')} SELECT uuid, name, dimension, floor(x / 64.0::DOUBLE) * 64.0::DOUBLE + 32.0::DOUBLE AS x, floor(z / 64.0::DOUBLE) * 64.0::DOUBLE + 32.0::DOUBLE AS z, updated_at FROM lt WHERE {fx.NOW_MS} - updated_at >= {HALF_DAY * 1000}")
def markers_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = MarkerPolicy(ServerMode.SURVIVAL, "exact", delay_seconds=HALF_DAY)
    return m.published(m.latest(m.visible_positions(fx.positions(spark, sf_dir))), policy, fx.NOW_MS)


@query(f"WITH {POSITIONS}, ol AS (SELECT * FROM ps WHERE {fx.NOW_MS} - updated_at >= {HALF_DAY * 1000}){LATEST.format(src='ol')} SELECT * FROM lt")
def markers_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = MarkerPolicy(ServerMode.PVE, "exact", delay_seconds=HALF_DAY)
    return m.published_as_of(m.visible_positions(fx.positions(spark, sf_dir)), policy, fx.NOW_MS)


@query(f"WITH {POSITIONS}{LATEST.format(src='ps')}, onl AS (SELECT DISTINCT 'u' || c_custkey AS uuid FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM lt WHERE dimension = 'minecraft:overworld' AND uuid IN (SELECT uuid FROM onl)")
def markers_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those online, whoever is in the default dimension."""
    online = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 2 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uuid"))
    policy = MarkerPolicy(ServerMode.BUILDING, "exact")
    return m.in_dimension(m.published(m.latest(m.visible_positions(fx.positions(spark, sf_dir)), online), policy, fx.NOW_MS), None, PROFILE.default_dimension)


@query(f"WITH {POSITIONS}{LATEST.format(src='ps')} SELECT * FROM lt WHERE false")
def markers_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server at war shows nobody."""
    return m.published(m.latest(m.visible_positions(fx.positions(spark, sf_dir))), MarkerPolicy(ServerMode.WAR, "exact"), fx.NOW_MS)


@query(f"""WITH {POSITIONS}{LATEST.format(src='ps')}, js AS (SELECT dimension, uuid, '{{"uuid":"' || uuid || '","name":"' || name || '","dimension":"' || dimension || '","x":' || CASE WHEN x = round(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%.4f', x) END || ',"z":' || CASE WHEN z = round(z) THEN CAST(CAST(z AS BIGINT) AS VARCHAR) ELSE printf('%.4f', z) END || ',"updatedAt":' || updated_at || '}}' AS d FROM lt)
SELECT dimension, '{{"players":[' || string_agg(d, ',' ORDER BY uuid) || ']}}' AS document FROM js GROUP BY 1""")
def marker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = MarkerPolicy(ServerMode.BUILDING, "exact")
    return publish.marker_document(m.published(m.latest(m.visible_positions(fx.positions(spark, sf_dir))), policy, fx.NOW_MS))


# --- addresses, versions and documents -------------------------------------------------------------------------------

_VERSION = "substr(sha256(concat_ws('|', {world}, {dim}, 'fast', substr(sha256('4,2,true,true'), 1, 8), 'default-pack', 'vanilla-map-colors', 'renderer-v2', '256,0,8,2,0,0,online-signed', 'png', '85')), 1, 16)"


@query(f"SELECT n_name AS world, {_VERSION.format(world='n_name', dim='r_name')} AS version FROM nation JOIN region ON n_regionkey = r_regionkey")
def tileset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("world"), x.tileset_version(F.col("n_name"), F.col("r_name"), PROFILE).alias("version"))


@query(f"""WITH {REQUESTS} SELECT request_id, '/tiles/raster/my%2Fworld/minecraft:overworld/fast/v1/' || zoom || '/x' || x || '/y' || y || '.png' AS url, 'tiles/v1/minecraft_overworld/' || zoom || '/x' || x || '/y' || y || '.png' AS path,
'/tiles/raster/my%20world/minecraft:overworld/fast/v1/' || zoom || '/x' || x || '/y' || y || '.png' AS client_url FROM rq""")
def tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.tile_requests(spark, sf_dir)
    lit, z, cx, cy = F.lit, F.col("zoom"), F.col("x"), F.col("y")
    client = x.client_tile_url(x.tile_url_template() + ".png", lit("my world"), lit("v1"), lit("fast"), F.col("dimension"), z, cx, cy)
    return r.select("request_id", x.tile_url(lit("my/world"), F.col("dimension"), lit("fast"), lit("v1"), z, cx, cy).alias("url"), x.tile_path(lit("v1"), F.col("dimension"), z, cx, cy).alias("path"), client.alias("client_url"))


@query(f"""WITH {REQUESTS}, u AS (SELECT request_id, CASE CAST(request_id % 8 AS INTEGER) WHEN 0 THEN '/tiles/raster/w/minecraft:overworld/fast/v1/' || zoom || '/x' || x || '/y' || y || '.png' WHEN 1 THEN '/tiles/raster/.w/minecraft:overworld/fast/v1/1/x1/y1.png' WHEN 2 THEN '/tiles/raster/w/a:b:c/fast/v1/1/x1/y1.png' WHEN 3 THEN '/tiles/raster/w/overworld/fast/v1/1/x1/y1.PNG'
  WHEN 4 THEN '/tiles/raster/w/overworld/fast/v1/one/x1/y1.png' WHEN 5 THEN '/tiles/raster/w/overworld/fast/v1/1/x1/y' || y || '.webp' WHEN 6 THEN '/other/w/overworld/fast/v1/1/x1/y1.png' ELSE '/tiles/raster/w/overworld/fast/v1/' || zoom || '/' || x || '/y1.png' END AS url FROM rq)
SELECT request_id, url, CAST(regexp_extract(url, '/(-?[0-9]+)/x(-?[0-9]+)/y(-?[0-9]+)\\.([a-z0-9]+)$', 1) AS INTEGER) AS zoom, CAST(regexp_extract(url, '/(-?[0-9]+)/x(-?[0-9]+)/y(-?[0-9]+)\\.([a-z0-9]+)$', 2) AS BIGINT) AS x, CAST(regexp_extract(url, '/(-?[0-9]+)/x(-?[0-9]+)/y(-?[0-9]+)\\.([a-z0-9]+)$', 3) AS BIGINT) AS y,
  regexp_extract(url, '\\.([a-z0-9]+)$', 1) AS extension FROM u WHERE regexp_matches(url, '^/tiles/raster/[A-Za-z0-9_-][A-Za-z0-9._-]*/[A-Za-z0-9_-][A-Za-z0-9._-]*(:[A-Za-z0-9_-][A-Za-z0-9._-]*)?/[A-Za-z0-9_-][A-Za-z0-9._-]*/[A-Za-z0-9_-][A-Za-z0-9._-]*/-?[0-9]+/x-?[0-9]+/y-?[0-9]+\\.[a-z0-9]{{1,8}}$')""")
def parsed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested addresses that name a tile; the others are left out."""
    r, i = fx.tile_requests(spark, sf_dir), F.col("request_id") % 8
    base, s = "/tiles/raster/w/overworld/fast/v1/", lambda c: F.col(c).cast("string")
    url = (
        F.when(i == 0, F.concat(F.lit("/tiles/raster/w/minecraft:overworld/fast/v1/"), s("zoom"), F.lit("/x"), s("x"), F.lit("/y"), s("y"), F.lit(".png"))).when(i == 1, "/tiles/raster/.w/minecraft:overworld/fast/v1/1/x1/y1.png")
        .when(i == 2, "/tiles/raster/w/a:b:c/fast/v1/1/x1/y1.png").when(i == 3, base + "1/x1/y1.PNG").when(i == 4, base + "one/x1/y1.png").when(i == 5, F.concat(F.lit(base + "1/x1/y"), s("y"), F.lit(".webp")))
        .when(i == 6, "/other/w/overworld/fast/v1/1/x1/y1.png").otherwise(F.concat(F.lit(base), s("zoom"), F.lit("/"), s("x"), F.lit("/y1.png")))
    )
    return x.parse_tile_urls(r.select("request_id", url.alias("url")), "url").select("request_id", "url", "zoom", "x", "y", "extension")


@query("""WITH a AS (SELECT p_partkey, '/assets/' || replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '-' END) || CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN '.js' WHEN 1 THEN '.css' WHEN 2 THEN '/../x.png' WHEN 3 THEN '.json' WHEN 4 THEN '.webp' ELSE '.bin' END AS path FROM part)
SELECT p_partkey, path, regexp_matches(path, '^(/[A-Za-z0-9_-][A-Za-z0-9._-]*)+$') AND length(path) <= 256 AS safe, CASE WHEN path LIKE '%.js' THEN 'application/javascript; charset=utf-8' WHEN path LIKE '%.css' THEN 'text/css; charset=utf-8' WHEN path LIKE '%.png' THEN 'image/png' WHEN path LIKE '%.json' THEN 'application/json; charset=utf-8' WHEN path LIKE '%.webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS kind,
  CASE WHEN p_size % 2 = 0 THEN p_brand END AS dimension FROM (SELECT a.*, p_size, p_brand FROM a JOIN part USING (p_partkey))""")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*[F.lit(v) for v in (".js", ".css", "/../x.png", ".json", ".webp", ".bin")]), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("/assets/"), F.replace(F.col("p_name"), F.lit(" "), F.when(k % 3 == 0, "/").otherwise("-")), tail)
    asked = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("v=1&dimension="), F.url_encode("p_brand"), F.lit("&dimension=x"))).otherwise(F.lit("v=1"))
    return p.select("p_partkey", path.alias("path"), x.is_asset_path(path).alias("safe"), x.content_type(path).alias("kind"), x.query_parameter(asked, "dimension").alias("dimension"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 4.0::DOUBLE AS v FROM lineitem) SELECT v, count(*) AS n, CASE WHEN v = round(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.4f', v) END AS json FROM n GROUP BY 1""")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_quantity") / F.lit(4.0)).alias("v")).agg(F.count("*").alias("n"))
    return n.withColumn("json", x.json_number(F.col("v")))


@query(f"WITH {STORED}, e AS (SELECT coalesce(min(x), 0) AS min_x, coalesce(min(y), 0) AS min_y, coalesce(max(x), 0) AS max_x, coalesce(max(y), 0) AS max_y FROM st WHERE zoom = 8) SELECT 'world' AS world, {_VERSION.format(world=chr(39) + 'world' + chr(39), dim=chr(39) + 'minecraft:overworld' + chr(39))} AS tileset_version, min_x, min_y, max_x, max_y, '\"' || {_VERSION.format(world=chr(39) + 'world' + chr(39), dim=chr(39) + 'minecraft:overworld' + chr(39))} || '\"' AS etag FROM e")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = t.signed_extent(fx.stored_tiles(spark, sf_dir), 8)
    return publish.manifest(spark, Settings(), WORLD, extent).drop("document")


@query(f"""WITH {EVENTS}, r AS (SELECT event_id AS id, ts_ms AS tm, CASE CAST(k % 7 AS INTEGER) WHEN 0 THEN 'rendered' WHEN 1 THEN 'failed' WHEN 2 THEN 'dropped' WHEN 3 THEN 'refreshed' WHEN 4 THEN 'hit' ELSE 'miss' END AS outcome, 'job ' || event_id AS message FROM ev)
SELECT count(*) FILTER (outcome = 'rendered') AS rendered, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'refreshed') AS refreshed, count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'miss') AS miss,
  count(*) FILTER (outcome = 'hit')::DOUBLE / count(*) FILTER (outcome IN ('hit', 'miss')) AS hit_ratio, (SELECT message FROM r WHERE outcome = 'failed' ORDER BY tm DESC, id DESC LIMIT 1) AS last_failure FROM r""")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 7
    e = fx._events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts_ms").alias("at"), F.when(k < 5, F.element_at(F.array(*[F.lit(v) for v in ("rendered", "failed", "dropped", "refreshed", "hit")]), F.least(k + 1, F.lit(5)).cast("int"))).otherwise("miss").alias("outcome"), F.concat(F.lit("job "), F.col("event_id").cast("string")).alias("message"))
    return j.outcomes(e)


_WORLD_VERSION = _VERSION.format(world="'world'", dim="'minecraft:overworld'")


@query(f"""WITH v AS (SELECT {_WORLD_VERSION} AS tileset_version) SELECT tileset_version, '{{"tilesetVersion":"' || tileset_version || '","world":"world","profile":"fast","resourcePackHash":"default-pack","rendererVersion":"renderer-v2","materialTableHash":"vanilla-map-colors","format":"png","quality":85,'
  || '"tileGrid":{{"mode":"online-signed","tileSize":256,"maxZoom":8,"minZoom":0,"pixelsPerBlockAtMaxZoom":2,"tileOriginX":0,"tileOriginZ":0}}}}' AS value FROM v""")
def tileset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.metadata(spark, Settings(), WORLD)


@query(f"""WITH {STORED}, e AS (SELECT coalesce(min(x), 0) AS ax, coalesce(min(y), 0) AS ay, coalesce(max(x), 0) AS bx, coalesce(max(y), 0) AS by_ FROM st WHERE zoom = 8)
SELECT '{{"crs":"MC:BLOCK_XZ","world":"world","dimension":"minecraft:overworld","defaultDimension":"minecraft:overworld","dimensions":["minecraft:overworld","minecraft:the_nether","minecraft:the_end"],"dataCoordinate":"block-xz","tileCoordinateMode":"online-signed","profile":"fast","tilesetVersion":"' || {_WORLD_VERSION}
  || '","rendererVersion":"renderer-v2","materialTableHash":"vanilla-map-colors","resourcePackHash":"default-pack","format":"png","quality":85,"tileUrlTemplate":"/tiles/raster/{{world}}/{{dimension}}/{{profile}}/{{tilesetVersion}}/{{z}}/x{{x}}/y{{y}}.png","markerMode":"off","markerPollIntervalMs":2000,"pendingTileRetryMs":1500,'
  || '"tileGrid":{{"mode":"online-signed","tileSize":256,"minZoom":0,"maxZoom":8,"pixelsPerBlockAtMaxZoom":2,"blocksPerTileAtMaxZoom":128,"tileOriginX":0,"tileOriginZ":0,"minSignedTileX":' || ax || ',"minSignedTileY":' || ay || ',"maxSignedTileX":' || bx || ',"maxSignedTileY":' || by_ || ',"normalizedOffsetX":' || ax || ',"normalizedOffsetY":' || ay || '}}}}' AS document FROM e""")
def manifest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.manifest(spark, Settings(), WORLD, t.signed_extent(fx.stored_tiles(spark, sf_dir), 8)).select("document")


@query(f"""WITH h AS ({ORACLE_SQL["health"]}) SELECT '{{"alive":true,"tilesetVersion":"v1","renderJobQueueDepth":3,"ancestorDirtyBacklog":4,"pendingDirtyChunks":5,"schedulerPaused":false,"currentTps":19.5000,"renderedJobs":' || rendered || ',"failedJobs":' || failed || ',"droppedJobs":' || dropped
  || ',"refreshedAncestors":' || refreshed || ',"tileCacheHits":' || hit || ',"tileCacheMisses":' || miss || ',"cacheHitRatio":' || printf('%.4f', hit_ratio) || ',"snapshotTimeMs":12,"metatileRenderMs":7.2500,"tileWriteLatencyMs":0,"lastFailure":"' || last_failure || '"}}' AS document FROM h""")
def health_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauges = {"alive": True, "tileset_version": "v1", "queue_depth": 3, "ancestor_backlog": 4, "pending_chunks": 5, "paused": False, "tps": 19.5, "snapshot_ms": 12.0, "render_ms": 7.25, "write_ms": 0.0}
    return publish.health_document(health(spark, sf_dir).withColumns({k: F.lit(v) for k, v in gauges.items()})).select("document")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building' ELSE 'survival' END AS server_mode, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 5 > 1 THEN CAST(c_nationkey % 5 * 1000 AS BIGINT) ELSE CAST(2000 AS BIGINT) END AS poll_ms, CASE WHEN c_nationkey % 2 = 0 THEN 304 ELSE 200 END AS status FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey % 5 = 1 THEN 5 * c_nationkey ELSE c_nationkey END AS c_nationkey FROM customer)""")
def client_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server modes from configuration values, poll intervals and validators of clients."""
    n = F.when(F.col("c_nationkey") % 5 == 1, F.col("c_nationkey") * 5).otherwise(F.col("c_nationkey"))
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", n.alias("k"))
    mode = F.lit(ServerMode.SURVIVAL.value)
    for s in ServerMode:
        mode = F.when(F.lower("c_mktsegment") == s.value, s.value).otherwise(mode)
    poll = j.poll_interval(F.when(F.col("k") % 3 == 0, "off").otherwise("exact"), F.when(F.col("k") % 5 > 1, F.col("k") % 5 * 1000).otherwise(0))
    tag = F.when(F.col("k") % 2 == 0, '"v1"').otherwise('"v0"')
    return cu.select("c_custkey", mode.alias("server_mode"), poll.alias("poll_ms"), j.not_modified(F.lit('"v1"'), tag).alias("status"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels to finished tiles."""
    return shaded_tiles(spark, sf_dir)
