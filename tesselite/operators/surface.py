"""From voxels to the visible surface of every column.

Voxels are sparse: what isn't there is air.  One row comes out for each column of
a dense grid: kind, y, colour, fluid depth and overlay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselite.functions import color as c
from tesselite.functions import grid as g

# Kinds of surface.
OPAQUE, FOLIAGE, FLUID, TRANSPARENT, THIN, DECORATION, UNKNOWN = "OPAQUE_SURFACE", "FOLIAGE_SURFACE", "FLUID_SURFACE", "TRANSPARENT_STRUCTURE", "THIN_OVERLAY", "DECORATION_VISUAL", "UNKNOWN_FALLBACK"
THIN_TOP, EPSILON = 0.25, 1e-6
#: Block states that are broadcast; a larger registry is joined by shuffle.
MOST_SENT = 100_000
KEY = ["dimension", "x", "z"]


def classify() -> Column:
    """Kind of a block state of the registry, null for air."""
    return (
        F.when(F.col("is_air"), F.lit(None))
        .when(F.col("fluid"), FLUID)
        .when(F.col("shape_empty"), DECORATION)
        .when((F.col("bottom") <= F.lit(EPSILON)) & (F.col("top") <= F.lit(THIN_TOP)), THIN)
        .when(F.col("solid_render"), F.when(F.col("leaves"), FOLIAGE).otherwise(OPAQUE))
        .when(F.col("leaves"), FOLIAGE)
        .when((F.col("top") >= F.lit(1 - EPSILON)) & ~F.col("can_occlude"), TRANSPARENT)
        .otherwise(UNKNOWN)
    )


def ends_walk(kind: Column) -> Column:
    return ~kind.isin(THIN, DECORATION)


def classified(voxels: DataFrame, registry: DataFrame) -> DataFrame:
    """Voxels with their block's properties.  The registry of block states is broadcast if counting finds few enough of them."""
    known = registry.select("material", classify().alias("kind"), "fluid", F.col("map_color").alias("own_color"), F.when(F.col("fluid") & ~F.col("sturdy_top"), F.col("fluid_color")).otherwise(F.col("map_color")).alias("seen_color"))
    few = registry.limit(MOST_SENT + 1).count() <= MOST_SENT
    return voxels.join(F.broadcast(known) if few else known, "material").filter(F.col("kind").isNotNull())


def complete_jobs(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs (job_id, dimension, min_x, min_z, max_x, max_z) all of whose chunks are there: job_id, chunks, present, complete."""
    first, last = (lambda a: g.floordiv(F.col(a), 16)), (lambda a: g.floordiv(F.col(a) - 1, 16))
    wanted = jobs.withColumn("chunk_x", F.explode(F.sequence(first("min_x"), last("max_x")))).withColumn("chunk_z", F.explode(F.sequence(first("min_z"), last("max_z"))))
    there = chunks.select("dimension", "chunk_x", "chunk_z").distinct().withColumn("_there", F.lit(1))
    met = wanted.join(there, ["dimension", "chunk_x", "chunk_z"], "left")
    return met.groupBy("job_id").agg(F.count("*").alias("chunks"), F.count("_there").alias("present")).withColumn("complete", F.col("chunks") == F.col("present"))


def chunks_of(voxels: DataFrame) -> DataFrame:
    """Chunks that hold a block, with how many, and the surface height of their highest column."""
    return voxels.groupBy("dimension", g.floordiv(F.col("x"), 16).alias("chunk_x"), g.floordiv(F.col("z"), 16).alias("chunk_z")).agg(F.count("*").alias("blocks"), F.max("y").alias("highest"))


def surface_heights(voxels: DataFrame) -> DataFrame:
    """Highest block of each column, with the column's place in its chunk."""
    return voxels.groupBy(*KEY).agg(F.max("y").alias("height")).withColumns({"local_x": F.pmod("x", F.lit(16)), "local_z": F.pmod("z", F.lit(16))})


def lookup(points: DataFrame, voxels: DataFrame, air: int = 0) -> DataFrame:
    """Material at each point (dimension, x, y, z); air where there is none."""
    return points.join(voxels.select("dimension", "x", "y", "z", "material"), ["dimension", "x", "y", "z"], "left").withColumn("material", F.coalesce("material", F.lit(air)))


def surfaces(voxels: DataFrame, registry: DataFrame, min_build: int) -> DataFrame:
    """Surface of each column that holds a block.

    One window over a column's blocks from the top finds the surface; fluid below it and what shows
    through a transparent structure follow from the same sorted rows, so that a column is shuffled once.
    """
    seen = classified(voxels, registry)
    column = Window.partitionBy(*KEY)
    kind, y = F.col("kind"), F.col("y")
    hit = F.max_by(F.when(ends_walk(kind), F.struct("y", "kind", "own_color", "seen_color")), F.when(ends_walk(kind), y)).over(column)
    rows = seen.withColumn("s", hit)
    below = F.col("s").isNotNull() & (y < F.col("s.y"))
    # fluid blocks that follow the surface without a gap
    run = Window.partitionBy(*KEY, F.col("fluid") & below).orderBy(F.desc("y"))
    rows = rows.withColumn("_rn", F.row_number().over(run)).withColumn("_in_run", F.coalesce(F.col("fluid") & below & (F.col("s.y") - y == F.col("_rn")), F.lit(False)))
    through = below & (F.col("s.kind") == TRANSPARENT) & ~kind.isin(TRANSPARENT, DECORATION)
    thin = (kind == THIN) & (F.col("own_color") != 0) & (F.col("s").isNull() | (y > F.col("s.y")))
    found = rows.groupBy(*KEY).agg(
        F.first("s").alias("s"), F.max("y").alias("top"),
        F.max_by(F.when(thin, F.col("own_color")), F.when(thin, y)).alias("thin"),
        F.sum(F.col("_in_run").cast("long")).alias("run"),
        F.max_by(F.when(through, F.struct("kind", "own_color")), F.when(through, y)).alias("b"),
        F.max(F.when(y == min_build, F.col("own_color"))).alias("at_min"),
    )
    void = F.col("top") <= min_build
    s, b = F.col("s"), F.col("b")
    structure = s["kind"] == TRANSPARENT
    shows = structure & b.isNotNull() & (b["own_color"] != 0)
    return found.select(
        *KEY,
        F.when(void | s.isNull(), F.lit(min_build).cast("long")).otherwise(s["y"]).alias("y"),
        F.when(void, F.lit(c.STONE)).when(s.isNull(), F.coalesce("at_min", F.lit(0))).when(shows, b["own_color"]).otherwise(s["seen_color"]).cast("int").alias("color"),
        F.when(void, OPAQUE).when(s.isNull(), UNKNOWN).when(shows, b["kind"]).otherwise(s["kind"]).alias("kind"),
        F.when(void | s.isNull() | structure | (s["kind"] != FLUID), F.lit(0).cast("long")).otherwise(F.col("run")).alias("depth"),
        F.when(void, F.lit(0).cast("long")).when(structure, c.translucent(s["own_color"])).otherwise(F.coalesce(c.translucent(F.col("thin")), F.lit(0).cast("long"))).alias("overlay"),
    )


def dense(columns: DataFrame, sampled: DataFrame, min_build: int) -> DataFrame:
    """Samples for all of ``columns`` (dimension, x, z); those without a block are bare stone at the bottom."""
    long0 = F.lit(0).cast("long")
    return columns.join(sampled, KEY, "left").select(
        *KEY, F.coalesce("y", F.lit(min_build).cast("long")).alias("y"), F.coalesce("color", F.lit(c.STONE)).alias("color"),
        F.coalesce("kind", F.lit(OPAQUE)).alias("kind"), F.coalesce("depth", long0).alias("depth"), F.coalesce("overlay", long0).alias("overlay"),
    )


def chunk_columns(chunks: DataFrame) -> DataFrame:
    """All columns (dimension, x, z) of the chunks."""
    side = lambda c: F.explode(F.sequence(F.col(c) * 16, F.col(c) * 16 + 15))
    return chunks.select("dimension", "chunk_x", "chunk_z").distinct().withColumn("x", side("chunk_x")).withColumn("z", side("chunk_z")).select(*KEY)


def in_complete_jobs(samples: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Samples of the jobs (job_id, dimension, min_x, min_z, max_x, max_z) all of whose chunks are there, with the job's id; a sample
    belongs to each job whose box holds it.  Boxes and samples meet by chunk."""
    span = lambda a, b: F.explode(F.sequence(g.floordiv(F.col(a), 16), g.floordiv(F.col(b) - 1, 16)))
    whole = complete_jobs(jobs, chunks).filter("complete").select("job_id")
    boxes = jobs.join(whole, "job_id").withColumn("chunk_x", span("min_x", "max_x")).withColumn("chunk_z", span("min_z", "max_z"))
    placed = samples.withColumns({"chunk_x": g.floordiv(F.col("x"), 16), "chunk_z": g.floordiv(F.col("z"), 16)})
    met = placed.join(boxes, ["dimension", "chunk_x", "chunk_z"])
    inside = (F.col("x") >= F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("z") >= F.col("min_z")) & (F.col("z") < F.col("max_z"))
    return met.filter(inside).select("job_id", *samples.columns)


def ceiling(columns: DataFrame) -> DataFrame:
    """Samples of a roofed dimension: dirt or stone by a hash of the place.  Only the lowest 21 bits matter, which
    keeps the arithmetic within a long."""
    m = F.lit(1 << 21).cast("long")
    h = F.pmod(F.col("x") + F.pmod(F.col("z"), m) * 231871, m)
    h = F.pmod(F.pmod(h * h, m) * F.pmod(F.lit(31287121).cast("long"), m) + h * 11, m)
    dirt = F.shiftright(h, 20).bitwiseAND(F.lit(1).cast("long")) == 0
    return columns.select(*KEY, F.lit(100).cast("long").alias("y"), F.when(dirt, c.DIRT).otherwise(c.STONE).alias("color"), F.lit(OPAQUE).alias("kind"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("overlay"))
