"""Documents about the map: manifest, positions, health and tileset metadata, as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.functions import text as x
from tesselite.plans.spec import Settings


def _str(v) -> Column:
    return x.json_string(v if isinstance(v, Column) else F.lit(v))


def _num(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("string")


def manifest(spark: SparkSession, settings: Settings, world: str, extent: DataFrame) -> DataFrame:
    """One row: scalar fields, and the document.  extent: one row of min_x, min_y, max_x, max_y."""
    p, m = settings.profile, settings.markers
    g = p.grid
    version = x.tileset_version(world, p.default_dimension, p)
    fields = [
        ("crs", _str("MC:BLOCK_XZ")), ("world", _str(world)), ("dimension", _str(p.default_dimension)), ("defaultDimension", _str(p.default_dimension)),
        ("dimensions", F.concat(F.lit("["), F.concat_ws(",", *[_str(d) for d in p.dimensions]), F.lit("]"))), ("dataCoordinate", _str("block-xz")), ("tileCoordinateMode", _str(p.mode.value)),
        ("profile", _str(p.profile_id)), ("tilesetVersion", _str(version)), ("rendererVersion", _str(p.renderer_version)), ("materialTableHash", _str(p.material_version)),
        ("resourcePackHash", _str(p.pack_signature)), ("format", _str(p.format)), ("quality", _num(p.quality)), ("tileUrlTemplate", _str(f"{x.tile_url_template()}.{p.extension}")),
        ("markerMode", _str(m.mode)), ("markerPollIntervalMs", _num(m.poll_ms)), ("pendingTileRetryMs", _num(settings.retry_ms)),
        ("tileGrid", x.json_object([
            ("mode", _str(p.mode.value)), ("tileSize", _num(g.tile_size)), ("minZoom", _num(g.min_zoom)), ("maxZoom", _num(g.max_zoom)), ("pixelsPerBlockAtMaxZoom", _num(g.pixels_per_block)),
            ("blocksPerTileAtMaxZoom", _num(g.blocks_at_max)), ("tileOriginX", _num(g.origin_x)), ("tileOriginZ", _num(g.origin_z)), ("minSignedTileX", _num(F.col("min_x"))), ("minSignedTileY", _num(F.col("min_y"))),
            ("maxSignedTileX", _num(F.col("max_x"))), ("maxSignedTileY", _num(F.col("max_y"))), ("normalizedOffsetX", _num(F.col("min_x"))), ("normalizedOffsetY", _num(F.col("min_y"))),
        ])),
    ]
    etag = F.concat(F.lit('"'), version, F.lit('"'))
    return extent.select(F.lit(world).alias("world"), version.alias("tileset_version"), "min_x", "min_y", "max_x", "max_y", etag.alias("etag"), x.json_object(fields).alias("document"))


def metadata(spark: SparkSession, settings: Settings, world: str) -> DataFrame:
    """One row: what is written beside a tileset."""
    p = settings.profile
    g = p.grid
    version = x.tileset_version(world, p.default_dimension, p)
    grid = x.json_object([("mode", _str(p.mode.value)), ("tileSize", _num(g.tile_size)), ("maxZoom", _num(g.max_zoom)), ("minZoom", _num(g.min_zoom)), ("pixelsPerBlockAtMaxZoom", _num(g.pixels_per_block)), ("tileOriginX", _num(g.origin_x)), ("tileOriginZ", _num(g.origin_z))])
    fields = [("tilesetVersion", _str(version)), ("world", _str(world)), ("profile", _str(p.profile_id)), ("resourcePackHash", _str(p.pack_signature)), ("rendererVersion", _str(p.renderer_version)), ("materialTableHash", _str(p.material_version)), ("format", _str(p.format)), ("quality", _num(p.quality)), ("tileGrid", grid)]
    return spark.range(1).select(version.alias("tileset_version"), x.json_object(fields).alias("value"))


def marker_document(markers: DataFrame) -> DataFrame:
    """One row for each dimension with its markers by uuid; a dimension's markers are bounded by who may be online."""
    fields = [("uuid", _str(F.col("uuid"))), ("name", _str(F.col("name"))), ("dimension", _str(F.col("dimension"))), ("x", x.json_number(F.col("x"))), ("z", x.json_number(F.col("z"))), ("updatedAt", _num(F.col("updated_at")))]
    one = markers.select("dimension", F.struct("uuid", x.json_object(fields).alias("j")).alias("m"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["j"]), ",")
    return one.groupBy("dimension").agg(F.concat(F.lit('{"players":['), listed, F.lit("]}")).alias("document"))


def health_document(counters: DataFrame) -> DataFrame:
    """The row of counters and gauges with its document."""
    kinds = (
        ("alive", "alive", "b"), ("tilesetVersion", "tileset_version", "s"), ("renderJobQueueDepth", "queue_depth", "n"), ("ancestorDirtyBacklog", "ancestor_backlog", "n"), ("pendingDirtyChunks", "pending_chunks", "n"),
        ("schedulerPaused", "paused", "b"), ("currentTps", "tps", "d"), ("renderedJobs", "rendered", "n"), ("failedJobs", "failed", "n"), ("droppedJobs", "dropped", "n"), ("refreshedAncestors", "refreshed", "n"),
        ("tileCacheHits", "hit", "n"), ("tileCacheMisses", "miss", "n"), ("cacheHitRatio", "hit_ratio", "d"), ("snapshotTimeMs", "snapshot_ms", "d"), ("metatileRenderMs", "render_ms", "d"), ("tileWriteLatencyMs", "write_ms", "d"), ("lastFailure", "last_failure", "s"),
    )
    as_json = {"s": lambda n: _str(F.col(n)), "n": lambda n: _num(F.col(n)), "b": lambda n: _num(F.col(n)), "d": lambda n: x.json_number(F.col(n).cast("double"))}
    return counters.withColumn("document", x.json_object([(j, as_json[k](n)) for j, n, k in kinds]))
