import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tesselite.functions import text as x
from tesselite.operators import publish
from tesselite.plans.spec import Grid, MarkerPolicy, Profile, ServerMode, Settings

GOOD = "/tiles/raster/w/minecraft:overworld/fast/v1/4/x12/y-9.png"
BAD = [
    "/tiles/raster/../o/fast/v1/4/x1/y1.png", "/tiles/raster/%2e%2e/o/fast/v1/4/x1/y1.png", "/tiles/raster/w%2F..%2Fx/o/fast/v1/4/x1/y1.png", "/tiles/raster/w/a:b:c/fast/v1/4/x1/y1.png", "/tiles/raster/w/o/fast/v1/4/x1/y1.PNG",
    "/tiles/raster/w/o/fast/v1/4/1/y1.png", "/tiles/raster/w/o/fast/v1/4/x1/1.png", "/tiles/raster/w/o/fast/v1/four/x1/y1.png", "/tiles/raster/w/o/fast/v1/4/x1/y1", "/tiles/raster/w/o/fast/v1/4/x99999999999/y1.png", "/tiles/raster/w/o/fast/4/x1/y1.png", "/other",
    "/tiles/raster/%zz/o/fast/v1/4/x1/y1.png", "",
]


def test_urls(spark):
    rows = spark.createDataFrame([(GOOD,), *[(b,) for b in BAD]], "u string")
    got = x.parse_tile_urls(rows, "u").collect()
    assert [(r.u, r.world, r.dimension, r.zoom, r.x, r.y, r.extension) for r in got] == [(GOOD, "w", "minecraft:overworld", 4, 12, -9, "png")]
    built = spark.range(1).select(x.tile_url(F.lit("w"), F.lit("minecraft:overworld"), F.lit("fast"), F.lit("v1"), F.lit(4), F.lit(12), F.lit(-9))).first()[0]
    assert built == GOOD


def test_asset_paths(spark):
    cases = {"/index.html": True, "/assets/a-1_b.js": True, "/": False, "/.env": False, "/a//b": False, "/a/../b": False, "/%2e%2e/b": False, "/a b": False, "index.html": False, "/" + "a" * 256: False, "/%zz": False}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in rows.select("p", x.is_asset_path(F.col("p")).alias("ok")).collect()} == cases


def test_versions_change_with_every_setting(spark):
    base = Profile()
    others = [Profile(profile_id="b"), Profile(grid=Grid(origin_x=1)), Profile(metatile=8), Profile(pack_signature="p"), Profile(material_version="m"), Profile(renderer_version="r"), Profile(format="webp"), Profile(quality=84), Profile(height_shade=False)]
    versions = [spark.range(1).select(x.tileset_version("world", "d", p)).first()[0] for p in [base, *others]]
    assert len(set(versions)) == len(versions) and all(len(v) == 16 for v in versions)
    inner = hashlib.sha256(b"4,2,true,true").hexdigest()[:8]
    assert inner == "1fd8511f"
    payload = f"world|d|fast|{inner}|default-pack|vanilla-map-colors|renderer-v2|256,0,8,2,0,0,online-signed|png|85"
    assert versions[0] == hashlib.sha256(payload.encode()).hexdigest()[:16]


@pytest.mark.parametrize(("value", "text"), [(0.0, "0"), (-3.0, "-3"), (1.5, "1.5000"), (0.00004, "0.0000"), (1e15, "1000000000000000.0000"), (float("nan"), "0"), (float("inf"), "0")])
def test_json_numbers(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(x.json_number(F.col("v"))).first()[0] == text


def test_json_strings(spark):
    value = 'a"b\\c\nd\re\tf\bg\fh\x01i\x1f é'
    got = spark.createDataFrame([(value,), (None,)], "v string").select(x.json_string(F.col("v"))).collect()
    assert json.loads(got[0][0]) == value and "\\u0001" in got[0][0] and got[1][0] == "null"


def test_documents(spark):
    extent = spark.createDataFrame([(-3, -2, 5, 6)], "min_x long, min_y long, max_x long, max_y long")
    row = publish.manifest(spark, Settings(markers=MarkerPolicy(ServerMode.PVE, "exact")), 'my "world"', extent).first()
    doc = json.loads(row.document)
    assert doc["world"] == 'my "world"' and doc["tileGrid"]["minSignedTileX"] == -3 and doc["tilesetVersion"] == row.tileset_version and doc["markerMode"] == "exact" and row.etag == f'"{row.tileset_version}"'
    assert json.loads(publish.metadata(spark, Settings(), "w").first().value)["tileGrid"]["maxZoom"] == 8
    health = spark.createDataFrame([(True, "v", 1, 2, 3, False, 19.5, 1, 2, 3, 4, 5, 6, 0.25, 1.0, 2.0, float("nan"), "")], "alive boolean, tileset_version string, queue_depth int, ancestor_backlog int, pending_chunks int, paused boolean, tps double, rendered long, failed long, dropped long, refreshed long, hit long, miss long, hit_ratio double, snapshot_ms double, render_ms double, write_ms double, last_failure string")
    got = json.loads(publish.health_document(health).first().document)
    assert got["cacheHitRatio"] == 0.25 and got["tileWriteLatencyMs"] == 0 and got["schedulerPaused"] is False and len(got) == 18


def test_other_scalars(spark):
    one = spark.range(1)
    assert one.select(x.safe_path_segment(F.lit("a:b/c\\d"))).first()[0] == "a_b_c_d"
    assert one.select(x.query_parameter(F.lit("a=1&dimension=x%3Ay&dimension=z"), "dimension")).first()[0] == "x:y"
    assert one.select(x.query_parameter(F.lit("a=1"), "dimension")).first()[0] is None
    assert one.select(x.mime_type(F.lit(b"RIFF1234WEBPxx"))).first()[0] == "image/webp"
    assert one.select(x.mime_type(F.lit(b"RIFF1234WEB"))).first()[0] == "image/png"
    assert one.select(x.content_type(F.lit("/a/b.mjs"))).first()[0].startswith("application/javascript")
