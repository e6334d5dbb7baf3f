import datetime as dt

from pyspark.sql import functions as F

from tesselite.operators import jobs as j
from tesselite.plans.spec import Profile
from tesselite.sources import store
from tesselite.streaming import live

TILE = "dimension string, zoom int, x long, y long, png binary"


def test_store(spark, tmp_path):
    path = str(tmp_path / "tiles")
    store.write_tiles(spark.createDataFrame([("o", 3, 1, 2, b"a"), ("o", 2, 0, 1, b"b"), ("n", 3, 1, 2, b"c")], TILE), path, "v1")
    assert bytes(store.read_tile(spark, path, "v1", "o", 3, 1, 2).first().png) == b"a"
    assert store.read_tile(spark, path, "v2", "o", 3, 1, 2).count() == 0
    # only the partitions written anew are replaced
    store.write_tiles(spark.createDataFrame([("o", 3, 1, 2, b"A")], TILE), path, "v1")
    assert sorted(bytes(r.png) for r in store.all_tiles(spark, path).collect()) == [b"A", b"b", b"c"]
    plan = store.read_tile(spark, path, "v1", "o", 3, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "PushedFilters: [IsNotNull(x)" in plan


def test_merge_and_delete(spark):
    old, new = spark.createDataFrame([("o", 1, 0, 0, b"a"), ("o", 1, 1, 0, b"b")], TILE), spark.createDataFrame([("o", 1, 1, 0, b"B"), ("o", 1, 2, 0, b"c")], TILE)
    assert sorted(bytes(r.png) for r in store.merged(old, new).collect()) == [b"B", b"a", b"c"]
    assert [r.x for r in store.without(old, new).collect()] == [0]


def test_world_identity_is_kept(spark, tmp_path):
    path = str(tmp_path / "world")
    first = store.world_identity(spark, path, "folder")
    assert first == store.world_identity(spark, path, "folder") and len(first) == 36


def _marks(spark, path, rows):
    schema = "dimension string, chunk_x long, chunk_z long, ts timestamp"
    base = dt.datetime(2024, 1, 1)
    # the last mark moves the watermark on and stays open itself
    data = [("d", x, 0, base + dt.timedelta(milliseconds=ms)) for x, ms in rows] + [("d", 99, 0, base + dt.timedelta(days=1))]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path), spark.createDataFrame(data, schema)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, 0), (0, 4999), (0, 9999), (0, 20000), (1, 100), (200, 5)]
    stream, batch = _marks(spark, str(tmp_path / "in"), rows)
    q = live.settled_sessions(stream, 5).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.chunk_x, r.marks) for r in spark.table("settled").collect())
    marks = batch.withColumn("ts_ms", F.unix_millis("ts"))
    want = sorted((r.chunk_x, r.marks) for r in j.debounce_islands(marks, 5000).filter("chunk_x <> 99").collect())
    assert got == want == [(0, 1), (0, 1), (0, 2), (1, 1), (200, 1)]


def test_jobs_of_a_stream(spark, tmp_path):
    stream, _ = _marks(spark, str(tmp_path / "in"), [(0, 0), (1, 100), (40, 5)])
    seen = []
    live.start_jobs(stream, Profile(), 5, lambda df, n: seen.extend((r.start_x, r.start_y) for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(set(seen)) == [(0, 0), (4, 0)]


def test_latest_positions_of_a_stream(spark, tmp_path):
    schema = "uuid string, name string, dimension string, x double, z double, updated_at long"
    spark.createDataFrame([("a", "A", "o", 1.0, 1.0, 5), ("a", "A", "o", 2.0, 1.0, 9), ("b", "B", "o", 3.0, 1.0, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live.start_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "latest_positions", str(tmp_path / "c")).awaitTermination(120)
    assert {(r.uuid, r.x) for r in spark.table("latest_positions").collect()} == {("a", 2.0), ("b", 3.0)}


def test_single_tiles_are_put_in_place(spark, tmp_path):
    path, staging = str(tmp_path / "tiles"), str(tmp_path / "staging")
    store.write_tiles(spark.createDataFrame([("o", 3, x, 0, b"a") for x in range(5)] + [("o", 2, 0, 0, b"b"), ("n", 3, 0, 0, b"c")], TILE), path, "v1")
    store.upsert_tiles(spark.createDataFrame([("o", 3, 1, 0, b"A"), ("o", 3, 9, 0, b"N"), ("e", 1, 0, 0, b"E")], TILE), path, "v1", staging)
    got = {(r.dimension, r.zoom, r.x): bytes(r.png) for r in store.all_tiles(spark, path).collect()}
    assert got == {("o", 3, 0): b"a", ("o", 3, 1): b"A", ("o", 3, 2): b"a", ("o", 3, 3): b"a", ("o", 3, 4): b"a", ("o", 3, 9): b"N", ("o", 2, 0): b"b", ("n", 3, 0): b"c", ("e", 1, 0): b"E"}


def test_latest_positions_go_to_a_store(spark, tmp_path):
    from tesselite.operators import markers as m

    schema = "uuid string, name string, dimension string, x double, z double, updated_at long"
    for n, rows in enumerate(([("a", "A", "o", 1.0, 1.0, 5), ("b", "B", "o", 3.0, 1.0, 1)], [("a", "A", "o", 2.0, 1.0, 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.start_latest_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), parts=2).awaitTermination(120)
        got = m.latest(spark.read.parquet(str(tmp_path / "out"))).collect()
        assert {(r.uuid, r.x) for r in got} == ({("a", 1.0), ("b", 3.0)} if n == 0 else {("a", 2.0), ("b", 3.0)})


def test_streams_may_run_on(spark, tmp_path):
    stream, _ = _marks(spark, str(tmp_path / "in"), [(0, 0)])
    q = live.start_jobs(stream, Profile(), 5, lambda df, n: None, str(tmp_path / "c"), every="1 seconds")
    assert q.isActive
    q.stop()
