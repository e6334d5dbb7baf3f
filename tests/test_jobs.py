from pyspark.sql import functions as F

from tesselite.operators import jobs as j
from tesselite.operators import markers as m
from tesselite.plans.spec import MarkerPolicy, Profile, Scheduling, ServerMode

MARK = "dimension string, chunk_x long, chunk_z long, ts_ms long"


def test_debounce(spark):
    one = spark.createDataFrame([("d", 0, 0, 1000)], MARK)
    assert j.settled(one, 3000, 5000).count() == 0 and j.settled(one, 6000, 5000).count() == 1
    again = spark.createDataFrame([("d", 0, 0, 1000), ("d", 0, 0, 4000)], MARK)
    assert j.settled(again, 6000, 5000).count() == 0 and j.settled(again, 9500, 5000).count() == 1


def test_islands_start_anew_at_the_gap(spark):
    rows = spark.createDataFrame([("d", 0, 0, t) for t in (0, 4999, 9999, 9999, 10000)], MARK)
    got = sorted((r.first_ms, r.last_ms, r.marks) for r in j.debounce_islands(rows, 5000).collect())
    assert got == [(0, 4999, 2), (9999, 10000, 3)]


def test_changes_without_effect_are_dropped(spark):
    rows = [("d", 0, 0, 1, None, 5, 0, 1, False), ("d", 0, 0, 1, 5, 5, 0, 1, False), ("d", 0, 0, 1, 4, 5, 1, 1, False), ("d", -1, 0, 1, 4, 5, 0, 1, False), ("d", 16, 0, 1, None, 5, 0, 0, True)]
    df = spark.createDataFrame(rows, "dimension string, block_x long, block_z long, ts_ms long, previous_state int, state int, previous_block int, block int, is_new boolean")
    assert sorted(r.chunk_x for r in j.effective_changes(df).collect()) == [-1, 1]


def test_queue(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "n int, k string")
    got = {r.n: r.outcome for r in j.bounded_queue(rows, 2, ["k"], ["n"]).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "duplicate", 4: "dropped"}
    assert sorted(r.k for r in j.accepted_jobs(rows, 2, ["k"], ["n"]).collect()) == ["a", "b"]


def test_hysteresis(spark):
    rows = spark.createDataFrame([(0, 19.0), (1, 20.0), (2, 18.0), (3, 18.6), (4, 19.3)], "t int, tps double")
    assert [r.paused for r in j.throttle(rows, Scheduling(), ["t"]).orderBy("t").collect()] == [False, False, True, True, False]


def test_many_chunks_become_one_job(spark):
    chunks = spark.createDataFrame([("d", x, z) for x in range(8) for z in range(8)] + [("d", -1, -1)], "dimension string, chunk_x long, chunk_z long")
    assert {(r.start_x, r.start_y) for r in j.metatile_jobs(chunks, Profile()).collect()} == {(0, 0), (-4, -4)}


def test_counters_of_nothing(spark):
    r = j.outcomes(spark.createDataFrame([], "id long, at long, outcome string, message string")).first()
    assert r.hit_ratio == 0.0 and r.rendered == 0 and r.last_failure == ""


def test_client_rules(spark):
    rows = spark.createDataFrame([("pending", "2"), ("pending", None), ("pending", "soon"), ("ready", None)], "s string, a string")
    assert [r[0] for r in rows.select(j.retry_delay(F.col("s"), F.col("a"), 1250)).collect()] == [2000, 1250, 1250, None]
    assert spark.range(1).select(j.tps(F.lit(20.0), F.lit(99_999_999.0))).first()[0] == 10.0


def test_blur_cells(spark):
    rows = spark.createDataFrame([(100.0, 64), (200.0, 64)], "v double, r int")
    assert [r[0] for r in rows.select(m.blur(F.col("v"), 64)).collect()] == [96.0, 224.0]
    assert spark.range(1).select(m.blur(F.lit(37.0), 16), m.blur(F.lit(-5.0), 16)).first()[:] == (40.0, -8.0)
    assert spark.range(1).select(m.blur(F.lit(3.2), 0)).first()[0] == 3.5


POSITION = "uuid string, name string, dimension string, x double, z double, updated_at long"


def test_policy_hides_what_is_recent(spark):
    rows = spark.createDataFrame([("a", "A", "o", 100.0, 200.0, 0), ("a", "A", "o", 1.0, 2.0, 999_000), ("b", "B", "n", 1.0, 2.0, 940_000)], POSITION)
    pve = MarkerPolicy(ServerMode.PVE, "exact")
    assert [r.uuid for r in m.published(m.latest(rows), pve, 1_000_000).collect()] == ["b"]
    assert {(r.uuid, r.x) for r in m.published_as_of(rows, pve, 1_000_000).collect()} == {("a", 100.0), ("b", 1.0)}
    assert m.published(m.latest(rows), MarkerPolicy(ServerMode.WAR, "exact"), 1_000_000).count() == 0
    assert [r.uuid for r in m.in_dimension(m.latest(rows), None, "o").collect()] == ["a"]
    online = spark.createDataFrame([("b",)], "uuid string")
    assert [r.uuid for r in m.latest(rows, online).collect()] == ["b"]


def test_jobs_come_before_tiles_above(spark):
    jobs = spark.createDataFrame([("d", 8, 0, 4)], "dimension string, zoom int, start_x long, start_y long")
    dirty = spark.createDataFrame([("d", z, 0, 0) for z in (2, 7, 5)], "dimension string, zoom int, x long, y long")
    order = lambda jobs, **more: sorted((r.phase, -r.zoom) for r in j.render_order(jobs, dirty, 2, **more).collect())
    assert order(jobs) == [(0, -8)] and order(jobs.limit(0)) == [(1, -7), (1, -5)] and order(jobs, paused=True) == []
