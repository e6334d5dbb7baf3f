import random

from pyspark.sql import functions as F

from tesselite.functions import color as c
from tesselite.operators import surface
from tesselite.sources import fixtures as fx

REG = {r[0]: dict(zip([p.strip().split(" ")[0] for p in fx._REGISTRY_COLUMNS.split(",")], r, strict=True)) for r in fx._REGISTRY}


def kind(b):
    if b["is_air"]:
        return None
    if b["fluid"]:
        return surface.FLUID
    if b["shape_empty"]:
        return surface.DECORATION
    if b["bottom"] <= 1e-6 and b["top"] <= 0.25:
        return surface.THIN
    if b["solid_render"]:
        return surface.FOLIAGE if b["leaves"] else surface.OPAQUE
    if b["leaves"]:
        return surface.FOLIAGE
    return surface.TRANSPARENT if b["top"] >= 1 - 1e-6 and not b["can_occlude"] else surface.UNKNOWN


def half(color):
    return 0 if color == 0 else 0x80000000 + c.BASE_COLORS[color]


def walk(blocks, low):
    """The definition, block by block from the top; blocks: y to material."""
    at = lambda y: REG[blocks.get(y, 0)]
    top = max((y for y, b in blocks.items() if kind(REG[b])), default=low)
    if top <= low:
        return low, c.STONE, surface.OPAQUE, 0, 0
    thin, y = 0, top
    while y >= low:
        k = kind(at(y))
        if k in (None, surface.DECORATION):
            pass
        elif k == surface.THIN:
            thin = thin or half(at(y)["map_color"])
        else:
            break
        y -= 1
    if y < low:
        return low, at(low)["map_color"], surface.UNKNOWN, 0, thin
    b, k = at(y), kind(at(y))
    if k == surface.FLUID:
        depth = 0
        while y - depth - 1 >= low and at(y - depth - 1)["fluid"]:
            depth += 1
        return y, b["map_color"] if b["sturdy_top"] else b["fluid_color"], k, depth, thin
    if k == surface.TRANSPARENT:
        color, found = b["map_color"], k
        for below in range(y - 1, low - 1, -1):
            kb = kind(at(below))
            if kb in (None, surface.TRANSPARENT, surface.DECORATION):
                continue
            if at(below)["map_color"]:
                color, found = at(below)["map_color"], kb
            break
        return y, color, found, 0, half(b["map_color"])
    return y, b["map_color"], k, 0, thin


def test_columns_equal_a_walk_block_by_block(spark):
    rnd = random.Random(5)
    worlds = {}
    for n in range(400):
        blocks = {y: rnd.randrange(16) for y in range(rnd.randrange(0, 14)) if rnd.random() < 0.8}
        worlds[n % 20 - 10, n // 20 - 10] = {y: rnd.choice((4, 14, 15, 6, 7, 12, b)) for y, b in blocks.items()}
    rows = [("d", x, y, z, b) for (x, z), col in worlds.items() for y, b in col.items()]
    vox = spark.createDataFrame(rows, "dimension string, x long, y long, z long, material int")
    columns = spark.createDataFrame([("d", x, z) for x, z in worlds], "dimension string, x long, z long")
    got = {(r.x, r.z): (r.y, r.color, r.kind, r.depth, r.overlay) for r in surface.dense(columns, surface.surfaces(vox, fx.registry(spark), 0), 0).collect()}
    assert got == {k: walk(v, 0) for k, v in worlds.items()}


def test_kinds(spark):
    got = {r.material: r.k for r in fx.registry(spark).select("material", surface.classify().alias("k")).collect()}
    assert got == {m: kind(b) for m, b in REG.items()}


def test_ceiling_equals_wrapping_arithmetic(spark):
    def wrap(v):
        return (v + 2**31) % 2**32 - 2**31

    rnd = random.Random(1)
    points = [(rnd.randrange(-30_000_000, 30_000_000), rnd.randrange(-30_000_000, 30_000_000)) for _ in range(500)]
    rows = spark.createDataFrame([("d", x, z) for x, z in points], "dimension string, x long, z long")
    for r in surface.ceiling(rows).collect():
        h = wrap(r.x + wrap(r.z * 231871))
        h = wrap(wrap(wrap(h * h) * 31287121) + wrap(h * 11))
        assert r.color == (c.DIRT if (h >> 20) & 1 == 0 else c.STONE)


def test_one_missing_chunk_makes_a_job_incomplete(spark):
    jobs = spark.createDataFrame([(1, "d", 0, 0, 32, 16), (2, "d", 0, 0, 33, 16), (3, "d", -1, 0, 1, 1)], "job_id int, dimension string, min_x long, min_z long, max_x long, max_z long")
    chunks = spark.createDataFrame([("d", 0, 0), ("d", 1, 0), ("d", 1, 0)], "dimension string, chunk_x long, chunk_z long")
    assert {r.job_id: (r.chunks, r.complete) for r in surface.complete_jobs(jobs, chunks).collect()} == {1: (2, True), 2: (3, False), 3: (2, False)}


def test_lookup_of_nothing_is_air(spark):
    points = spark.createDataFrame([("d", 1, 500, 1)], "dimension string, x long, y long, z long")
    none = spark.createDataFrame([], "dimension string, x long, y long, z long, material int")
    assert surface.lookup(points, none).first().material == 0


def test_a_column_is_shuffled_once(spark):
    vox = spark.createDataFrame([("d", 0, 0, 0, 1)], "dimension string, x long, y long, z long, material int")
    plan = surface.surfaces(vox, fx.registry(spark), 0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") >= 1 and F is not None
    executed = surface.surfaces(vox, fx.registry(spark), 0)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") <= 2


def test_a_large_registry_is_not_broadcast(spark, monkeypatch):
    voxels = spark.createDataFrame([("d", k, 0, k % 3, k % 17) for k in range(200)], "dimension string, x long, y long, z long, material int")
    registry = fx.registry(spark)
    sent = surface.classified(voxels, registry)
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(surface, "MOST_SENT", 3)
    dealt = surface.classified(voxels, registry)
    assert "Broadcast" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.exceptAll(sent).isEmpty() and sent.exceptAll(dealt).isEmpty()
