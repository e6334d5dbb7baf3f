import random
import re

import numpy as np

from tesselite.llm import components as c
from tesselite.llm import dart

from test_dart import boilerplate


def searched(edges):
    near, out = {}, {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for least in sorted(near):
        todo = [least] if least not in out else []
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = least
                todo += near[x]
    return out


def found(spark, edges):
    kept = c.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    out = kept.collect()
    assert kept.columns == ["row", "component"] and len({r.row for r in out}) == len(out)
    return {r.row: r.component for r in out}


def test_components_are_those_of_a_search(spark):
    rnd = random.Random(5)
    path = [(i, i + 1) for i in range(1000, 1040)]
    tangled = [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(300)]
    hubs = [(3500, i) for i in range(3000, 3900)] + [(-7, i) for i in range(3800, 4200)]
    odd = [(5000, 5000), (None, 5001), (5002, None), (5003, 5004), (5004, 5003), (5003, 5004)]
    edges = path + tangled + hubs + odd
    rnd.shuffle(edges)
    assert found(spark, edges) == searched(edges)
    assert found(spark, odd[:3]) == {}


def watched(monkeypatch):
    """Names and plans of what is written from now on."""
    seen = []

    def materialise(df, name, kept=c.materialise):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    for module in (c, dart):
        monkeypatch.setattr(module, "materialise", materialise)
    return seen


def test_stars_around_least_nodes_take_no_round(spark, monkeypatch):
    seen = watched(monkeypatch)
    assert found(spark, [(i, i % 7) for i in range(7, 200)]) == {i: i % 7 for i in range(200)}
    assert [name for name, _ in seen] == ["edges", "nodes", "components"]


def test_near_copies_broadcast_nothing_by_joins(spark, monkeypatch):
    """Very many small joins: each broadcast would stay in the driver until it collects garbage."""
    seen = watched(monkeypatch)
    monkeypatch.setattr(dart, "PROPOSED", 50)
    dart.keep_one(spark.createDataFrame(boilerplate(200), "doc_id long, text string"))
    assert {"edges", "pairs", "links", "classes", "chosen"} <= {name for name, _ in seen}
    assert not [name for name, plan in seen if "Broadcast" in plan]


def test_rows_of_one_home_are_dealt_among_tasks(spark):
    sets = spark.createDataFrame([(i, bytearray(np.arange(i, i + 9, dtype=np.uint64).tobytes())) for i in range(20)], "row long, items binary")
    rows = spark.createDataFrame([(0, i, i, i % 2 == 0) for i in range(20)], "home long, row long, component long, asks boolean")
    blocks = dart._blocks(rows, sets, 0.8)
    lines = blocks._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [lines[k + 1] for k, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(home#\d+L?, \d+\)", line)]
    assert below and all("HashAggregate" in line for line in below), below
    assert {(r.a, r.b) for r in blocks.collect()} == {(a, b) for b in range(0, 20, 2) for a in (b - 1, b + 1) if 0 <= a < 20}
