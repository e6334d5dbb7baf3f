import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tesselite.llm import mixing, queries


def fill(sizes, most=3):
    """Sharing the excess again and again; sizes: (source, size) in order."""
    total, target, full = sum(n for _, n in sizes), {}, set()
    weight = {s: k % 3 + 1 for k, (s, _) in enumerate(sizes)}
    size = dict(sizes)
    while True:
        left = total - sum(most * size[s] for s in full)
        open_ = [s for s in size if s not in full]
        share = sum(weight[s] for s in open_)
        target = {s: most * size[s] if s in full else left * weight[s] / share for s in size}
        over = {s for s in open_ if target[s] > most * size[s]}
        if not over:
            return target
        full |= over


def _docs(spark):
    rows, n = [], 0
    for source, docs, words in (("a", 40, 50), ("b", 3, 4), ("B", 200, 30), (None, 60, 20), ("é", 1, 2000), ("z", 30, 0)):
        for _ in range(docs):
            rows.append((n, " ".join(["w"] * words) if words else None, source, "k"))
            n += 1
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_targets_equal_sharing_again_and_again(spark):
    for case in ([("a", 100), ("b", 5), ("c", 1000), ("d", 1), ("e", 50), (None, 3)], [("a", 0), ("b", 0)], [("a", 7)], [("a", 1), ("b", 1), ("c", 1000)]):
        df = spark.createDataFrame(case, "source string, source_size long")
        for few in (True, False):
            assert {r.source: r.target for r in mixing.targets(df, few=few).collect()} == pytest.approx(fill(case))


@pytest.mark.parametrize("few", [True, False])
def test_mix(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    rows, df = _docs(spark)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))
    got = mixing.mix(df, keep=("doc_id", "source")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], 60) for s in sizes if s != "é")
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5), keep=("doc_id", "source")).collect())) if None not in sizes else True
    emitted = mixing.emit(df)
    assert emitted.columns == df.columns and emitted.count() == sum(r.copies for r in got)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a b", "s"), (1, "x", "s"), (1, "x", "s")], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 4 and mixing.mix(df.limit(0)).count() == 0 and mixing.emit(df.limit(0)).count() == 0


def test_words(spark):
    text = "a\tb\n c d   e\x0b\x0cf"
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert mixing.mix(df).first()["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def _duck(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP7_SQL})").fetchall()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    got = queries.op7_mix(spark, f"/root/testdata/{sf}").select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(_duck(f"/root/testdata/{sf}/documents.parquet"))


def test_odd_rows_equal_sql(spark, tmp_path):
    rows, _ = _docs(spark)
    rows = [r[:3] for r in rows] + [(None, None, None), (None, "a b", "s"), (1, "x y z", "s"), (1, "x y z", "s"), (5, "é\u00a0ü\tx\x0by", "ß")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op7_mix(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(_duck(f"{tmp_path}/documents.parquet/*.parquet"), key=str)


def test_draws_have_the_fractions_frequency(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for seed in (0, 7):
        share = df.select(*mixing.fate(F.col("doc_id"), F.col("text"))).select(mixing._draw(seed).alias("d")).agg(F.avg((F.col("d") < 0.3).cast("int")), F.min("d"), F.max("d")).first()
        assert abs(share[0] - 0.3) < 0.01 and share[1] >= 0 and share[2] < 1
