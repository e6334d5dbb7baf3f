import duckdb
import numpy as np
from pyspark.sql import functions as F

from tesselite.llm import queries, topk


def brute(rows, queries_of, k=5):
    out = []
    fine = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in {i: a for i, a in reversed(fine) if queries_of(i)}.items():
        scores = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 30)), rng.normal(size=(50, 30))
    matrix = topk.turn(x)
    assert np.allclose(matrix @ matrix.T, np.eye(30)) and np.allclose((x @ matrix) @ (y @ matrix).T, x @ y.T)
    for s in (1, 4, 16, 30):
        for m in (np.eye(30), matrix):
            upper = topk.statistics(x @ m, s) @ topk.statistics(y @ m, s).T
            assert (upper >= x @ y.T - 1e-9).all()


def test_few_products_are_computed_where_a_few_axes_say_most():
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(64, 64))
    for spread, most in ((0.8, 0.02), (0.97, 0.6), (1.0, 1.0)):
        x = np.floor(256 * (rng.normal(size=(6000, 64)) * spread ** np.arange(64)) @ np.linalg.qr(mixed)[0])
        s = topk.Searcher(np.arange(0, 6000, 50), x[::50], matrix=topk.turn(x[:500]))
        s.meet(np.arange(6000), x)
        assert s.pairs == 120 * 5999 and s.products <= most * s.pairs, (spread, s.products / s.pairs)
        score = x[::50] @ x.T
        score[np.arange(120), np.arange(0, 6000, 50)] = -np.inf
        want = np.sort(score, axis=1)[:, ::-1][:, :5]
        assert (s.best.score == want).all()


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24).round(3).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 24), (1003, [float("inf")] * 24), (None, [1.0] * 24), (1050, [0.5, 0.25]), (1051, [0.5, 0.5]), (1100, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 50 == 0)
    for size, part in ((topk.QUERY_BYTES, topk.VECTOR_BYTES), (2000, 9000)):
        got = sorted(tuple(r) for r in topk.search(df, F.col("id") % 50 == 0, query_bytes=size, vector_bytes=part).select("query_id", "rank", "vec_id", "score").collect())
        assert got == want
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP5_SQL})").fetchall()
    assert sorted(tuple(r) for r in queries.op5_segment_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_repeated_query_rows_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(200)]
    rows += [(50, rng.normal(size=8).round(2).tolist()), (100, rows[100][1]), (150, (-np.array(rows[150][1])).tolist()), (7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    want = sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP5_SQL})").fetchall())
    for size in (topk.QUERY_BYTES, 200):
        assert sorted(tuple(r) for r in topk.search(df, F.col("id") % 50 == 0, query_bytes=size).select("query_id", "rank", "vec_id", "score").collect()) == want
