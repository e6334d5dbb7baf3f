import random

import duckdb
from pyspark.sql import functions as F

from tesselite.llm import queries, warc

SCHEMA = "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1#x", "https://example.com/a?a=1&b=2&utm_source=f", "example.com/a/?ref=z&a=1&b=2", " HTTPS://EXAMPLE.COM:443/a?a=1&b=2 "]
    other = ["http://example.com/A?a=1&b=2", "http://m.example.com/a?a=1&b=2", "http://example.com/a?a=1&b=3"]
    rows = spark.createDataFrame([(u,) for u in same + other], "u string")
    got = [r[0] for r in rows.select(warc.canonical_url(F.col("u"))).collect()]
    assert set(got[: len(same)]) == {"example.com/a?a=1&b=2"} and len(set(got)) == 1 + len(other)


def test_headers_that_may_change(spark):
    rows = spark.createDataFrame([({"Content-Length": "9", "Date": "1", "X": "k"}, {"content-length": "0", "DATE": "2", "Expires": "3"}), (None, None)], "a map<string,string>, b map<string,string>")
    got = [r[0] for r in rows.select(warc.merged_headers(F.col("a"), F.col("b"))).collect()]
    assert got == [{"content-length": "9", "x": "k", "date": "2", "expires": "3"}, {}]
    rows = spark.createDataFrame([({"Set-Cookie": "a", "set-cookie": "b", "ETag": None}, {"SET-COOKIE": "c", "Set-cookie": "d", "date": "1", "Date": None}), ({}, {})], "a map<string,string>, b map<string,string>")
    got = [r[0] for r in rows.select(warc.merged_headers(F.col("a"), F.col("b"))).collect()]
    assert got == [{"etag": None, "set-cookie": "c, d", "date": "1"}, {}]


def test_edges_are_searched_in_two_steps(spark):
    for n in (0, 1, 2, 3, 8, 15, 100):
        edges = [3 * i for i in range(n)]
        df = spark.range(-2, 3 * n + 3)
        assert all(r.got == sum(e < r.id for e in edges) for r in df.select("id", warc._below(edges, F.col("id")).alias("got")).collect())


def test_one_moment_may_hold_all_captures_of_a_url(spark):
    rows = [(i, "http://a.example/", 5, "response" if i % 3 else "revisit", '"a"', None, None, {}) for i in range(3000)] + [(9000, "a.example", 1, "response", 'W/"a"', None, None, {"X": "y"}), (9001, "a.example", 9, "revisit", '"a"', None, None, None)]
    got = {r.record_id: (r.base_id, r.outcome) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (9000, "match") for i in range(0, 3000, 3)} | {9001: (2999, "match")}


def test_as_of_join_equals_a_walk(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        response = rnd.random() < 0.4
        url = "http://hot.example/" if rnd.random() < 0.4 else f"http://h{rnd.randrange(30)}.example/p"
        tag = rnd.choice(['"a"', 'W/"a"', '"b"', None])
        rows.append((i, rnd.choice([url, url, url, None, ""]), rnd.choice([rnd.randrange(300), rnd.randrange(300), None]), "response" if response else "revisit", tag, rnd.choice(["d1", "d2", None]), rnd.choice(["x", "y", None]), {"date": str(i)}))
    rows.append(rows[3])
    want = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [] if not r[1] or r[2] is None else [s for s in rows if s[3] == "response" and s[1] == r[1] and s[2] is not None and s[2] < r[2]]
        base = max(before, key=lambda s: (s[2], s[0]), default=None)
        outcome = "no_base"
        if base:
            bare = lambda t: t.removeprefix("W/")
            for k in (4, 5, 6):
                if r[k] is not None and base[k] is not None:
                    outcome = "match" if (bare(r[k]) == bare(base[k])) else "mismatch"
                    break
            else:
                outcome = "no_validator"
        want[r[0]] = (base and base[0], outcome)
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA), buckets=7).collect()
    assert {r.record_id: (r.base_id, r.outcome) for r in got} == want
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    assert all((r.headers is not None) == (r.outcome == "match") for r in got)


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(f"SELECT record_id, base_id, outcome, headers FROM ({queries.OP2_SQL})").fetchall()
    got = [tuple(r) for r in queries.op2_not_modified(spark, sf).select("record_id", "base_id", "outcome", "headers").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[2] for r in got}) > 2
