import zlib

import corpus_pipeline as p
import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tesselite.llm import queries, secrets, subword, tokens
from tesselite.llm._util import table

from test_dart import brute

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    good = p.quality(spark, docs, SF)
    assert good.columns == columns
    model = subword.fit(docs, table(spark, SF, "labels"))
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i, r in rows.items() if model.score(r.text) >= 0.5}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in kept) >= 0.95 * sum(v == 1 for v in labels.values())
    one = p.near_copies(spark, good, SF)
    assert one.columns == columns
    left = {r.doc_id for r in one.collect()}
    assert left == set(brute([(i, rows[i].text) for i in sorted(kept)]).values())
    safe = p.redact_secrets(spark, one, SF)
    assert safe.columns == columns
    got = {r.doc_id: r for r in safe.collect()}
    assert {i: r.text for i, r in got.items()} == {i: secrets.redact(rows[i].text) for i in left}
    assert all(not secrets.scan(r.text)[0] and (r.n_chars == len(r.text) or r.text == rows[i].text) for i, r in got.items())
    mixed = p.mix(spark, safe, SF)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= left


def test_whole_run_equals_the_stages_by_hand(spark):
    """run() against each stage's meaning recomputed from the one before without the operators' joins."""
    assert [n for n, _ in p.STAGES] == ["quality", "near_copies", "secrets", "mix", "pack"]
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = subword.fit(docs, table(spark, SF, "labels"))
    good = {i for i, r in rows.items() if model.score(r.text) >= 0.5}
    left = sorted(set(brute([(i, rows[i].text) for i in sorted(good)]).values()))
    texts = {i: secrets.redact(rows[i].text) for i in left}
    # the mix by SQL, over what was left
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(left, pa.int64()), "text": pa.array([texts[i] for i in left], pa.string()), "source": pa.array([rows[i].source for i in left], pa.string())}))
    copies = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({queries.OP7_SQL}) WHERE size > 0").fetchall() if taken}
    own = Tokenizer.from_file(tokens.vocabulary_path())
    got, filled = {}, {}
    for r in p.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(copies)
    for i, pieces in got.items():
        ids = own.encode(texts[i], add_special_tokens=False).ids + [2]
        assert sum(r.length for r in pieces) == copies[i] * len(ids) and sum(r.start == 0 for r in pieces) == copies[i]
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_columns_with_any_names_come_through(spark):
    docs = table(spark, SF, "documents").limit(40).withColumnsRenamed({"lang": "score"}).selectExpr("*", "doc_id * 2 AS `odd name; ``x``.y`", "'s' AS spans", "1 AS rate", "2 AS size", "3 AS node", "4 AS component", "5 AS seed")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() >= 0
    assert p.STAGES[-1][1](spark, docs, SF).count() > 0
