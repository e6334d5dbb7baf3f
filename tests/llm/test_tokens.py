import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tesselite.llm import packing, queries, separators, tokens  # noqa: E402

ODD = [None, "", " ", "It's I'LL don'TS ' 's x'sx", "a²b½ ª º µ ß ÿ Ŀ ŉ ǅ ×÷ _a_b 1_2 Æ ẞ", "<|endoftext|> hi <|endoftext|>", "é é \xad x\xady", "İstanbul DŽ", "a b\u0085c\x1cd", "日本語 text １２", "Σίσυφος ΣΑΣ", "a.b.c d,e .,a . , , 5.5 a,,b a!.b x.% 9. µ.ß, don.'t x", "A" * 300]


@pytest.fixture(scope="module")
def own():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.mark.parametrize("plain", [False, True])
def test_cached_ids_equal_the_tokenizer(own, plain):
    rnd = random.Random(1)
    chars = [chr(c) for c in range(1, 0x250)] + ["'s", "'ll", " ", " ", ",", ".", "%%%", "the", "word"]
    texts = ODD + ["".join(rnd.choice(chars) for _ in range(60)) for _ in range(400)] + [" ".join(f"a{chr(c)}{chr(c)}b {chr(c)}." for c in range(0x21, 0x250))]
    own.encode_special_tokens = plain
    for t, got in zip(texts, tokens.encoder(tokens.vocabulary_path(), plain).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(t or "", add_special_tokens=False).ids, repr(t)
    own.encode_special_tokens = False


def test_generations_forget_what_is_not_asked_for():
    g = tokens.Generations(2)
    for k in "abc":
        for new in g.missing({k}):
            g.young[new] = k
    assert g.missing({"a"}) == [] and len(g.young) <= 2 and g.missing({"z"}) == ["z"]


def test_differencing_is_near_equal():
    rnd = random.Random(2)
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    sizes = [rnd.randrange(1, 513) for _ in range(900)]
    sums = np.bincount(packing.differencing(sizes, 50), weights=sizes, minlength=50)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 5
    assert packing.differencing([5], 3).tolist() == [packing.differencing([5], 3)[0]] and len(packing.differencing([], 3)) == 0


def test_windows_rise_where_capacity_is_exceeded():
    where, k = packing.divide([60, 60, 60], 100)
    assert k == 3 and len(set(where.tolist())) == 3
    assert packing.divide([50, 50], 100)[1] == 1


def _check(rows, want, capacity):
    filled, pieces = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
        pieces.setdefault(r.doc_id, []).append(r)
    assert max(filled.values()) <= capacity and set(pieces) == set(want)
    for doc, ids in want.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return 1 - sum(filled.values()) / (capacity * len(filled))


def test_packing(spark, own):
    rnd = random.Random(3)
    texts = ODD + [" ".join(rnd.choice(["the", "river", "stonework", "of", "x"]) for _ in range(rnd.randrange(400))) for _ in range(150)] + ["word " * 9000]
    df = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "doc_id long, text string, offset string").coalesce(1)
    want = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert _check(packing.pack(df).collect(), want, 4096) < 0.1
    assert _check(packing.pack(df, capacity=64, windows=16, piece=20).collect(), want, 64) < 0.3
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_query(spark, own):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: own.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert _check(queries.op9_pack(spark, sf).collect(), want, 4096) < 0.05


def test_separators_across_any_blocks(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for file in range(6):
        docs = [[rnd.randrange(9) for _ in range(rnd.choice([0, 0, 1, 2, 5, 40]))] for _ in range(rnd.randrange(30))]
        flat = [x for d in docs for x in [*d, 99]]
        rest = [1] * rnd.randrange(4)
        at, out = 0, []
        for d in docs:
            out.append((at, len(d), True))
            at += len(d) + 1
        if rest:
            out.append((at, len(rest), False))
        want |= {(file, k): v for k, v in enumerate(out)}
        raw, at, n = np.array(flat + rest, "<u2").tobytes(), 0, 0
        while at < len(raw):
            size = 2 * rnd.choice([0, 1, 1, 2, 3, 7, 30])
            rows.append((file, n, raw[at : at + size]))
            at, n = at + size, n + 1
    df = spark.createDataFrame([*rows, (9, 0, None), (9, 1, b"")], "file long, block long, data binary")
    for group in (1, 3, 1024):
        got = {(r.file, r.ordinal): (r.start, r.tokens, r.closed) for r in separators.count_tokens(df, 99, group).collect()}
        assert got == want
    assert separators.count_tokens(df.limit(0), 99).count() == 0


def test_counts_of_documents(spark, own):
    texts = ODD + ["many words " * 3000, "x", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    blocks, who = separators.write_flat(df, block=500)
    got = {r.doc_id: r.tokens for r in separators.count_tokens(blocks).filter("closed").join(who, ["file", "ordinal"]).collect()}
    own.encode_special_tokens = True
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    own.encode_special_tokens = False
    assert got == want


def test_count_query(spark, own):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.tokens for r in queries.op6_separator_scan(spark, sf).collect()} == want


@pytest.mark.parametrize("text", ["DEMİ. yeni", "DEMİ, yeni", "İ.İ,İ .a", "plain DİZİ, 5.5 x"])
def test_dotted_capital_before_punctuation(own, text):
    assert np.frombuffer(tokens.encoder(tokens.vocabulary_path()).encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_every_latin_character_beside_every_sign(own):
    letters = [chr(c) for c in range(0x20, 0x180)]
    signs = [chr(c) for c in range(0x21, 0x180) if not chr(c).isalnum() and not chr(c).isspace()] + ["..", ".,", "%.", "1", "'s"]
    texts = [t for c in letters for s in signs for t in (f"a{c}{s} b", f"{s}{c}x")]
    got = tokens.encoder(tokens.vocabulary_path()).encode(texts)
    for a in range(0, len(texts), 10_000):
        for t, g, w in zip(texts[a : a + 10_000], got[a : a + 10_000], own.encode_batch(texts[a : a + 10_000], add_special_tokens=False), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == w.ids, repr(t)


def test_mixed_texts_equal_the_tokenizer(own):
    rnd = random.Random(7)
    chars = [chr(c) for c in range(0x20, 0x180)] + list(" .,!'") * 20 + ["\u0307", "\u0301", "ſ", "ẞ", "\t", "\n"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(12))) for _ in range(20_000)]
    for t, g, w in zip(texts, tokens.encoder(tokens.vocabulary_path()).encode(texts), own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == w.ids, repr(t)


def test_many_tiny_pieces_stay_small():
    import tracemalloc

    tracemalloc.start()
    where, k = packing.divide([1] * 100_000 + [3] * 20_000)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert k <= -(-160_000 // 4096) + 1 and np.bincount(where, weights=[1] * 100_000 + [3] * 20_000).max() <= 4096
