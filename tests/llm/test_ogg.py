import random
import zlib

from tesselite.llm import ogg, queries


def bitwise(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum_equals_the_bitwise_one():
    rnd = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rnd.randbytes(n)
        assert ogg.checksum(data) == bitwise(data)


def test_packets_survive_any_sizes():
    rnd = random.Random(2)
    streams = {}
    for serial in (7, 8, 9):
        at, packets = 0, []
        for n in (0, 1, 254, 255, 256, 510, 65024, 65025, 65026, 200_000, *[rnd.randrange(3000) for _ in range(40)]):
            at += n
            packets.append((rnd.randbytes(n), at))
        streams[serial] = packets
    got, bad = ogg.demux(ogg.mux(streams))
    assert bad == 0 and {s: [p.data for p in v.packets] for s, v in got.items()} == {s: [d for d, _ in v] for s, v in streams.items()}
    assert all(v.begun and v.ended and not v.lost_packets for v in got.values())
    # of an unknown codec a packet has a granule only where a page says so, and no time
    for s, v in streams.items():
        assert all(p.granule in (-1, g) and p.seconds == -1 for p, (_, g) in zip(got[s].packets, v, strict=True))
        assert 0 < sum(p.granule >= 0 for p in got[s].packets) < len(v)


def test_damage_is_counted_and_passed_over():
    media = bytearray(ogg.mux({1: [(b"head", 0)] + [(bytes([k]) * 60_000, k * 60_000) for k in range(1, 9)]}))
    whole = len(ogg.demux(bytes(media))[0][1].packets)
    media[len(media) // 2] ^= 1
    streams, bad = ogg.demux(bytes(media))
    assert bad == 1 and streams[1].lost_pages == 1 and 0 < len(streams[1].packets) < whole
    assert ogg.demux(bytes(media)[:-10])[1] == 2 and ogg.demux(b"") == ({}, 0) and ogg.demux(None) == ({}, 0)


def test_texts_come_back():
    for text in (None, "", "a", "é" * 95, "x" * 192, "x" * 193, "long text " * 40_000):
        n, payload = ogg.payload_of(text)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload[:n] == (text or "").encode() and set(payload[n:]) <= {32}
        assert ogg.load_text(ogg.store_text(payload))[0] == payload


def test_packets_as_rows(spark):
    rows = spark.createDataFrame([(1, ogg.mux({5: [(b"abc", 3), (b"de", 5)]})), (2, None), (3, b"no")], "id long, media binary")
    assert sorted((r.id, r.serial, r.number, bytes(r.data)) for r in ogg.read_packets(rows, "id").collect()) == [(1, 5, 0, b"abc"), (1, 5, 1, b"de")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_ogg(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, payload = ogg.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-16:])) and "damaged=0" in r.feature


def test_times_by_codec():
    head = ogg._IDENT.pack(b"PCM     ", 0, 0, 8000, 8, 1, 0)
    sizes = [100, 1, 0, 700, 255, 40_000, 9]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    got = ogg.demux(ogg.mux({1: [(head, 0), *((bytes(n), e) for n, e in zip(sizes, ends, strict=True))]}))[0][1].packets
    assert [p.granule for p in got] == [0, *ends] and got[-1].seconds == ends[-1] / 8000
    # Opus: 20 ms a packet, one of two frames, 312 samples before the start
    opus = b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + bytes(7)
    packets = [(opus, 0), (b"OpusTags", 0), (bytes([19 << 3, 1]), 960), (bytes([19 << 3 | 1, 1]), 2880), (bytes([19 << 3, 1]), 3840)]
    got = ogg.demux(ogg.mux({1: packets}))[0][1].packets
    assert [p.granule for p in got[2:]] == [960, 2880, 3840] and got[-1].seconds == (3840 - 312) / 48_000
    assert ogg.opus_samples(b"") == -1 and ogg.opus_samples(bytes([3])) == -1 and ogg.opus_samples(bytes([3, 4])) == 4 * 480
    vorbis = b"\x01vorbis" + bytes(5) + (44_100).to_bytes(4, "little") + bytes(14)
    got = ogg.demux(ogg.mux({1: [(vorbis, 0), (b"x" * 9, 1024), (b"y" * 9, 2048)]}))[0][1].packets
    assert [p.granule for p in got] == [0, -1, 2048] and got[2].seconds == 2048 / 44_100 and got[1].seconds == -1


def test_damaged_payloads_are_null(spark):
    _, payload = ogg.payload_of("some text " * 900)
    media = ogg.store_text(payload)
    rnd = random.Random(5)
    for at in [*range(0, 60), *(rnd.randrange(len(media)) for _ in range(60))]:
        broken = bytearray(media)
        broken[at] ^= 1 << rnd.randrange(8)
        got, feature = ogg.load_text(bytes(broken))
        assert got is None and "damaged=" in feature, at
        cut = ogg.load_text(media[:at])[0]
        assert cut is None
    assert ogg.load_text(media) == ogg.load_text(bytes(media)) and ogg.load_text(None)[0] is None and ogg.load_text(b"OggS")[0] is None
    rows = spark.createDataFrame([(1, 5, bytearray(media[:-9])), (2, 5, None), (3, 5, bytearray(media))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in ogg.read_texts(rows).collect()}
    assert got[1].payload_sha256 is None and got[2].payload_bytes is None and got[2].media_bytes == 0 and got[3].payload_bytes == len(payload)
