"""Ogg: pages, packets, logical streams and timestamps.

``mux`` writes several logical streams into one physical stream; ``pages`` reads it
back, verifies each page's checksum and finds the next page where one is
damaged; ``demux`` reassembles packets from lacing values by serial number and
derives a time for every packet from granule positions.

``store_text`` keeps a text as 8-bit PCM in two channels, one logical stream each
(even and odd bytes), which ``load_text`` reads back.

Times are derived where a codec says how: for this PCM every packet's, for Opus every
packet's from the durations that its packets state, for Vorbis, Speex and FLAC those of the packets
at which a page's granule position stands.  Other codecs' packets keep their page's granule and have no time (-1).

Damaged pages are counted and skipped, and packets that miss a page are
dropped and counted, never repaired.  A payload of which a head or a packet is missing
is null, with what was counted in the feature.  Empty media have no streams.  Null
media give the same as empty ones.  Texts of any length are stored in one media; a task holds a few
copies of the longest.  Repeated rows give equal results; columns beside those asked for are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tesselite.llm._util import map_texts

CONTINUED, FIRST, LAST = 1, 2, 4
UNIT = 192
RATE = 8000
#: Samples of one packet.
FRAME = 1920
NO_GRANULE = (1 << 64) - 1

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBQIIIB")
_IDENT = struct.Struct("<8sHHIBBB")


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (0x04C11DB7, most significant bit first, no initial or final inversion).  It is zlib's register
    over bit-reversed bytes, started from zero."""
    crc = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    #: Samples before its end, -1 where no page says so.
    granule: int = -1
    seconds: float = -1.0


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    lost_pages: int = 0
    lost_packets: int = 0
    begun: bool = False
    ended: bool = False
    #: Numbers of packets before which one or more are missing.
    gaps: set[int] = field(default_factory=set)


def page_bytes(p: Page) -> bytes:
    head = _HEAD.pack(b"OggS", 0, p.flags, p.granule, p.serial, p.sequence, 0, len(p.lacing))
    crc = checksum(b"".join((head, p.lacing, p.body)))
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], p.lacing, p.body))


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[Page]:
    """Pages of one logical stream.  packets: data, and the granule position at its end.  The first has a page of
    its own; the others fill pages of 255 lacing values, so that a packet may run over several pages."""
    out: list[Page] = []

    def cut(chunk: list[tuple[bytes, int]], first: bool, last: bool) -> None:
        lacing = bytearray()
        ends: list[tuple[int, int]] = []  # lacing values so far, granule
        for data, granule in chunk:
            whole, rest = divmod(len(data), 255)
            lacing += b"\xff" * whole
            lacing.append(rest)
            ends.append((len(lacing), granule))
        body = b"".join(d for d, _ in chunk)
        at, done, carried = 0, 0, False
        for a in range(0, len(lacing), 255):
            part = bytes(lacing[a : a + 255])
            granule = NO_GRANULE
            while done < len(ends) and ends[done][0] <= a + len(part):
                granule = ends[done][1]
                done += 1
            size = sum(part)
            final = last and a + 255 >= len(lacing)
            out.append(Page(CONTINUED * carried | FIRST * (first and a == 0) | LAST * final, granule, serial, len(out), part, body[at : at + size]))
            at += size
            carried = part[-1] == 255

    cut(packets[:1], True, len(packets) == 1)
    if len(packets) > 1:
        cut(packets[1:], False, True)
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    paged = [paginate(serial, packets) for serial, packets in streams.items() if packets]
    out = [page_bytes(p[0]) for p in paged]
    for k in range(1, max(map(len, paged), default=0)):
        out += [page_bytes(p[k]) for p in paged if k < len(p)]
    return b"".join(out)


def pages(media: bytes) -> tuple[list[Page], int]:
    """Pages whose checksum holds, and how many captures were not such pages."""
    out, bad, at = [], 0, 0
    while (at := media.find(b"OggS", at)) >= 0:
        if at + 27 > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if version or len(lacing) < n or end > len(media) or checksum(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : end]))) != crc:
            bad += 1
            at += 4
            continue
        out.append(Page(flags, granule, serial, sequence, lacing, media[start:end]))
        at = end
    return out, bad


def demux(media: bytes | None) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged pages."""
    found, bad = pages(media or b"")
    streams: dict[int, Stream] = {}
    open_parts: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    for p in found:
        s = streams.setdefault(p.serial, Stream(p.serial))
        s.begun |= bool(p.flags & FIRST)
        s.ended |= bool(p.flags & LAST)
        parts = open_parts.get(p.serial)
        gap = p.sequence - expected.get(p.serial, 0)
        if gap:
            s.lost_pages += max(0, gap)
            s.lost_packets += parts is not None
            s.gaps.add(len(s.packets))
            parts = None
        expected[p.serial] = p.sequence + 1
        s.pages += 1
        skip = bool(p.flags & CONTINUED) and parts is None
        if not p.flags & CONTINUED and parts is not None:
            s.lost_packets += 1
            s.gaps.add(len(s.packets))
            parts = None
        at, here = 0, []
        a = 0
        for i, v in enumerate(p.lacing):
            at += v
            if v < 255 or i == len(p.lacing) - 1:
                piece = p.body[a:at]
                a = at
                if skip:
                    skip = v == 255
                    s.lost_packets += v < 255
                    continue
                parts = [*(parts or []), piece]
                if v < 255:
                    here.append(Packet(p.serial, len(s.packets), b"".join(parts)))
                    s.packets.append(here[-1])
                    parts = None
        open_parts[p.serial] = parts
        if here and p.granule != NO_GRANULE:
            here[-1].granule = p.granule
    for serial, parts in open_parts.items():
        streams[serial].lost_packets += parts is not None
    for s in streams.values():
        _times(s)
    return streams, bad


def pcm_head(data: bytes) -> tuple[int, int, int] | None:
    """Rate, channels and channel of a head packet of PCM."""
    if len(data) < _IDENT.size or data[:8] != b"PCM     ":
        return None
    _, _, _, rate, _, channels, channel = _IDENT.unpack_from(data)
    return (rate, channels, channel) if rate else None


def codec(head: bytes) -> tuple[str, int, int]:
    """Name, granules a second (0: unknown) and granules before the start, from a stream's first packet."""
    if pcm := pcm_head(head):
        return "pcm", pcm[0], 0
    if head[:8] == b"OpusHead" and len(head) >= 12:
        return "opus", 48_000, int.from_bytes(head[10:12], "little")
    if head[:7] == b"\x01vorbis" and len(head) >= 16:
        return "vorbis", int.from_bytes(head[12:16], "little"), 0
    if head[:8] == b"Speex   " and len(head) >= 40:
        return "speex", int.from_bytes(head[36:40], "little"), 0
    if head[:5] == b"\x7fFLAC" and len(head) >= 30:
        return "flac", int.from_bytes(head[27:30], "big") >> 4, 0
    return "", 0, 0


def opus_samples(packet: bytes) -> int:
    """Samples of an Opus packet at 48 kHz, from its first bytes; -1 where they say nothing valid."""
    if not packet:
        return -1
    config, code = packet[0] >> 3, packet[0] & 3
    frame = (480, 960, 1920, 2880)[config % 4] if config < 12 else (480, 960)[config % 2] if config < 16 else (120, 240, 480, 960)[config % 4]
    if code == 3 and len(packet) < 2:
        return -1
    return frame * (1, 2, 2, packet[1] & 63 if code == 3 else 0)[code]


def _times(s: Stream) -> None:
    """Granule positions of packets that end within a page, back from the page's own, where the codec tells how long a
    packet is; and times where its rate is known."""
    if not s.packets or not s.begun:
        return
    name, rate, skip = codec(s.packets[0].data)
    samples = {"pcm": len, "opus": opus_samples}.get(name)
    if samples:
        s.packets[0].granule = 0
        # only neighbours of which nothing was lost between
        for after, p in zip(reversed(s.packets), reversed(s.packets[1:-1]), strict=False):
            if p.granule < 0 <= after.granule and after.number not in s.gaps and (n := samples(after.data)) >= 0:
                p.granule = after.granule - n
    for p in s.packets:
        if p.granule >= 0 and rate:
            p.seconds = max(0, p.granule - skip) / rate


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes with blanks up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store_text(payload: bytes) -> bytes:
    """The payload as two channels of 8-bit PCM in Ogg; serial numbers come from the payload."""
    base = zlib.crc32(payload) & 0x7FFFFFFE
    streams = {}
    for c in (0, 1):
        data = payload[c::2]
        head = _IDENT.pack(b"PCM     ", 0, 0, RATE, 8, 2, c)
        packets = [(head, 0)] + [(data[a : a + FRAME], min(a + FRAME, len(data))) for a in range(0, len(data), FRAME)]
        streams[base + c] = packets
    return mux(streams)


def load_text(media: bytes | None) -> tuple[bytes | None, str]:
    """The stored payload, null where a part of it is missing, and what was read on the way: streams, pages, damaged pages, packets,
    milliseconds, and the channels' mean levels."""
    streams, bad = demux(media)
    channels: dict[int, bytes] = {}
    wanted, whole = 0, True
    for s in streams.values():
        head = pcm_head(s.packets[0].data) if s.packets and s.begun else None
        whole &= head is not None and s.ended and not s.lost_pages and not s.lost_packets and not s.gaps
        if head:
            wanted = max(wanted, head[1])
            channels[head[2]] = b"".join(p.data for p in s.packets[1:])
    whole &= wanted > 0 and sorted(channels) == list(range(wanted)) and len({len(d) for d in channels.values()}) == 1
    out = None
    if whole:
        out = bytearray(sum(map(len, channels.values())))
        for c, data in channels.items():
            out[c::wanted] = data
    n = sum(s.pages for s in streams.values())
    ms = max((round(p.seconds * 1000) for s in streams.values() for p in s.packets), default=0)
    levels = "/".join(f"{sum(channels[c]) / max(1, len(channels[c])):.3f}" for c in sorted(channels))
    return bytes(out) if whole else None, f"streams={len(streams)};pages={n};damaged={bad};packets={sum(len(s.packets) for s in streams.values())};ms={max(0, ms)};mean={levels}"


def read_packets(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """A row for each packet of each row's Ogg bytes: the key, serial, number, granule (-1: unknown), seconds, data."""
    rows = media.select(media[key].alias("_key"), media[column].alias("_media"))
    kind = rows.schema["_key"].dataType

    def run(batches):
        for b in batches:
            for k, m in zip(b.column("_key"), b.column("_media").to_pylist(), strict=True):
                got = [p for s in demux(m)[0].values() for p in s.packets]
                if got:
                    yield pa.RecordBatch.from_pydict({
                        "_key": pa.array([k.as_py()] * len(got), b.schema.field("_key").type), "serial": pa.array([p.serial for p in got], pa.int64()), "number": pa.array([p.number for p in got], pa.int64()),
                        "granule": pa.array([p.granule for p in got], pa.int64()), "seconds": pa.array([p.seconds for p in got], pa.float64()), "data": pa.array([p.data for p in got], pa.binary()),
                    })

    return map_texts(rows, run, f"_key {kind.simpleString()}, serial bigint, number bigint, granule bigint, seconds double, data binary").withColumnRenamed("_key", key)


def store_texts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media) of every text."""
    rows = documents.select(documents[key].alias("_key"), documents["text"].alias("_text"))

    def run(batches):
        for b in batches:
            made = [payload_of(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_key": b.column("_key"), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array([store_text(p) for _, p in made], pa.binary())})

    return map_texts(rows, run, f"_key {rows.schema['_key'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("_key", key)


def read_texts(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of what ``store_texts`` stored, from its bytes alone."""
    rows = media.select(media[key].alias("_key"), "n_bytes", "media")

    def run(batches):
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in b.column("media").to_pylist():
                payload, feature = load_text(m)
                digest = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                for k, v in zip(cols, (*digest, len(m or b""), hashlib.sha256(m or b"").hexdigest(), feature), strict=True):
                    cols[k].append(v)
            types = {k: pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string() for k in cols}
            yield pa.RecordBatch.from_pydict({"_key": b.column("_key"), "n_bytes": b.column("n_bytes")} | {k: pa.array(v, types[k]) for k, v in cols.items()})

    schema = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_texts(rows, run, f"_key {rows.schema['_key'].dataType.simpleString()}, {schema}").withColumnRenamed("_key", key)
