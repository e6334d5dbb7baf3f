"""Tiles as PNG: indexed where 256 colours do, in the order in which they are met, else true colour with alpha."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COLORS = 256


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray) -> bytes:
    """PNG of a square of 32-bit ARGB numbers."""
    height, width = image.shape
    flat = image.ravel()
    values, first, index = np.unique(flat, return_index=True, return_inverse=True)
    parts = [b"\x89PNG\r\n\x1a\n"]
    if len(values) <= MOST_COLORS:
        order = np.argsort(first)
        rank = np.empty(len(values), np.uint8)
        rank[order] = np.arange(len(values))
        raw = rank[index].reshape(height, width)
        palette = values[order].astype(np.uint32)
        rgb = np.stack([palette >> 16 & 255, palette >> 8 & 255, palette & 255], axis=1).astype(np.uint8)
        parts += [_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 3, 0, 0, 0)), _chunk(b"PLTE", rgb.tobytes()), _chunk(b"tRNS", (palette >> 24).astype(np.uint8).tobytes())]
    else:
        v = flat.astype(np.uint32)
        raw = np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], axis=1).astype(np.uint8).reshape(height, width * 4)
        parts.append(_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)))
    lines = np.zeros((height, raw.shape[1] + 1), np.uint8)
    lines[:, 1:] = raw
    return b"".join([*parts, _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)), _chunk(b"IEND", b"")])


def decode(data: bytes) -> np.ndarray:
    """ARGB numbers of a PNG that ``encode`` made."""
    at, palette, alpha, body, head = 8, None, None, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        palette = np.frombuffer(part, np.uint8).reshape(-1, 3).astype(np.int64) if kind == b"PLTE" else palette
        alpha = np.frombuffer(part, np.uint8).astype(np.int64) if kind == b"tRNS" else alpha
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    width, height, _, color = head[:4]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)[:, 1:].astype(np.int64)
    if color == 3:
        return ((alpha << 24) + (palette[:, 0] << 16) + (palette[:, 1] << 8) + palette[:, 2])[lines]
    p = lines.reshape(height, width, 4)
    return (p[..., 3] << 24) + (p[..., 0] << 16) + (p[..., 1] << 8) + p[..., 2]


def encode_tiles(cut: DataFrame, tile_size: int) -> DataFrame:
    """(dimension, zoom, tile_x, tile_y, colors, png, message) of every tile; pixels that aren't there are clear.  A tile that
    can't be encoded, as a pixel of it lies outside, has no bytes and a message, and the others go on.  A group is
    one tile, so its size is fixed."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data, colors, message = None, None, None
        try:
            image = np.zeros((tile_size, tile_size), np.int64)
            image[rows["in_y"].to_numpy(), rows["in_x"].to_numpy()] = rows["argb"].to_numpy()
            data, colors = encode(image), len(np.unique(image))
        except Exception as e:
            message = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"dimension": [key[0]], "zoom": [key[1]], "tile_x": [key[2]], "tile_y": [key[3]], "colors": pd.array([colors], "Int64"), "png": [data], "message": [message]})

    key = ["dimension", "zoom", "tile_x", "tile_y"]
    return cut.select(*key, "in_x", "in_y", "argb").groupBy(*key).applyInPandas(one, "dimension string, zoom int, tile_x bigint, tile_y bigint, colors bigint, png binary, message string")


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """Pixels of encoded tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b[b["png"].notna()].itertuples(index=False):
                image = decode(r.png)
                y, x = np.indices(image.shape)
                yield pd.DataFrame({"dimension": r.dimension, "zoom": r.zoom, "tile_x": r.tile_x, "tile_y": r.tile_y, "in_x": x.ravel(), "in_y": y.ravel(), "argb": image.ravel()})

    return tiles.select("dimension", F.col("zoom").cast("int"), "tile_x", "tile_y", "png").mapInPandas(run, "dimension string, zoom int, tile_x bigint, tile_y bigint, in_x bigint, in_y bigint, argb bigint")
