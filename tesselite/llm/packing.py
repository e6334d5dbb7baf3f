"""Packing into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into pieces; the pieces of a group of about
``WINDOWS`` windows start as partial partitions with one piece each, and the two
partial partitions with the largest imbalances are merged again and again,
largest part with smallest, until one partition with near-equal windows is left.
Whenever a window exceeds the capacity, the group gets one more window and is
divided anew.

Groups follow the input's partitions, so that there is no shuffle and a task
holds one group at a time.  A group ends where its tokens leave ``SLACK`` of free
places a window, which is what differencing needs; the document there is cut.

Null and empty texts are one piece with the end token alone.  A document of
any length is cut into full windows and a rest.  Repeated rows are packed as often
as they come; columns beside those asked for are ignored.  An empty table has
no pieces.  Sequence ids hold the partition's number above 32 bits.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tesselite.llm import tokens
from tesselite.llm._util import map_texts

CAPACITY = 4096
END_ID = 2
#: Windows of one group that is divided by differencing.
WINDOWS = 256
#: Longest piece but for full windows; shorter pieces make windows more equal.
PIECE = 512
#: Free places a window of a full group.
SLACK = 12


def differencing(sizes: list[int] | np.ndarray, k: int) -> np.ndarray:
    """A window from 0 to k - 1 for each size, by the largest differencing method.

    A partial partition keeps its parts that hold anything, the largest first: their sums, and the first and last
    of each part's pieces, which are chained.  So all partial partitions together never hold more parts than there are pieces."""
    n = len(sizes)
    where = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return where
    own = np.asarray(sizes, np.int64)
    behind = np.full(n, -1, np.int64)
    # (minus the imbalance, number): a number below n is a piece alone
    heap = [(-size, i) for i, size in enumerate(own.tolist())]
    heapq.heapify(heap)
    partial: dict[int, np.ndarray] = {}

    def take(i: int) -> np.ndarray:
        return np.array([[own[i]], [i], [i]], np.int64) if i < n else partial.pop(i)

    number = n
    while len(heap) > 1:
        left, right = take(heapq.heappop(heap)[1]), take(heapq.heappop(heap)[1])
        # the right one's largest part goes to the left one's smallest, which may be empty
        met = max(0, left.shape[1] + right.shape[1] - k)
        if met:
            a, b = left[:, left.shape[1] - met :], right[:, right.shape[1] - met :][:, ::-1]
            behind[a[2]] = b[1]
            parts = np.concatenate((left[:, : left.shape[1] - met], np.stack((a[0] + b[0], a[1], b[2])), right[:, : right.shape[1] - met]), axis=1)
        else:
            parts = np.concatenate((left, right), axis=1)
        parts = parts[:, np.argsort(-parts[0], kind="stable")]
        partial[number] = parts
        heapq.heappush(heap, (int(parts[0, -1] if parts.shape[1] == k else 0) - int(parts[0, 0]), number))
        number += 1
    for window, i in enumerate(take(heap[0][1])[1].tolist()):
        while i >= 0:
            where[i] = window
            i = int(behind[i])
    return where


def divide(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Windows for the sizes, none above capacity, and how many windows there are."""
    total = int(np.sum(sizes))
    k = max(1, -(-total // capacity))
    while True:
        where = differencing(sizes, k)
        if np.bincount(where, weights=sizes, minlength=k).max() <= capacity:
            return where, k
        k += 1


class Packer:
    """Collects pieces, and gives a group's rows as soon as it is full."""

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS, piece: int = PIECE, slack: int = SLACK):
        self.capacity, self.room, self.piece = capacity, windows * (capacity - slack), min(piece, capacity)
        self.pieces: list[tuple] = []
        self.held = self.sequences = 0

    def _close(self) -> list[tuple]:
        sizes = [p[2] for p in self.pieces]
        where, k = divide(sizes, self.capacity)
        filled, rows = [0] * k, []
        for p, w in zip(self.pieces, where.tolist(), strict=True):
            rows.append((*p, self.sequences + w, filled[w]))
            filled[w] += p[2]
        self.sequences += k
        self.pieces, self.held = [], 0
        return rows

    def add(self, doc, ids: bytes) -> list[tuple]:
        """(doc, start, length, crc32, tokens, sequence, offset) of pieces that have their place; ids: 4 bytes each."""
        total, at, rows = len(ids) // 4, 0, []
        while total - at >= self.capacity:
            end = at + self.capacity
            rows.append((doc, at, self.capacity, zlib.crc32(ids[4 * at : 4 * end]), total, self.sequences, 0))
            self.sequences += 1
            at = end
        while at < total:
            n = min(self.piece, total - at, self.room - self.held)
            self.pieces.append((doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total))
            self.held += n
            at += n
            if self.held >= self.room:
                rows += self._close()
        return rows

    def finish(self) -> list[tuple]:
        return self._close() if self.pieces else []


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(documents: DataFrame, *, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, windows: int = WINDOWS, piece: int = PIECE, key: str = "doc_id") -> DataFrame:
    """A row for each piece: the key and COLUMNS."""
    path = vocabulary or tokens.vocabulary_path()
    rows = documents.select(documents[key].alias("_key"), documents["text"].alias("_text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        packer = Packer(capacity, windows, piece)
        kind = None

        def made(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            cols[5] = [base + s for s in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["_key", *COLUMNS])

        encode = tokens.encoder(path).encode
        for b in batches:
            kind = b.schema.field("_key").type
            keys, texts = b.column("_key").to_pylist(), b.column("_text").to_pylist()
            for a in range(0, len(keys), tokens.TOGETHER):
                out = []
                for k, ids in zip(keys[a : a + tokens.TOGETHER], encode(texts[a : a + tokens.TOGETHER]), strict=True):
                    out += packer.add(k, ids + end)
                if out:
                    yield made(out)
        if out := packer.finish():
            yield made(out)

    schema = ", ".join(f"`{c}` bigint" for c in COLUMNS)
    return map_texts(rows, run, f"_key {rows.schema['_key'].dataType.simpleString()}, {schema}").withColumnRenamed("_key", key)
