"""Hashes of words and runs of characters, many texts at once, in pieces of bounded size.

A word's hash is a polynomial in its code points modulo 2**64, so that prefix sums
give the hashes of all words of a piece, and a word that runs over several pieces is
put together from its parts.  Texts are lower-cased; words are what white space
separates, as ``str.split`` sees it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

#: Code points that are looked at together.
PIECE = 1 << 18
BASE = 0x100000001B3
_MASK = (1 << 64) - 1
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and their inverses, for every place of a piece."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(PIECE + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _blank(c: np.ndarray) -> np.ndarray:
    return _BLANK[np.minimum(c, 0x3001)]


def lowered(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


def groups(texts: list[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``most`` characters together; a longer text is alone."""
    a = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield a, k
            a, held = k, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def words(lows: list[str], of_point: Callable[[np.ndarray], np.ndarray], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the lower-cased texts, in order.  of_point: a 64-bit number for each code point."""
    ends = np.cumsum([len(t) + 1 for t in lows], dtype=np.int64)
    whole = " ".join(lows) + " "
    power, inverse = _powers()
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    open_hash = open_len = open_at = 0
    for at in range(0, len(whole), piece):
        c = _points(whole[at : at + piece])
        blank = _blank(c)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(of_point(c) * power[: len(c)], out=total[1:])
        before = np.concatenate(([open_len == 0], blank[:-1]))
        b, e = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        if open_len:
            upto = int(e[0]) if len(e) else len(c)
            open_hash = (open_hash + pow(BASE, open_len, 1 << 64) * int(total[upto])) & _MASK
            open_len += upto
            if not len(e):
                continue
            hashes.append(np.array([open_hash], np.uint64))
            starts.append(np.array([open_at], np.int64))
            e = e[1:]
        if open_len := (len(c) - int(b[-1]) if len(b) > len(e) else 0):
            open_at = at + int(b[-1])
            open_hash = int(((total[-1:] - total[b[-1:]]) * inverse[b[-1:]])[0])
            b = b[:-1]
        hashes.append((total[e] - total[b]) * inverse[b])
        starts.append(b + at)
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(starts), side="right")


def normalised(low: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Code points of a lower-cased text in pieces, each run of white space as one blank, one blank at either end;
    nothing for a text without words."""
    first, ended = True, True
    for at in range(0, len(low), piece):
        c = _points(low[at : at + piece])
        blank = _blank(c)
        keep = ~(blank & np.concatenate(([ended], blank[:-1])))
        ended = bool(blank[-1])
        c = np.where(blank, np.uint32(32), c)[keep]
        if len(c):
            yield np.concatenate((np.array([32], np.uint32), c)) if first else c
            first = False
    if not ended:
        yield np.array([32], np.uint32)
