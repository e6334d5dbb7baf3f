"""Token ids of whole texts by a public tokenizer's file.

The tokenizer of lower-cased words drops white space and never lets a token
cross it, so that a chunk between blanks has the same ids wherever it stands, and
the last id of a word is always one that ends words.  Chunks are therefore looked
up in a cache of bounded size, and only new ones go to the tokenizer, many
at once.  Texts with characters for which this
isn't plainly so (anything but printable Latin, tab, line feed and carriage
return, a capital I with a dot, which lower-cases to a letter and a sign, or the
start of a special token) go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

#: Entries of one of the cache's two generations.
CHUNKS = 600_000
#: Texts that are looked up together.
TOGETHER = 64
VOCABULARY = "word_bpe_49k.json"

# Classes of UTF-8 bytes: a letter, digit or part of one; white space; comma or full stop; other signs; what needs a
# closer look (control characters, and lead bytes of characters that aren't Latin letters)
_CLASS = bytes(
    32 if i in (9, 10, 13, 32) else 0 if i < 32 or i == 127 or i == 0xC2 or i > 0xC5 else 46 if i in (44, 46) else 97 if i > 127 or chr(i).isalnum() else 33 for i in range(256)
)
# a comma or full stop after one of these belongs to a longer run; else it can be a chunk of its own
_RUN = re.compile(r"[^\sa-z0-9ªµºß-öø-ſ²³¹¼½¾][.,]|[.,][^\sa-z0-9ªµºß-öø-ſ²³¹¼½¾]")
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ſ]|<\|")
# the tokenizer's own split, for lower-cased characters that are not unusual
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ſ²³¹¼½¾]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations:
    """A cache of two generations: what was not asked for during the filling of one is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not known; the known ones are young afterwards."""
        return [k for k, v in self.found(keys).items() if v is None]

    def found(self, keys: set[str]) -> dict:
        """What is known of each key, None if nothing; the known ones are young afterwards."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        known = dict(zip(keys, map(self.young.get, keys), strict=True))
        if self.old:
            for k in [k for k, v in known.items() if v is None]:
                if (v := self.old.get(k)) is not None:
                    known[k] = self.young[k] = v
        return known


class Encoder:
    """``encode(texts)``: the ids of each as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str, plain: bool = False):
        """plain: special tokens' strings in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = plain
        # for chunks of lower-cased letters alone, which the tokenizer's normalisation and split leave as they are
        self._lean = Tokenizer.from_file(path)
        self._lean.normalizer = None
        self._lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._chunks = Generations(CHUNKS)
        vocabulary = self._own.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self._own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks of letters alone, many at once."""
        known: dict[str, bytes] = {}
        for a in range(0, len(chunks), 200):
            part = chunks[a : a + 200]
            ids = np.array(self._lean.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for c, end in zip(part, (cuts * 4).tolist(), strict=True):
                    known[c] = raw[at:end]
                    at = end
            else:
                known.update((c, self._whole(c)) for c in part)
        return known

    def _ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of all the chunks, in a dictionary of their own that is small enough to be fast."""
        known = self._chunks.found(chunks)
        new = [c for c, v in known.items() if v is None]
        letters = {c for c in new if c.isalpha()}
        mixed = {c: _WORD.findall(c) for c in new if c not in letters}
        pieces = set().union(*mixed.values()) if mixed else set()
        signs = {p for p in pieces if not p.isalpha()}
        learned = self._letters(list(letters | (pieces - signs)))
        young = self._chunks.young
        for p in signs:
            ids = known.get(p) or young.get(p)
            learned[p] = self._whole(p) if ids is None else ids
        young.update(learned)
        known.update(learned)
        for c, parts in mixed.items():
            known[c] = young[c] = b"".join(map(learned.__getitem__, parts))
        return known

    @staticmethod
    def _split(text: str) -> list[str] | None:
        """Chunks of the text; None if it must go to the tokenizer whole."""
        raw = text.encode("utf-8", "surrogatepass")
        kinds = raw.translate(_CLASS)
        if b"\0" in kinds or b"<|" in raw or b"\xc4\xb0" in raw or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
            if _UNUSUAL.search(text):
                return None
            text = text.lower()
            apart = not _RUN.search(text)
        else:
            text = text.lower()
            apart = not (b"!." in kinds or b".!" in kinds or b".." in kinds)
        if apart:
            text = text.replace(",", " , ").replace(".", " . ")
        return text.split()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        out = []
        for a in range(0, len(texts), TOGETHER):
            part = texts[a : a + TOGETHER]
            split = [self._split(t) for t in part]
            get = self._ids(set().union(*(s for s in split if s))).__getitem__
            out += [self._whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(part, split, strict=True)]
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each file, kind and process."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
