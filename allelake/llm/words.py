"""Texts as arrays of 64-bit word ids: the words that count in a comparison.

Case, accents (ß is ss), punctuation, line breaks and interruptions in round or
square brackets make no difference.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import xxhash

#: A bracketed interruption: closed, not nested. An open bracket alone is punctuation.
INTERRUPTION = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
#: The marks that most accents are taken apart into.
_MARKS = re.compile("[\u0300-\u034e\u0350-\u036f]+")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes([32]) * 128

#: Stands between texts; no word has it.
GAP = np.uint64(0)


class _Ids(dict):
    """Word to id. Ids are hashes, so all tasks agree; the dict only saves hashing a word twice."""

    def __missing__(self, word) -> int:
        if len(self) > 2_000_000:
            self.clear()
        raw = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        self[word] = found = xxhash.xxh3_64_intdigest(raw) or 1
        return found


_IDS = _Ids()


def words(text: str | None) -> list:
    """The normal forms of a text's words (bytes where all are ASCII, else strings). Null and empty texts have none."""
    if not text:
        return []
    if "(" in text or "[" in text:
        text = INTERRUPTION.sub(" ", text)
    if text.isascii():
        return text.lower().encode().translate(_PLAIN).split()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss")))
    if not text.isascii():
        text = "".join([c for c in text if c < "\x80" or not unicodedata.combining(c)])
    if text.isascii():
        return text.encode().translate(_PLAIN).split()
    return [w.encode() if w.isascii() else w for w in _WORD.findall(text)]


def ids(text: str | None) -> np.ndarray:
    """The ids of a text's words."""
    own = words(text)
    return np.fromiter(map(_IDS.__getitem__, own), np.uint64, len(own))


def joined(texts: Iterable[str | None], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many texts in one array with ``gap`` zeros after each, and where each text starts (and the end)."""
    parts, starts, at = [], [0], 0
    zeros = np.zeros(gap, np.uint64)
    for t in texts:
        own = ids(t)
        at += len(own) + gap
        parts += [own, zeros]
        starts.append(at)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(starts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(seq: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` ids, by its start; empty where the array is shorter."""
    if len(seq) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(seq) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + seq[i : len(seq) - n + 1 + i]
        return mixed(out)


class Lookup:
    """Finds the few members of a fixed set among many 64-bit hashes: a bitmap of the top bits first, then a binary search."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.unique(known)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.known)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where members stand in ``hashes``, and which members they are."""
        if not len(self.known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.flatnonzero(self.bitmap.take((hashes >> np.uint64(44)).view(np.int64)))
        at = np.minimum(np.searchsorted(self.known, hashes[near]), len(self.known) - 1)
        there = self.known[at] == hashes[near]
        return near[there], at[there]
