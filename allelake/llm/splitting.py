"""Oversized texts in pieces under a token limit, cut at natural boundaries, with overlap.

Method: a cut may be made after any token that ends a character. Every cut has
a strength (paragraph, sentence, interruption, line, word, none). A sparse
table over the strengths answers the strongest cut of any window in two
look-ups; of equally strong ones the rightmost is taken. A piece starts so many
tokens before the end of the one before as the overlap says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.llm import tokens as K

LIMIT, OVERLAP = 2_048, 64

#: Strength of a cut. Within brackets it is at most that of a word's end.
PARAGRAPH, SENTENCE, INTERRUPTION, LINE, WORD, NONE = 6, 5, 4, 3, 2, 1
_BRACKETS = re.compile(rb"\([^()]*\)|\[[^\[\]]*\]")
_CLOSERS = b"\"')]"


def _among(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BLANK, _STOP, _CLOSE, _OPEN = _among(b" \t\n\r\v\f"), _among(b".!?:;"), _among(_CLOSERS), _among(b"([")


class StrongestCut:
    """Range maximum over boundary strengths: a sparse table whose entry ``(level, i)`` covers ``2**level`` cuts from ``i``."""

    def __init__(self, strengths: np.ndarray) -> None:
        self.n = len(strengths)
        row = strengths.astype(np.int64) * (self.n + 1) + np.arange(self.n)  # the later of equals is greater
        self.levels = [row]
        width = 1
        while 2 * width <= self.n:
            row = np.maximum(row[:-width], row[width:])
            self.levels.append(row)
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """The strongest cut in ``lo..hi`` (inclusive), the rightmost of equals."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi + 1 - (1 << level)]) % (self.n + 1))


def strengths(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength of the cut behind each token (0 within a character), and which tokens start with the first of a run of blanks.

    All natural boundaries are runs of blanks (or follow a closing bracket); a
    run may be cut before it or behind it.
    """
    data = np.frombuffer(raw, np.uint8)
    at = np.full(len(raw) + 1, NONE, np.int8)
    blank = np.concatenate([[False], _BLANK[data], [False]])
    first = np.flatnonzero(blank[1:] & ~blank[:-1])  # where runs start
    stop = np.flatnonzero(~blank[1:] & blank[:-1])  # and the byte behind them
    at[1:][_CLOSE[data] & (data != 34) & (data != 39)] = INTERRUPTION
    if len(first):
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        breaks = lines[stop] - lines[first]
        before = data[np.maximum(first - 1, 0)]
        earlier = np.where(_CLOSE[before], data[np.maximum(first - 2, 0)], before)
        behind = data[np.minimum(stop, len(raw) - 1)]
        strength = np.where(breaks > 0, LINE, WORD)
        strength[_OPEN[behind] | (before == 41) | (before == 93)] = INTERRUPTION
        strength[_STOP[before] | _STOP[earlier]] = SENTENCE
        strength[breaks > 1] = PARAGRAPH
        at[first] = strength
        at[stop] = strength
    for m in _BRACKETS.finditer(raw):
        inside = at[m.start() + 1 : m.end()]
        np.minimum(inside, WORD, out=inside)
    at[:-1][(data & 0xC0) == 0x80] = 0
    runs = np.zeros(len(raw) + 1, bool)
    runs[first] = True
    return at[ends], runs[np.concatenate([[0], ends])]


class _Counter:
    """Tokens of pieces by themselves. Only a piece's outer words can differ from the whole text's tokens, as words are tokenized apart from each other."""

    def __init__(self, raw: bytes, starts: np.ndarray, runs: np.ndarray, path: str | None) -> None:
        self.raw, self.starts, self.at, self.path = raw, starts, np.flatnonzero(runs), path

    def __call__(self, first: int, end: int) -> int:
        """Tokens of the piece from token ``first`` to before token ``end``."""
        own = lambda i, j: K.count(self.raw[self.starts[i] : self.starts[j]].decode(), self.path) if j > i else 0
        lo = int(np.searchsorted(self.at, first))
        hi = int(np.searchsorted(self.at, end, "right")) - 1
        if hi <= lo or lo >= len(self.at):
            return own(first, end)
        return own(first, self.at[lo]) + int(self.at[hi] - self.at[lo]) + own(self.at[hi], end)


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> list[tuple[int, int, int]]:
    """Pieces of a text as (first byte, byte after the last, tokens); one piece if it fits, none for the empty text.

    Each piece, tokenized by itself, has at most ``limit`` tokens. Pieces leave
    nothing out; neighbours share ``overlap`` tokens (a few bytes more where the
    place would fall within a character). Long runs without a boundary are cut
    between characters.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    text = K.clean(text)
    if not text:
        return []
    ends = K.encode(text, path)
    n = len(ends)
    raw = text.encode()
    if n <= limit:
        return [(0, len(raw), n)]
    power, runs = strengths(raw, ends)
    table = StrongestCut(power)
    starts = np.concatenate([[0], ends])  # byte at which token i starts
    tokens = _Counter(raw, starts, runs, path)
    out, first, reach = [], 0, limit
    while True:
        if n - first <= limit and (count := tokens(first, n)) <= limit:
            out.append((int(starts[first]), len(raw), count))
            return out
        # Behind the overlap, and no shorter than half of the limit, so every piece gets on.
        cut = table.query(min(first + max(limit // 2, overlap + 1), n - 1) - 1, min(first + reach, n) - 1)
        if not power[cut]:  # a window within one character can't be: it is longer than any
            raise ValueError("no character ends within the limit")
        lo, hi = int(starts[first]), int(ends[cut])
        count = tokens(first, cut + 1)
        if count > limit:  # cut off from their neighbours the outer tokens may fall apart
            reach -= max(1, count - limit)
            continue
        out.append((lo, hi, count))
        reach = limit
        back = cut + 1 - overlap
        while back > first + 1 and back <= cut and not power[back - 1]:
            back -= 1
        first = back


def split_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None, only_oversized: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece_no, n_pieces, first_byte, end_byte, n_tokens, piece``.

    Texts that fit are one piece; with ``only_oversized`` they are left out, and
    texts of no more bytes than the limit aren't tokenized at all (a token has at
    least one byte). Null and empty texts have no pieces; a null or repeated id is
    kept as it is. Empty tables give no rows. Other columns are ignored.
    """
    docs = documents.select(F.col(doc_id), F.col(text)).where(F.col(text) != "")
    if only_oversized:
        docs = docs.where(F.octet_length(text) > limit)
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType)])
    for name, kind in (("piece_no", T.IntegerType()), ("n_pieces", T.IntegerType()), ("first_byte", T.LongType()), ("end_byte", T.LongType()), ("n_tokens", T.IntegerType()), ("piece", T.StringType())):
        schema.add(name, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in arrow]
            size = 0
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = split(t, limit, overlap, path)
                if only_oversized and len(found) < 2:
                    continue
                raw = K.clean(t).encode()
                for i, (lo, hi, n) in enumerate(found):
                    for column, x in zip(rows, (key, i, len(found), lo, hi, n, raw[lo:hi].decode())):
                        column.append(x)
                size += len(raw)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)
                    rows, size = [[] for _ in arrow], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

    return docs.mapInArrow(pieces, schema)
