"""Parquet footers as trees: a reader and writer of Thrift's compact protocol.

A struct is a dict of field id to (type, value), so fields that a newer writer
added survive being read and written again.
"""

from __future__ import annotations

import struct

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
MAGIC = b"PAR1"


class Reader:
    """Reads one value after another from ``data``."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):  # as a list element: one byte
            self.at += 1
            return self.data[self.at - 1] == TRUE
        if kind == BYTE:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == BINARY:
            size = self.varint()
            self.at += size
            return self.data[self.at - size : self.at]
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            size, of = head >> 4, head & 15
            if size == 15:
                size = self.varint()
            return of, [self.value(of) for _ in range(size)]
        if kind == MAP:
            size = self.varint()
            if not size:
                return 0, 0, []
            kinds = self.data[self.at]
            self.at += 1
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(size)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"type {kind} in a footer")

    def struct(self) -> dict:
        out, last = {}, 0
        while head := self.data[self.at]:
            self.at += 1
            kind = head & 15
            last = last + (head >> 4) if head >> 4 else self.signed()
            out[last] = (kind, kind == TRUE) if kind in (TRUE, FALSE) else (kind, self.value(kind))
        self.at += 1
        return out


class Writer:
    """Writes into ``out``."""

    def __init__(self) -> None:
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n > 127:
            self.out.append(n & 127 | 128)
            n >>= 7
        self.out.append(n)

    def signed(self, n: int) -> None:
        self.varint(n << 1 if n >= 0 else (-n << 1) - 1)

    def value(self, kind: int, x) -> None:
        if kind in (TRUE, FALSE):
            self.out.append(TRUE if x else FALSE)
        elif kind == BYTE:
            self.out.append(x & 255)
        elif kind in (I16, I32, I64):
            self.signed(x)
        elif kind == DOUBLE:
            self.out += struct.pack("<d", x)
        elif kind == BINARY:
            self.varint(len(x))
            self.out += x
        elif kind in (LIST, SET):
            of, items = x
            if len(items) < 15:
                self.out.append(len(items) << 4 | of)
            else:
                self.out.append(240 | of)
                self.varint(len(items))
            for item in items:
                self.value(of, item)
        elif kind == MAP:
            of_key, of_value, items = x
            self.varint(len(items))
            if items:
                self.out.append(of_key << 4 | of_value)
            for k, v in items:
                self.value(of_key, k)
                self.value(of_value, v)
        elif kind == STRUCT:
            self.struct(x)

    def struct(self, fields: dict) -> None:
        last = 0
        for number in sorted(fields):
            kind, x = fields[number]
            if kind in (TRUE, FALSE):
                kind = TRUE if x else FALSE
            if 0 < number - last < 16:
                self.out.append((number - last) << 4 | kind)
            else:
                self.out.append(kind)
                self.signed(number)
            if kind not in (TRUE, FALSE):
                self.value(kind, x)
            last = number
        self.out.append(0)


def read_footer(source, size: int) -> dict:
    """The FileMetaData tree of a seekable file of ``size`` bytes."""
    if size < 12:
        raise ValueError("shorter than any Parquet file")
    source.seek(size - 8)
    tail = source.read(8)
    if tail[4:] != MAGIC:
        raise ValueError("not a plain Parquet file")
    length = int.from_bytes(tail[:4], "little")
    source.seek(size - 8 - length)
    return Reader(source.read(length)).struct()


def footer_bytes(footer: dict) -> bytes:
    """A footer as it stands at a file's end."""
    w = Writer()
    w.struct(footer)
    return bytes(w.out) + len(w.out).to_bytes(4, "little") + MAGIC


def schema_key(footer: dict) -> bytes:
    """Equal for files whose row groups may stand in one file: the schema and the column orders."""
    w = Writer()
    w.struct({k: footer[k] for k in (2, 7) if k in footer})
    return bytes(w.out)


# Field numbers of the Parquet format.
ROWS, GROUPS, PAIRS, CREATED = 3, 4, 5, 6
COLUMNS, GROUP_ROWS, GROUP_OFFSET, ORDINAL = 1, 3, 5, 7
CHUNK_OFFSET, CHUNK_META, INDEXES = 2, 3, (4, 5, 6, 7)
COMPRESSED, DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE, BLOOM = 7, 9, 10, 11, (14, 15)


def span(group: dict) -> tuple[int, int]:
    """First byte of a row group and the byte after its last."""
    lo, hi = None, 0
    for chunk in group[COLUMNS][1][1]:
        meta = chunk[CHUNK_META][1]
        starts = [meta[f][1] for f in (DATA_PAGE, DICTIONARY_PAGE) if f in meta and meta[f][1] > 0]
        lo, hi = min(starts + ([lo] if lo is not None else [])), max(hi, min(starts) + meta[COMPRESSED][1])
    return lo or 0, hi


def moved(group: dict, by: int, ordinal: int) -> dict:
    """A row group whose bytes stand ``by`` further on. Page indexes and Bloom filters, which stay behind, are no longer named."""
    chunks = []
    for chunk in group[COLUMNS][1][1]:
        chunk = {k: v for k, v in chunk.items() if k not in INDEXES}
        meta = {k: v for k, v in chunk[CHUNK_META][1].items() if k not in BLOOM}
        for f in (DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE):
            if f in meta and meta[f][1] > 0:
                meta[f] = (meta[f][0], meta[f][1] + by)
        kind, at = chunk.get(CHUNK_OFFSET, (I64, 0))
        chunk[CHUNK_OFFSET] = (kind, at + by if at else 0)
        chunk[CHUNK_META] = (STRUCT, meta)
        chunks.append(chunk)
    out = dict(group) | {COLUMNS: (LIST, (STRUCT, chunks))}
    if GROUP_OFFSET in out:
        out[GROUP_OFFSET] = (I64, out[GROUP_OFFSET][1] + by)
    if ORDINAL in out:
        out.pop(ORDINAL)
        if ordinal < 1 << 15:
            out[ORDINAL] = (I16, ordinal)
    return out
