"""Binary variant files: a reader that gives the same records as the text reader.

A file is decoded as a stream by the task that has its path, from whatever file
system the path names. The values are turned into the text notation, so types
and columns are those of text files.
"""

from __future__ import annotations

import gzip
import math
import re
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.functions import alleles as A
from allelake.session import ship

SCHEMA = (
    "file string, sample string, contig string, pos int, id string, alleles array<string>, qual float, filters array<string>, info map<string,string>, fmt map<string,string>"
)

#: Fixed values of the format: struct codes, missing and end-of-list marks by type.
_INTS = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -(2**31), -(2**31) + 1)}
_FLOAT_MISSING, _FLOAT_END = 0x7F800001, 0x7F800002


class _Bytes:
    """A cursor over one record's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def kind(self) -> tuple[int, int]:
        """(type, number of values) of the value that follows."""
        head = self.take("B")[0]
        n = head >> 4
        return head & 15, self.values(*self.kind(), raw=True)[0] if n == 15 else n

    def values(self, kind: int, n: int, raw: bool = False):
        """``n`` values: text for characters, else a list with None for missing ones."""
        if kind == 7:
            text = self.data[self.at : self.at + n]
            self.at += n
            return text.split(b"\0")[0].decode("utf-8", "replace")
        if kind == 5:
            bits, again = self.take(f"{n}I"), self.at - 4 * n
            floats = struct.unpack_from(f"<{n}f", self.data, again)
            return [None if b == _FLOAT_MISSING else f for b, f in zip(bits, floats) if b != _FLOAT_END]
        if kind in _INTS:
            form, missing, end = _INTS[kind]
            got = self.take(f"{n}{form}")
            return list(got) if raw else [None if x == missing else x for x in got if x != end]
        return []

    def value(self):
        return self.values(*self.kind())


def _text(x) -> str:
    if isinstance(x, str):
        return x or "."
    out = []
    for v in x:
        if v is None:
            out.append(".")
        elif isinstance(v, float):
            out.append(f"{v:.6g}" if math.isfinite(v) else str(v))
        else:
            out.append(str(v))
    return ",".join(out) or "."


def _genotype(values: Sequence[int | None]) -> str:
    """Alleles from their codes: twice the number plus one, and a bit for phased."""
    out = ""
    for i, v in enumerate(values):
        allele = "." if v is None or v >> 1 == 0 else str((v >> 1) - 1)
        out += ("" if i == 0 else "|" if v is not None and v & 1 else "/") + allele
    return out or "."


def dictionaries(header: str) -> tuple[dict[int, str], dict[int, str]]:
    """Names by number: of filters, INFO and FORMAT fields, and of contigs; in order of first use unless IDX says otherwise."""
    strings, contigs = {0: "PASS"}, {}
    seen = {"PASS"}
    for line in header.splitlines():
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>", line)
        if not m:
            continue
        bare = re.sub(r'"(?:[^"\\]|\\.)*"', '""', m[2])
        name, idx = re.search(r"(?:^|,)ID=([^,]+)", bare), re.search(r"(?:^|,)IDX=(\d+)", bare)
        if not name:
            continue
        table = contigs if m[1] == "contig" else strings
        if idx:
            table[int(idx[1])] = name[1]
        elif m[1] == "contig":
            table[len(table)] = name[1]
        elif name[1] not in seen:
            table[len(seen)] = name[1]
        if m[1] != "contig":
            seen.add(name[1])
    return strings, contigs


def top(stream, file: str) -> tuple[str, str]:
    """Header text, column line included, and sample name. Raises ValueError if the file is none or has several samples."""
    if stream.read(5)[:4] != b"BCF\2":
        raise ValueError(f"{file} is no binary variant file")
    header = stream.read(struct.unpack("<I", stream.read(4))[0]).rstrip(b"\0").decode("utf-8", "replace")
    columns = next((line for line in header.splitlines() if line.startswith("#CHROM")), "#CHROM").split("\t")
    if len(columns) > 10:
        raise ValueError(f"more than one sample in {file}")
    return header, columns[9].strip() if len(columns) == 10 else ""


def bcf_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, sample, header`` of binary files, as :func:`allelake.sources.vcf.read_headers` gives them."""
    ship(spark)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from allelake.sources.files import open_uri

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, at = open_uri(path)
                with system.open_input_file(at) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    header, sample = top(gzip.GzipFile(fileobj=raw) if packed else raw, path)
                found.append((path, sample, "\n".join(x for x in header.splitlines() if x.startswith("##"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 3, names=["file", "sample", "header"])

    return listed.mapInArrow(read, "file string, sample string, header string")


def decode(stream, file: str) -> Iterator[dict]:
    """Records of one file, from its uncompressed bytes. Raises ValueError if it is none or has several samples."""
    def exactly(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError(f"{file} ends within a record")
        return data

    header, sample = top(stream, file)
    strings, contigs = dictionaries(header)
    while head := stream.read(8):
        if len(head) != 8:
            raise ValueError(f"{file} ends within a record")
        shared, own = struct.unpack("<II", head)
        r, f = _Bytes(exactly(shared)), _Bytes(exactly(own))
        contig, pos, _, bits, n_info, n_allele, both = r.take("iiiIHHI")
        n_sample, n_fmt = both & 0xFFFFFF, both >> 24
        qual = None if bits == _FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", bits))[0]
        name = r.value()
        alleles = [r.value() for _ in range(n_allele)]
        filters = [strings.get(i, str(i)) for i in r.value()] if r.at < len(r.data) else []
        info = {}
        for _ in range(n_info):
            key = strings.get(r.value()[0], "?")
            kind, n = r.kind()
            got = r.values(kind, n)
            info[key] = "" if kind == 0 or n == 0 else _text(got)
        fmt = {}
        for _ in range(n_fmt):
            key = strings.get(f.value()[0], "?")
            kind, n = f.kind()
            got = f.values(kind, n)
            if n_sample:
                fmt[key] = _genotype(got) if key == "GT" else _text(got)
        yield {
            "file": file, "sample": sample, "contig": contigs.get(contig, str(contig)), "pos": pos, "id": name or ".", "alleles": alleles, "qual": qual,
            "filters": filters or None, "info": list(info.items()), "fmt": list(fmt.items()),
        }


def read_bcf(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of binary single-sample files, with the columns of :func:`allelake.sources.vcf.read_vcf`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)
    ship(spark)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from allelake.sources.files import open_uri

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = open_uri(path)
                with system.open_input_file(at) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    held = []
                    for record in decode(gzip.GzipFile(fileobj=raw) if packed else raw, path):
                        held.append(record)
                        if len(held) == 5_000:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    end = A.end_position(F.col("pos"), F.element_at("alleles", 1), F.element_at("info", "END"))
    out = listed.mapInArrow(read, kind).withColumn("end_pos", end).withColumn("gt", A.decode_gt(F.element_at("fmt", "GT")))
    return out.select("file", "sample", "contig", "pos", "end_pos", "id", "alleles", "qual", "filters", "gt", "info", "fmt")
