"""Binary files, written here by a small encoder, give what the same text file gives."""

import gzip
import struct

import pytest
from common import rows

from allelake.sources.bcf import read_bcf
from allelake.sources.vcf import read_vcf

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="x, ID=y">
##FILTER=<ID=q10,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="share">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##INFO=<ID=END,Number=1,Type=Integer,Description="end">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="likelihood">
##FORMAT=<ID=FT,Number=1,Type=String,Description="filter">
##contig=<ID=1>
##contig=<ID=chr2,length=5>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1
"""
LINES = """1\t10\trs1\tA\tC,<NON_REF>\t9.5\tPASS\tDP=300;AF=0.5,.;DB\tGT:PL:FT\t0|1:1,.,70000:ok
chr2\t3\t.\tGT\tG\t.\tq10\tEND=40\tGT\t./1
chr2\t4\t.\tG\t.\t.\t.\tDP=7\tGT:PL\t2:3
"""


def kind(n, t):
    return bytes([n << 4 | t]) if n < 15 else bytes([0xF0 | t]) + number([n])


def number(xs):
    size = 1 if all(x is None or -120 <= x <= 127 for x in xs) else 2 if all(x is None or abs(x) < 32000 for x in xs) else 3
    form, missing = {1: ("b", -128), 2: ("h", -32768), 3: ("i", -(2**31))}[size]
    return kind(len(xs), size) + struct.pack(f"<{len(xs)}{form}", *(missing if x is None else x for x in xs))


def text(s):
    return kind(len(s), 7) + s.encode()


def floats(xs):
    return kind(len(xs), 5) + b"".join(struct.pack("<I", 0x7F800001) if x is None else struct.pack("<f", x) for x in xs)


def record(contig, pos, id_, alleles, qual, filters, info, fmt):
    shared = struct.pack("<iii", contig, pos, 1) + (struct.pack("<I", 0x7F800001) if qual is None else struct.pack("<f", qual)) + struct.pack("<HHI", len(info), len(alleles), len(fmt) << 24 | 1)
    shared += (text(id_) if id_ else kind(0, 7)) + b"".join(map(text, alleles)) + (number(filters) if filters else kind(0, 1))
    shared += b"".join(number([k]) + v for k, v in info)
    own = b"".join(number([k]) + v for k, v in fmt)
    return struct.pack("<II", len(shared), len(own)) + shared + own


def test_binary_equals_text(spark, tmp_path):
    body = [
        record(0, 9, "rs1", ["A", "C", "<NON_REF>"], 9.5, [0], [(2, number([300])), (3, floats([0.5, None])), (4, kind(0, 0))], [(6, number([2, 5])), (7, number([1, None, 70000])), (8, text("ok"))]),
        record(1, 2, "", ["GT", "G"], None, [1], [(5, number([40]))], [(6, number([0, 4]))]),
        record(1, 3, "", ["G"], None, [], [(2, number([7]))], [(6, number([6])), (7, number([3]))]),
    ]
    head = HEADER.encode() + b"\0"
    (tmp_path / "a.bcf").write_bytes(gzip.compress(b"BCF\2\2" + struct.pack("<I", len(head)) + head + body[0]) + gzip.compress(body[1] + body[2]))
    (tmp_path / "a.vcf").write_text(HEADER + LINES)
    got, want = read_bcf(spark, [str(tmp_path / "a.bcf")]), read_vcf(spark, str(tmp_path / "a.vcf"))
    assert rows(got.drop("file")) == rows(want.drop("file")) and got.columns == want.columns
    (tmp_path / "cut.bcf").write_bytes((b"BCF\2\2" + struct.pack("<I", len(head)) + head + body[0])[:-3])
    with pytest.raises(Exception, match="ends within"):
        read_bcf(spark, [str(tmp_path / "cut.bcf")]).count()
