"""Merging single-sample records at a position into one record per cohort."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations_with_replacement
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelake.session import ship
from allelake.sources.vcf import Field

SCHEMA = (
    "contig string, pos int, nth int, id string, alleles array<string>, qual float, filters array<string>, "
    "info map<string,string>, format array<string>, calls map<string,string>"
)


def trim_shared(alleles: Sequence[str]) -> list[str]:
    """Alleles without the last bases that all of them share; each keeps one base at least."""
    shared = 0
    least = min(map(len, alleles))
    while shared + 1 < least and len({a[-1 - shared] for a in alleles}) == 1:
        shared += 1
    return [a[: len(a) - shared] for a in alleles] if shared and len(alleles[0]) > 1 else list(alleles)


def merge_alleles(records: Sequence[Sequence[str]]) -> tuple[list[str], list[list[int]]]:
    """The cohort's alleles (the longest reference first) and, per record, the cohort number of each of its alleles.

    Alternates of records with a shorter reference get the rest of the longest
    one appended; symbolic alleles stay as they are.
    """
    own = [trim_shared(a) for a in records]
    ref = max((a[0] for a in own), key=len)
    known: dict[str, int] = {}
    maps = []
    for alleles in own:
        rest = ref[len(alleles[0]) :]
        maps.append([0] + [known.setdefault(a if a.startswith("<") else a + rest, len(known) + 1) for a in alleles[1:]])
    return [ref, *known], maps


def spread(values: Sequence[str], number: str, to: Sequence[int], total: int) -> list[str]:
    """Values per allele (``R``), alternate (``A``) or genotype (``G``, of any ploidy) at their cohort places, ``.`` elsewhere. A number of values that no ploidy has gives a lone ``.``."""
    if number == "R":
        out = ["."] * total
        for v, t in zip(values, to):
            out[t] = v
    elif number == "A":
        out = ["."] * (total - 1)
        for v, t in zip(values, to[1:]):
            out[t - 1] = v
    else:
        # Ploidy follows from the number of values; 2 where several fit (a single allele).
        ploidy = next((n for n in (2, 1, *range(3, 17)) if comb(len(to) + n - 1, n) == len(values)), None)
        if ploidy is None:
            return ["."]
        out = ["."] * comb(total + ploidy - 1, ploidy)
        for own in combinations_with_replacement(range(len(to)), ploidy):
            out[genotype_place(sorted(to[a] for a in own))] = values[genotype_place(own)]
    return out


def genotype_place(alleles: Sequence[int]) -> int:
    """Place of a genotype (allele numbers in ascending order, any ploidy) in lists with one value per genotype."""
    return sum(comb(a + i, i + 1) for i, a in enumerate(alleles))


def _whole(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def merge_records(records: Sequence[Mapping], numbers: Mapping[tuple[str, str], str]) -> dict:
    """One cohort record from records of different samples at a position. ``numbers``: the declared Number by (blob, field)."""
    alleles, maps = merge_alleles([r["alleles"] for r in records])
    total = len(alleles)
    ids = list(dict.fromkeys(x for r in records for x in (r["id"] or ".").split(";") if x not in (".", "")))
    filters = list(dict.fromkeys(x for r in records for x in r["filters"] or ()))
    if len(filters) > 1:
        filters = [f for f in filters if f != "PASS"]
    quals = [r["qual"] for r in records if r["qual"] is not None]
    info: dict[str, str] = {}
    counts, called = [0] * total, 0
    for r, to in zip(records, maps):
        for key, value in (r["info"] or {}).items():
            number = numbers.get(("info", key), ".")
            if key in ("AC", "AN"):
                continue
            if key in ("END", "DP"):  # of those that are numbers the greatest, or the sum
                old, new = _whole(info.get(key)), _whole(value)
                if new is not None:
                    info[key] = str(new if old is None else max(old, new) if key == "END" else old + new)
                else:
                    info.setdefault(key, value)
            elif number in ("A", "R", "G"):
                new = spread(value.split(","), number, to, total)
                old = info[key].split(",") if key in info else ["."] * len(new)
                info[key] = ",".join(n if n != "." else o for n, o in zip(new, old))  # the last that has a value
            else:
                info.setdefault(key, value)
        for g in r["gt"] or ():
            if 0 <= g < len(to):
                counts[to[g]] += 1
                called += 1
    if "END" in info and info["END"].isdigit():
        info["END"] = str(max(int(info["END"]), records[0]["pos"] + len(alleles[0])))
    if total > 1:
        info["AC"] = ",".join(map(str, counts[1:]))
    info["AN"] = str(called)
    keys = list(dict.fromkeys(k for r in records for k in r["fmt"] or {}))
    if "GT" in keys:
        keys = ["GT", *(k for k in keys if k != "GT")]
    calls = {}
    for r, to in zip(records, maps):
        values = []
        for k in keys:
            value = (r["fmt"] or {}).get(k)
            number = numbers.get(("fmt", k), ".")
            if value is None:
                values.append("./." if k == "GT" else ".")
            elif k == "GT":
                values.append("".join(str(to[int(x)]) if x.isdigit() and int(x) < len(to) else x for x in _gt_parts(value)))
            elif number in ("A", "R", "G") and value != ".":
                values.append(",".join(spread(value.split(","), number, to, total)))
            else:
                values.append(value)
        calls[r["sample"]] = ":".join(values)
    return {"id": ";".join(ids) or ".", "alleles": alleles, "qual": max(quals, default=None), "filters": filters or None, "info": info, "format": keys, "calls": calls}


def _gt_parts(text: str) -> Iterator[str]:
    part = ""
    for c in text:
        if c in "/|":
            yield part
            yield c
            part = ""
        else:
            part += c
    yield part


def merge_cohort(records: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """One row per position and ordinal: the k-th records of all samples at a position become one.

    ``calls`` maps each sample that has a record to its FORMAT values, in the order
    of ``format``. A group holds at most one record per sample. Repeated records
    of a sample get further ordinals; records without alleles are left out.
    """
    ship(records.sparkSession)
    numbers = {(f.blob, f.name): f.number for f in fields}
    w = Window.partitionBy("contig", "pos", "sample").orderBy("end_pos", "alleles", "id")
    ordered = records.where(F.size("alleles") > 0).withColumn("nth", F.row_number().over(w).cast("int"))
    one = F.struct("sample", "pos", "alleles", "id", "qual", "filters", "gt", "info", "fmt")
    sites = ordered.groupBy("contig", "pos", "nth").agg(F.array_sort(F.collect_list(F.struct("sample", one.alias("r"))), lambda a, b: F.when(a["sample"] < b["sample"], -1).when(a["sample"] > b["sample"], 1).otherwise(0)).alias("rs"))
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for contig, pos, nth, rs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = [x["r"] | {"info": dict(x["r"]["info"] or ()), "fmt": dict(x["r"]["fmt"] or ())} for x in rs]
                merged = merge_records(own, numbers)
                rows.append({"contig": contig, "pos": pos, "nth": nth} | merged | {"info": list(merged["info"].items()), "calls": list(merged["calls"].items())})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sites.mapInArrow(merge, kind)
