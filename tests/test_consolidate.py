import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from common import rows

from allelake.operators.consolidate import consolidate, consolidated, listed_files
from allelake.operators.redelivery import contained_files, once, redelivered
from allelake.sources import footer


def small_files(tmp_path, n=40):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(n):
        t = pa.table({"id": pa.array(range(i * 10, i * 10 + i % 7), pa.int64()), "s": pa.array(["é" * (i % 3)] * (i % 7), pa.string()), "l": pa.array([[1, None], None, []] * 3, pa.list_(pa.int32())).slice(0, i % 7)})
        pq.write_table(t, d / f"f{i:03}.parquet", row_group_size=3, compression=["snappy", "zstd", "none"][i % 3], write_page_index=i % 2 == 0)
    return d


def test_footer_round_trip(tmp_path):
    for f in sorted(small_files(tmp_path).glob("*"))[:6]:
        with f.open("rb") as s:
            tree = footer.read_footer(s, f.stat().st_size)
        out = footer.footer_bytes(tree)
        assert footer.Reader(out[:-8]).struct() == tree


def test_blocks_are_copied_whole(spark, tmp_path):
    d = small_files(tmp_path)
    out = str(tmp_path / "out")
    report = consolidate(listed_files(spark, str(d)), out, target=1 << 20).collect()
    files = glob.glob(out + "/*.parquet")
    assert len(files) == len(report) == 1
    assert report[0]["rows"] == report[0]["input_rows"] and report[0]["inputs"] == 40
    assert rows(spark.read.parquet(out)) == rows(spark.read.parquet(str(d)))
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.num_row_groups == report[0]["input_blocks"]
    assert sorted(map(str, pq.read_table(files[0]).to_pylist())) == sorted(map(str, pq.read_table(d).to_pylist()))


def test_several_bins_hold_every_row_once(spark, tmp_path):
    d = small_files(tmp_path)
    got = consolidated(spark, str(d), target=8_000)
    assert len(got.inputFiles()) > 1
    assert rows(got) == rows(spark.read.parquet(str(d)))


def test_different_schemas_stay_apart_and_bad_files_raise(spark, tmp_path):
    d = small_files(tmp_path)
    pq.write_table(pa.table({"id": ["x"]}), d / "other.parquet")
    assert consolidate(listed_files(spark, str(d)), str(tmp_path / "o"), 1 << 20).count() == 2
    (d / "bad.parquet").write_bytes(b"PAR1 this is no parquet file")
    with pytest.raises(Exception, match="bad.parquet"):
        consolidate(listed_files(spark, str(d)), str(tmp_path / "o2"), 1 << 20)


RECORD = ("c", "p", "a")


def deliveries(spark):
    rec = {1: "ABC", 2: "AB", 3: "ABC", 4: "AX", 5: "", 6: "Q", 7: "Q", 8: "BCA", 9: "XAZ"}
    data = [(i * 100 + j, f, r, None if r == "X" else ord(r), [r, "y"]) for i, (f, rs) in enumerate(rec.items()) for j, r in enumerate(rs + rs[:1])]
    return rec, spark.createDataFrame(data, "row_id long, f long, c string, p int, a array<string>")


def test_contained_files_against_brute_force(spark):
    rec, df = deliveries(spark)
    want = [(a, b) for a in rec for b in rec if a != b and rec[a] and set(rec[a]) <= set(rec[b])]
    assert rows(contained_files(df, "f", RECORD), "inner", "outer") == sorted(want, key=repr)
    assert contained_files(df.limit(0), "f", RECORD).count() == 0


def test_redelivered_names_and_records(spark):
    rec, df = deliveries(spark)
    names = {1: "u", 5: "u", 2: "v", 3: None, 4: None, 6: "w", 7: "x", 9: "z"}
    listing = spark.createDataFrame(list(names.items()), "f long, uri string")
    want = {(a, b) for a in names for b in names if a < b and ((names[a] and names[a] == names[b]) or (rec[a] and set(rec[a]) <= set(rec[b])) or (rec[b] and set(rec[b]) <= set(rec[a])))}
    assert rows(redelivered(listing, df, "f", "uri", RECORD)) == sorted(want, key=repr)


def test_once(spark):
    _, df = deliveries(spark)
    got = once(df, RECORD, "row_id").collect()
    assert len({(r["c"], r["p"], *r["a"]) for r in got}) == len(got) == df.select(*RECORD).distinct().count()


def test_nulls_within_arrays_make_other_records(spark):
    data = [(1, 1, "c", 1, ["a", None]), (2, 2, "c", 1, [None, "a"]), (3, 3, "c", 1, ["a"]), (4, 4, "c", 1, None), (5, 5, None, 1, ["a"]), (6, 6, "", 1, ["a"]), (7, 7, "c", 1, ["a", None])]
    df = spark.createDataFrame(data, "row_id long, f long, c string, p int, a array<string>")
    assert rows(once(df, RECORD, "row_id"), "row_id") == [(i,) for i in range(1, 7)]
    assert rows(contained_files(df, "f", RECORD), "inner", "outer") == [(1, 7), (7, 1)]


def test_partition_folders_are_kept(spark, tmp_path):
    base = tmp_path / "batch=3" / "table"  # a folder above the table is no partition of it
    df = spark.range(300).selectExpr("id", "id % 4 as k", "concat('a b/', id % 3) as name", "cast(null as string) as empty")
    df.repartition(5).write.partitionBy("k", "name").parquet(str(base))
    got = consolidated(spark, str(base), target=1 << 20)
    assert len(got.inputFiles()) == 12 and rows(got, "id", "k", "name", "empty") == rows(df.selectExpr("id", "cast(k as int) k", "name", "empty"))


def test_outputs_are_sized_within_a_schema(spark, tmp_path):
    d = small_files(tmp_path, 60)
    for i in range(30):
        pq.write_table(pa.table({"id": list(range(20)), "other": [str(i)] * 20}), d / f"a{i:02}.parquet")
    total = sum(f.stat().st_size for f in d.glob("*"))
    report = consolidate(listed_files(spark, str(d)), str(tmp_path / "o"), target=total // 8).collect()
    assert len(report) <= 8 + 2 and all(r["bytes"] <= 1.3 * total / 8 for r in report) and sum(r["inputs"] for r in report) == 90


def test_once_with_null_and_equal_order(spark):
    df = spark.createDataFrame([(None, "a", 1), (5, "a", 2), (None, "b", 3), (None, "b", 4), (7, "c", 5), (7, "c", 5), (None, "d", 6), (8, None, 7), (9, None, 8)], "o int, c string, x int")
    got = rows(once(df, ["c"], "o"))
    assert [r for r in got if r[1] != "b"] == sorted([(5, "a", 2), (7, "c", 5), (None, "d", 6), (8, None, 7)], key=repr) and len(got) == 5
    assert once(df.limit(0), ["c"], "o").count() == 0
