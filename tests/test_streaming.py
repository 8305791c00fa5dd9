import gzip
import struct

import pytest
from common import rows
from pyspark.sql import functions as F

from allelake.dataset import Dataset
from allelake.streaming.ingest import running_allele_counts, watch_files, windowed_records

def variants(path, sample, *positions):
    lines = ["##fileformat=VCFv4.2", "##contig=<ID=1>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"]
    path.write_text("\n".join([*lines, *[f"1\t{p}\t.\tA\tC\t.\tPASS\t.\tGT\t0/1" for p in positions]]) + "\n")


def test_files_are_ingested_once(spark, tmp_path):
    uri, drop = str(tmp_path / "ds"), tmp_path / "drop"
    drop.mkdir()
    Dataset(spark, uri, "w").create_dataset()
    for name in ("first", "second"):
        variants(drop / f"{name}.vcf", name, 10, 20)
        watch_files(spark, str(drop), uri, str(tmp_path / "cp")).awaitTermination()
    assert Dataset(spark, uri).samples() == ["first", "second"] and Dataset(spark, uri).count() == 4


def test_later_files_of_a_sample_and_contig(spark, tmp_path):
    uri, drop = str(tmp_path / "ds"), tmp_path / "drop"
    drop.mkdir()
    Dataset(spark, uri, "w").create_dataset()
    for name, positions in (("a", (10, 20)), ("b", (30,)), ("c", (20, 40))):
        variants(drop / f"{name}.vcf", "s", *positions)
        watch_files(spark, str(drop), uri, str(tmp_path / "cp")).awaitTermination()
    variants(drop / "d.vcf", "s", 50)
    watch_files(spark, str(drop), uri, str(tmp_path / "other")).awaitTermination()  # takes d only
    ds = Dataset(spark, uri)
    assert sorted(r[0] for r in ds.query(attrs=["pos_start"]).collect()) == [10, 20, 20, 30, 40, 50]
    assert list(ds.read_allele_count(regions=["1:1-100"])["count"]) == [1, 2, 1, 1, 1] and ds.sample_qc().first()["n_records"] == 6


def test_a_failed_batch_is_tried_again(spark, tmp_path, monkeypatch):
    uri, drop = str(tmp_path / "ds"), tmp_path / "drop"
    drop.mkdir()
    Dataset(spark, uri, "w").create_dataset()
    variants(drop / "a.vcf", "s", 10, 20)
    real = Dataset._write
    for fails in ("variant_stats", "sample_stats"):  # the first time allele counts are written already

        def write(self, df, name, ident, fails=fails):
            if name == fails:
                raise OSError("no space")
            real(self, df, name, ident)

        monkeypatch.setattr(Dataset, "_write", write)
        with pytest.raises(Exception, match="no space"):
            watch_files(spark, str(drop), uri, str(tmp_path / "cp")).awaitTermination()
    monkeypatch.setattr(Dataset, "_write", real)
    watch_files(spark, str(drop), uri, str(tmp_path / "cp")).awaitTermination()
    ds = Dataset(spark, uri)
    assert ds.count() == 2 and ds.sample_qc().first()["n_records"] == 2
    assert list(ds.read_allele_count(regions=["1:1-100"])["count"]) == [1, 1] and set(ds.read_variant_stats(regions=["1:1-100"])["ac"]) == {1}


def test_binary_files_are_watched(spark, tmp_path):
    uri, drop = str(tmp_path / "ds"), tmp_path / "drop"
    drop.mkdir()
    Dataset(spark, uri, "w").create_dataset()
    head = "##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description=\"\">\n##contig=<ID=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n\0".encode()
    shared = struct.pack("<iii", 0, 9, 1) + struct.pack("<I", 0x7F800001) + struct.pack("<II", 2 << 16, 1) + b"\x17.\x17A\x17C\x11\0"
    (drop / "a.bcf").write_bytes(gzip.compress(b"BCF\2\2" + struct.pack("<I", len(head)) + head + struct.pack("<II", len(shared), 0) + shared))
    watch_files(spark, str(drop), uri, str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in Dataset(spark, uri).query(attrs=["sample_name", "pos_start"]).collect()] == [("s", 10)]


def test_running_counts_equal_a_batch(spark, tmp_path):
    recs = spark.createDataFrame([("1", 5, ["A", "C"], None, [0, 1]), ("1", 5, ["A", "C"], None, [0, 1]), ("1", 6, ["A", "C"], None, [0, 0])], "contig string, pos int, alleles array<string>, filters array<string>, gt array<int>").withColumn("ingest_ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    recs.write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(recs.schema).parquet(str(tmp_path / "r"))
    for name, df in (("counts", running_allele_counts(stream)), ("days", windowed_records(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("counts")) == [("1", 5, "A", "C", ".", "0,1", 2)]
    assert rows(spark.table("days"), "contig", "n_records") == [("1", 3)]
