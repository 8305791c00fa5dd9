"""Datasets of small variant files written here, against counts made in plain Python."""

import gzip
import os

import pytest
from common import rows
from pyspark.sql import functions as F

from allelake.cli import main
from allelake.dataset import Dataset, ReadConfig
from allelake.sources.listing import BedFile, read_bed
from allelake.sources.vcf import read_headers, read_vcf

HEAD = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
##FILTER=<ID=weak,Description="Little support">
##INFO=<ID=END,Number=1,Type=Integer,Description="Last position">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known before">
##INFO=<ID=FS,Number=1,Type=Float,Description="Strand bias"> 
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depth of each allele">
##contig=<ID=c1,length=1000>
##contig=<ID=c2,length=500>""".replace("> \n", ">\n")

#: By sample: contig, pos (1-based), id, ref, alt, qual, filter, info, format, call.
CALLS = {
    "ada": [
        ("c1", 10, "rs1", "A", "C", "50.5", "PASS", "DB;FS=1.5", "GT:DP:AD", "0/1:20:9,11"), ("c1", 20, ".", "GTT", "G", "30", "weak", "FS=2", "GT:DP", "1/1:14"),
        ("c1", 31, ".", "T", "<NON_REF>", ".", ".", "END=60", "GT:DP", "0/0:8"), ("c2", 5, ".", "C", "T,G", "12", "PASS", ".", "GT", "1/2"),
    ],
    "bo": [("c1", 10, ".", "A", "C", "40", "PASS", ".", "GT:DP", "1/1:30"), ("c1", 40, ".", "G", "A", "9", "PASS", ".", "GT", "0/1"), ("c2", 5, ".", "C", "T", "12", "PASS", ".", "GT", "./.")],
    "cy": [("c1", 10, ".", "A", "G", "11", "weak;PASS", ".", "GT", "0/1"), ("c1", 90, ".", "C", "CA", "70", "PASS", ".", "GT", "0|1"), ("c2", 7, ".", "T", "A", "5", "PASS", ".", "GT", "0/1/1")],
    "di": [("c1", 10, ".", "A", "C", "33", "PASS", ".", "GT", "0/0"), ("c2", 9, "BAD", "T", "A", "5", "PASS", ".", "GT", "1/4")],
}
ALL = sum(map(len, CALLS.values()))


def text(sample, calls, head=HEAD):
    return "\n".join([head, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}", *("\t".join(map(str, c)) for c in calls)]) + "\n"


def files(folder, samples=CALLS):
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for s in samples:
        path = folder / f"{s}.vcf"
        path.write_text(text(s, CALLS[s]))
        out.append(str(path))
    return out


def made(spark, path, **options):
    w = Dataset(spark, str(path), "w")
    w.create_dataset(**options)
    return w


@pytest.fixture(scope="module")
def four(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("four")
    w = made(spark, base / "ds")
    assert w.ingest_samples(files(base / "in")) == ALL
    return str(base / "ds")


def valid(samples=CALLS):
    """(contig, pos, alleles, genotype) of calls whose genotype names only alleles there are, and at least one."""
    for s in samples:
        for c in CALLS[s]:
            alleles = [c[3], *c[4].split(",")]
            gt = [-1 if g == "." else int(g) for g in c[9].split(":")[0].replace("|", "/").split("/")]
            if max(gt) >= 0 and max(gt) < len(alleles):
                yield c[0], c[1] - 1, alleles, gt


def site_counts(samples=CALLS):
    """{(contig, pos, allele): (ac, an)}"""
    ac, an = {}, {}
    for contig, pos, alleles, gt in valid(samples):
        ac.setdefault((contig, pos, "ref"), 0)
        for g in gt:
            if g >= 0:
                key = (contig, pos, "ref" if g == 0 else f"{alleles[0]},{alleles[g]}")
                ac[key] = ac.get(key, 0) + 1
                an[contig, pos] = an.get((contig, pos), 0) + 1
    return {k: (n, an[k[:2]]) for k, n in ac.items()}


EVERYWHERE = ["c1:1-1000", "c2:1-500"]


def stats_of(ds, **kw):
    df = ds.read_variant_stats(regions=EVERYWHERE, **kw)
    return {(r.contig, r.pos, r.alleles): (r.ac, r.an) for r in df.itertuples()}


def test_variant_stats(spark, four):
    ds, want = Dataset(spark, four), site_counts()
    assert stats_of(ds) == want
    assert stats_of(ds, scan_all_samples=True) == {k: (n, 8) for k, (n, _) in want.items()}
    assert stats_of(ds, drop_ref=True) == {k: v for k, v in want.items() if k[2] != "ref"}
    part = ds.read_variant_stats(regions=["c1:9-10", "c1:10-39", "c2:6-7"])
    assert {(r.contig, r.pos) for r in part.itertuples()} == {k[:2] for k in want if k[:2] in (("c1", 9), ("c1", 19), ("c1", 30), ("c2", 6))}
    assert list(part["af"]) == pytest.approx([a / n for (a, n) in zip(part["ac"], part["an"])])
    assert ds.read_variant_stats_arrow(regions=["c1:1-1000"]).num_rows == sum(k[0] == "c1" for k in want)


def test_many_regions_are_joined(spark, four):
    ds = Dataset(spark, four)
    many = [f"c1:{i}-{i}" for i in range(2, 900, 2)]
    assert list(ds.read_variant_stats(regions=many)["pos"]) == list(ds.read_variant_stats(regions=["c1:10-10", "c1:20-20", "c1:40-40", "c1:90-90"])["pos"])


def test_allele_count(spark, four):
    df = Dataset(spark, four).read_allele_count(regions=EVERYWHERE)
    want = {("c1", 9, "A", "C", "PASS", "0,1"): 1, ("c1", 9, "A", "C", "PASS", "1,1"): 1, ("c1", 9, "A", "G", "weak;PASS", "0,1"): 1, ("c1", 19, "GTT", "G", "weak", "1,1"): 1,
            ("c1", 39, "G", "A", "PASS", "0,1"): 1, ("c1", 89, "C", "CA", "PASS", "0,1"): 1, ("c2", 4, "C", "G,T", "PASS", "1,2"): 1}
    assert {(r.contig, r.pos, r.ref, r.alt, r.filter, r.gt): r.count for r in df.itertuples(index=False)} == {k: pytest.approx(v) for k, v in want.items()} or dict(zip(zip(*(df[c] for c in ("contig", "pos", "ref", "alt", "filter", "gt"))), df["count"])) == want
    assert Dataset(spark, four).read_allele_count(regions=["c3:1-10000"]).empty


def frequencies():
    return {k: a / n for k, (a, n) in site_counts().items()}


@pytest.mark.parametrize("condition", ["<0.2", "<=0.5", ">0.5", ">=0.5", "==0.5", "!=1"])
def test_af_filter(spark, four, condition):
    op = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}[condition.rstrip("0123456789.")]
    x, af, want = float(condition.lstrip("<>=!")), frequencies(), []
    for s, calls in CALLS.items():
        for c in calls:
            alleles = [c[3], *c[4].split(",")]
            gt = [g for g in c[9].split(":")[0].replace("|", "/").split("/")]
            if set(gt) == {"."}:
                want.append((s, c[0], c[1]))
                continue
            called = [int(g) for g in gt if g != "."]
            own = [af.get((c[0], c[1] - 1, "ref" if g == 0 else f"{alleles[0]},{alleles[g]}")) for g in called if g < len(alleles) and alleles[g] != "<NON_REF>"]
            if any(getattr(f, op)(x) for f in own if f is not None):
                want.append((s, c[0], c[1]))
    ds = Dataset(spark, four)
    got = rows(ds.query(attrs=["sample_name", "contig", "pos_start"], set_af_filter=condition), "sample_name", "contig", "pos_start")
    assert got == sorted(want, key=repr)
    inside = [w for w in want if w[1] == "c1" and w[2] <= 40]
    assert rows(ds.query(attrs=["sample_name", "contig", "pos_start"], regions=["c1:1-40"], set_af_filter=condition), "sample_name", "contig", "pos_start") == sorted(inside, key=repr)


def test_frequency_of_a_record_that_starts_before_the_region(spark, four):
    got = Dataset(spark, four).read(attrs=["sample_name", "info_IAF"], regions=["c1:22-22"])  # the deletion at 20
    assert list(got["sample_name"]) == ["ada"] and list(got["info_IAF"][0]) == [0.0, 1.0]


def test_scans_are_bounded(spark, four):
    ds = Dataset(spark, four)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (ds.query_variant_stats(regions=["c1:5-12"]), ds.query_allele_count(regions=["c1:5-12"]), ds.query(regions=["c1:5-12"], set_af_filter="<0.5")):
        for scan in [x for x in plan(df).splitlines() if "FileScan parquet" in x and "pos" in x]:
            assert "PartitionFilters: [" in scan and "contig" in scan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(pos" in scan + "GreaterThanOrEqual(pos" * ("LessThanOrEqual(pos" in scan)
    late = Dataset(spark, four, cfg=ReadConfig(start_timestamp=1, end_timestamp=4_000_000_000_000))
    assert "GreaterThanOrEqual(ingest_ts" in plan(late.query())


def test_parameter_errors(spark, four):
    ds = Dataset(spark, four)
    for fn in (ds.read_variant_stats, ds.read_allele_count):
        with pytest.raises(ValueError, match="is required"):
            fn()
        with pytest.raises(ValueError, match="mutually exclusive"):
            fn("c1:1-100", regions=["c1:1-100"])
        for region, cause in (("", "format"), ("c1", "format"), ("c1:-", "format"), (":1-100", "empty"), ("c1:0-100", "1-based"), ("c1:100-1", "not a valid region")):
            with pytest.raises(ValueError, match=cause):
                fn(regions=[region])
    with pytest.raises(ValueError, match="no attribute"):
        ds.read(attrs=["nope"])
    with pytest.raises(ValueError, match="mode"):
        Dataset(spark, four, "x")
    with pytest.raises(RuntimeError, match="mode"):
        ds.ingest_samples(["a.vcf"])
    with pytest.raises(FileNotFoundError):
        Dataset(spark, four + "-none")


def test_sample_qc(spark, four):
    r = {x["sample"]: x for x in Dataset(spark, four).sample_qc().collect()}
    assert [(r[s]["n_records"], r[s]["n_called"], r[s]["n_not_called"]) for s in CALLS] == [(4, 4, 0), (3, 2, 1), (3, 3, 0), (2, 1, 0)]
    assert (r["ada"]["n_hom_ref"], r["ada"]["n_het"], r["ada"]["n_deletion"], r["ada"]["n_snp"], r["ada"]["dp_mean"]) == (1, 2, 2, 3, 14.0)
    assert r["cy"]["n_insertion"] == 1 and r["di"]["n_hom_ref"] == 1
    assert [x["sample"] for x in Dataset(spark, four).sample_qc(["bo"]).collect()] == ["bo"]


def test_attributes_paging_partitions(spark, four):
    ds = Dataset(spark, four)
    assert ds.samples() == sorted(CALLS) and "fmt_GT" in ds.attributes("fmt") and "info_END" in ds.attributes("info")
    page = ds.read_page(attrs=["sample_name"], rows=5)
    total = len(page)
    while (page := ds.continue_read()) is not None:
        total += len(page)
    assert total == ds.count() == ALL and ds.read_completed()
    parts = [Dataset(spark, four, cfg=ReadConfig(sample_partition=(i, 3))).count() for i in range(3)]
    assert sum(parts) == ALL and parts[0] == len(CALLS["ada"]) + len(CALLS["bo"])
    assert Dataset(spark, four, cfg=ReadConfig(end_timestamp=1)).count() == 0 and Dataset(spark, four, cfg=ReadConfig(start_timestamp=1)).count() == ALL
    assert {r["contig"]: r["n_records"] for r in ds.contig_counts().collect()} == {c: sum(x[0] == c for calls in CALLS.values() for x in calls) for c in ("c1", "c2")}
    assert ds.stat()["n_records"] == ALL and ds.version() and ds.headers(["bo"]).count() == 1 and ds.headers(first=True).first()["sample"] == "ada"


def test_samples_and_regions(spark, four, tmp_path):
    ds = Dataset(spark, four)
    (tmp_path / "names.txt").write_text("bo\n\n cy \n")
    assert ds.count(samples_file=str(tmp_path / "names.txt")) == 6 and ds.count(["bo"]) == 3
    (tmp_path / "bad.txt").write_text("bo\nzed\n")
    with pytest.raises(ValueError, match="zed"):
        ds.count(samples_file=str(tmp_path / "bad.txt"))
    assert ds.count(samples_file=str(tmp_path / "bad.txt"), skip_check_samples=True) == 3
    bed = "track name=x\n# c\nc1\t0\t15\nc1\t8\nc1\t9\t45\tname\n\nc2 4 5\n"
    (tmp_path / "r.bed").write_text(bed)
    for suffix in (".gz", ".bgz", ".bgzf"):
        (tmp_path / f"r.bed{suffix}").write_bytes(gzip.compress(bed.encode()))
    for suffix in ("", ".gz", ".bgz", ".bgzf"):
        assert rows(read_bed(spark, str(tmp_path / f"r.bed{suffix}"))) == [("c1", 0, 14, 0), ("c1", 9, 44, 2), ("c2", 4, 4, 3)]
        got = ds.query(attrs=["sample_name", "pos_start", "query_bed_line"], bed_file=str(tmp_path / f"r.bed{suffix}"))
        assert got.count() == 4 + 7 + 2 and got.where("query_bed_line = 3").count() == 2
    table = spark.createDataFrame([("c2", 4, 9)], "contig string, start int, end int")
    assert ds.count(bed_table=table) == 4
    b = BedFile(spark, str(tmp_path / "r.bed"))
    assert b.contig_count() == 2 and b.region_count("c1") == 2 and b.region("c1", 1) == ("c1", 9, 45)
    with pytest.raises(ValueError):
        BedFile(spark, "x.txt")
    line = lambda cfg, regions: dict(rows(Dataset(spark, four, cfg=cfg).query(attrs=["contig", "query_bed_line"], regions=regions).distinct(), "contig", "query_bed_line"))
    assert line(ReadConfig(), ["c2:1-10", "c1:1-30"]) == {"c1": 0, "c2": 1} and line(ReadConfig(sort_regions=False), ["c2:1-10", "c1:1-30"]) == {"c2": 0, "c1": 1}
    parts = [Dataset(spark, four, cfg=ReadConfig(region_partition=(i, 2))).count(regions=EVERYWHERE) for i in range(2)]
    assert sum(parts) == ALL and parts[1] == 4


def test_limit_holds_everywhere(spark, four, tmp_path, capsys):
    ds = Dataset(spark, four, cfg=ReadConfig(limit=2))
    assert len(ds.read()) == ds.count() == 2
    ds.export(output_format="t", tsv_fields=["POS"], output_path=str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 2
    ds.export(output_dir=str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).where(~F.col("value").startswith("#")).count() == 2
    ds.export(merge=True, output_path=str(tmp_path / "m"))
    assert 1 <= spark.read.text(str(tmp_path / "m")).where(~F.col("value").startswith("#")).count() <= 2
    main(["export", "-u", four, "-c", "-n", "3"], spark)
    assert capsys.readouterr().out.split() == ["3"]


def test_af_filter_on_exports(spark, four, tmp_path):
    for condition in ("<0.0001", "<0.3"):
        path = str(tmp_path / condition[1:])
        main(["export", "-u", four, "-O", "t", "-t", "CHR,POS", "-o", path, "--af-filter", condition], spark)
        want = rows(Dataset(spark, four).query(attrs=["sample_name", "contig", "pos_start"], set_af_filter=condition), "sample_name", "contig", "pos_start")
        got = spark.read.option("header", True).option("sep", "\t").csv(path) if want else None
        assert (rows(got.select("SAMPLE", "CHR", F.col("POS").cast("int"))) if want else []) == want


def test_delete_and_again(spark, tmp_path):
    w = made(spark, tmp_path / "d", variant_stats_version=3)
    paths = files(tmp_path / "in")
    w.ingest_samples(paths)
    full = stats_of(Dataset(spark, w.uri))
    w.delete_samples(["ada", "bo"])
    r = Dataset(spark, w.uri)
    assert r.samples() == ["cy", "di"] and r.count() == 5 == r.stat()["n_records"]
    two = made(spark, tmp_path / "two", variant_stats_version=3)
    two.ingest_samples(paths[2:])
    assert stats_of(r) == stats_of(Dataset(spark, two.uri)) != full
    with pytest.raises(ValueError, match="not in the dataset"):
        w.delete_samples(["ada"])
    w.compact()
    assert w.vacuum() > 0 and Dataset(spark, w.uri).count() == 5 and stats_of(Dataset(spark, w.uri)) == stats_of(r)
    assert w.ingest_samples(paths[:2]) == 7 and stats_of(Dataset(spark, w.uri)) == full and Dataset(spark, w.uri).samples() == sorted(CALLS)
    w.delete_samples(["di"], skip_aggregate_stats=True)
    assert stats_of(Dataset(spark, w.uri)) == full and w.kept_aggregates() == ["di"] and Dataset(spark, w.uri).sample_count() == 3
    w.delete_samples(["ada", "bo", "cy"])
    w.compact()
    assert Dataset(spark, w.uri).count() == 0 and w.kept_aggregates() == ["di"]


def test_later_files_of_a_sample(spark, tmp_path):
    w = made(spark, tmp_path / "ds")
    (tmp_path / "in").mkdir()
    for i, part in enumerate((CALLS["ada"][:2], CALLS["ada"][2:])):
        (tmp_path / "in" / f"{i}.vcf").write_text(text("ada", part))
        assert w.ingest_samples([str(tmp_path / "in" / f"{i}.vcf")]) == 2
    assert Dataset(spark, w.uri).count() == 4 and stats_of(Dataset(spark, w.uri)) == site_counts(["ada"])


def test_a_failed_ingest_leaves_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    w, paths = made(spark, tmp_path / "ds"), files(tmp_path / "in")
    real = Dataset._write
    for fails in ("variant_stats", "sample_stats", "records"):

        def write(self, df, name, ident, fails=fails):
            if name == fails:
                raise OSError("no space")
            real(self, df, name, ident)

        monkeypatch.setattr(Dataset, "_write", write)
        with pytest.raises(OSError):
            w.ingest_samples(paths, batch="one")
        assert Dataset(spark, w.uri).count() == 0 and stats_of(Dataset(spark, w.uri)) == {} and Dataset(spark, w.uri).samples() == []
    monkeypatch.setattr(Dataset, "_write", real)
    assert w.ingest_samples(paths, batch="one") == ALL and w.ingest_samples(paths, batch="one") == 0
    assert stats_of(Dataset(spark, w.uri)) == site_counts() and w.vacuum() >= 5 and Dataset(spark, w.uri).count() == ALL
    w.compact()
    assert w.ingest_samples(paths, batch="one") == 0


def test_resume_batches_duplicates_and_contig_modes(spark, tmp_path):
    w, paths = made(spark, tmp_path / "r", allow_duplicates=False), files(tmp_path / "in")
    assert w.ingest_samples(paths, sample_batch_size=3) == ALL and len(w._batches()) == 2
    assert w.ingest_samples(paths, resume=True) == 0
    (tmp_path / "in" / "twice.vcf").write_text(text("e", [CALLS["bo"][0], CALLS["bo"][0]]))
    with pytest.raises(ValueError, match="start at"):
        w.ingest_samples([str(tmp_path / "in" / "twice.vcf")])
    x = made(spark, tmp_path / "x")
    (tmp_path / "list.txt").write_text("\n".join(paths) + "\n")
    n = [x.ingest_samples(str(tmp_path / "list.txt"), contig_mode=m, contigs_to_keep_separate=["c2"]) for m in ("separate", "merged")]
    assert n == [4, ALL - 4] and Dataset(spark, x.uri).count() == ALL and stats_of(Dataset(spark, x.uri)) == site_counts()


def test_bad_column_lines(spark, tmp_path):
    (tmp_path / "two.vcf").write_text(text("a\tb", []))
    (tmp_path / "comma.vcf").write_text(text("a,b", []))
    for name, cause in (("two", "more than one sample"), ("comma", "no valid sample name")):
        with pytest.raises(Exception, match=cause):
            read_headers(spark, str(tmp_path / f"{name}.vcf")).collect()
    (tmp_path / "sites.vcf").write_text(HEAD + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc1\t1\t.\tA\tC\t.\t.\tDB;DB;FS=1;FS=2\n")
    assert rows(read_vcf(spark, str(tmp_path / "sites.vcf")).select("sample", "pos", F.element_at("info", "FS"), "gt")) == [("", 0, "2", None)]
    (tmp_path / "none.vcf").write_text("")
    assert read_vcf(spark, str(tmp_path / "none.vcf")).count() == 0


def test_exports(spark, four, tmp_path):
    ds = Dataset(spark, four)
    ds.export(output_dir=str(tmp_path / "vcf"))
    for s in CALLS:
        folder = str(tmp_path / "vcf" / f"sample={s}")
        whole = tmp_path / f"{s}.vcf"
        whole.write_text("".join(open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.startswith("part")))
        (tmp_path / "want.vcf").write_text(text(s, CALLS[s]))
        same = ("sample", "contig", "pos", "end_pos", "id", "alleles", "qual", "filters", "gt", "info", "fmt")
        assert rows(read_vcf(spark, str(whole)), *same) == rows(read_vcf(spark, str(tmp_path / "want.vcf")), *same)
    ds.export(output_format="z", output_dir=str(tmp_path / "z"), samples=["bo"])
    assert rows(spark.read.text(str(tmp_path / "z" / "sample=bo")).where(~F.col("value").startswith("#"))).__len__() == 3
    ds.export(output_format="t", tsv_fields=["CHR", "POS", "REF", "ALT", "I:FS", "F:DP", "Q:POS"], output_path=str(tmp_path / "tsv"), regions=["c1:1-100"])
    tsv = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert tsv.columns == ["SAMPLE", "CHR", "POS", "REF", "ALT", "I:FS", "F:DP", "Q:POS"] and tsv.count() == ds.count(regions=["c1:1-100"])
    assert rows(tsv.where("I:FS <> '.'".replace("I:FS", "`I:FS`")).select("POS", "`I:FS`", "`F:DP`")) == [("10", "1.5", "20"), ("20", "2", "14")]
    ds.export(merge=True, output_path=str(tmp_path / "merged"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "merged")).collect()]
    head = next(x for x in lines if x.startswith("#CHROM")).split("\t")
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert head[9:] == sorted(CALLS) and all(len(x) == 13 for x in body)
    site = next(x for x in body if x[:2] == ["c1", "10"])
    assert site[3] == "A" and site[4] == "C,G" and [c.split(":")[0] for c in site[9:]] == ["0/1", "1/1", "0/2", "0/0"]


def test_fields_of_all_headers_count(spark, tmp_path):
    w = made(spark, tmp_path / "h")
    (tmp_path / "a.vcf").write_text(text("a", [("c1", 5, ".", "A", "C", ".", ".", ".", "GT", "0/1")]))
    more = HEAD + '\n##INFO=<ID=XX,Number=1,Type=Integer,Description="Only here">\n##contig=<ID=c9>'
    (tmp_path / "b.vcf").write_text(text("b", [("c9", 5, ".", "A", "C", ".", ".", "XX=7", "GT", "0/1")], more))
    w.ingest_samples([str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")])
    ds = Dataset(spark, w.uri)
    assert "info_XX" in ds.attributes("info") and sorted(ds.read(attrs=["sample_name", "info_XX"]).dropna()["info_XX"].map(list)) == [[7]]
    assert ds.header().count("ID=XX") == 1 and ds.header().count("ID=c9") == 1 and ds.header().count("##FORMAT=<ID=GT") == 1


def test_command_line(spark, tmp_path, capsys):
    uri = str(tmp_path / "c")
    paths = files(tmp_path / "in", ["bo", "cy"])
    main(["create", "-u", uri], spark)
    main(["store", "-u", uri, *paths], spark)
    main(["list", "-u", uri], spark)
    main(["export", "-u", uri, "-c", "-r", "c1:1-50"], spark)
    main(["delete", "-u", uri, "-s", "cy"], spark)
    main(["utils", "consolidate", "-u", uri], spark)
    main(["utils", "vacuum", "-u", uri], spark)
    main(["export", "-u", uri, "-c"], spark)
    main(["version"], spark)
    out = capsys.readouterr().out.split()
    assert out[:4] == ["6", "bo", "cy", "3"] and out[-2:] == ["3", Dataset.version()]


def test_end_as_text_flags_and_types(spark, tmp_path):
    (path,) = files(tmp_path / "in", ["ada"])
    w = made(spark, tmp_path / "t", vcf_attrs=path)
    w.ingest_samples([path])
    df = Dataset(spark, w.uri).query(attrs=["pos_start", "pos_end", "info_DB", "info_FS", "fmt_DP", "fmt_AD", "fmt_GT"]).orderBy("pos_start").toPandas()
    assert list(df["pos_start"]) == [5, 10, 20, 31] and list(df["pos_end"]) == [5, 10, 22, 60] and list(df["info_DB"]) == [0, 1, 0, 0]
    assert list(df["fmt_AD"][1]) == [9, 11] and list(df["fmt_DP"][1:]) == [20, 14, 8] and list(df["info_FS"][1]) == [1.5] and list(df["fmt_GT"][0]) == [1, 2]
