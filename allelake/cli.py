"""Command line: create, store, export, list, stat, delete, compact, vacuum, utils, version."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="allelake", description="Variant datasets on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    pair = lambda s: tuple(int(x) for x in s.split(":", 1))

    c = sub.add_parser("create", help="create a dataset")
    c.add_argument("-u", "--uri", required=True)
    c.add_argument("-a", "--attributes", default="", help="INFO and FORMAT fields kept as columns, by commas")
    c.add_argument("-v", "--vcf-attributes", default=None, help="take them from this file's header")
    c.add_argument("-n", "--no-duplicates", action="store_true")
    c.add_argument("--variant-stats-version", type=int, default=2)
    for name in ("allele-count", "variant-stats", "sample-stats"):
        c.add_argument(f"--disable-{name}", action="store_true")

    s = sub.add_parser("store", help="ingest files")
    s.add_argument("-u", "--uri", required=True)
    s.add_argument("-f", "--samples-file")
    s.add_argument("--resume", action="store_true")
    s.add_argument("--contig-mode", default="all", choices=("all", "separate", "merged"))
    s.add_argument("--contigs-to-keep-separate", default="")
    s.add_argument("-s", "--sample-batch-size", type=int)
    s.add_argument("paths", nargs="*")

    e = sub.add_parser("export", help="export records")
    e.add_argument("-u", "--uri", required=True)
    e.add_argument("-O", "--output-format", default="v", choices=("v", "z", "t"))
    e.add_argument("-o", "--output-path", default="")
    e.add_argument("-d", "--output-dir", default=".")
    e.add_argument("-m", "--merge", action="store_true")
    e.add_argument("-t", "--tsv-fields", default="CHR,POS,REF,ALT")
    e.add_argument("-r", "--regions", default="")
    e.add_argument("-R", "--regions-file")
    e.add_argument("-s", "--sample-names", default="")
    e.add_argument("-f", "--samples-file")
    e.add_argument("-n", "--limit", type=int)
    e.add_argument("-c", "--count-only", action="store_true")
    e.add_argument("--af-filter", default="")
    e.add_argument("--sample-partition", type=pair)
    e.add_argument("--region-partition", type=pair)
    e.add_argument("--disable-check-samples", action="store_true")

    for name, text in (("list", "sample names"), ("stat", "figures of a dataset"), ("compact", "fold batches into one, without deleted samples"), ("vacuum", "remove folders nothing refers to")):
        sub.add_parser(name, help=text).add_argument("-u", "--uri", required=True)
    u = sub.add_parser("utils", help="consolidate or vacuum")
    u.add_argument("action", choices=("consolidate", "vacuum"))
    u.add_argument("-u", "--uri", required=True)
    d = sub.add_parser("delete", help="delete samples")
    d.add_argument("-u", "--uri", required=True)
    d.add_argument("-s", "--sample-names", required=True)
    d.add_argument("--skip-aggregate-stats", action="store_true")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run one command. ``spark``: the session to use; one is made if none is given."""
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from allelake.dataset import VERSION, Dataset, ReadConfig

    if a.command == "version":
        print(VERSION)
        return 0

    spark = spark or SparkSession.builder.appName("allelake").getOrCreate()
    words = lambda s: [x for x in s.split(",") if x]
    if a.command == "create":
        Dataset(spark, a.uri, "w").create_dataset(
            words(a.attributes), a.vcf_attributes, not a.no_duplicates, not a.disable_allele_count, not a.disable_variant_stats, not a.disable_sample_stats, a.variant_stats_version
        )
    elif a.command == "store":
        n = Dataset(spark, a.uri, "w").ingest_samples(a.samples_file or a.paths, a.resume, a.contig_mode, words(a.contigs_to_keep_separate), sample_batch_size=a.sample_batch_size)
        print(n)
    elif a.command == "export":
        if a.af_filter and a.count_only:
            raise SystemExit("--af-filter and --count-only exclude each other")
        ds = Dataset(spark, a.uri, cfg=ReadConfig(limit=a.limit, sample_partition=a.sample_partition, region_partition=a.region_partition))
        names = words(a.sample_names) or None
        if a.count_only:
            print(ds.count(names, words(a.regions) or None, samples_file=a.samples_file, bed_file=a.regions_file))
        else:
            ds.export(names, words(a.regions) or None, a.samples_file, a.regions_file, a.merge, a.output_format, a.output_path, a.output_dir, words(a.tsv_fields), a.disable_check_samples, a.af_filter)
    elif a.command == "list":
        print("\n".join(Dataset(spark, a.uri).samples()))
    elif a.command == "stat":
        print(json.dumps(Dataset(spark, a.uri).stat(), indent=1))
    elif a.command == "delete":
        Dataset(spark, a.uri, "w").delete_samples(words(a.sample_names), a.skip_aggregate_stats)
    elif a.command == "compact" or a.command == "utils" and a.action == "consolidate":
        Dataset(spark, a.uri, "w").compact()
    elif a.command in ("vacuum", "utils"):
        print(Dataset(spark, a.uri, "w").vacuum())
    return 0


if __name__ == "__main__":
    sys.exit(main())
