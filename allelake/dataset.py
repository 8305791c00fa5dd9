"""A dataset of variant records: create, ingest, read, export, delete.

A dataset is a folder of Parquet tables: ``records``, ``allele_count`` and
``variant_stats`` (by contig, sorted by position), ``sample_stats``, ``headers``, and
``meta.json``. Every change (an ingest, a deletion, a compaction) is a batch: it
writes a folder ``batch=<id>`` of its own in each table it touches and is committed
last, by one rename of its folder into ``batches``, the log. Readers take the folders
of committed batches only, so a failure leaves nothing behind that anyone sees, a
retry counts nothing twice, and no reader meets half a change. The log has a row per
sample and contig of a batch, which answers counts, resumed ingests and retries
without reading records.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators import frequency, select, stats
from allelake.operators.cohort import merge_cohort
from allelake.operators.overlap import few_bounds, overlap_join
from allelake.regions import Region, coalesce, region_table
from allelake.session import ship, written
from allelake.sinks import text as sinks
from allelake.sources import listing
from allelake.sources.bcf import bcf_headers, read_bcf
from allelake.sources.vcf import Field, header_fields, merged_header, read_headers, read_vcf

log = logging.getLogger("allelake")

VERSION = "0.2.0"

#: Names of attributes, tables and columns, which callers use.
DEFAULT_ATTRS = ("sample_name", "contig", "pos_start", "alleles", "fmt_GT")
BUILTIN = ("sample_name", "contig", "pos_start", "pos_end", "alleles", "id", "filters", "qual", "fmt", "info", "query_bed_start", "query_bed_end", "query_bed_line")

RECORDS = (
    "sample string, pos int, end_pos int, id string, alleles array<string>, qual float, filters array<string>, "
    "gt array<int>, info map<string,string>, fmt map<string,string>, ingest_ts timestamp"
)
#: Columns of the tables in their files; those by contig have it as a folder.
TABLES = {
    "records": RECORDS,
    "allele_count": "pos int, ref string, alt string, filter string, gt string, count int, sample string",
    "variant_stats": "pos int, end_pos int, sample string, allele string, ac int, an int, n_hom int",
    "sample_stats": "sample string, " + ", ".join(f"{c} long" for c in stats.COUNTERS) + ", ingest_ts timestamp",
    "headers": "sample string, header string, ingest_ts timestamp",
}
BY_CONTIG = ("records", "allele_count", "variant_stats")

#: The log: a row per sample and contig of an ingest (``contig`` null: a sample with a header only; ``sample`` null: the batch's name alone), and per deleted sample.
LOG = "kind string, name string, at timestamp, sample string, contig string, n_records long, max_length int, kept_aggregates boolean"

#: Regions of at most this many become predicates of the scan one by one; more are bounded by contig and joined.
FEW_REGIONS = 100


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(", ")]


@dataclass
class ReadConfig:
    """Options of a read. Memory and buffer sizes have no meaning here and are accepted for old callers."""

    limit: int | None = None
    region_partition: tuple[int, int] | None = None
    sample_partition: tuple[int, int] | None = None
    sort_regions: bool = True
    memory_budget_mb: int | None = None
    buffer_percentage: int | None = None
    tile_cache_percentage: int | None = None
    start_timestamp: int | None = None
    end_timestamp: int | None = None


def config_logging(level: str = "fatal", log_file: str = "") -> None:
    """Level (fatal, error, warn, info, debug, trace) and file of this library's log."""
    names = {"fatal": logging.CRITICAL, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}
    if level not in names:
        raise ValueError(f"no log level {level!r}")
    log.setLevel(names[level])
    if log_file:
        log.addHandler(logging.FileHandler(log_file))


class Dataset:
    """A dataset open for reading (``mode="r"``) or writing (``mode="w"``)."""

    def __init__(self, spark: SparkSession, uri: str, mode: str = "r", cfg: ReadConfig | None = None) -> None:
        if mode not in ("r", "w"):
            raise ValueError(f"Unsupported dataset mode {mode}")
        ship(spark)
        self.spark, self.uri, self.mode, self.cfg = spark, uri.rstrip("/"), mode, cfg or ReadConfig()
        self._pages: Iterator | None = None
        self._known: list[Field] | None = None
        if mode == "r" and not self._exists():
            raise FileNotFoundError(f"no dataset at {uri}")

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """End this handle; further calls raise."""
        self.mode, self._pages = "closed", None

    # -- storage

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self) -> bool:
        p, fs = self._path("meta.json")
        return fs.exists(p)

    @property
    def meta(self) -> dict:
        return json.loads(self._text(f"{self.uri}/meta.json"))

    def _schema(self, name: str) -> str:
        own = [f"{a} string" for a in self._own_columns()] if name == "records" else []
        return ", ".join([TABLES[name], *own])

    def _own_columns(self) -> list[str]:
        """INFO and FORMAT fields kept as columns besides the maps, so a read of one doesn't read all; the genotype always is."""
        return [a for a in self.meta["extra_attrs"] if a != "fmt_GT"]

    def _batches(self) -> list[str]:
        """Ids of the committed batches that no compaction replaced, oldest first. Ids begin with what a batch is (b, d, c) and its time in milliseconds."""
        p, fs = self._path("batches")
        ids = {s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")}
        for c in [i for i in ids if i.startswith("c")]:
            at, _ = self._path(f"batches/batch={c}/_replaces")
            ids -= set(json.loads(self._text(at.toString())))
        return sorted(ids, key=lambda i: i[1:])

    def _text(self, path: str) -> str:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        stream = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        p, fs = self._path(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _table(self, name: str, batches: Sequence[str] | None = None) -> DataFrame:
        """A table of the committed batches."""
        schema = self._schema(name) + (", contig string" if name in BY_CONTIG else "") + ", batch string"
        ids = self._batches() if batches is None else list(batches)
        ids = [i for i in ids if i[0] in ("b", "c") or name in ("allele_count", "variant_stats")] if self.meta["enable"].get(name, True) else []
        if not ids:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.uri}/{name}").parquet(*(f"{self.uri}/{name}/batch={i}" for i in ids))

    def _log(self) -> DataFrame:
        ids = self._batches()
        if not ids:
            return self.spark.createDataFrame([], LOG + ", batch string")
        return self.spark.read.schema(LOG + ", batch string").option("basePath", f"{self.uri}/batches").parquet(*(f"{self.uri}/batches/batch={i}" for i in ids))

    def _need(self, mode: str) -> None:
        if self.mode != mode:
            raise RuntimeError(f"the dataset must be open in mode {mode!r}, not {self.mode!r}")

    def create_dataset(
        self, extra_attrs: Sequence[str] = (), vcf_attrs: str | None = None, allow_duplicates: bool = True, enable_allele_count: bool = True,
        enable_variant_stats: bool = True, enable_sample_stats: bool = True, variant_stats_version: int = 2, compression: str = "zstd",
    ) -> None:
        """Create the dataset. ``extra_attrs`` (or the header of ``vcf_attrs``) name INFO and FORMAT fields kept as columns of their own besides ``fmt_GT``."""
        self._need("w")
        if extra_attrs and vcf_attrs:
            raise ValueError("extra_attrs and vcf_attrs exclude each other")
        if variant_stats_version not in (2, 3):
            raise ValueError("variant_stats_version must be 2 or 3")
        if self._exists():
            raise FileExistsError(f"there is a dataset at {self.uri}")
        if vcf_attrs:
            header = read_headers(self.spark, vcf_attrs).select("header").first()
            extra_attrs = [f.column for f in header_fields(header[0])] if header else ()
        bad = [a for a in extra_attrs if not a.startswith(("info_", "fmt_"))]
        if bad:
            raise ValueError(f"attributes must start with info_ or fmt_: {bad}")
        meta = {
            "version": 4, "extra_attrs": sorted({"fmt_GT", *extra_attrs}), "allow_duplicates": allow_duplicates, "compression": compression, "variant_stats_version": variant_stats_version,
            "enable": {"allele_count": enable_allele_count, "variant_stats": enable_variant_stats, "sample_stats": enable_sample_stats},
        }
        p, fs = self._path("batches")
        fs.mkdirs(p)
        self._put("meta.json", json.dumps(meta))

    def ingest_samples(
        self, sample_uris: Sequence[str] | str, resume: bool = False, contig_mode: str = "all", contigs_to_keep_separate: Sequence[str] = (), batch: str | None = None,
        sample_batch_size: int | None = None,
    ) -> int:
        """Append single-sample files (a list of paths, or a file with a path per line) and return the number of new records.

        ``resume`` skips (sample, contig) pairs that have records. ``contig_mode``: all,
        separate (only the contigs to keep separate) or merged (only the others). ``batch``
        names this ingest: one that is committed under its name isn't done again.
        ``sample_batch_size``: so many files are committed at a time; default: all at once.
        """
        self._need("w")
        if contig_mode not in ("all", "separate", "merged"):
            raise ValueError(f"no contig mode {contig_mode!r}")
        uris = [r["uri"] for r in listing.read_sample_uris(self.spark, sample_uris).collect()] if isinstance(sample_uris, str) else list(sample_uris)
        if not uris:
            return 0
        if sample_batch_size is not None and sample_batch_size < 1:
            raise ValueError("sample_batch_size must be at least 1")
        if sample_batch_size is not None and len(uris) > sample_batch_size:
            parts = [uris[i : i + sample_batch_size] for i in range(0, len(uris), sample_batch_size)]
            return sum(self.ingest_samples(part, resume, contig_mode, contigs_to_keep_separate, batch and f"{batch}/{i}") for i, part in enumerate(parts))
        binary = [u for u in uris if u.endswith(".bcf")]
        plain = [u for u in uris if not u.endswith(".bcf")]
        tops = ([written(read_headers(self.spark, plain), "heads")] if plain else []) + ([bcf_headers(self.spark, binary)] if binary else [])
        parts = ([read_vcf(self.spark, plain, tops[0])] if plain else []) + ([read_bcf(self.spark, binary)] if binary else [])
        records = parts[0].unionByName(parts[1]).drop("file") if len(parts) > 1 else parts[0].drop("file")
        headers = tops[0].unionByName(tops[1]) if len(tops) > 1 else tops[0]
        if contig_mode != "all":
            own = F.col("contig").isin(list(contigs_to_keep_separate))
            records = records.where(own if contig_mode == "separate" else ~own)
        if resume:
            there = self._live(self._log()).where("n_records > 0").select("sample", "contig").distinct()
            records = records.join(there, ["sample", "contig"], "left_anti")
        return self.append(records, headers.drop("file"), batch)

    def append(self, records: DataFrame, headers: DataFrame, batch: str | None = None) -> int:
        """Append parsed records and headers with their aggregates as one batch; the number of records written is checked. A ``batch`` that is committed under its name gives 0."""
        if batch is not None and not self._log().where(F.col("name") == batch).isEmpty():
            return 0
        meta, ident, now = self.meta, *self._new_id("b")
        at = F.timestamp_millis(F.lit(now))
        # Parsed once; aggregates, records and the check all read the staged table.
        own = [F.element_at(a.split("_", 1)[0], a.split("_", 1)[1]).alias(a) for a in self._own_columns()]
        records = written(records.withColumn("ingest_ts", at).select("contig", *_names(RECORDS), *own), "ingest")
        if not meta["allow_duplicates"]:
            twice = records.groupBy("contig", "pos", "sample").count().where("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"several records of sample {twice[0]['sample']!r} start at {twice[0]['contig']}:{twice[0]['pos'] + 1}")
        known = self._live(self._table("headers")).select("sample").distinct()
        new = headers.select("sample", "header").join(known, "sample", "left_anti").withColumn("ingest_ts", at).dropDuplicates(["sample"])
        self._write(new, "headers", ident)
        if meta["enable"]["allele_count"]:
            self._write(self._by_sample(records), "allele_count", ident)
        if meta["enable"]["variant_stats"]:
            self._write(stats.variant_stats_partial(records, meta["variant_stats_version"]), "variant_stats", ident)
        if meta["enable"]["sample_stats"]:
            deep = records.withColumns({c: F.split(F.element_at("fmt", c.upper()), ",")[0].try_cast("int") for c in ("dp", "gq")})
            self._write(stats.sample_stats(deep).withColumn("ingest_ts", at), "sample_stats", ident)
        self._write(records, "records", ident)
        counts = records.groupBy("sample", "contig").agg(F.count(F.lit(1)).alias("n_records"), F.max(F.col("end_pos") - F.col("pos") + 1).alias("max_length"))
        bare = headers.select("sample").distinct().withColumns({"contig": F.lit(None).cast("string"), "n_records": F.lit(0).cast("long"), "max_length": F.lit(None).cast("int")})
        log = written(counts.unionByName(bare).unionByName(bare.limit(0).unionByName(self._nameless())).withColumns({"kind": F.lit("ingest"), "name": F.lit(batch).cast("string"), "at": at, "kept_aggregates": F.lit(None).cast("boolean")}), "log")
        expected, wrote = log.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0], self._table("records", [ident]).count()  # from the footers of the batch's own files
        if wrote != expected:
            raise RuntimeError(f"{expected} records were read but {wrote} written")
        self._commit(log, ident)
        return wrote

    def _nameless(self) -> DataFrame:
        """A log row without a sample, so a batch of no samples has its name in the log too."""
        return self.spark.createDataFrame([(None, None, 0, None)], "sample string, contig string, n_records long, max_length int")

    @staticmethod
    def _new_id(kind: str) -> tuple[str, int]:
        now = int(time.time() * 1000)
        return f"{kind}{now:014d}-{uuid.uuid4().hex}", now

    def _commit(self, log: DataFrame, ident: str, replaces: Sequence[str] = ()) -> None:
        """Write the batch's log aside and make it, and with it the batch, visible by one rename."""
        aside = f"batches/_{ident}"
        log.select(*_names(LOG)).coalesce(1).write.parquet(f"{self.uri}/{aside}")  # a row per sample and contig
        if replaces:
            self._put(f"{aside}/_replaces", json.dumps(list(replaces)))
        (old, fs), (new, _) = self._path(aside), self._path(f"batches/batch={ident}")
        if not fs.rename(old, new):
            raise RuntimeError(f"batch {ident} couldn't be committed")

    @staticmethod
    def _by_sample(records: DataFrame) -> DataFrame:
        # The sample stays in the partials, so deletion can take its counts back without rereading records.
        by = stats.allele_count(records.withColumn("contig", F.struct("contig", "sample")))
        return by.select(F.col("contig.contig").alias("contig"), "pos", "ref", "alt", "filter", "gt", "count", F.col("contig.sample").alias("sample"))

    def _write(self, df: DataFrame, name: str, ident: str) -> None:
        """Write a batch's part of a table; those by contig in order of position, so a region's read skips files and row groups."""
        cols = _names(self._schema(name))
        path, compression = f"{self.uri}/{name}/batch={ident}", self.meta["compression"]
        if name in BY_CONTIG:
            df = df.select(*cols, "contig").repartitionByRange("contig", "pos", "sample").sortWithinPartitions("contig", "pos", "sample")
            df.write.partitionBy("contig").option("compression", compression).parquet(path)
        else:
            df.select(*cols).write.option("compression", compression).parquet(path)

    def delete_samples(self, samples: Sequence[str], skip_aggregate_stats: bool = False) -> None:
        """Delete samples; unknown ones raise. With ``skip_aggregate_stats`` their counts stay in the aggregates and a mark says so.

        The mark and the aggregates that take their counts back become visible together.
        """
        self._need("w")
        known = {r["sample"] for r in self._samples().where(F.col("sample").isin(list(samples))).collect()}
        if missing := sorted(set(samples) - known):
            raise ValueError(f"samples not in the dataset: {missing}")
        ident, now = self._new_id("d")
        own = F.col("sample").isin(list(samples))
        for name, counts in (("allele_count", ("count",)), ("variant_stats", ("ac", "an", "n_hom"))):
            if self.meta["enable"][name]:
                gone = stats.negated(self._table(name).where(own), counts)
                self._write(gone.limit(0) if skip_aggregate_stats else gone, name, ident)
        rows = [("delete", None, None, s, None, 0, None, skip_aggregate_stats) for s in samples]
        log = self.spark.createDataFrame(rows, LOG).withColumn("at", F.timestamp_millis(F.lit(now)))
        self._commit(log, ident)

    def kept_aggregates(self) -> list[str]:
        """Deleted samples whose counts were left in the aggregates."""
        return sorted(r["sample"] for r in self._log().where("kind = 'delete' and kept_aggregates").select("sample").distinct().collect())

    def _live(self, table: DataFrame, at: str | None = None) -> DataFrame:
        """Without samples deleted after they were ingested, and, of the log, without what isn't a sample's ingest."""
        log = "kind" in table.columns
        if log:
            table = table.where("kind = 'ingest' and sample is not null")
        if not any(i.startswith("d") for i in self._batches()):
            return table
        gone = self._log().where("kind = 'delete'").groupBy("sample").agg(F.max("at").alias("__gone"))
        when = at or ("at" if log else "ingest_ts")
        return table.join(gone, "sample", "left").where(F.col("__gone").isNull() | (F.col(when) > F.col("__gone"))).drop("__gone")

    def compact(self) -> None:
        """Fold all batches into one: few sorted files, without deleted samples, aggregates summed.

        Readers see the old batches until the new one is committed. Folders that
        nothing refers to any more are removed by :meth:`vacuum`.
        """
        self._need("w")
        old = self._batches()
        if not old:
            return
        ident, _ = self._new_id("c")
        on = self.meta["enable"]
        for name in ("records", "headers", "sample_stats"):
            if on.get(name, True):
                self._write(self._live(self._table(name, old)), name, ident)
        ac = self._table("allele_count", old).groupBy("contig", "pos", "ref", "alt", "filter", "gt", "sample").agg(F.sum("count").cast("int").alias("count"))
        if on["allele_count"]:
            self._write(ac.where("count <> 0"), "allele_count", ident)
        vs = self._table("variant_stats", old).groupBy("contig", "pos", "end_pos", "sample", "allele")
        # Rows of 0 calls that no deletion took back (reference rows of version 2) stay.
        vs = vs.agg(F.sum("ac").cast("int").alias("ac"), F.sum("an").cast("int").alias("an"), F.sum("n_hom").cast("int").alias("n_hom"))
        if on["variant_stats"]:
            self._write(vs.where("ac <> 0 or an <> 0"), "variant_stats", ident)
        log = self._log()
        names = log.where("name is not null").select("name").distinct().select(
            F.lit("ingest").alias("kind"), "name", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("sample"), F.lit(None).cast("string").alias("contig"),
            F.lit(0).cast("long").alias("n_records"), F.lit(None).cast("int").alias("max_length"), F.lit(None).cast("boolean").alias("kept_aggregates"),
        )
        marks = log.where("kind = 'delete' and kept_aggregates")
        live = self._live(log).where(F.col("batch").isin(old))
        self._commit(live.drop("batch").unionByName(names).unionByName(marks.drop("batch")), ident, old)

    def vacuum(self) -> int:
        """Remove the folders of replaced and of failed batches and return how many. Not while others ingest or read what was there before."""
        self._need("w")
        keep, removed = set(self._batches()), 0
        for name in (*TABLES, "batches"):
            p, fs = self._path(name)
            for s in fs.listStatus(p) if fs.exists(p) else []:
                ident = s.getPath().getName().removeprefix("batch=").removeprefix("_")
                if ident not in keep:
                    removed += bool(fs.delete(s.getPath(), True))
        return removed

    @staticmethod
    def delete(spark: SparkSession, uri: str) -> None:
        """Remove a dataset's folder."""
        d = Dataset(spark, uri, "w")
        if not d._exists():
            raise FileNotFoundError(f"no dataset at {uri}")
        p, fs = d._path("")
        fs.delete(p, True)

    # -- catalogue

    def samples(self) -> list[str]:
        """Names of the samples, sorted."""
        return [r["sample"] for r in self._samples().orderBy("sample").collect()]

    def sample_count(self) -> int:
        return self._samples().count()

    def _samples(self) -> DataFrame:
        return self._as_of(self._live(self._table("headers"))).select("sample").distinct()

    def _as_of(self, table: DataFrame) -> DataFrame:
        return select.as_of(table, self.cfg.start_timestamp, self.cfg.end_timestamp)

    def header(self) -> str:
        """One header for all samples: the first one's, with what the others declare besides."""
        return merged_header(self._live(self._table("headers")))

    def headers(self, samples: Sequence[str] | None = None, first: bool = False) -> DataFrame:
        """``sample, header`` of all samples, of the given ones, or of the first in order of name."""
        table = self._live(self._table("headers")).select("sample", "header")
        if samples is not None:
            table = table.where(F.col("sample").isin(list(samples)))
        return table.orderBy("sample").limit(1) if first else table

    def fields(self) -> list[Field]:
        """INFO and FORMAT fields with their types, as all stored headers declare them; of several declarations that of the first sample counts."""
        if self._known is None:
            self._known = header_fields(self.header())
        return self._known

    def attributes(self, attr_type: str = "all") -> list[str]:
        """Names a read can ask for: all, info, fmt or builtin."""
        if attr_type not in ("all", "info", "fmt", "builtin"):
            raise ValueError("attr_type must be all, info, fmt or builtin")
        named = [f.column for f in self.fields()]
        out = {"builtin": list(BUILTIN), "info": [n for n in named if n.startswith("info_")], "fmt": [n for n in named if n.startswith("fmt_")]}
        return sorted(x for v in out.values() for x in v) if attr_type == "all" else sorted(out[attr_type])

    def schema_version(self) -> int:
        return self.meta["version"]

    def stat(self) -> dict:
        """Version, kept attributes, toggles, samples and records."""
        m = self.meta
        n = self._live(self._log()).agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
        return {"uri": self.uri, "version": m["version"], "extra_attrs": m["extra_attrs"], "enable": m["enable"], "n_samples": self.sample_count(), "n_records": n}

    def contig_counts(self) -> DataFrame:
        """Records of each contig, from the log."""
        return self._live(self._log()).where("n_records > 0").groupBy("contig").agg(F.sum("n_records").alias("n_records"))

    @staticmethod
    def version() -> str:
        """Version of the library."""
        return VERSION

    # -- reads

    def query(
        self, attrs: Sequence[str] = DEFAULT_ATTRS, samples: Sequence[str] | None = None, samples_file: str | None = None, regions: Sequence[str] | str | None = None,
        bed_file: str | None = None, bed_table: DataFrame | None = None, set_af_filter: str = "", scan_all_samples: bool = False, skip_check_samples: bool = False,
    ) -> DataFrame:
        """The read as a lazy DataFrame: one row per record and overlapped region."""
        self._need("r")
        if samples is not None and samples_file is not None:
            raise ValueError("Argument 'samples' and 'samples_file' are mutually exclusive")
        attrs = list(dict.fromkeys(attrs))
        found = self._select(samples, samples_file, regions, bed_file, bed_table, skip_check_samples)
        iaf = [a for a in attrs if a in ("info_IAF", "info_IAC", "info_IAN")]
        if iaf or set_af_filter:
            attrs = list(dict.fromkeys([*attrs, "alleles", "fmt_GT", "info_IAF", "info_IAC", "info_IAN"]))
            found = self._with_frequency(found, set_af_filter, scan_all_samples)
        return self._limited(found).select(*self._columns(attrs, found))

    def _with_frequency(self, found: DataFrame, condition: str, scan_all_samples: bool = False) -> DataFrame:
        """Records with the frequencies of their alleles; those that don't meet the condition are left out. Of the counts only the regions' reach is read."""
        n = self.sample_count() if scan_all_samples else None
        counts = self._table("variant_stats")
        if self._reach is not None:
            counts = counts.where(self._reach)
        return frequency.af_filter(found, counts, condition or ">=0", n, self.meta["variant_stats_version"])

    def _limited(self, found: DataFrame) -> DataFrame:
        return found if self.cfg.limit is None else found.limit(self.cfg.limit)

    def _columns(self, attrs: Sequence[str], found: DataFrame) -> list:
        has = set(found.columns)
        region = lambda c, plus: ((F.col(c) + plus) if c in has else F.lit(None).cast("int"))
        fixed = {
            "sample_name": F.col("sample"), "contig": F.col("contig"), "pos_start": F.col("pos") + 1, "pos_end": F.col("end_pos") + 1, "alleles": F.col("alleles"), "id": F.col("id"),
            "filters": F.col("filters"), "qual": F.col("qual"), "fmt": F.col("fmt"), "info": F.col("info"), "query_bed_start": region("region_lo", 0), "query_bed_end": region("region_hi", 1), "query_bed_line": region("region_line", 0),
            "fmt_GT": F.col("gt"),
        }
        if "iaf" in has:
            fixed |= {"info_IAF": F.col("iaf"), "info_IAC": F.col("iac"), "info_IAN": F.col("ian")}
        known, own = {f.column: f for f in self.fields()}, set(self._own_columns())
        out = []
        for a in attrs:
            if a in fixed:
                out.append(fixed[a].alias(a))
            elif a in known:
                out.append(known[a].value(a in own).alias(a))
            else:
                raise ValueError(f"no attribute {a!r}")
        return out

    def _select(self, samples, samples_file, regions, bed_file, bed_table, skip_check) -> DataFrame:
        start, end = self.cfg.start_timestamp, self.cfg.end_timestamp
        # A batch's time is in its name; compacted ones hold several.
        ids = [i for i in self._batches() if i[0] != "b" or (start is None or int(i[1:15]) >= start) and (end is None or int(i[1:15]) <= end)]
        records = self._live(self._as_of(self._table("records", ids))).drop("batch")
        names = self._samples()
        self._reach: Column | None = None
        if samples is not None:
            records = select.with_samples(records, [samples] if isinstance(samples, str) else samples)
        elif samples_file is not None:
            records = select.with_samples(records, listing.read_samples(self.spark, samples_file), None if skip_check else names)
        if self.cfg.sample_partition is not None:
            records = records.join(select.sample_partition(names, *self.cfg.sample_partition), "sample", "left_semi")
        tables = []
        if regions is not None and len(regions):
            joined = coalesce([regions] if isinstance(regions, str) else list(regions))  # sorted
            if not self.cfg.sort_regions:  # numbered in the order given: a joined one where its first part stands
                given = [Region.parse(r) for r in ([regions] if isinstance(regions, str) else regions)]
                joined.sort(key=lambda j: next(i for i, g in enumerate(given) if g.contig == j.contig and j.start <= g.start <= j.end))
            tables.append(region_table(self.spark, joined))
        if bed_file is not None:
            tables.append(listing.read_bed(self.spark, bed_file))
        if bed_table is not None:
            tables.append(listing.bed_table(bed_table))
        if not tables:
            return records
        wanted = tables[0]
        for t in tables[1:]:
            wanted = wanted.unionByName(t)
        if self.cfg.region_partition is not None:
            wanted = select.region_partition(wanted, *self.cfg.region_partition)
        bounds = few_bounds(wanted)
        if bounds is not None:
            # A record that overlaps a region starts at most the longest record before it, and so does a block that covers that start.
            longest = {r["contig"]: r["m"] for r in self._log().where(F.col("contig").isin([b["contig"] for b in bounds])).groupBy("contig").agg(F.max("max_length").alias("m")).collect()}
            self._reach = F.lit(False)
            for b in bounds:
                size = longest.get(b["contig"]) or 0
                self._reach = self._reach | ((F.col("contig") == b["contig"]) & F.col("pos").between(b["lo"] - 2 * size, b["hi"]) & (F.col("end_pos") >= b["lo"] - size))
        return overlap_join(records, wanted, bounds=bounds)

    def read(self, *args, **kwargs) -> pd.DataFrame:
        """:meth:`query` as a pandas frame, for results a driver can hold."""
        return self.query(*args, **kwargs).toPandas()

    def read_arrow(self, *args, **kwargs) -> pa.Table:
        return self.query(*args, **kwargs).toArrow()

    def read_iter(self, *args, rows: int = 100_000, **kwargs) -> Iterator[pd.DataFrame]:
        """Pages of at most ``rows`` rows; only one partition is held at a time."""
        df = self.query(*args, **kwargs)
        page: list = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            page.append(row)
            if len(page) == rows:
                yield pd.DataFrame(page, columns=df.columns)
                page = []
        if page:
            yield pd.DataFrame(page, columns=df.columns)

    def read_page(self, *args, **kwargs) -> pd.DataFrame | None:
        """Start a paged read and give its first page; :meth:`continue_read` gives the next."""
        self._pages = self.read_iter(*args, **kwargs)
        return self.continue_read()

    def continue_read(self) -> pd.DataFrame | None:
        """The next page of the read begun, or None when it is complete."""
        if self._pages is None:
            return None
        page = next(self._pages, None)
        if page is None:
            self._pages = None
        return page

    def read_completed(self) -> bool:
        return self._pages is None

    def count(self, samples: Sequence[str] | None = None, regions: Sequence[str] | None = None, **kwargs) -> int:
        """Number of (record, region) pairs."""
        self._need("r")
        found = self._select(samples, kwargs.get("samples_file"), regions, kwargs.get("bed_file"), kwargs.get("bed_table"), kwargs.get("skip_check_samples", False))
        return self._limited(found).count()

    def _one_of(self, region: str | None, regions: Sequence[str] | None) -> list[Region]:
        if region is None and not regions:
            raise ValueError('"region" or "regions" parameter is required')
        if region is not None and regions:
            raise ValueError('"region" and "regions" parameters are mutually exclusive')
        if region is not None:
            warnings.warn('"region" parameter is deprecated', DeprecationWarning, stacklevel=3)
        return coalesce([region] if region is not None else regions)

    def _at(self, table: DataFrame, regions: list[Region]) -> DataFrame:
        """Rows at the sites of (coalesced) regions; contig and position bounds reach the scan."""
        if len(regions) <= FEW_REGIONS:
            near = F.lit(False)
            for r in regions:
                near = near | ((F.col("contig") == r.contig) & F.col("pos").between(r.start - 1, r.end - 1))
            return table.where(near)
        table = table.where(F.col("contig").isin(sorted({r.contig for r in regions})))
        return overlap_join(table.withColumn("__end", F.col("pos")), region_table(self.spark, regions), end="__end").drop("__end", "region_lo", "region_hi", "region_line")

    def query_variant_stats(self, region: str | None = None, regions: Sequence[str] | None = None, drop_ref: bool = False, scan_all_samples: bool = False) -> DataFrame:
        """``contig, pos`` (0-based)``, alleles, ac, an, af`` at the sites in the regions, sorted."""
        self._need("r")
        part = self._at(self._table("variant_stats"), self._one_of(region, regions))
        return stats.variant_stats(part, self.sample_count() if scan_all_samples else None, drop_ref).orderBy("contig", "pos", "alleles")

    def read_variant_stats(self, *args, **kwargs) -> pd.DataFrame:
        return self.query_variant_stats(*args, **kwargs).toPandas()

    def read_variant_stats_arrow(self, *args, **kwargs) -> pa.Table:
        return self.query_variant_stats(*args, **kwargs).toArrow()

    def query_allele_count(self, region: str | None = None, regions: Sequence[str] | None = None) -> DataFrame:
        """``contig, pos`` (0-based)``, ref, alt, filter, gt, count`` at the sites in the regions, sorted."""
        self._need("r")
        part = self._at(self._table("allele_count"), self._one_of(region, regions))
        return stats.sum_allele_counts(part).orderBy("contig", "pos", "ref", "alt", "filter", "gt")

    def read_allele_count(self, *args, **kwargs) -> pd.DataFrame:
        return self.query_allele_count(*args, **kwargs).toPandas()

    def read_allele_count_arrow(self, *args, **kwargs) -> pa.Table:
        return self.query_allele_count(*args, **kwargs).toArrow()

    def sample_qc(self, samples: Sequence[str] | None = None) -> DataFrame:
        """Per-sample quality, sorted by sample."""
        table = self._live(self._table("sample_stats"))
        if samples is not None:
            table = table.where(F.col("sample").isin(list(samples)))
        return stats.sample_qc(table).orderBy("sample")

    def read_allele_frequency(self, region: str) -> pd.DataFrame:
        """Variant statistics of one region."""
        return self.read_variant_stats(regions=[region])

    # -- exports

    def export(
        self, samples: Sequence[str] | None = None, regions: Sequence[str] | None = None, samples_file: str | None = None, bed_file: str | None = None, merge: bool = False,
        output_format: str = "v", output_path: str = "", output_dir: str = ".", tsv_fields: Sequence[str] = (), skip_check_samples: bool = False, set_af_filter: str = "",
    ) -> None:
        """Write per-sample files below ``output_dir``, one merged file at ``output_path`` (``merge``), or a table (format ``t``) at ``output_path``.

        Formats: ``v`` text, ``z`` gzip, ``t`` tab-separated. Binary formats aren't written.
        The limit of the read's configuration and ``set_af_filter`` hold for exports too.
        """
        self._need("r")
        if merge and not output_path:
            raise ValueError("merge needs output_path")
        if output_format not in ("v", "z", "t"):
            raise ValueError("output_format must be v, z or t")
        found = self._select(samples, samples_file, regions, bed_file, None, skip_check_samples)
        if set_af_filter:
            found = self._with_frequency(found, set_af_filter).drop("iaf", "iac", "ian")
        found = self._limited(found)
        if output_format == "t":
            sinks.write_tsv(found, tsv_fields, output_path or output_dir)
            return
        headers = self._live(self._table("headers")).select("sample", "header")
        plain = found.drop("region_lo", "region_hi", "region_line")
        if merge:
            plain = written(plain, "merge") if self.cfg.limit is not None else plain  # a limit may pick others each time
            names = [r["sample"] for r in plain.select("sample").distinct().orderBy("sample").collect()]  # they become columns
            sinks.write_cohort_vcf(merge_cohort(plain, self.fields()), names, self.header(), output_path)
        else:
            plain = written(plain, "export") if self.cfg.limit is not None else plain
            sinks.write_sample_vcfs(plain, headers, output_dir, "gzip" if output_format == "z" else "none")


def read_allele_frequency(spark: SparkSession, uri: str, region: str) -> pd.DataFrame:
    """Variant statistics of a region of the dataset at ``uri``."""
    return Dataset(spark, uri).read_allele_frequency(region)


def sample_qc(spark: SparkSession, uri: str, samples: Sequence[str] | None = None) -> pd.DataFrame:
    """Per-sample quality of the dataset at ``uri``."""
    return Dataset(spark, uri).sample_qc(samples).toPandas()
