import random

import pytest
from common import rows

from allelake.operators.overlap import overlap_join, overlap_join_binned, stab_sums
from allelake.plans.variants import region_overlap_binned
from allelake.regions import Region, coalesce, coalesced_table, region_table


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_and_binned_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    def interval():
        lo = rng.randrange(100_000)
        return lo, lo + rng.choice([-1, 0, 5, 900, 3_000, 70_000, 5_000_000])
    recs = [(i, rng.choice(["1", "2", None]), *interval()) for i in range(150)]
    regs = [(rng.choice(["1", "2", "3"]), *interval(), i) for i in range(60)]
    v = spark.createDataFrame(recs, "id int, contig string, pos int, end_pos int")
    r = spark.createDataFrame(regs, "contig string, lo int, hi int, line int")
    want = sorted((i, line) for i, c, s, e in recs for c2, lo, hi, line in regs if c == c2 and s <= hi and e >= lo and e >= s and hi >= lo)
    assert rows(overlap_join(v, r), "id", "region_line") == sorted(want, key=repr)
    assert rows(overlap_join_binned(v, r, width=10), "id", "region_line") == sorted(want, key=repr)
    assert rows(overlap_join(v, r, small=5), "id", "region_line") == sorted(want, key=repr)


def test_empty(spark):
    v = spark.createDataFrame([(1, "1", 2, 3)], "id int, contig string, pos int, end_pos int")
    r = region_table(spark, ["1:1-9"])
    assert overlap_join(v.limit(0), r).count() == 0 and overlap_join(v, r.limit(0)).count() == 0 and overlap_join_binned(v.limit(0), r.limit(0)).count() == 0


FAR = 3_000_000_001


@pytest.mark.parametrize("far, kind, want", [
    (FAR, "bigint", [(7, 2, 10, 30), (FAR, 1, 20, 30)]),  # an id that no int holds stays what it is
    (-FAR, "bigint", [(-FAR, 1, 20, 30), (7, 2, 10, 30)]),
    (2**31 - 1, "int", [(7, 2, 10, 30), (2**31 - 1, 1, 20, 30)]),
])
def test_blocks_with_large_ids(spark, tmp_path, far, kind, want):
    records = [(1, "1", 10, 12), (2, "1", 20, 30), (3, "1", 40, 39)]
    blocks = [(7, "1", 0, 25), (far, "1", 25, 50), (FAR + 1, "2", 0, 50), (FAR + 2, "1", 9, 5), (FAR + 3, "1", 9, None)]
    spark.createDataFrame([(*x, "s", None, ["A", "C"], None, None, [0, 1], None, None, None) for x in records], "row_id long, contig string, start_pos int, end_pos int, sample string, id string, alleles array<string>, qual float, filter_ids array<string>, gt array<int>, info string, fmt string, ingest_ts timestamp").write.parquet(f"{tmp_path}/data_array.parquet")
    spark.createDataFrame(blocks, "block_id long, contig string, block_start int, block_end int").write.parquet(f"{tmp_path}/ref_blocks.parquet")
    got = region_overlap_binned(spark, str(tmp_path))
    assert dict(got.dtypes)["region_line"] == kind and sorted(map(tuple, got.collect())) == want


def test_stabbing(spark):
    p = spark.createDataFrame([("1", 5), ("1", 5), ("1", 2500), ("2", 5)], "contig string, pos int")
    b = spark.createDataFrame([("1", 0, 3000, 2), ("1", 5, 5, 3), ("1", 6, 4, 9)], "contig string, lo int, hi int, n int")
    assert rows(stab_sums(p, b, ["n"])) == [("1", 2500, 2), ("1", 5, 5)]


def test_region_text():
    assert Region.parse("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    for bad, message in (("", "must have format"), ("chr1", "must have format"), ("chr1:-", "must have format"), (":1-100", "cannot be empty"), ("chr1:0-100", "must be 1-based"), ("chr1:100-1", '"100-1" is not a valid region interval')):
        with pytest.raises(ValueError, match=message):
            Region.parse(bad)


def test_coalesce(spark):
    assert coalesce(["b:1-2", "a:5-9", "a:1-4", "a:8-8", "a:11-12"]) == [("a", 1, 9), ("a", 11, 12), ("b", 1, 2)]
    t = region_table(spark, ["b:1-2", "a:5-9", "a:1-4", "a:8-8", "a:11-12"])
    assert rows(coalesced_table(t), "contig", "lo", "hi") == [("a", 0, 8), ("a", 10, 11), ("b", 0, 1)]
