from allelake.operators.cohort import genotype_place, merge_alleles, merge_records, spread, trim_shared


def test_alleles():
    assert trim_shared(["CTG", "CG"]) == ["CT", "C"] and trim_shared(["A", "C"]) == ["A", "C"] and trim_shared(["AA", "AA"]) == ["A", "A"]
    assert merge_alleles([["A", "C"], ["AT", "A"], ["A", "<NON_REF>"]]) == (["AT", "CT", "A", "<NON_REF>"], [[0, 1], [0, 2], [0, 3]])


def test_values_follow_their_alleles():
    assert spread(["1", "2"], "A", [0, 2, 1], 4) == ["2", "1", "."]
    assert spread(["r", "x"], "R", [0, 2], 3) == ["r", ".", "x"]
    assert spread(["00", "01", "11"], "G", [0, 2], 3) == ["00", ".", ".", "01", ".", "11"]
    assert spread(["0", "1"], "G", [0, 2], 3) == ["0", ".", "1"]


def test_merged_record():
    def rec(sample, alleles, gt, **more):
        return {"sample": sample, "pos": 9, "alleles": alleles, "id": ".", "qual": None, "filters": None, "gt": gt, "info": {}, "fmt": {"GT": "/".join(map(str, gt))}} | more
    out = merge_records([
        rec("a", ["A", "C"], [0, 1], id="x", qual=3.0, filters=["PASS"], info={"DP": "3", "AF": "0.1", "END": "11"}, fmt={"GT": "0|1", "AD": "5,6"}),
        rec("b", ["A", "G", "C"], [1, 2], id="x;y", qual=9.0, filters=["q10", "PASS"], info={"DP": "4", "AF": "0.2,0.3"}),
    ], {("info", "AF"): "A", ("fmt", "AD"): "R"})
    assert out["alleles"] == ["A", "C", "G"] and out["id"] == "x;y" and out["qual"] == 9.0 and out["filters"] == ["q10"]
    assert out["info"] == {"DP": "7", "AF": "0.3,0.2", "END": "11", "AC": "2,1", "AN": "4"}
    assert out["format"] == ["GT", "AD"] and out["calls"] == {"a": "0|1:5,6,.", "b": "2/1:."}


def test_missing_depth_and_end_beside_numbers():
    rec = lambda s, info: {"sample": s, "pos": 4, "alleles": ["A", "C"], "id": ".", "qual": None, "filters": None, "gt": [0, 1], "info": info, "fmt": {"GT": "0/1"}}
    for infos, want in (([{"DP": "."}, {"DP": "7"}, {"DP": "5"}], "12"), ([{"DP": "7"}, {"DP": "."}], "7"), ([{"DP": "."}, {"DP": "."}], "."), ([{"DP": "x"}, {"DP": "3"}], "3")):
        assert merge_records([rec(str(i), x) for i, x in enumerate(infos)], {})["info"]["DP"] == want
    assert merge_records([rec("a", {"END": "."}), rec("b", {"END": "9"})], {})["info"]["END"] == "9"


def test_genotype_values_of_any_ploidy():
    from itertools import combinations_with_replacement

    for ploidy in (1, 2, 3, 4):
        places = [genotype_place(g) for g in combinations_with_replacement(range(4), ploidy)]
        assert sorted(places) == list(range(len(places)))
    # Order of a triploid with two alleles: 000 001 011 111. Allele 1 becomes 2 of three.
    assert spread(["a", "b", "c", "d"], "G", [0, 2], 3) == ["a", ".", ".", ".", "b", ".", ".", "c", ".", "d"]
    assert spread(["a", "b", "c"], "G", [0, 2], 3) == ["a", ".", ".", "b", ".", "c"] and spread(["a", "b"], "G", [0, 2], 3) == ["a", ".", "b"]
