import datetime as dt
import itertools
import random

from common import rows
from pyspark.sql import types as T

from allelake.operators import drift
from allelake.operators.drift import Edit, Node, assign, consistent, declarations, distance, edit_script, header_changes, previous, tree_of, undeclared_keys, unify


def test_assignment_is_least_cost():
    rng = random.Random(1)
    for n in range(1, 6):
        for _ in range(30):
            cost = [[rng.randrange(20) for _ in range(n)] for _ in range(n)]
            got = assign(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i][got[i]] for i in range(n)) == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def leaf(name, kind="Int/1", note=""):
    return Node(name, kind, note or name.lower())


def test_scripts():
    a = Node("", "", "", (Node("info", "blob", "info", (leaf("A"), leaf("B", note="depth"), leaf("C"))), Node("fmt", "blob", "fmt", (leaf("D"),))))
    b = Node("", "", "", (Node("info", "blob", "info", (leaf("A", "Str/1"), leaf("B2", "Flt/1", "depth"))), Node("fmt", "blob", "fmt", (leaf("C"), leaf("E")))))
    assert set(edit_script(a, b)) == {
        Edit("retyped", ("info",), "A", "A"), Edit("renamed", ("info",), "B", "B2"), Edit("retyped", ("info",), "B", "B2"),
        Edit("moved", ("fmt",), "info.C", "C"), Edit("removed", ("fmt",), "D", ""), Edit("added", ("fmt",), "", "E"),
    }
    assert edit_script(a, a) == [] and distance(a, a) == 0 and distance(a, b) == distance(b, a) > 0


def test_header_lines():
    text = '##INFO=<Number=1,ID=X,Description="a, ID=Y, \\"q\\" (z)",Type=Integer>\r\n##FORMAT=<ID=X,Type=Float,Number=A>\r##INFO=<Type=Flag>\n##INFO=<ID=X,Type=Flag,Number=0,Description="later">\n##contig=<ID=1>\n'
    assert declarations(text) == [("fmt", "X", "Float", "A", ""), ("info", "X", "Integer", "1", "aidyqz")]
    assert declarations(None) == declarations("") == []


def header(**fields):
    return "\n".join(f'##INFO=<ID={k},Number=1,Type={v[0]},Description="{v[1]}">' for k, v in fields.items())


def files(spark):
    t = dt.datetime(2024, 1, 1)
    listing = spark.createDataFrame([(1, "a", t), (2, "a", t), (3, "b", t), (4, "a", t + dt.timedelta(1)), (5, None, t), (6, "b", None)], "uri_id long, centre string, written_at timestamp")
    heads = {1: header(DP=("Integer", "Read depth."), Q=("Float", "qual")), 2: header(dp=("Float", "read  DEPTH"), Q=("Float", "other words")), 3: header(DP=("Integer", "x")), 4: header(Q=("String", "other words"), N=("Flag", "new")), 5: None, 6: "junk"}
    return listing, spark.createDataFrame(list(heads.items()), "uri_id long, header string")


def test_changes_between_files_of_a_centre(spark):
    listing, heads = files(spark)
    assert rows(header_changes(listing, heads)) == sorted([
        (2, "info", "dp", "DP", "renamed"), (2, "info", "dp", "", "retyped"), (4, "info", "dp", "", "removed"), (4, "info", "N", "", "added"), (4, "info", "Q", "", "retyped"),
    ], key=repr)
    assert header_changes(listing.limit(0), heads).count() == 0


def test_undeclared_and_consistent(spark):
    listing, heads = files(spark)
    data = spark.createDataFrame([(1, 1, "DP=3;Q=1;Z", None), (2, 1, ".", ""), (3, 2, "dp=4=5;dp=6", "GQ=1"), (4, 9, "A", None), (5, None, "B", "C")], "row_id long, uri_id long, info string, fmt string")
    assert rows(undeclared_keys(data, heads)) == [(1, "info", "Z"), (2, "fmt", "GQ"), (9, "info", "A")]
    got = {r["row_id"]: (r["info"], r["fmt"]) for r in consistent(data, header_changes(listing, heads), "row_id").collect()}
    assert got[1] == ({"DP": "3", "Q": "1", "Z": "1"}, {}) and got[2] == ({}, {}) and got[3] == ({"DP": "6"}, {"GQ": "1"})


def test_previous_in_a_group_that_is_cut(spark, monkeypatch):
    rng = random.Random(5)
    t = dt.datetime(2024, 1, 1)
    data = [(i, "hot" if i % 4 else rng.choice(["x", None]), t + dt.timedelta(minutes=rng.randrange(60))) for i in range(200)]
    df = spark.createDataFrame(data, "id long, g string, at timestamp")
    got = {r["id"]: r["__previous"] for r in previous(df, "g", ("at", "id"), "id", 4, 10).collect()}
    want = {}
    for g in {"hot", "x", None}:
        own = sorted((d[2], d[0]) for d in data if d[1] == g)
        want |= {b[1]: a[1] for a, b in zip([(None, None), *own], own)}
    assert got == want


def test_frames_of_drifting_schemas(spark):
    old = spark.createDataFrame([(1, (7, "u"))], "a int, s struct<x:int,y:string>")
    new = spark.createDataFrame([("2", (8.5,), True)], "a string, s struct<x:double>, z boolean")
    out, report = unify([old, new])
    assert rows(out) == sorted([("1", (7.0,), None), ("2", (8.5,), True)], key=repr)
    assert {(e.op, e.old or e.new) for i, e in report if i == 0} == {("retyped", "a"), ("retyped", "x"), ("removed", "y"), ("added", "z")}


def test_projection_of_renames(spark):
    def schema(name):
        return T.StructType([T.StructField("k", T.IntegerType()), T.StructField(name, T.IntegerType(), metadata={"comment": "depth"})])
    old, new = spark.createDataFrame([(1, 2)], schema("DP")), schema("depth")
    script = edit_script(tree_of(old.schema), tree_of(new))
    assert [e.op for e in script] == ["renamed"]
    assert rows(old.selectExpr(*drift.projection(script, tree_of(old.schema), tree_of(new))), "depth", "k") == [(2, 1)]
