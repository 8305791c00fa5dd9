"""Schemas that drift between files: edit scripts between nested schemas, and one consistent table.

A schema is a tree: a node has a label (the field's name), a kind (type and
number), a note (text that identifies a field under another name) and
children. The distance is that of constrained unordered tree edits: subtrees map
to subtrees, and the children of matched nodes are matched at least cost, level
by level (an assignment problem; siblings have no order, as the lines of a
header have none). Equal children are matched first, which never costs more as
names are unique among siblings, so only the few that differ are assigned.
Afterwards a subtree that goes at one place and comes at another is a move.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.operators.ranges import RANGE, range_cuts, with_range
from allelake.session import ship, written

#: Costs. A rename is cheaper than removing and adding, a change of kind cheaper still.
RENAME, RETYPE, REMOVE, ADD = 1.0, 0.5, 2.0, 2.0
_NEVER = 1e9


@dataclass(frozen=True)
class Node:
    """A field of a nested schema."""

    label: str
    kind: str = ""
    note: str = ""
    children: tuple[Node, ...] = field(default=())

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


class Edit(NamedTuple):
    """One step of a script. ``path``: the parent's labels; ``old`` is '' for added, ``new`` for removed."""

    op: str  # renamed, retyped, added, removed, moved
    path: tuple[str, ...]
    old: str
    new: str


def _twins(a: Node, b: Node) -> bool:
    """Whether two fields of different names may be the same field."""
    if a.children or b.children:
        return bool(a.children) and bool(b.children) and bool({(c.label, c.kind) for c in a.children} & {(c.label, c.kind) for c in b.children})
    return bool(a.note) and a.note == b.note


def assign(cost: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row in a least-cost assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while row_of[j0]:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


@lru_cache(maxsize=50_000)
def distance(a: Node, b: Node) -> float:
    """Least cost of turning ``a`` into ``b``, names of the two included."""
    return (RENAME if a.label != b.label else 0.0) + (RETYPE if a.kind != b.kind else 0.0) + _match(a, b)[0]


def _match(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]], list[Node], list[Node]]:
    """Cost and pairs of the children of matched nodes, then those removed and those added."""
    left, right = {c.label: c for c in a.children}, {c.label: c for c in b.children}
    pairs = [(left[x], right[x]) for x in left if x in right]  # a kept name is never dearer than a new one
    cost = sum(distance(x, y) for x, y in pairs if x != y)
    gone = sorted((left[x] for x in left if x not in right), key=lambda n: n.label)
    come = sorted((right[x] for x in right if x not in left), key=lambda n: n.label)
    if gone and come:
        g, c = len(gone), len(come)
        matrix = [[_NEVER] * (g + c) for _ in range(g + c)]
        for i, x in enumerate(gone):
            for j, y in enumerate(come):
                if _twins(x, y):
                    matrix[i][j] = distance(x, y)
            matrix[i][c + i] = REMOVE * x.size()
        for j, y in enumerate(come):
            matrix[g + j][j] = ADD * y.size()
            for i in range(g):
                matrix[g + j][c + i] = 0.0
        chosen = assign(matrix)
        renamed = {i: chosen[i] for i in range(g) if chosen[i] < c and matrix[i][chosen[i]] < _NEVER}
        pairs += [(gone[i], come[j]) for i, j in renamed.items()]
        cost += sum(matrix[i][j] for i, j in renamed.items())
        gone, come = [x for i, x in enumerate(gone) if i not in renamed], [y for j, y in enumerate(come) if j not in renamed.values()]
    cost += sum(REMOVE * x.size() for x in gone) + sum(ADD * y.size() for y in come)
    return cost, pairs, gone, come


def edit_script(a: Node, b: Node) -> list[Edit]:
    """The edits of least cost from ``a`` to ``b``, parents before children. Equal trees give none."""
    out: list[Edit] = []
    went: list[tuple[tuple[str, ...], Node]] = []
    came: list[tuple[tuple[str, ...], Node]] = []

    def walk(x: Node, y: Node, path: tuple[str, ...]) -> None:
        if x == y:
            return
        _, pairs, gone, come = _match(x, y)
        for p, q in pairs:
            if p.label != q.label:
                out.append(Edit("renamed", path, p.label, q.label))
            if p.kind != q.kind:
                out.append(Edit("retyped", path, p.label, q.label))
            walk(p, q, (*path, q.label))
        went.extend((path, n) for n in gone)
        came.extend((path, n) for n in come)

    walk(a, b, ())
    for path, n in list(went):
        # The same field under another parent: cheaper than removing and adding it.
        to = next((c for c in came if c[0] != path and c[1].label == n.label and c[1].kind == n.kind and c[1].note == n.note and c[1].children == n.children and n.note), None)
        if to:
            out.append(Edit("moved", to[0], ".".join((*path, n.label)), n.label))
            went.remove((path, n))
            came.remove(to)
    out += [Edit("removed", path, n.label, "") for path, n in went]
    out += [Edit("added", path, "", n.label) for path, n in came]
    return out


def tree_of(schema: T.DataType, label: str = "") -> Node:
    """The tree of a Spark schema; a field's comment is its note."""
    if isinstance(schema, T.StructType):
        kids = []
        for f in schema.fields:
            inner = tree_of(f.dataType, f.name)
            kids.append(Node(f.name, inner.kind, (f.metadata or {}).get("comment", ""), inner.children))
        return Node(label, "struct", "", tuple(sorted(kids, key=lambda n: n.label)))
    return Node(label, schema.simpleString())


def projection(script: Sequence[Edit], have: Node, want: Node) -> list[str]:
    """The SQL expressions that give a file with schema ``have`` the columns of ``want``, following the script between them.

    Added fields are null, removed ones are left out, renamed and moved ones are
    read from their old place, retyped ones are cast (null where that fails).
    """
    source: dict[tuple[str, ...], tuple[str, ...]] = {}
    for e in script:
        if e.op == "renamed":
            source[(*e.path, e.new)] = (*e.path, e.old)
        elif e.op == "moved":
            source[(*e.path, e.new)] = tuple(e.old.split("."))

    def origin(path: tuple[str, ...]) -> tuple[str, ...]:
        if path in source:
            old = source[path]
            return (*origin(old[:-1]), old[-1]) if len(old) > 1 else old
        return (*origin(path[:-1]), path[-1]) if path else ()

    def there(path: tuple[str, ...]) -> Node | None:
        node: Node | None = have
        for p in path:
            node = next((c for c in node.children if c.label == p), None) if node else None
        return node

    def expr(node: Node, path: tuple[str, ...]) -> str:
        old = origin(path)
        found = there(old)
        name = ".".join(f"`{p}`" for p in old)
        if node.children:
            return "named_struct(" + ", ".join(f"'{c.label}', {expr(c, (*path, c.label))}" for c in node.children) + ")" if found else f"cast(null as {ddl(node)})"
        if not found:
            return f"cast(null as {node.kind})"
        return name if found.kind == node.kind else f"try_cast({name} as {node.kind})"

    return [f"{expr(c, (c.label,))} as `{c.label}`" for c in want.children]


def ddl(node: Node) -> str:
    """The SQL type of a node."""
    return "struct<" + ", ".join(f"`{c.label}`: {ddl(c)}" for c in node.children) + ">" if node.children else node.kind


def unify(frames: Sequence[DataFrame], want: T.StructType | None = None) -> tuple[DataFrame, list[tuple[int, Edit]]]:
    """All frames as one table with the newest frame's schema (or ``want``), and the edits from each frame to it.

    The number of frames is one per schema, not per file. Clashing names can't
    arise: the result has the wanted columns only. No frames raise.
    """
    target = tree_of(want or frames[-1].schema)
    parts, report = [], []
    for i, df in enumerate(frames):
        have = tree_of(df.schema)
        script = edit_script(have, target)
        report += [(i, e) for e in script]
        parts.append(df.selectExpr(*projection(script, have, target)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, report


# ---- headers of variant files

_LINE = re.compile(r"##\s*(INFO|FORMAT)\s*=\s*<(.*)>\s*$", re.S)
_PAIR = re.compile(r'\s*([^=,\s]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^,]*)\s*(?:,|$)', re.S)
_PLAIN = re.compile(r"[\W_]+")


@lru_cache(maxsize=200_000)
def declaration(line: str) -> tuple[str, str, str, str, str] | None:
    """``blob, name, type, number, note`` of an INFO or FORMAT line; None for any other line or one without an ID."""
    m = _LINE.match(line.strip())
    if not m:
        return None
    pairs: dict[str, str] = {}
    for k, v in _PAIR.findall(m[2]):
        pairs.setdefault(k, v)
    name = pairs.get("ID", "").strip().strip('"')
    if not name:
        return None
    note = _PLAIN.sub("", pairs.get("Description", "").strip('"').lower())
    return {"INFO": "info", "FORMAT": "fmt"}[m[1]], name, pairs.get("Type", "").strip(), pairs.get("Number", "").strip(), note


def declarations(header: str | None) -> list[tuple[str, str, str, str, str]]:
    """The declarations of a header in one order, whatever the order of its lines; the first of several with the same blob and name counts."""
    found: dict[tuple[str, str], tuple] = {}
    for line in re.split(r"\r\n|\n|\r", header or ""):
        if line.startswith("##") and (d := declaration(line)):
            found.setdefault(d[:2], d)
    return sorted(found.values())


def header_tree(decls: Sequence[Sequence[str]]) -> Node:
    """Root, then the blobs, then their fields."""
    blobs: dict[str, list[Node]] = {"info": [], "fmt": []}
    for blob, name, kind, number, note in decls:
        blobs[blob].append(Node(name, f"{kind}/{number}", note))
    return Node("", "", "", tuple(Node(b, "blob", b, tuple(kids)) for b, kids in blobs.items()))


DECLS = "array<struct<blob:string,name:string,kind:string,number:string,note:string>>"


def parsed_headers(headers: DataFrame, file: str, header: str) -> DataFrame:
    """``file, sig, decls``: a header's declarations and a signature that is equal for equal schemas."""
    ship(headers.sparkSession)
    schema = f"file {headers.schema[file].dataType.simpleString()}, decls {DECLS}"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("blob", "name", "kind", "number", "note")
        for pdf in batches:
            yield pd.DataFrame({"file": pdf["file"], "decls": [[dict(zip(names, d)) for d in declarations(h)] for h in pdf["header"]]})

    given = headers.where(F.col(file).isNotNull() & F.col(header).isNotNull()).select(F.col(file).alias("file"), F.col(header).alias("header"))
    return given.mapInPandas(parse, schema).withColumn("sig", F.sha2(F.to_json("decls"), 256))


def previous(df: DataFrame, group: str, order: Sequence[str], value: str, tasks: int | None = None, least: int = 20_000) -> DataFrame:
    """Add ``__previous``: ``value`` of the row before in the same group, null for a group's first row.

    ``order``: a timestamp, then further columns. Large groups are cut into
    ranges of the timestamp; a range's first row gets the last value of the one
    before, so no task holds a whole large group.
    """
    df = df.withColumn("__at", F.unix_micros(F.col(order[0]).cast("timestamp")))
    cuts = range_cuts(df.select(group, "__at"), [group], "__at", tasks, least)
    placed = with_range(df, cuts, [group], "__at")
    w = Window.partitionBy(group, RANGE).orderBy("__at", *order[1:])
    placed = placed.withColumns({"__previous": F.lag(value).over(w), "__nth": F.row_number().over(w)})
    if not cuts.limit(1).count():
        return placed.drop("__at", "__nth", RANGE)
    ends = with_range(df, cuts, [group], "__at").groupBy(group, RANGE).agg(F.max_by(value, F.struct("__at", *order[1:])).alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy(group).orderBy(RANGE)))  # a row a range
    ends = ends.where(F.col(RANGE) > 0).select(F.col(group).alias("__g"), F.col(RANGE).alias("__r"), "__before")
    out = placed.join(F.broadcast(ends), placed[group].eqNullSafe(F.col("__g")) & (F.col(RANGE) == F.col("__r")), "left")  # ranges but the first: at most 2 * tasks
    return out.withColumn("__previous", F.when(F.col("__nth") == 1, F.col("__before")).otherwise(F.col("__previous"))).drop("__at", "__nth", RANGE, "__g", "__r", "__before")


@lru_cache(maxsize=20_000)
def _script(old: tuple, new: tuple) -> tuple[tuple[str, str, str, str], ...]:
    """(blob, field, old name, change) rows from one header's declarations to another's."""
    rows = []
    for e in edit_script(header_tree(old), header_tree(new)):
        if e.op == "moved":  # a header's blobs are separate: there it left, here it came
            blob, name = e.old.split(".", 1)
            rows += [(blob, name, "", "removed"), (e.path[0], e.new, "", "added")]
        else:
            rows.append((e.path[0], e.new or e.old, e.old if e.op == "renamed" else "", e.op))
    return tuple(rows)


def header_changes(listing: DataFrame, headers: DataFrame, file: str = "uri_id", group: str = "centre", order: Sequence[str] = ("written_at", "uri_id"), parsed: DataFrame | None = None) -> DataFrame:
    """Every change of a file's declarations against the file before it in its group.

    Columns ``file, blob_name, field_name, old_name, change_kind``. Scripts are
    made once per pair of different schemas, not per file. Files without a
    header, a group or a time aren't compared. ``parsed``: the headers as
    :func:`parsed_headers` gives them, where the caller has them already.
    """
    parsed = parsed or written(parsed_headers(headers, file, "header"), "headers")
    schemas = parsed.groupBy("sig").agg(F.first("decls").alias("decls"))
    cols = list(dict.fromkeys([file, group, *order]))
    files = listing.select(*cols).where(F.col(group).isNotNull() & F.col(order[0]).isNotNull() & F.col(file).isNotNull())
    files = files.join(parsed.select(F.col("file").alias("__f"), "sig"), F.col(file) == F.col("__f")).drop("__f")
    steps = previous(files, group, order, "sig").where("__previous is not null and __previous <> sig").select(F.col(file).alias("file"), F.col("__previous").alias("old"), F.col("sig").alias("new"))
    steps = written(steps, "steps")
    pairs = steps.select("old", "new").distinct()
    pairs = pairs.join(schemas.select(F.col("sig").alias("old"), F.col("decls").alias("had")), "old").join(schemas.select(F.col("sig").alias("new"), F.col("decls").alias("has")), "new")

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda ds: tuple((d["blob"], d["name"], d["kind"], d["number"], d["note"]) for d in ds)
        for pdf in batches:
            rows = [(o, n, *edit) for o, n, had, has in zip(pdf["old"], pdf["new"], pdf["had"], pdf["has"]) for edit in _script(plain(had), plain(has))]
            yield pd.DataFrame(rows, columns=["old", "new", "blob_name", "field_name", "old_name", "change_kind"])

    edits = pairs.mapInPandas(scripts, "old string, new string, blob_name string, field_name string, old_name string, change_kind string")
    return steps.join(edits, ["old", "new"]).select("file", "blob_name", "field_name", "old_name", "change_kind")


def keys_of(c):
    """The keys of ``key=value;flag`` text; null, ``.`` and empty parts have none."""
    parts = F.transform(F.split(c, ";"), lambda p: F.trim(F.substring_index(p, "=", 1)))
    return F.array_distinct(F.filter(parts, lambda k: ~k.isin("", ".")))


def _names_in(blob: str):
    return F.transform(F.filter("decls", lambda d: d["blob"] == blob), lambda d: d["name"])


def undeclared_keys(rows: DataFrame, headers: DataFrame, file: str = "uri_id", blobs: Sequence[str] = ("info", "fmt"), parsed: DataFrame | None = None) -> DataFrame:
    """``file, blob_name, field_name``: keys in a file's rows that its own header doesn't declare in that blob.

    Distinct keys are formed before the shuffle, so a file with a third of all
    rows is no hot spot. Every key of a file without a header is undeclared.
    """
    found = rows.where(F.col(file).isNotNull()).select(F.col(file).alias("file"), F.inline(F.array(*(F.struct(F.lit(b).alias("blob_name"), keys_of(F.col(b)).alias("ks")) for b in blobs))))
    found = found.where("size(ks) > 0").select("file", "blob_name", F.explode("ks").alias("field_name")).distinct()
    used = found.groupBy("file", "blob_name").agg(F.collect_list("field_name").alias("ks"))
    parsed = parsed or parsed_headers(headers, file, "header")
    declared = parsed.select("file", F.inline(F.array(*(F.struct(F.lit(b).alias("blob_name"), _names_in(b).alias("ds")) for b in blobs))))
    open_ = used.join(declared, ["file", "blob_name"], "left").select("file", "blob_name", F.array_except("ks", F.coalesce("ds", F.array().cast("array<string>"))).alias("ks"))
    return open_.select("file", "blob_name", F.explode("ks").alias("field_name"))


def canonical_names(changes: DataFrame, most: int = 200_000) -> dict[tuple[str, str], str]:
    """(blob, name) to the name all its spellings share: names linked by renames form a class, named by its smallest spelling.

    There is one row per distinct rename, whatever the number of files; more
    than ``most`` raise, as such names are no longer a schema.
    """
    links = changes.where("change_kind = 'renamed'").select("blob_name", "old_name", "field_name").distinct().limit(most + 1).collect()
    if len(links) > most:
        raise ValueError(f"more than {most} distinct renames")
    parent: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x: tuple[str, str]) -> tuple[str, str]:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for blob, old, new in links:
        a, b = sorted((root((blob, old)), root((blob, new))))
        parent[b] = a
    return {x: root(x)[1] for x in list(parent)}


def consistent(rows: DataFrame, changes: DataFrame, key: str, blobs: Sequence[str] = ("info", "fmt")) -> DataFrame:
    """``key`` and each blob as a map from canonical name to text, whatever a file called the field, with what that map can't hold beside it.

    The renames of all scripts are compiled into one projection. Flags have the
    value ``1``; of several spellings of a field in one row the last counts, and the
    others' differing values stand in ``<blob>_clashes`` as sorted ``name=value``
    texts; null, empty and ``.`` blobs give an empty map.
    """
    from allelake.sources.vcf import map_of

    names = canonical_names(changes)
    table = {b: F.from_json(F.lit(json.dumps({old: new for (blob, old), new in names.items() if blob == b and old != new})), "map<string,string>") for b in blobs}

    def entries(b: str):
        parts = F.filter(F.split(F.coalesce(F.col(b), F.lit("")), ";"), lambda p: ~F.trim(p).isin("", "."))
        own = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("1").alias("v")))
        return F.transform(own, lambda e: F.struct(F.coalesce(F.element_at(table[b], e["k"]), e["k"]).alias("k"), e["v"].alias("v")))

    text = lambda es, k, v: F.transform(es, lambda e: F.concat(e[k], F.lit("="), e[v]))
    # Each blob is taken apart once; the column is used for both results.
    apart = rows.select(key, *(entries(b).alias(b) for b in blobs))
    whole = apart.select(key, *blobs, *(map_of(F.col(b)).alias(f"__{b}") for b in blobs))
    return whole.select(
        key, *(F.col(f"__{b}").alias(b) for b in blobs),
        *(F.when(F.size(b) > F.size(f"__{b}"), F.array_sort(F.array_except(text(b, "k", "v"), text(F.map_entries(f"__{b}"), "key", "value")))).otherwise(F.array().cast("array<string>")).alias(f"{b}_clashes") for b in blobs),
    )
