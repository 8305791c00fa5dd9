"""p4: attribute-value rows of info and fmt into one typed row per record."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators.widen import attributes, widen
from allelake.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """What stands in the way: ``untypable`` and ``conflict`` by record and attribute, read off the wide table."""
    types = table(spark, folder, "field_types")
    wide = widen(table(spark, folder, "attr_cells"), types, "row_id", issues=True)
    cases = [
        F.when(F.col(f"`{a.column}__{issue}`"), F.struct(F.lit(a.blob).alias("blob_name"), F.lit(a.name).alias("attr"), F.lit(issue).alias("issue")))
        for a in attributes(types)
        for issue in ("conflict", "untypable")
    ]
    return wide.select("row_id", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())).alias("c")).select("row_id", "c.*")


def p4_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with a typed column per attribute."""
    return widen(table(spark, folder, "attr_cells"), table(spark, folder, "field_types"), "row_id")


def p4_wide_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table's cells that have a value, as rows again: numbers of Float columns, the text of others."""
    types = table(spark, folder, "field_types")
    wide = widen(table(spark, folder, "attr_cells"), types, "row_id")
    cells = []
    for a in attributes(types):
        values = F.col(a.column) if a.many else F.array(a.column)
        numbers = values.cast("array<double>") if a.vtype == "Float" else F.lit(None).cast("array<double>")
        texts = F.lit(None).cast("array<string>") if a.vtype == "Float" else values.cast("array<string>")
        cells.append(F.when(F.col(a.column).isNotNull(), F.struct(F.lit(a.column).alias("column_name"), numbers.alias("numbers"), texts.alias("texts"))))
    return wide.select("row_id", F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


QUERIES = {"p4_found": p4_found, "p4_wide": p4_wide, "p4_wide_cells": p4_wide_cells}

_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

_CELLS = f"""
with c as (select a.cell_id, a.loaded_at, a.row_id, a.blob_name, f.attr, f.vtype, f.num, trim(a.cell_value) as v, upper(trim(a.attr)) = upper(f.attr) as exact
           from attr_cells a join field_types f on a.blob_name = f.blob_name
            and regexp_replace(upper(trim(a.attr)), '^' || upper(a.blob_name) || '_', '') = upper(f.attr)
           where a.row_id is not null and trim(a.cell_value) not in ('', '.')),
     e as (select *, list_transform(case when num in ('0', '1') then [v] else str_split(v, ',') end, lambda x: case when trim(x) in ('', '.') then null else trim(x) end) as xs from c),
     k as (select *, len(list_filter(xs, lambda x: x is not null)) > 0 and len(list_filter(xs, lambda x: x is not null and not coalesce(case when vtype = 'String' then true when vtype = 'Flag' then x in ('0', '1')
                   when vtype = 'Float' then regexp_matches(x, '{_NUMBER}') else regexp_matches(x, '{_NUMBER}') and try_cast(x as double) = floor(try_cast(x as double)) end, false))) = 0 as ok from e),
     p as (select *, row_number() over (partition by row_id, blob_name, attr order by exact desc, loaded_at desc nulls last, cell_id desc) as nth from k where ok)
select row_id, blob_name || '_' || attr as column_name, case when vtype = 'Float' then list_transform(xs, lambda x: cast(x as double)) end as numbers,
       case when vtype = 'Integer' then list_transform(xs, lambda x: cast(coalesce(try_cast(x as bigint), try_cast(try_cast(x as double) as bigint)) as varchar))
            when vtype = 'Flag' then list_transform(xs, lambda x: case when x = '1' then 'true' else 'false' end) when vtype = 'String' then xs end as texts
from p where nth = 1"""

SQL = {
    "p4_wide_cells": _CELLS,
    "p4_found": f"""
with c as (select a.row_id, a.blob_name, f.attr, f.vtype, f.num, trim(a.cell_value) as v
           from attr_cells a join field_types f on a.blob_name = f.blob_name
            and regexp_replace(upper(trim(a.attr)), '^' || upper(a.blob_name) || '_', '') = upper(f.attr)
           where a.row_id is not null and trim(a.cell_value) not in ('', '.')),
     e as (select distinct row_id, blob_name, attr, vtype, v, case when num in ('0', '1') then [v] else str_split(v, ',') end as xs from c),
     x as (select row_id, blob_name, attr, vtype, v, unnest(xs) as x0, generate_subscripts(xs, 1) as i from e),
     t as (select *, case when trim(x0) in ('', '.') then null else trim(x0) end as x from x),
     y as (select row_id, blob_name, attr, v, bool_and(case when x is null then true when vtype = 'String' then true when vtype = 'Flag' then x in ('0', '1')
                   when vtype = 'Float' then regexp_matches(x, '{_NUMBER}')
                   else regexp_matches(x, '{_NUMBER}') and coalesce(try_cast(x as double) = floor(try_cast(x as double)), false) end) as ok,
                  count(x) as n, string_agg(case when x is null then '.' when vtype in ('Integer', 'Float') then coalesce(cast(try_cast(x as double) as varchar), x) else x end, ',' order by i) as canon
           from t group by row_id, blob_name, attr, v)
select distinct row_id, blob_name, attr, 'untypable' as issue from y where not ok
union all
select row_id, blob_name, attr, 'conflict' from y where ok and n > 0 group by row_id, blob_name, attr having count(distinct canon) > 1""",
}
