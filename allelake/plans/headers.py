"""p3: declarations that change from file to file of a centre, and one consistent table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators.drift import consistent, header_changes, parsed_headers, undeclared_keys
from allelake.session import table, written


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each change of a header against the one before it of its centre, and the keys used without a declaration."""
    headers = table(spark, folder, "vcf_headers")
    parsed = written(parsed_headers(headers, "uri_id", "header"), "headers")
    changes = header_changes(table(spark, folder, "sample_uris"), headers, parsed=parsed)
    loose = undeclared_keys(table(spark, folder, "data_array"), headers, parsed=parsed)
    loose = loose.select("file", "blob_name", "field_name", F.lit("").alias("old_name"), F.lit("undeclared").alias("change_kind"))
    return changes.unionByName(loose).withColumnRenamed("file", "uri_id")


def p3_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Info and fmt of every record under one name per field, as sorted key=value text, and values that another spelling in the same record overrules."""
    changes = header_changes(table(spark, folder, "sample_uris"), table(spark, folder, "vcf_headers"))
    maps = consistent(table(spark, folder, "data_array"), changes, "row_id")
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return maps.select("row_id", text(F.col("info")).alias("info_text"), text(F.col("fmt")).alias("fmt_text"), "info_clashes", "fmt_clashes")


QUERIES = {"p3_found": p3_found, "p3_consistent": p3_consistent}

_QUOTED = '"(?:[^"\\\\]|\\\\.)*"'

_CHANGES = f"""
with l as (select uri_id, trim(unnest(string_split_regex(header, '\\r\\n|\\n|\\r'))) as line from vcf_headers where header is not null),
     p as (select uri_id, line, regexp_replace(line, '{_QUOTED}', '""', 'g') as bare from l where line like '##INFO=<%' or line like '##FORMAT=<%'),
     d as (select uri_id, case when line like '##INFO%' then 'info' else 'fmt' end as blob_name,
                  trim(regexp_extract(bare, '[<,]\\s*ID\\s*=\\s*([^,>]*)', 1)) as name,
                  trim(regexp_extract(bare, '[<,]\\s*Type\\s*=\\s*([^,>]*)', 1)) || '/' || trim(regexp_extract(bare, '[<,]\\s*Number\\s*=\\s*([^,>]*)', 1)) as kind,
                  regexp_replace(lower(regexp_extract(line, '[<,]\\s*Description\\s*=\\s*"((?:[^"\\\\]|\\\\.)*)"', 1)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as note
           from p where regexp_extract(bare, '[<,]\\s*ID\\s*=\\s*([^,>]*)', 1) <> ''),
     u as (select uri_id, lag(uri_id) over (partition by centre order by written_at, uri_id) as before
           from sample_uris where centre is not null and written_at is not null and uri_id in (select uri_id from vcf_headers where header is not null)),
     n as (select u.uri_id, d.blob_name, d.name, d.kind, d.note from u join d using (uri_id) where before is not null),
     o as (select u.uri_id, d.blob_name, d.name, d.kind, d.note from u join d on d.uri_id = u.before),
     come as (select * from n anti join o using (uri_id, blob_name, name)),
     gone as (select * from o anti join n using (uri_id, blob_name, name)),
     ren as (select come.uri_id, blob_name, come.name as name, gone.name as old, come.kind <> gone.kind as differs from come join gone using (uri_id, blob_name, note) where note <> '')"""

SQL = {
    "p3_found": f"""{_CHANGES}
select uri_id, blob_name, name as field_name, old as old_name, 'renamed' as change_kind from ren
union all select uri_id, blob_name, name, '', 'added' from come anti join ren using (uri_id, blob_name, name)
union all select uri_id, blob_name, name, '', 'removed' from gone anti join (select uri_id, blob_name, old as name from ren) using (uri_id, blob_name, name)
union all select uri_id, blob_name, name, '', 'retyped' from n join o using (uri_id, blob_name, name) where n.kind <> o.kind
union all select uri_id, blob_name, name, '', 'retyped' from ren where differs
union all
select k.uri_id, k.blob_name, k.name, '', 'undeclared'
from (select distinct uri_id, blob_name, trim(split_part(part, '=', 1)) as name
      from (select uri_id, 'info' as blob_name, unnest(string_split(info, ';')) as part from data_array union all select uri_id, 'fmt', unnest(string_split(fmt, ';')) from data_array)) k
anti join d using (uri_id, blob_name, name) where k.name not in ('', '.')""",
    "p3_consistent": f"""{_CHANGES.replace('with l as', 'with recursive l as', 1)},
     link as (select distinct blob_name, name as a, old as b from ren union select distinct blob_name, old, name from ren),
     reach as (select blob_name, a, b from link union select reach.blob_name, reach.a, link.b from reach join link on link.blob_name = reach.blob_name and link.a = reach.b),
     canon as (select blob_name, a, least(a, min(b)) as c from reach group by blob_name, a),
     part as (select row_id, 'info' as blob_name, unnest(string_split(info, ';')) as p, generate_subscripts(string_split(info, ';'), 1) as i from data_array where info is not null
              union all select row_id, 'fmt', unnest(string_split(fmt, ';')), generate_subscripts(string_split(fmt, ';'), 1) from data_array where fmt is not null),
     pair as (select row_id, blob_name, i, trim(split_part(p, '=', 1)) as k, case when contains(p, '=') then substr(p, instr(p, '=') + 1) else '1' end as v from part where trim(p) not in ('', '.')),
     named as (select row_id, pair.blob_name, i, coalesce(c, k) as k, v from pair left join canon on canon.blob_name = pair.blob_name and canon.a = pair.k),
     ranked as (select *, first_value(v) over (partition by row_id, blob_name, k order by i desc) as kept, row_number() over (partition by row_id, blob_name, k order by i desc) as nth from named),
     texts as (select row_id, blob_name, string_agg(k || '=' || v, ';' order by k || '=' || v) filter (nth = 1) as text,
                      list_sort(list(distinct k || '=' || v) filter (v <> kept)) as clashes from ranked group by row_id, blob_name)
select d.row_id, coalesce(a.text, '') as info_text, coalesce(b.text, '') as fmt_text, coalesce(a.clashes, []) as info_clashes, coalesce(b.clashes, []) as fmt_clashes
from data_array d left join texts a on a.row_id = d.row_id and a.blob_name = 'info' left join texts b on b.row_id = d.row_id and b.blob_name = 'fmt'""",
}
