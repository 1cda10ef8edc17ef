"""Queries of problem 1: unigram lines and data points that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.session import table
from keyloom.sources.unigrams import load_unigrams, parse_points, rejected_records

_P = "[0-9]{4},[0-9]+,[0-9]+"
_TOKEN = '("([^"]|"")+"|[^"\\t]+)'
_RIGHT = (
    "list_bool_and(list_transform({p}, lambda x: coalesce(split_part(x,',',1)::int between 1470 and 2019 and try_cast(split_part(x,',',2) as bigint) >= 1 "
    "and try_cast(split_part(x,',',3) as bigint) between 1 and try_cast(split_part(x,',',2) as bigint), false)))"
)
_LINES = f"""u as (select distinct line_id, line from unigram_lines),
a as (select line_id, line, regexp_full_match(line, '{_TOKEN}(\\t({_P}|"{_P}"))+') ok,
  regexp_extract(line, '^{_TOKEN}') tok,
  regexp_extract_all(regexp_replace(line, '^{_TOKEN}', ''), '\\t"?({_P})"?', 1) pts from u),
b as (select *, ok and {_RIGHT.format(p="pts")} fine from a)"""
_POINTS = f"""v as (select distinct point_id, line_id, word, data_point from data_points),
c as (select *, regexp_full_match(data_point, '{_P}|"{_P}"') and {_RIGHT.format(p="[trim(data_point, chr(34))]")} fine from v
  where regexp_full_match(data_point, '{_P}|"{_P}"'))"""
_FIELD = '("([^"]|"")*"|[^"\\t]*)'
_BARE = "case when {0}[1] = '\"' then replace({0}[2:-2], '\"\"', '\"') else {0} end"
_REASON = f"""case when p = '' then 'empty point' when len(string_split(p, ',')) <> 3 then 'point without three numbers' when not regexp_full_match(p, '{_P}') then 'point with an invalid number'
  when try_cast(split_part(p, ',', 2) as bigint) is null or try_cast(split_part(p, ',', 3) as bigint) is null then 'count beyond 64 bits' when split_part(p, ',', 1)::int not between 1470 and 2019 then 'year out of range'
  when try_cast(split_part(p, ',', 2) as bigint) < 1 then 'match count below 1' when try_cast(split_part(p, ',', 3) as bigint) not between 1 and try_cast(split_part(p, ',', 2) as bigint) then 'volume count out of range' end"""
_REASONS = f"""l as (select distinct line_id, line, regexp_full_match(line, '{_FIELD}(\\t{_FIELD})*') whole from unigram_lines),
f as (select *, case when whole then regexp_extract_all(chr(9) || line, '\\t("(?:[^"]|"")*"|[^"\\t]*)', 1) end f from l),
p as (select line_id, line, place, {_BARE.format('x')} p from (select line_id, line, unnest(f[2:]) x, unnest(range(1, len(f))) place from f)),
w as (select line_id, line, arg_min({_REASON}, place) reason from p where {_REASON} is not null group by line_id, line),
a as (select f.line_id, case when f.line is null then 'null line' when not whole then 'broken quoting' when {_BARE.format('f[1]')} = '' then 'empty token' when len(f) < 2 then 'no data point' else w.reason end reason
  from f left join w on f.line_id is not distinct from w.line_id and f.line = w.line),
q as (select distinct point_id, data_point, {_BARE.format('data_point')} p, regexp_full_match(data_point, '{_FIELD}') whole from data_points),
b as (select point_id, case when data_point is null then 'null point' when not whole and contains(data_point, '"') then 'broken quoting' when not whole then 'more than one field' else {_REASON} end reason from q),
r as (select 'unigram_lines' src_table, line_id record_id, reason from a union all select 'data_points', point_id, reason from b),
m as (select src_table, record_id, min(reason) reason from r where reason is not null group by src_table, record_id)"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_records(table(spark, d, "unigram_lines"), table(spark, d, "data_points")).select("src_table", "record_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = rejected_records(table(spark, d, "unigram_lines"), table(spark, d, "data_points"))
    return found.groupBy("src_table", "reason").agg(F.count("*").alias("records"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_unigrams(table(spark, d, "unigram_lines"))[0]


def p1_loaded_points(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "data_points").select("point_id", "line_id", "word", "data_point").dropDuplicates()
    good = parse_points(once).filter("kl_reason IS NULL")
    return good.select("point_id", "line_id", "word", "kl_point.year", "kl_point.match_count", "kl_point.volume_count")


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p1_loaded": p1_loaded, "p1_loaded_points": p1_loaded_points}

SQL = {
    "p1_reasons": f"with {_REASONS} select src_table, reason, count(*) as records from m group by src_table, reason",
    "p1_found": f"""with {_LINES}, {_POINTS}
select 'unigram_lines' as src_table, line_id as record_id from b where not coalesce(fine, false)
union all select 'data_points', point_id from (select distinct point_id from data_points) where point_id not in (select point_id from c where fine)""",
    "p1_loaded": f"""with {_LINES}, e as (select line_id, case when tok[1] = '"' then replace(tok[2:-2], '""', '"') else tok end as word, unnest(pts) p from b where fine)
select line_id, word, split_part(p,',',1)::int as year, split_part(p,',',2)::bigint as match_count, split_part(p,',',3)::bigint as volume_count from e""",
    "p1_loaded_points": f"""with {_POINTS}, e as (select point_id, line_id, word, trim(data_point, '"') p from c where fine)
select point_id, line_id, word, split_part(p,',',1)::int as year, split_part(p,',',2)::bigint as match_count, split_part(p,',',3)::bigint as volume_count from e""",
}
