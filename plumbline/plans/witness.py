"""Data witnesses: what a rule of the catalog means in rows, measured on real tables.

Each query is one declarative plan; the same statement, where the dialects agree, is what the checking engine runs.
``{name}`` stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import table

_HOLE = re.compile(r"\{(\w+)\}")

# name: statement, or (statement here, statement of the checking engine)
WITNESSES: dict[str, str | tuple[str, str]] = {
    # predicates an index can't seek on, and their rewrites
    "w_year_function_vs_range": "select 'function' as form, count(*) as n from {orders} where year(o_orderdate) = 1997 union all select 'range', count(*) from {orders} where o_orderdate >= timestamp '1997-01-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00'",
    "w_case_fold": "select 'folded' as form, count(*) as n from {orders} where upper(o_orderpriority) = '1-URGENT' union all select 'bare', count(*) from {orders} where o_orderpriority = '1-URGENT'",
    "w_column_arithmetic": "select 'arithmetic' as form, count(*) as n from {lineitem} where l_quantity + 0 = 5 union all select 'bare', count(*) from {lineitem} where l_quantity = 5",
    "w_leading_wildcard": "select p_brand, count(*) as n from {part} where p_name like '%ring' group by p_brand",
    "w_like_without_wildcard": "select 'like' as form, count(*) as n from {part} where p_type like 'ECONOMY' union all select 'equals', count(*) from {part} where p_type = 'ECONOMY'",
    "w_left_prefix": "select 'left' as form, count(*) as n from {part} where left(p_name, 3) = 'sma' union all select 'like', count(*) from {part} where p_name like 'sma%'",
    "w_regexp_prefix": ("select lang, count(*) as n from {documents} where text rlike '^CREATE' group by lang", "select lang, count(*) as n from documents where regexp_matches(text, '^CREATE') group by lang"),
    # silent loss on write
    "w_scale_narrowing": "select l_returnflag, count(*) as n from {lineitem} where cast(l_extendedprice as decimal(14,1)) <> cast(l_extendedprice as decimal(14,2)) group by l_returnflag",
    "w_exact_truncation": "select l_returnflag, count(*) as n from {lineitem} where floor(l_extendedprice) <> l_extendedprice group by l_returnflag",
    "w_length_truncation": "select p_type, count(*) as n, max(length(p_name)) as longest from {part} where length(p_name) > 10 group by p_type",
    "w_temporal_precision": "select event_type, count(*) as n from {events} where date_trunc('day', ts) <> ts group by event_type",
    "w_temporal_scale": "select event_type, count(*) as n from {events} where date_trunc('second', ts) <> ts group by event_type",
    "w_unicode_loss": (r"select lang, count(*) as n from {documents} where text rlike '[^\\x00-\\x7F]' group by lang", r"select lang, count(*) as n from documents where regexp_matches(text, '[^\x00-\x7F]') group by lang"),
    "w_between_end_of_day": "select 'between' as form, count(*) as n from {events} where ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-02 23:59:59' union all select 'half-open', count(*) from {events} where ts >= timestamp '2024-01-02 00:00:00' and ts < timestamp '2024-01-03 00:00:00'",
    # three-valued logic
    "w_not_in_null_trap": "select 'not in' as form, count(*) as n from {customer} where c_custkey not in (select nullif(o_custkey, 5) from {orders}) union all select 'not exists', count(*) from {customer} c where not exists (select 1 from {orders} o where nullif(o.o_custkey, 5) = c.c_custkey)",
    "w_equals_null": "select 'equals' as form, count(*) as n from {documents} where lang = null union all select 'is null', count(*) from {documents} where lang is null",
    "w_check_unknown_passes": "select kind, count_if((length(detail_text) > 5) is null) as unknown, count_if(length(detail_text) > 5) as passed, count(*) as n from {duplication_findings} group by kind",
    "w_plus_null_propagation": "select kind, count(*) as n, count(coalesce(module_qualified_name, '') || coalesce(detail_text, '')) as kept_coalesce, count(module_qualified_name || detail_text) as kept from {duplication_findings} group by kind",
    "w_case_missing_else": "select l_returnflag, count_if(case l_linestatus when 'O' then 1 end is null) as nulls from {lineitem} group by l_returnflag",
    "w_not_null_contradiction": "select count_if(o_orderkey is null) as null_keys, count(*) as n from {orders}",
    # joins
    "w_outer_join_collapse": "select 'left' as form, count(*) as n from {customer} c left join {orders} o on o.o_custkey = c.c_custkey where o.o_orderstatus = 'F' union all select 'inner', count(*) from {customer} c join {orders} o on o.o_custkey = c.c_custkey where o.o_orderstatus = 'F'",
    "w_cartesian": "select r_name, count(*) as n from {region} cross join {nation} group by r_name",
    "w_contradictory_join": "select count(*) as n from {orders} o join {customer} c on o.o_custkey = c.c_custkey and 1 = 0",
    "w_partial_key_fanout": "select l_linenumber, count(*) as n_rows, count(distinct l_orderkey) as n_orders from {lineitem} group by l_linenumber",
    "w_distinct_masks_fanout": "select 'joined' as form, count(*) as n from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey union all select 'distinct', count(*) from (select distinct o.o_orderkey from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey) d",
    "w_nonunique_update_source": "select l_orderkey, count(*) as n_sources, min(l_extendedprice) as least, max(l_extendedprice) as most from {lineitem} group by l_orderkey having count(*) > 1",
    "w_fk_orphans": "select 'orders' as child, count(*) as n from {orders} o where not exists (select 1 from {customer} c where c.c_custkey = o.o_custkey and c.c_mktsegment <> 'BUILDING') union all select 'lineitem', count(*) from {lineitem} l where not exists (select 1 from {orders} o where o.o_orderkey = l.l_orderkey and o.o_orderstatus <> 'P')",
    "w_lateral_apply": "select c.c_mktsegment, count(t.o_orderkey) as n from {customer} c left join lateral (select o.o_orderkey from {orders} o where o.o_custkey = c.c_custkey and o.o_totalprice > 100000) t on true group by c.c_mktsegment",
    "w_semi_vs_join": "select 'exists' as form, count(*) as n from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey) union all select 'in', count(*) from {customer} where c_custkey in (select o_custkey from {orders})",
    # aggregates and grouping
    "w_having_on_key": "select o_orderstatus, count(*) as n from {orders} group by o_orderstatus having o_orderstatus <> 'P'",
    "w_grouping_sets": "select l_returnflag, l_linestatus, grouping(l_returnflag) as g1, grouping(l_linestatus) as g2, count(*) as n from {lineitem} group by cube(l_returnflag, l_linestatus)",
    "w_rollup": "select l_returnflag, l_linestatus, count(*) as n, sum(cast(l_quantity as bigint)) as qty from {lineitem} group by rollup(l_returnflag, l_linestatus)",
    "w_explicit_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "w_float_vs_decimal_sum": "select l_returnflag, sum(cast(l_extendedprice as decimal(18,2))) as exact_sum, round(sum(l_extendedprice), 0) as rounded from {lineitem} group by l_returnflag",
    "w_count_star_vs_exists": "select 'count' as form, case when count(*) > 0 then 1 else 0 end as found from {orders} where o_totalprice > 1000 union all select 'exists', case when exists (select 1 from {orders} where o_totalprice > 1000) then 1 else 0 end",
    "w_pivot": ("select * from (select o_orderpriority, o_orderstatus, o_orderkey from {orders}) pivot (count(o_orderkey) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))", "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as f, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as o, nullif(count(*) filter (where o_orderstatus = 'P'), 0) as p from orders group by o_orderpriority"),
    "w_unpivot": ("select kind, count(*) as n, round(sum(amount), 0) as total from (select l_discount, l_tax from {lineitem}) unpivot (amount for kind in (l_discount, l_tax)) group by kind", "select kind, count(*) as n, round(sum(amount), 0) as total from (select 'l_discount' as kind, l_discount as amount from lineitem union all select 'l_tax', l_tax from lineitem) group by kind"),
    "w_string_agg": ("select o_orderstatus, listagg(distinct o_orderpriority, ',') within group (order by o_orderpriority) as priorities from {orders} group by o_orderstatus", "select o_orderstatus, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities from orders group by o_orderstatus"),
    "w_statistics": "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sdp, round(var_samp(l_quantity), 4) as v, round(var_pop(l_quantity), 4) as vp from {lineitem} group by l_returnflag",
    # windows
    "w_range_vs_rows": "select count(*) as n, count_if(r <> k) as differ from (select sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate range between unbounded preceding and current row) as r, sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as k from {orders}) t",
    "w_ranking_functions": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn, rank() over (partition by o_custkey order by o_orderdate) as rk, dense_rank() over (partition by o_custkey order by o_orderdate) as dr, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as nt from {orders}",
    "w_lag_lead": "select o_custkey, o_orderkey, lag(o_orderkey, 1) over (partition by o_custkey order by o_orderdate, o_orderkey) as before_key, lead(o_orderkey, 1) over (partition by o_custkey order by o_orderdate, o_orderkey) as after_key from {orders}",
    "w_percent_rank": "select o_custkey, o_orderkey, round(percent_rank() over (partition by o_custkey order by o_orderdate), 6) as pr, round(cume_dist() over (partition by o_custkey order by o_orderdate), 6) as cd from {orders}",
    "w_percentile_cont": "select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as median, percentile_cont(0.9) within group (order by l_quantity) as p90 from {lineitem} group by l_returnflag",
    "w_top_total_order": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20",
    "w_offset_fetch": "select o_orderkey from {orders} order by o_orderdate, o_orderkey limit 10 offset 20",
    # set operations and CTEs
    "w_union_disjoint": "select 'union' as form, count(*) as n from (select o_orderkey from {orders} where o_orderstatus = 'F' union select o_orderkey from {orders} where o_orderstatus = 'O') a union all select 'union all', count(*) from (select o_orderkey from {orders} where o_orderstatus = 'F' union all select o_orderkey from {orders} where o_orderstatus = 'O') b",
    "w_intersect_except": "select 'intersect' as form, count(*) as n from (select c_nationkey from {customer} intersect select s_nationkey from {supplier}) a union all select 'except', count(*) from (select c_custkey from {customer} except select o_custkey from {orders} where o_orderstatus = 'P') b",
    "w_recursive_closure": "with recursive steps(n, v) as (select 1, 1 union all select n + 1, v * 2 from steps where n < 12) select n, v from steps",
    "w_multi_referenced_cte": "with big as (select o_custkey, count(*) as k from {orders} group by o_custkey) select 'a' as side, count(*) as n from big where k > 5 union all select 'b', count(*) from big where k <= 5",
    "w_view_closure": "with recursive edges as (select 'v3' as a, 'v2' as b union all select 'v2', 'v1' union all select 'v1', 't' union all select 'v3', 't'), walk(a, b, d) as (select a, b, 1 from edges union all select w.a, e.b, w.d + 1 from walk w join edges e on e.a = w.b where w.d < 8) select a, b, min(d) as depth from walk group by a, b",
    # keys, merge, DDL replay
    "w_duplicate_merge_source": "select finding_id, count(*) as n from {duplication_findings} group by finding_id having count(*) > 1",
    "w_ignore_dup_key": "select count(*) as n_rows, count(distinct finding_id) as kept, count(*) - count(distinct finding_id) as dropped from {deprecated_syntax_findings}",
    "w_key_uniqueness": "select 'orders' as t, count(*) as n, count(distinct o_orderkey) as d from {orders} union all select 'lineitem', count(*), count(distinct l_orderkey * 100 + l_linenumber) from {lineitem}",
    "w_identity_headroom": "select 'orders' as t, max(o_orderkey) as most, round(cast(max(o_orderkey) as double) / 2147483647, 9) as share from {orders} union all select 'findings', max(finding_id), round(cast(max(finding_id) as double) / 2147483647, 9) from {duplication_findings}",
    "w_latest_delivery": "select finding_id, kind, ingested_at from (select finding_id, kind, ingested_at, row_number() over (partition by finding_id order by ingested_at desc, kind) as k from {duplication_findings}) t where k = 1",
    # text and security
    "w_long_lines": ("select lang, count(*) as n from (select lang, explode(split(text, '\\n')) as line from {documents}) t where length(line) > 200 group by lang", "select lang, count(*) as n from (select lang, unnest(string_split(text, chr(10))) as line from documents) t where length(line) > 200 group by lang"),
    "w_tab_lines": ("select source, count(*) as n from {documents} where instr(text, '\\t') > 0 group by source", "select source, count(*) as n from documents where instr(text, chr(9)) > 0 group by source"),
    "w_module_lines": ("select object_type_code, count(*) as n, max(size(split(definition, '\\n'))) as most from {live_modules} where definition is not null group by object_type_code", "select object_type_code, count(*) as n, max(len(string_split(definition, chr(10)))) as most from live_modules where definition is not null group by object_type_code"),
    "w_repeated_texts": "select text, count(*) as n from {documents} where text is not null group by text having count(*) > 1",
    "w_dotted_quads": (r"select lang, count(*) as n from {documents} where text rlike '(^|[^0-9.])[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}([^0-9.]|$)' group by lang", r"select lang, count(*) as n from documents where regexp_matches(text, '(^|[^0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}([^0-9.]|$)') group by lang"),
    "w_task_comments": ("select object_type_code, count(*) as n from {live_modules} where definition rlike '(?i)(select|update)' group by object_type_code", "select object_type_code, count(*) as n from live_modules where regexp_matches(definition, '(?i)(select|update)') group by object_type_code"),
    "w_string_split": ("select w, count(*) as n from (select explode(split(p_name, ' ')) as w from {part}) t group by w", "select w, count(*) as n from (select unnest(string_split(p_name, ' ')) as w from part) t group by w"),
    "w_weak_hash": "select c_mktsegment, md5(c_mktsegment) as weak, count(*) as n from {customer} group by c_mktsegment",
    "w_replicate_length": "select count_if(length(repeat(p_name, 900)) > 8000) as over_cap, count(*) as n from {part}",
    "w_datefirst": ("select weekday(o_orderdate) as monday_is_0, count(*) as n from {orders} group by weekday(o_orderdate)", "select cast(isodow(o_orderdate) - 1 as int) as monday_is_0, count(*) as n from orders group by 1"),
    # JSON and vectors
    "w_json_property": ("select get_json_object(props, '$.k') as k, count(*) as n from {events} group by get_json_object(props, '$.k')", "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1"),
    "w_vector_dimension": ("select size(embedding) as dims, count(*) as n from {embeddings} group by size(embedding)", "select len(embedding) as dims, count(*) as n from embeddings group by 1"),
    "w_vector_norm": ("select label, count(*) as n, round(sum(sqrt(aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)))), 3) as norms from {embeddings} group by label", "select label, count(*) as n, round(sum(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))))), 3) as norms from embeddings group by label"),
    # the catalog rules over index and key records
    "c_disabled_index": ("select distinct table_qualified_name as object, name as detail from {cat_indexes} where is_disabled", "select distinct table_qualified_name as object, name as detail from cat_indexes where is_disabled"),
    "c_untrusted_foreign_key": "select distinct parent_table_qualified_name as object, constraint_name as detail from {foreign_keys} where is_not_trusted",
    "c_cascading_foreign_key": "select distinct parent_table_qualified_name as object, constraint_name as detail from {foreign_keys} where lower(delete_action) <> 'noaction' or lower(update_action) <> 'noaction'",
    "c_filtered_share": "select kind, count_if(is_filtered) as filtered, count_if(is_clustered) as clustered, count(*) as n from {cat_indexes} group by kind",
    "c_parity_by_facet": "select list_name, facet, count(*) as n, count_if(coalesce(inferred_value <> actual_value, false)) as differ from {lineage_parity} group by list_name, facet",
}


def _build(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(_HOLE.findall(statement)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(statement, **{n: table(spark, sf_dir, n) for n in names})

    run.__doc__ = statement
    return run


QUERIES = {k: _build(v if isinstance(v, str) else v[0]) for k, v in WITNESSES.items()}
ORACLE = {k: _HOLE.sub(r"\1", v) if isinstance(v, str) else v[1] for k, v in WITNESSES.items()}
