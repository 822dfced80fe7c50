"""Rules over a database catalog: each is a query over the relations of ``SCHEMAS`` that returns ``(object, detail)``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COLTYPE = "type string, max_length int, precision int, scale int, collation string, is_max boolean"
#: The catalog's relations. Names are qualified and in one spelling, types in lower case, lengths in bytes.
SCHEMAS = {
    "cat_tables": "table_name string, kind string, is_memory_optimized boolean, is_schema_only boolean, is_ledger boolean, is_partitioned boolean, partition_scheme string, partition_column string, has_fulltext boolean, has_rule boolean, filegroup string, is_readonly boolean, is_ms_shipped boolean",
    "cat_columns": f"table_name string, column_name string, ordinal int, {_COLTYPE}, is_nullable boolean, is_identity boolean, identity_seed double, identity_increment double, identity_current double, is_computed boolean, is_persisted boolean, definition string, encryption string, encryption_key string, is_enclave boolean, is_masked boolean, is_sparse boolean, is_ansi_padded boolean, generated_always string, default_definition string, declared string, is_temporal boolean",
    "cat_indexes": "table_name string, name string, kind string, is_unique boolean, key_columns array<string>, included_columns array<string>, key_column_is_descending array<boolean>, is_filtered boolean, is_clustered boolean, is_disabled boolean, is_columnstore boolean, is_hypothetical boolean, is_json boolean, filter_definition string, filter_columns array<string>, partition_scheme string, allow_row_locks boolean, allow_page_locks boolean, optimize_sequential boolean, ignore_dup_key boolean",
    "cat_fks": "constraint_name string, parent_table string, parent_column string, referenced_table string, referenced_column string, is_not_trusted boolean, is_disabled boolean, delete_action string, update_action string",
    "cat_checks": "constraint_name string, table_name string, definition string, is_disabled boolean, is_not_trusted boolean, columns array<string>, null_tested array<string>",
    "cat_stats": "table_name string, name string, columns array<string>, no_recompute boolean",
    "cat_triggers": "trigger_name string, table_name string, event string, is_after boolean, is_disabled boolean, is_first boolean, is_last boolean",
    "cat_temporal": "current_table string, history_table string",
    "cat_secpred": "policy string, table_name string, kind string, is_enabled boolean, columns array<string>",
    "cat_types": "type_name string, schema_name string, is_alias boolean, is_clr boolean",
    "alter_events": "table_name string, column_name string, old_type string, old_length int, old_precision int, old_scale int, new_type string, new_length int, new_precision int, new_scale int, is_online boolean",
    "rebuild_events": "table_name string, target string, index_name string, is_online boolean, partition int",
    "switch_events": "source_table string, target_table string, partition int",
    "drop_events": "kind string, name string",
    "cat_objects": "schema_name string, object_name string",
    "dbconfig": "database_name string, collation string, compat int, engine_default int, page_verify string, auto_shrink boolean, auto_close boolean, target_recovery_time int, query_store_state string, query_store_capture string, auto_create_stats boolean, auto_update_stats boolean, rcsi boolean, recursive_triggers boolean, forced_parameterization boolean",
    "plan_guides": "name string, is_disabled boolean",
    "disabled_on_compat": "object_name string, index_name string",
}

# Closed lists of types.
_LOB = "('text','ntext','image')"
_STR = "('char','varchar','nchar','nvarchar','text','ntext')"
_ACTIVE = "not i.is_disabled and not coalesce(i.is_hypothetical, false)"
_ROWSTORE = "not coalesce({0}.is_columnstore, false) and not coalesce({0}.is_json, false) and not {0}.is_disabled and not coalesce({0}.is_filtered, false) and not coalesce({0}.is_hypothetical, false)"
_PAIR = f"cat_indexes x join cat_indexes y on x.table_name = y.table_name and x.name <> y.name and x.is_unique = y.is_unique and x.kind = y.kind and {_ROWSTORE.format('x')} and {_ROWSTORE.format('y')}"
_INC = "coalesce({0}.included_columns, array())"


def _col(where: str) -> str:
    return f"select concat(c.table_name, '.', c.column_name) as object, c.type as detail from cat_columns c where {where}"


def _mem(extra: str) -> str:
    return f"from cat_tables t {extra} and t.is_memory_optimized"


def _db(where: str, what: str) -> str:
    return f"select database_name as object, cast({what} as string) as detail from dbconfig where {where}"


_SWITCH = "from switch_events s join cat_tables a on a.table_name = s.source_table join cat_tables b on b.table_name = s.target_table"
_SW = "select concat(s.source_table, ' > ', s.target_table) as object, "
_KEYCOL = "(select table_name, name, k, pos, is_clustered, kind, is_disabled, is_hypothetical from cat_indexes lateral view posexplode(key_columns) e as pos, k)"

CATALOG_RULES: dict[str, str] = {
    # columns
    "catalog/column-collation-drift": "select concat(c.table_name, '.', c.column_name) as object, c.collation as detail from cat_columns c join dbconfig d where c.type in " + _STR + " and c.collation is not null and lower(c.collation) <> lower(d.collation)",
    "catalog/column-ansi-padding-off": _col("not c.is_ansi_padded and c.type in ('varchar','nvarchar','varbinary')"),
    "catalog/max-typed-column": _col("c.is_max or c.type = 'json'"),
    "catalog/legacy-large-object-column": _col(f"c.type in {_LOB}"),
    "index-design/deprecated-lob-column-type": _col(f"c.type in {_LOB}"),
    "index-design/timestamp-column-naming": _col("c.type = 'timestamp'"),
    "catalog/always-encrypted-unsupported-data-type": _col("c.encryption is not null and c.type in ('xml','timestamp','rowversion','image','ntext','text','sql_variant','hierarchyid','geography','geometry','json','vector')"),
    "catalog/always-encrypted-identity-column": _col("c.encryption is not null and c.is_identity"),
    "catalog/sparse-column-disallowed-type": _col("c.is_sparse and c.type in ('text','ntext','image','geography','geometry','timestamp','rowversion','json','vector')"),
    "catalog/legacy-lob-utf8-collation": _col("c.type in ('text','ntext') and c.collation rlike '(?i)_(UTF8|SC)(_|$)'"),
    "catalog/non-persisted-computed-column": _col("c.is_computed and not c.is_persisted"),
    "catalog/default-constraint-on-nullable-column": _col("c.default_definition is not null and c.is_nullable"),
    "identity/range-near-exhaustion": "select concat(table_name, '.', column_name) as object, type as detail from (select *, case type when 'tinyint' then if(identity_increment > 0, 255D, 0D) when 'smallint' then if(identity_increment > 0, 32767D, -32768D) when 'int' then if(identity_increment > 0, 2147483647D, -2147483648D) when 'bigint' then if(identity_increment > 0, 9223372036854775807D, -9223372036854775808D) end as bound from cat_columns where is_identity and identity_current is not null) where bound is not null and abs(identity_current - identity_seed) >= 0.9 * abs(bound - identity_seed)",
    # memory-optimized tables
    "catalog/memory-optimized-unsupported-column-type": "select concat(c.table_name, '.', c.column_name) as object, c.type as detail " + _mem("join cat_columns c on c.table_name = t.table_name where c.type in ('xml','json','sql_variant','text','ntext','image','timestamp','rowversion','hierarchyid','geometry','geography')"),
    "catalog/memory-optimized-utf8-collation": "select concat(c.table_name, '.', c.column_name) as object, c.collation as detail " + _mem("join cat_columns c on c.table_name = t.table_name where c.type in ('char','varchar') and c.collation rlike '(?i)_UTF8'"),
    "catalog/memory-optimized-ledger-conflict": "select t.table_name as object, '' as detail " + _mem("where t.is_ledger"),
    "catalog/memory-optimized-clustered-index": "select t.table_name as object, i.name as detail " + _mem("join cat_indexes i on i.table_name = t.table_name where i.is_clustered and not coalesce(i.is_columnstore, false)"),
    "catalog/memory-optimized-index-included-columns": "select t.table_name as object, i.name as detail " + _mem("join cat_indexes i on i.table_name = t.table_name where size(i.included_columns) > 0"),
    "catalog/memory-optimized-filtered-index": "select t.table_name as object, i.name as detail " + _mem("join cat_indexes i on i.table_name = t.table_name where i.is_filtered"),
    "catalog/memory-optimized-schema-only-durability": "select t.table_name as object, '' as detail " + _mem("where t.is_schema_only"),
    "catalog/memory-optimized-cross-storage-foreign-key": "select distinct f.parent_table as object, f.constraint_name as detail from cat_fks f join cat_tables p on p.table_name = f.parent_table join cat_tables r on r.table_name = f.referenced_table where p.is_memory_optimized <> r.is_memory_optimized",
    "catalog/memory-optimized-foreign-key-referential-action": "select distinct f.parent_table as object, f.constraint_name as detail from cat_fks f join cat_tables p on p.table_name = f.parent_table join cat_tables r on r.table_name = f.referenced_table where p.is_memory_optimized and r.is_memory_optimized and (lower(f.delete_action) <> 'noaction' or lower(f.update_action) <> 'noaction')",
    # keys and constraints
    "catalog/untrusted-foreign-key": "select distinct f.parent_table as object, f.constraint_name as detail from cat_fks f where f.is_not_trusted",
    "catalog/cascading-foreign-key": "select distinct f.parent_table as object, f.constraint_name as detail from cat_fks f where lower(f.delete_action) <> 'noaction' or lower(f.update_action) <> 'noaction'",
    "catalog/cross-table-fk-type-drift": "select concat(f.parent_table, '.', f.parent_column) as object, concat(p.type, ' ', r.type) as detail from cat_fks f join cat_columns p on p.table_name = f.parent_table and p.column_name = f.parent_column join cat_columns r on r.table_name = f.referenced_table and r.column_name = f.referenced_column where not (struct(p.type, p.max_length, p.precision, p.scale, p.collation) <=> struct(r.type, r.max_length, r.precision, r.scale, r.collation))",
    "catalog/untrusted-check-constraint": "select table_name as object, constraint_name as detail from cat_checks where is_not_trusted",
    "catalog/check-constraint-null-not-handled": "select k.table_name as object, k.constraint_name as detail from (select * from cat_checks lateral view explode(columns) e as col where not is_disabled) k join cat_columns c on c.table_name = k.table_name and c.column_name = k.col where c.is_nullable and not array_contains(k.null_tested, k.col)",
    "catalog/check-constraint-on-identity-column": "select k.table_name as object, k.constraint_name as detail from (select * from cat_checks lateral view explode(columns) e as col where not is_disabled) k join cat_columns c on c.table_name = k.table_name and c.column_name = k.col where c.is_identity",
    "statement-shape/table-with-no-primary-key": "select t.table_name as object, '' as detail from cat_tables t left anti join cat_indexes i on i.table_name = t.table_name and i.kind = 'PrimaryKey' where t.kind = 'Table'",
    "index-design/unindexed-foreign-key": f"select f.parent_table as object, f.constraint_name as detail from (select parent_table, constraint_name, collect_set(parent_column) as cols from cat_fks group by parent_table, constraint_name) f left anti join cat_indexes i on i.table_name = f.parent_table and {_ROWSTORE.format('i')} and size(i.key_columns) >= size(f.cols) and forall(slice(i.key_columns, 1, size(f.cols)), c -> array_contains(f.cols, c))",
    # indexes
    "index-design/duplicate-index": f"select x.table_name as object, concat_ws(' ', x.name, y.name) as detail from {_PAIR} where x.name < y.name and x.key_columns = y.key_columns",
    "index-design/subsumed-index": f"select x.table_name as object, concat_ws(' ', x.name, y.name) as detail from cat_indexes x join (select i.*, slice(i.key_columns, 1, k) as prefix from cat_indexes i lateral view explode(sequence(1, size(i.key_columns) - 1)) e as k where size(i.key_columns) > 1 and {_ROWSTORE.format('i')}) y on x.table_name = y.table_name and x.key_columns = y.prefix and x.is_unique = y.is_unique and x.kind = y.kind where x.name <> y.name and {_ROWSTORE.format('x')} and size(array_except({_INC.format('x')}, {_INC.format('y')})) = 0",
    "index-design/mergeable-indexes-differing-include-only": f"select x.table_name as object, concat_ws(' ', x.name, y.name) as detail from {_PAIR} where x.name < y.name and x.key_columns = y.key_columns and x.key_column_is_descending <=> y.key_column_is_descending and size(array_except({_INC.format('x')}, {_INC.format('y')})) > 0 and size(array_except({_INC.format('y')}, {_INC.format('x')})) > 0",
    "index-design/disabled-index": "select i.table_name as object, i.name as detail from cat_indexes i where i.is_disabled and not coalesce(i.is_hypothetical, false)",
    "index-design/hypothetical-index": "select i.table_name as object, i.name as detail from cat_indexes i where i.is_hypothetical",
    "index-design/non-unique-clustered-index": f"select i.table_name as object, i.name as detail from cat_indexes i where i.is_clustered and not i.is_unique and not coalesce(i.is_columnstore, false) and {_ACTIVE}",
    "index-design/heap-with-nonclustered-indexes": "select table_name as object, '' as detail from cat_indexes i where not is_disabled group by table_name having max(cast(is_clustered as int)) = 0 and max(cast(kind = 'PrimaryKey' as int)) = 0",
    "index-design/heap-with-nonclustered-primary-key": "select table_name as object, '' as detail from cat_indexes i where not is_disabled group by table_name having max(cast(is_clustered as int)) = 0 and max(cast(kind = 'PrimaryKey' as int)) = 1",
    "index-design/random-clustered-key-guid-default": "select i.table_name as object, i.name as detail from cat_indexes i join cat_columns c on c.table_name = i.table_name and c.column_name = get(i.key_columns, 0) where i.is_clustered and c.type = 'uniqueidentifier' and lower(c.default_definition) rlike '\\\\bnewid\\\\s*\\\\('",
    "index-design/filter-column-not-in-index": f"select i.table_name as object, i.name as detail from cat_indexes i where i.is_filtered and {_ACTIVE} and size(array_except(i.filter_columns, concat(i.key_columns, {_INC.format('i')}))) > 0",
    "index-design/float-or-real-index-key-column": f"select i.table_name as object, concat(i.name, ' ', i.k) as detail from {_KEYCOL} i join cat_columns c on c.table_name = i.table_name and c.column_name = i.k where c.type in ('float','real')",
    "index-design/variable-length-key-column-exceeds-key-limit": f"select i.table_name as object, i.name as detail from {_KEYCOL} i join cat_columns c on c.table_name = i.table_name and c.column_name = i.k group by i.table_name, i.name, i.is_clustered having sum(c.max_length) > if(i.is_clustered, 900, 1700) and max(cast(c.type in ('varchar','nvarchar','varbinary') as int)) = 1",
    "index-design/monotonic-clustered-key-missing-sequential-optimization": "select i.table_name as object, i.name as detail from cat_indexes i join cat_columns c on c.table_name = i.table_name and c.column_name = get(i.key_columns, 0) where i.is_clustered and c.is_identity and not coalesce(i.optimize_sequential, false)",
    "index-design/non-aligned-partitioned-index": f"select i.table_name as object, i.name as detail from cat_indexes i join cat_tables t on t.table_name = i.table_name where t.is_partitioned and {_ACTIVE} and (i.partition_scheme is null or i.partition_scheme <> t.partition_scheme)",
    "index-design/row-or-page-locking-disabled": f"select i.table_name as object, i.name as detail from cat_indexes i where {_ACTIVE} and (not i.allow_row_locks or not i.allow_page_locks)",
    "index-design/no-recompute-statistics": "select table_name as object, name as detail from cat_stats where no_recompute",
    "catalog/columnstore-unsupported-column-type": "select i.table_name as object, concat(i.name, ' ', c.column_name) as detail from (select * from cat_indexes lateral view explode(concat(coalesce(key_columns, array()), coalesce(included_columns, array()))) e as k where is_columnstore) i join cat_columns c on c.table_name = i.table_name and c.column_name = i.k where c.type in ('sql_variant','xml','hierarchyid','geometry','geography','ntext','text','image','timestamp','rowversion')",
    "catalog/always-encrypted-non-enclave-key-column": f"select distinct k.table_name as object, concat(k.name, ' ', k.k) as detail from (select table_name, name, k from {_KEYCOL} union all select table_name, name, k from cat_stats lateral view explode(columns) e as k) k join cat_columns c on c.table_name = k.table_name and c.column_name = k.k where upper(c.encryption) = 'RANDOMIZED' and not coalesce(c.is_enclave, false)",
    "catalog/temporal-history-index-gap": "select p.current_table as object, i.name as detail from cat_temporal p join cat_indexes i on i.table_name = p.current_table left anti join cat_indexes h on h.table_name = p.history_table and h.key_columns = i.key_columns where not i.is_clustered and not i.is_disabled",
    "catalog/rls-predicate-unindexed-column": "select s.table_name as object, s.policy as detail from (select * from cat_secpred lateral view explode(columns) e as k where is_enabled and upper(kind) = 'FILTER') s left anti join cat_indexes i on i.table_name = s.table_name and get(i.key_columns, 0) = s.k and not i.is_disabled",
    "catalog/trigger-firing-order-undefined": "select table_name as object, event as detail from cat_triggers where is_after and not is_disabled group by table_name, event having count(*) >= 2 and count_if(not is_first and not is_last) >= 2",
    # DDL events
    "catalog/alter-column-precision-scale-narrowing": "select concat(table_name, '.', column_name) as object, concat(old_type, ' ', new_type) as detail from alter_events where (old_type in ('decimal','numeric') and new_type in ('decimal','numeric') and (new_precision < old_precision or new_scale < old_scale)) or (old_type in ('money','smallmoney') and new_type in ('decimal','numeric') and new_scale < 4) or (old_type = new_type and old_type in ('time','datetime2','datetimeoffset') and new_scale < old_scale) or (old_type = new_type and old_type in ('char','varchar','nchar','nvarchar','binary','varbinary') and new_length < old_length and new_length <> -1)",
    "catalog/alter-column-incompatible-family-conversion": "select concat(table_name, '.', column_name) as object, concat(old_type, ' ', new_type) as detail from alter_events where old_type in ('char','nchar','varchar','nvarchar') and new_type in ('binary','varbinary')",
    "catalog/alter-column-temporal-offset-dropped": "select concat(table_name, '.', column_name) as object, concat(old_type, ' ', new_type) as detail from alter_events where old_type = 'datetimeoffset' and new_type in ('datetime2','datetime','smalldatetime','date','time')",
    "catalog/online-rebuild-legacy-lob-alter-table": f"select r.table_name as object, '' as detail from rebuild_events r left semi join cat_columns c on c.table_name = r.table_name and c.type in {_LOB} where r.is_online and r.target = 'table'",
    "catalog/online-rebuild-legacy-lob-alter-index-all": f"select r.table_name as object, '' as detail from rebuild_events r left semi join cat_columns c on c.table_name = r.table_name and c.type in {_LOB} where r.is_online and r.target = 'index all'",
    "catalog/online-rebuild-legacy-lob-alter-column": f"select concat(table_name, '.', column_name) as object, concat(old_type, ' ', new_type) as detail from alter_events where is_online and (old_type in {_LOB} or new_type in {_LOB})",
    "catalog/online-rebuild-legacy-lob-drop-index": f"select r.table_name as object, r.index_name as detail from rebuild_events r join cat_indexes i on i.table_name = r.table_name and i.name = r.index_name and i.is_clustered left semi join cat_columns c on c.table_name = r.table_name and c.type in {_LOB} where r.is_online and r.target = 'drop index'",
    "catalog/drop-schema-not-empty": "select d.name as object, '' as detail from drop_events d left semi join cat_objects o on lower(o.schema_name) = lower(d.name) where d.kind = 'schema'",
    # partition switches
    "query/alter-table-switch-column-mismatch": _SW + "'' as detail from switch_events s left semi join (select e.source_table, e.target_table from switch_events e join cat_columns a on a.table_name = e.source_table left join cat_columns b on b.table_name = e.target_table and b.ordinal = a.ordinal where not (struct(a.column_name, a.type, a.max_length, a.precision, a.scale, a.collation, a.is_nullable) <=> struct(b.column_name, b.type, b.max_length, b.precision, b.scale, b.collation, b.is_nullable)) union select e.source_table, e.target_table from switch_events e join cat_columns b on b.table_name = e.target_table left anti join cat_columns a on a.table_name = e.source_table and a.ordinal = b.ordinal) m on m.source_table = s.source_table and m.target_table = s.target_table",
    "query/alter-table-switch-index-mismatch": _SW + "i.name as detail from switch_events s join cat_indexes i on i.table_name = s.target_table left anti join cat_indexes j on j.table_name = s.source_table and j.key_columns = i.key_columns and j.key_column_is_descending <=> i.key_column_is_descending and j.is_clustered = i.is_clustered and j.is_unique = i.is_unique",
    "query/alter-table-switch-filegroup-mismatch": _SW + f"a.filegroup as detail {_SWITCH} where a.filegroup <> b.filegroup or a.is_readonly or b.is_readonly",
    "query/alter-table-switch-full-text-index-restriction": _SW + f"'' as detail {_SWITCH} where a.has_fulltext or b.has_fulltext",
    "query/alter-table-switch-rule-constraint": _SW + f"'' as detail {_SWITCH} where a.has_rule or b.has_rule",
    "query/alter-table-switch-temporal-mismatch": _SW + "'' as detail from switch_events s left join cat_temporal x on x.current_table = s.source_table left join cat_temporal y on y.current_table = s.target_table where (x.current_table is null) <> (y.current_table is null)",
    "query/alter-table-switch-target-only-index-restriction": _SW + "i.name as detail from switch_events s join cat_indexes i on i.table_name = s.target_table where lower(i.kind) in ('xml','spatial')",
    # the database
    "database/page-verify-not-checksum": _db("upper(page_verify) <> 'CHECKSUM'", "page_verify"),
    "database/auto-shrink-on": _db("auto_shrink", "auto_shrink"),
    "database/auto-close-on": _db("auto_close", "auto_close"),
    "database/target-recovery-time-unset": _db("target_recovery_time = 0", "target_recovery_time"),
    "database/query-store-not-read-write": _db("upper(query_store_state) <> 'READ_WRITE'", "query_store_state"),
    "database/query-store-capture-mode-not-auto": _db("upper(query_store_state) = 'READ_WRITE' and upper(query_store_capture) <> 'AUTO'", "query_store_capture"),
    "database/auto-create-statistics-off": _db("not auto_create_stats", "auto_create_stats"),
    "database/auto-update-statistics-off": _db("not auto_update_stats", "auto_update_stats"),
    "database/compatibility-level-behind-engine-default": _db("compat < engine_default", "compat"),
    "database/spatial-persisted-computed-column-compatibility-change": "select object_name as object, index_name as detail from disabled_on_compat",
    "database/plan-guide-alters-optimization": "select name as object, '' as detail from plan_guides where not is_disabled",
}


def complete(spark: SparkSession, relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every relation of ``SCHEMAS``: the given ones in their schema, the others empty.

    Columns that a given relation lacks are null (for flags: false), columns it has besides are ignored.
    """
    out = {}
    for name, ddl in SCHEMAS.items():
        df = relations.get(name)
        schema = StructType.fromDDL(ddl)
        if df is None:  # known to be empty when the query is planned, so what joins it is pruned
            out[name] = spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
            continue
        have = {c.lower() for c in df.columns}
        cols = []
        for f in schema:
            kind = f.dataType.simpleString()
            c = F.col(f"`{f.name}`").cast(kind) if f.name in have else F.lit(None).cast(kind)
            cols.append((F.coalesce(c, F.lit(f.name.startswith("allow_") or f.name == "is_ansi_padded")) if kind == "boolean" else c).alias(f.name))
        out[name] = df.select(*cols)
    return out


_NAMES = re.compile(r"\b(" + "|".join(sorted(SCHEMAS, key=len, reverse=True)) + r")\b")


def catalog_scan(spark: SparkSession, relations: dict[str, DataFrame], rules: list[str] | None = None) -> DataFrame:
    """``(rule_id, object, detail)`` of the catalog rules over ``relations``; a relation that is not given is empty."""
    frames = complete(spark, relations)
    out = None
    for rule in rules or CATALOG_RULES:
        sql = CATALOG_RULES[rule]
        found = spark.sql(_NAMES.sub(lambda m: "{" + m.group() + "}", sql), **{k: frames[k] for k in set(_NAMES.findall(sql))})
        found = found.select(F.lit(rule).alias("rule_id"), F.col("object").cast("string"), F.col("detail").cast("string"))
        out = found if out is None else out.unionByName(found)
    return out
