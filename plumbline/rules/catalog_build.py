"""The catalog that DDL declares: the ``ddl`` facts of scripts and modules as the relations of ``catalog_rules.SCHEMAS``.

Statements are taken in the order of their module's number and their place in it: what a later ALTER or DROP says holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.session import cut

# Bytes of types of one size.
_BYTES = {"bit": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "smallmoney": 4, "money": 8, "real": 4, "float": 8, "date": 3, "time": 5, "smalldatetime": 4, "datetime": 8, "datetime2": 8, "datetimeoffset": 10, "uniqueidentifier": 16, "timestamp": 8, "decimal": 17}


def flag(name: str) -> Column:
    return F.array_contains("f", name)


def value(prefix: str) -> Column:
    """The text after ``prefix:`` in the first flag that has it."""
    return F.regexp_extract(F.try_element_at(F.filter("f", lambda x: x.startswith(f"{prefix}:")), F.lit(1)), rf"(?s)^{prefix}:(.*)$", 1)


def values(prefix: str) -> Column:
    return F.transform(F.filter("f", lambda x: x.startswith(f"{prefix}:")), lambda x: F.substring(x, len(prefix) + 2, 1 << 20))


def named(c: Column) -> Column:
    """A table name with the default schema where none is written."""
    return F.when(c.contains(".") | c.startswith("#") | c.startswith("@"), c).otherwise(F.concat(F.lit("dbo."), c))


def build(facts: DataFrame) -> dict[str, DataFrame]:
    """Relations by name. A table, index or column that is declared again counts as declared last; dropped ones are left out."""
    d = cut(facts.where((F.col("rel") == "ddl") & ~flag("with_schema")).select("module_id", "stmt", "line", "col", named(F.col("a")).alias("t"), F.col("a").alias("raw"), "b", "c", "n", "f"))
    kind = lambda k: d.where(F.element_at("f", 1) == k)
    last = lambda df, *by: df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("module_id"), F.desc("stmt"), F.desc("line"), F.desc("col")))).where("__r = 1").drop("__r")
    dropped = kind("drop_column").select("t", "b")
    local = flag("returns") | flag("variable") | flag("table_type") | flag("external")
    cols = last(kind("column").where(~local), "t", "b").join(dropped, ["t", "b"], "left_anti")
    defaults = kind("default").select("t", "b", F.col("c").alias("dflt")).dropDuplicates(["t", "b"])
    cols = cols.join(defaults, ["t", "b"], "left")
    collation = F.when(value("collate") != "", value("collate"))
    kinds = T.parse_type(F.col("c"), collation)
    wide = F.when(F.col("k.name").isin(T.WIDE_STRINGS), 2).otherwise(1)
    size = F.create_map(*[F.lit(x) for kv in _BYTES.items() for x in kv])[F.col("k.name")]
    cols = cols.withColumn("k", kinds).withColumn("raw_type", F.regexp_extract("c", r"^(?:dbo\.)?([a-z_0-9]+)", 1))
    seed = F.split(value("seed"), ",")
    columns = cols.select(
        F.col("t").alias("table_name"), F.col("b").alias("column_name"), F.col("n").cast("int").alias("ordinal"), F.coalesce("k.name", "raw_type").alias("type"), F.col("c").alias("declared"),
        F.coalesce(F.col("k.length") * wide, size).alias("max_length"), F.col("k.precision").alias("precision"), F.col("k.scale").alias("scale"), collation.alias("collation"), F.coalesce("k.is_max", F.lit(False)).alias("is_max"),
        (~flag("not_null")).alias("is_nullable"), flag("identity").alias("is_identity"), F.when(flag("identity"), F.coalesce(F.try_element_at(seed, F.lit(1)).try_cast("double"), F.lit(1.0))).alias("identity_seed"), F.when(flag("identity"), F.coalesce(F.try_element_at(seed, F.lit(2)).try_cast("double"), F.lit(1.0))).alias("identity_increment"),
        flag("computed").alias("is_computed"), flag("persisted").alias("is_persisted"), value("def").alias("definition"), F.when(value("encrypted") != "", value("encrypted")).alias("encryption"), F.when(value("cek") != "", value("cek")).alias("encryption_key"), flag("masked").alias("is_masked"), flag("sparse").alias("is_sparse"), F.when(value("generated") != "", value("generated")).alias("generated_always"),
        F.coalesce(F.when(value("default") != "", value("default")), F.col("dflt")).alias("default_definition"),
    )
    tables = last(kind("table"), "t").select(F.col("t").alias("table_name"), F.lit("Table").alias("kind"), flag("memory").alias("is_memory_optimized"), flag("schema_only").alias("is_schema_only"), flag("ledger").alias("is_ledger"), flag("temporal").alias("is_temporal"), F.regexp_extract("c", r" on (\w+)", 1).alias("filegroup"))
    off = kind("disable_index").select("t", "b").distinct()
    gone = kind("drop_constraint").select("t", "b").distinct()
    ix = last(kind("index"), "t", "b").join(gone, ["t", "b"], "left_anti").join(off.withColumn("is_disabled", F.lit(True)), ["t", "b"], "left")
    opt = lambda x: F.exists("f", lambda y: y == f"opt:{x}")
    indexes = ix.where("t not like '@%'").select(
        F.col("t").alias("table_name"), F.col("b").alias("name"), F.col("c").alias("kind"), flag("unique").alias("is_unique"), values("key").alias("key_columns"), values("inc").alias("included_columns"), F.transform(values("desc"), lambda x: x == "1").alias("key_column_is_descending"),
        flag("filtered").alias("is_filtered"), flag("clustered").alias("is_clustered"), F.coalesce("is_disabled", F.lit(False)).alias("is_disabled"), flag("columnstore").alias("is_columnstore"), flag("json").alias("is_json"), F.when(flag("filtered"), value("filter")).alias("filter_definition"), values("fcol").alias("filter_columns"),
        (~opt("allow_row_locks = off")).alias("allow_row_locks"), (~opt("allow_page_locks = off")).alias("allow_page_locks"), opt("ignore_dup_key = on").alias("ignore_dup_key"), opt("optimize_for_sequential_key = on").alias("optimize_sequential"),
    )
    disabled = kind("disable_constraint").select("t", "b").distinct().withColumn("off", F.lit(True))
    fk = last(kind("fk"), "t", "b").join(gone, ["t", "b"], "left_anti").join(disabled, ["t", "b"], "left")
    fks = fk.select(F.col("b").alias("constraint_name"), F.col("t").alias("parent_table"), named(F.col("c")).alias("referenced_table"), (flag("untrusted") | F.coalesce("off", F.lit(False))).alias("is_not_trusted"), F.coalesce("off", F.lit(False)).alias("is_disabled"), value("delete").alias("delete_action"), value("update").alias("update_action"), F.explode(F.arrays_zip(values("key").alias("x"), values("ref").alias("y"))).alias("z"))
    fks = fks.select("constraint_name", "parent_table", F.col("z.x").alias("parent_column"), "referenced_table", F.col("z.y").alias("referenced_column"), "is_not_trusted", "is_disabled", "delete_action", "update_action")
    ck = last(kind("check"), "t", "b").join(gone, ["t", "b"], "left_anti").join(disabled, ["t", "b"], "left")
    checks = ck.select(F.col("b").alias("constraint_name"), F.col("t").alias("table_name"), F.col("c").alias("definition"), F.coalesce("off", F.lit(False)).alias("is_disabled"), (flag("untrusted") | F.coalesce("off", F.lit(False))).alias("is_not_trusted"), F.array_distinct(values("key")).alias("columns"), values("null").alias("null_tested"))
    stats = kind("stats").select(F.col("t").alias("table_name"), F.col("b").alias("name"), values("key").alias("columns"), flag("norecompute").alias("no_recompute"))
    alias = kind("type").select(F.substring_index("t", ".", -1).alias("type_name"), F.substring_index("t", ".", 1).alias("schema_name"), flag("alias").alias("is_alias"), flag("clr").alias("is_clr"))
    old = columns.select(F.col("table_name").alias("t"), F.col("column_name").alias("b"), F.col("type").alias("old_type"), F.col("max_length").alias("old_length"), F.col("precision").alias("old_precision"), F.col("scale").alias("old_scale"))
    new = kind("alter_column").withColumn("k", T.parse_type(F.col("c"))).join(old, ["t", "b"])
    alters = new.select(F.col("t").alias("table_name"), F.col("b").alias("column_name"), "old_type", "old_length", "old_precision", "old_scale", F.col("k.name").alias("new_type"), (F.col("k.length") * wide).alias("new_length"), F.col("k.precision").alias("new_precision"), F.col("k.scale").alias("new_scale"), flag("online").alias("is_online"))
    online_drop = kind("drop_constraint").where(F.col("c").contains("online = on")).select(F.col("t").alias("table_name"), F.lit("drop index").alias("target"), F.col("b").alias("index_name"), F.lit(True).alias("is_online"), F.lit(None).cast("int").alias("partition"))
    rebuilds = kind("rebuild").select(F.col("t").alias("table_name"), value("target").alias("target"), F.col("b").alias("index_name"), flag("online").alias("is_online"), F.when(F.col("n") != 0, F.col("n")).cast("int").alias("partition")).unionByName(online_drop)
    switches = kind("switch").select(F.col("t").alias("source_table"), named(F.col("b")).alias("target_table"), F.when(F.col("n") != 0, F.col("n")).cast("int").alias("partition"))
    st = facts.where("rel = 'stmt' and a = 'drop'").where("b in ('schema','role')")
    drops = st.select(F.col("b").alias("kind"), F.regexp_extract("c", r"^drop \w+ (?:if exists )?(\S+)", 1).alias("name"))
    objects = tables.select("table_name").unionByName(facts.where("rel = 'module'").select(named(F.col("b")).alias("table_name"))).distinct()
    triggers = facts.where("rel = 'module' and a = 'trigger'").select(F.col("b").alias("trigger_name"), named(F.col("c")).alias("table_name"), F.explode(F.array_intersect("f", F.array(*[F.lit(x) for x in ("insert", "update", "delete")]))).alias("event"), (~flag("instead")).alias("is_after"))
    return {
        "cat_tables": tables, "cat_columns": columns, "cat_indexes": indexes, "cat_fks": fks, "cat_checks": checks, "cat_stats": stats, "cat_types": alias, "alter_events": alters, "rebuild_events": rebuilds, "switch_events": switches, "drop_events": drops,
        "cat_objects": objects.select(F.substring_index("table_name", ".", 1).alias("schema_name"), F.substring_index("table_name", ".", -1).alias("object_name")), "cat_triggers": triggers,
    }
