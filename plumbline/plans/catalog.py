"""Queries of the rule engine: catalog rules over the index and key tables, module rules over the module texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.rules import engine
from plumbline.rules.catalog_rules import catalog_scan
from plumbline.session import cut, cut_columns
from plumbline.sources.tables import table

INDEX_RULES = ["index-design/duplicate-index", "index-design/subsumed-index", "index-design/mergeable-indexes-differing-include-only", "index-design/disabled-index", "index-design/non-unique-clustered-index", "index-design/heap-with-nonclustered-indexes", "index-design/heap-with-nonclustered-primary-key", "index-design/unindexed-foreign-key", "catalog/untrusted-foreign-key", "catalog/cascading-foreign-key"]


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalog relations that the dataset holds. Rows loaded twice count once."""
    ix = table(spark, sf_dir, "cat_indexes").drop("loaded_at", "index_key").distinct().withColumnRenamed("table_qualified_name", "table_name")
    fk = table(spark, sf_dir, "foreign_keys").select(
        "constraint_name", F.col("parent_table_qualified_name").alias("parent_table"), F.col("parent_column_name").alias("parent_column"), F.col("referenced_table_qualified_name").alias("referenced_table"), F.col("referenced_column_name").alias("referenced_column"), "is_not_trusted", "is_disabled", "delete_action", "update_action"
    )
    return {"cat_indexes": ix, "cat_fks": fk}


def rules_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the index and key rules."""
    return catalog_scan(spark, relations(spark, sf_dir), INDEX_RULES)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "live_modules", "module_id", "definition", "object_type_code", "uses_quoted_identifier", "uses_ansi_nulls", "is_recompiled", "is_schema_bound", "uses_database_collation")


def rules_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the module rules, ranked."""
    found, broken = engine.scan(_modules(spark, sf_dir))
    if broken:
        raise RuntimeError("; ".join(broken))
    return engine.ranked(engine.best_of_duplicates(found)).drop("rank")


def rules_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and modules of each rule."""
    found, broken = engine.scan(_modules(spark, sf_dir))
    if broken:
        raise RuntimeError("; ".join(broken))
    return found.groupBy("rule_id", "confidence").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("module_id").alias("n_modules"))


def module_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts of each relation each kind of module has. A row counts for the kind that it names, also if its id comes again."""
    return engine.fact_counts(table(spark, sf_dir, "live_modules", "definition", "object_type_code"), "object_type_code").withColumnRenamed("kind", "object_type_code")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call graph: which module executes which procedure, with the number of call sites."""
    facts = cut(engine.module_facts(_modules(spark, sf_dir)).where(F.col("rel").isin("module", "exec")))
    callers = facts.where("rel = 'module'").select("module_id", F.col("b").alias("caller"))
    calls = facts.where("rel = 'exec' and a <> '(dynamic)'").select("module_id", F.col("a").alias("callee"))
    return calls.join(callers, "module_id").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n_sites"))


def dml_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables the corpus reads and writes, how often, from how many modules."""
    facts = cut_columns(engine.module_facts(_modules(spark, sf_dir)).where("rel in ('from_ref','stmt')"))  # parsed once, read twice
    reads = facts.where("rel = 'from_ref' and c = 'table'").select("module_id", F.col("a").alias("table_name"), F.lit("read").alias("access"))
    writes = facts.where("rel = 'stmt' and a = 'dml'").select("module_id", F.col("b").alias("table_name"), F.col("c").alias("access"))
    return reads.unionByName(writes).groupBy("table_name", "access").agg(F.count(F.lit(1)).alias("n_sites"), F.count_distinct("module_id").alias("n_modules"))


def rules_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that no rule has seen: without a definition, or with a text that could not be read to its end."""
    modules = table(spark, sf_dir, "live_modules", "module_id", "definition")
    unread = engine.module_facts(modules).where("rel = 'skipped'").select("module_id", F.concat_ws(" ", F.lit("not read:"), "a").alias("reason")).distinct()
    return modules.where(F.col("definition").isNull()).select("module_id", F.lit("no definition").alias("reason")).unionByName(unread)


QUERIES = {"rules_catalog": rules_catalog, "rules_modules": rules_modules, "rules_summary": rules_summary, "module_relations": module_relations, "call_edges": call_edges, "dml_matrix": dml_matrix, "rules_skipped": rules_skipped}

_IX = "(SELECT DISTINCT table_qualified_name AS table_name, name, kind, is_unique, key_columns, included_columns, key_column_is_descending, is_filtered, is_clustered, is_disabled, filter_definition FROM cat_indexes)"
_OK = "NOT {0}.is_disabled AND NOT coalesce({0}.is_filtered, false)"
_TWO = f"FROM {_IX} x JOIN {_IX} y ON x.table_name = y.table_name AND x.name <> y.name AND x.is_unique = y.is_unique AND x.kind = y.kind WHERE {_OK.format('x')} AND {_OK.format('y')}"
_NOT_IN = "len(list_filter(coalesce({0}.included_columns, []), lambda c: NOT list_contains(coalesce({1}.included_columns, []), c)))"

ORACLE = {
    "rules_skipped": "SELECT module_id, 'no definition' AS reason FROM live_modules WHERE definition IS NULL",
    "rules_catalog": " UNION ALL ".join(
        [
            f"SELECT 'index-design/duplicate-index' AS rule_id, x.table_name AS object, concat_ws(' ', x.name, y.name) AS detail {_TWO} AND x.name < y.name AND x.key_columns = y.key_columns",
            f"SELECT 'index-design/subsumed-index', x.table_name, concat_ws(' ', x.name, y.name) {_TWO} AND len(x.key_columns) < len(y.key_columns) AND y.key_columns[1:len(x.key_columns)] = x.key_columns AND {_NOT_IN.format('x', 'y')} = 0",
            f"SELECT 'index-design/mergeable-indexes-differing-include-only', x.table_name, concat_ws(' ', x.name, y.name) {_TWO} AND x.name < y.name AND x.key_columns = y.key_columns AND x.key_column_is_descending IS NOT DISTINCT FROM y.key_column_is_descending AND {_NOT_IN.format('x', 'y')} > 0 AND {_NOT_IN.format('y', 'x')} > 0",
            f"SELECT 'index-design/disabled-index', table_name, name FROM {_IX} i WHERE is_disabled",
            f"SELECT 'index-design/non-unique-clustered-index', table_name, name FROM {_IX} i WHERE is_clustered AND NOT is_unique AND NOT is_disabled",
            f"SELECT 'index-design/heap-with-nonclustered-indexes', table_name, '' FROM {_IX} i WHERE NOT is_disabled GROUP BY table_name HAVING NOT bool_or(coalesce(is_clustered, false)) AND NOT bool_or(coalesce(kind = 'PrimaryKey', false))",
            f"SELECT 'index-design/heap-with-nonclustered-primary-key', table_name, '' FROM {_IX} i WHERE NOT is_disabled GROUP BY table_name HAVING NOT bool_or(coalesce(is_clustered, false)) AND bool_or(coalesce(kind = 'PrimaryKey', false))",
            f"SELECT 'index-design/unindexed-foreign-key', f.p, f.c FROM (SELECT parent_table_qualified_name AS p, constraint_name AS c, list(DISTINCT parent_column_name) AS cols FROM foreign_keys GROUP BY 1, 2) f WHERE NOT EXISTS (SELECT 1 FROM {_IX} i WHERE i.table_name = f.p AND {_OK.format('i')} AND len(i.key_columns) >= len(f.cols) AND len(list_filter(i.key_columns[1:len(f.cols)], lambda c: NOT list_contains(f.cols, c))) = 0)",
            "SELECT DISTINCT 'catalog/untrusted-foreign-key', parent_table_qualified_name, constraint_name FROM foreign_keys WHERE is_not_trusted",
            "SELECT DISTINCT 'catalog/cascading-foreign-key', parent_table_qualified_name, constraint_name FROM foreign_keys WHERE lower(delete_action) <> 'noaction' OR lower(update_action) <> 'noaction'",
        ]
    )
}
