"""Queries of the general problems: differences, even per-key results, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.chunked import keyed_stats
from plumbline.operators.diff import diff
from plumbline.operators.hierarchy import descendants, hierarchy, parents
from plumbline.session import cut
from plumbline.sources.tables import table

COPIES = {"cat_indexes": "index_key", "lineage_parity": "parity_key"}
FINDINGS = ("duplication_findings", "deprecated_syntax_findings")
HEAVY_SHARE = 0.025


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing rows and differing fields of both catalog tables against their copies."""
    out = None
    for name, key in COPIES.items():
        d = diff(table(spark, sf_dir, name), table(spark, sf_dir, f"{name}_copy"), key, ignore=("loaded_at",))
        d = d.select(F.lit(name).alias("dataset"), "row_key", "diff_kind", "field")
        out = d if out is None else out.unionByName(d)
    return out


def p4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per module name of each findings table: rows, distinct findings and kinds, first and last time found."""
    out = None
    for name in FINDINGS:
        s = keyed_stats(table(spark, sf_dir, name, "module_qualified_name", "finding_id", "kind", "found_at"), "module_qualified_name", "finding_id", "kind", "found_at")
        s = s.select(F.lit(name).alias("table_name"), F.col("key").alias("module_qualified_name"), "n_rows", F.col("n_ids").alias("n_findings"), "n_kinds", F.col("first_at").alias("first_found_at"), F.col("last_at").alias("last_found_at"))
        out = s if out is None else out.unionByName(s)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null names with at least 2.5 % of all rows of a findings table."""
    s = cut(p4_stats(spark, sf_dir))  # one row for each name
    totals = s.groupBy("table_name").agg(F.sum("n_rows").alias("total"))
    heavy = s.join(F.broadcast(totals), "table_name").where(F.col("module_qualified_name").isNotNull() & (F.col("n_rows") >= HEAVY_SHARE * F.col("total")))
    return heavy.select("table_name", "module_qualified_name")


def bare_name(c):
    """A table name in lower case without brackets."""
    return F.lower(F.translate(c, "[]", ""))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    fk = table(spark, sf_dir, "foreign_keys", "parent_table_qualified_name", "referenced_table_qualified_name", "delete_action", "is_disabled")
    links = fk.where((F.lower("delete_action") == "cascade") & ~F.coalesce("is_disabled", F.lit(False)))
    return links.select(bare_name("parent_table_qualified_name").alias("below"), bare_name("referenced_table_qualified_name").alias("above"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy of tables along enabled cascading foreign keys."""
    return hierarchy(_links(spark, sf_dir), "below", "above").select(F.col("node").alias("table_name"), "node_kind", "root_name", "depth", "path", "n_descendants")


def p5_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's places in the Euler tour of its tree."""
    return hierarchy(_links(spark, sf_dir), "below", "above").select(F.col("node").alias("table_name"), "tour", "entry", "exit", "cycle")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a table and a table below it, by the interval join of the tours."""
    return descendants(hierarchy(_links(spark, sf_dir), "below", "above")).select(F.col("node").alias("table_name"), "descendant")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link, those included that the hierarchy doesn't go up because the table has another parent before them."""
    return parents(_links(spark, sf_dir), "below", "above").select(F.col("node").alias("table_name"), F.col("parent").alias("parent_name"), "is_way_up")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_stats": p4_stats, "p5_found": p5_found, "p5_intervals": p5_intervals, "p5_descendants": p5_descendants, "p5_links": p5_links}

_STATS = """SELECT '{t}' AS table_name, module_qualified_name, count(*) AS n_rows, count(DISTINCT finding_id) AS n_findings,
 count(DISTINCT kind) AS n_kinds, min(found_at) AS first_found_at, max(found_at) AS last_found_at FROM {t} GROUP BY module_qualified_name"""
_FOUND = """SELECT '{t}' AS table_name, module_qualified_name FROM {t} WHERE module_qualified_name IS NOT NULL
 GROUP BY module_qualified_name HAVING count(*) >= 0.025 * (SELECT count(*) FROM {t})"""


def _diff_sql(name: str, key: str, columns: list[str]) -> str:
    cols = ", ".join([key, *columns])
    parts = [
        f"SELECT '{name}' AS dataset, {key} AS row_key, 'missing_left' AS diff_kind, '' AS field FROM (SELECT DISTINCT {key} FROM {name}_copy) c WHERE NOT EXISTS (SELECT 1 FROM {name} l WHERE l.{key} = c.{key})",
        f"SELECT '{name}', {key}, 'missing_right', '' FROM (SELECT DISTINCT {key} FROM {name}) c WHERE NOT EXISTS (SELECT 1 FROM {name}_copy r WHERE r.{key} = c.{key})",
    ]
    pair = f"(SELECT DISTINCT {cols} FROM {name}) l JOIN (SELECT DISTINCT {cols} FROM {name}_copy) r ON l.{key} = r.{key}"
    parts += [f"SELECT '{name}', l.{key}, 'value', '{c}' FROM {pair} WHERE l.{c} IS DISTINCT FROM r.{c}" for c in columns]
    return " UNION ALL ".join(parts)


_CAT = "table_qualified_name name kind is_unique key_columns included_columns key_column_is_descending is_filtered is_clustered is_disabled filter_definition".split()
_PARITY = "list_name qualified_view_name column_name facet inferred_value actual_value cached_value live_value error_number error_message reason".split()

_P5_BASE = """WITH RECURSIVE l AS (SELECT DISTINCT lower(translate(parent_table_qualified_name, '[]', '')) AS c, lower(translate(referenced_table_qualified_name, '[]', '')) AS p
 FROM foreign_keys WHERE lower(delete_action) = 'cascade' AND NOT coalesce(is_disabled, false)),
 n AS (SELECT c AS v FROM l UNION SELECT p FROM l),
 up(v, a, d, path) AS (SELECT c, p, 1, [c] FROM l UNION ALL SELECT u.v, l.p, u.d + 1, list_append(u.path, u.a) FROM up u JOIN l ON l.c = u.a WHERE NOT list_contains(u.path, u.a)),
 reach AS (SELECT DISTINCT v, a FROM up)"""

_P5 = _P5_BASE + """,
 cyc AS (SELECT v FROM reach WHERE v = a),
 bc AS (SELECT DISTINCT v FROM reach WHERE a IN (SELECT v FROM cyc)),
 top AS (SELECT up.v, up.a AS root, up.d, up.path FROM up WHERE up.a NOT IN (SELECT c FROM l)),
 des AS (SELECT a AS v, count(*) FILTER (WHERE v <> a) AS k FROM reach GROUP BY a)
 SELECT n.v AS table_name, CASE WHEN n.v IN (SELECT v FROM cyc) THEN 'cycle' WHEN n.v IN (SELECT v FROM bc) THEN 'below_cycle' ELSE 'tree' END AS node_kind,
 CASE WHEN n.v IN (SELECT v FROM bc) THEN '' ELSE coalesce(top.root, n.v) END AS root_name,
 CAST(CASE WHEN n.v IN (SELECT v FROM bc) THEN -1 ELSE coalesce(top.d, 0) END AS BIGINT) AS depth,
 CASE WHEN n.v IN (SELECT v FROM bc) THEN '' WHEN top.root IS NULL THEN n.v ELSE array_to_string(list_reverse(list_append(top.path, top.root)), ' > ') END AS path,
 CAST(coalesce(des.k, 0) AS BIGINT) AS n_descendants FROM n LEFT JOIN top ON top.v = n.v LEFT JOIN des ON des.v = n.v"""

ORACLE = {
    "p2_found": " UNION ALL ".join([_diff_sql("cat_indexes", "index_key", _CAT), _diff_sql("lineage_parity", "parity_key", _PARITY)]),
    "p4_stats": " UNION ALL ".join(_STATS.format(t=t) for t in FINDINGS),
    "p4_found": " UNION ALL ".join(_FOUND.format(t=t) for t in FINDINGS),
    "p5_found": _P5,
    "p5_descendants": _P5_BASE + " SELECT a AS table_name, v AS descendant FROM reach WHERE v <> a",
    "p5_links": "WITH l AS (SELECT DISTINCT lower(translate(parent_table_qualified_name, '[]', '')) AS c, lower(translate(referenced_table_qualified_name, '[]', '')) AS p FROM foreign_keys WHERE lower(delete_action) = 'cascade' AND NOT coalesce(is_disabled, false)) SELECT c AS table_name, p AS parent_name, p = min(p) OVER (PARTITION BY c) AS is_way_up FROM l WHERE c IS NOT NULL AND p IS NOT NULL",
}
