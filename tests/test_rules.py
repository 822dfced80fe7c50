import pytest

from plumbline.plans import planted
from plumbline.rules import engine
from plumbline.rules.catalog_rules import CATALOG_RULES, catalog_scan
from plumbline.rules.module_rules import FACT_RULES

MODULES = [
    (1, "create procedure dbo.a as begin tran update dbo.x set c = 1 update dbo.y set c = 1 commit"),
    (2, "create procedure dbo.b as begin tran update dbo.y set c = 1 update dbo.x set c = 1 commit"),
    (3, "create trigger dbo.t1 on dbo.m after insert as update dbo.n set c = 1"),
    (4, "create trigger dbo.t2 on dbo.n after update as insert into dbo.m (c) values (1)"),
    (5, "create view dbo.v1 as select a from dbo.base"),
    (6, "create view dbo.v2 as select a from dbo.v1"),
    (7, "create function dbo.f (@a int) returns int as begin return @a end"),
    (8, "create procedure dbo.c as select 1 from dbo.t where dbo.f(a) = 1"),
    (9, "create view dbo.v3 as select a from dbo.v2"),
    (11, "create procedure dbo.p as set nocount on; select t.a from dbo.t t left join dbo.u u on u.a = t.a where exists (select 1 from dbo.v u where u.b = 1)"),
    (12, "create procedure dbo.r as set nocount on; select t.a from dbo.t t right join dbo.u u on u.a = t.a where t.b = 1"),
    (13, "create procedure dbo.d as set nocount on; select 1 from dbo.t where 1 = 0 and year(d) = 2024"),
    (14, "create procedure dbo.e as set nocount on; select N'ab', N'ab', N'ab'"),
    (9998, None),
    (9999, ""),
]


@pytest.fixture(scope="module")
def found(spark):
    f, broken = engine.scan(spark.createDataFrame(MODULES, "module_id long, definition string"))
    assert not broken
    return f


@pytest.fixture(scope="module")
def hits(found):
    return {(r.rule_id, r.module_id) for r in found.collect()}


def test_planted_corpus(spark):
    """Every planted rule fires on its module and is silent on the clean twin."""
    assert [tuple(r) for r in planted.rules_planted(spark, "").where("not fires or not silent_on_twin").collect()] == []


def test_planted_catalog(spark):
    assert [tuple(r) for r in planted.rules_planted_catalog(spark, "").where("not fires or not silent_on_twin").collect()] == []


def test_cross_module_rules(hits):
    assert {("cross-module/inconsistent-lock-order", 1), ("cross-module/inconsistent-lock-order", 2), ("trigger/multi-hop-recursion-cycle", 3), ("trigger/multi-hop-recursion-cycle", 4)} <= hits
    assert {("lineage/nested-view-depth", 9), ("scalar-udf/in-predicate", 8), ("statement-shape/missing-set-nocount-on", 1)} <= hits
    assert not {("lineage/nested-view-depth", 5), ("lineage/nested-view-depth", 6)} & hits


def test_scopes_do_not_leak_and_dead_leaves_are_silent(hits):
    assert ("join/outer-join-predicate-collapse", 11) not in hits and ("join/outer-join-predicate-collapse", 12) in hits
    assert ("tier1/date-function-on-column", 13) not in hits
    assert ("duplication/duplicated-string-literal", 14) not in hits
    assert {m for _, m in hits} & {9998, 9999} <= {9999}


def test_ranking_is_total(found):
    ranked = engine.ranked(engine.best_of_duplicates(found), "High").collect()
    assert ranked and all(r.confidence == "High" for r in ranked)


def test_catalog_rules(spark):
    ix = spark.createDataFrame(
        [("t", "i1", "Index", False, ["a"], ["x"], [False], False, False, False), ("t", "i2", "Index", False, ["a", "b"], ["x", "y"], [False, False], False, False, False), ("t", "i3", "Index", False, ["a"], ["z"], [False], False, False, True), ("t", "i4", "Index", False, ["a"], ["q"], [False], False, False, False), ("u", "pk", "PrimaryKey", True, ["k"], [], [False], False, True, False)],
        "table_name string, name string, kind string, is_unique boolean, key_columns array<string>, included_columns array<string>, key_column_is_descending array<boolean>, is_filtered boolean, is_clustered boolean, is_disabled boolean",
    )
    cols = spark.createDataFrame([("t", "a", "float", 8, True), ("t", "b", "varchar", 2000, True), ("t", "c", "text", 16, False)], "table_name string, column_name string, type string, max_length int, is_nullable boolean")
    fk = spark.createDataFrame([("f", "t", "b", "u", "k", True, False, "Cascade", "NoAction")], "constraint_name string, parent_table string, parent_column string, referenced_table string, referenced_column string, is_not_trusted boolean, is_disabled boolean, delete_action string, update_action string")
    got = {(r.rule_id.split("/")[1], r.object, r.detail) for r in catalog_scan(spark, {"cat_indexes": ix, "cat_columns": cols, "cat_fks": fk}).collect()}
    assert {("duplicate-index", "t", "i1 i4"), ("subsumed-index", "t", "i1 i2"), ("mergeable-indexes-differing-include-only", "t", "i1 i4"), ("disabled-index", "t", "i3"), ("untrusted-foreign-key", "t", "f"), ("cascading-foreign-key", "t", "f"), ("unindexed-foreign-key", "t", "f")} <= got
    assert {("legacy-large-object-column", "t.c", "text"), ("float-or-real-index-key-column", "t", "i1 a"), ("variable-length-key-column-exceeds-key-limit", "t", "i2")} <= got
    assert ("subsumed-index", "t", "i4 i2") not in got


def test_every_catalog_rule_builds_on_an_empty_catalog(spark):
    assert catalog_scan(spark, {}, list(CATALOG_RULES)).count() == 0
    assert len(CATALOG_RULES) + len(FACT_RULES) > 180
