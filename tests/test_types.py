from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.rules import engine, typed


def test_decimal_results():
    assert T.decimal_result("+", 10, 2, 8, 4) == (13, 4)
    assert T.decimal_result("*", 10, 2, 8, 4) == (19, 6)
    assert T.decimal_result("/", 10, 2, 8, 4) == (23, 11)
    assert T.decimal_result("%", 10, 2, 8, 4) == (8, 4)
    assert T.decimal_result("+", 38, 10, 38, 20) == (38, 10)
    assert T.decimal_result("*", 38, 10, 38, 10)[0] == 38


def test_merge_takes_the_highest_precedence():
    assert T.merged_name(["int", "varchar", "bigint"]) == "bigint"
    assert T.merged_name(["int", "mystery"]) is None


VERDICTS = [
        ("varchar(20)", "SQL_Latin1_General_CP1_CI_AS", "nvarchar(20)", None, False, "=", "ScanForced"),
        ("varchar(20)", "Latin1_General_CI_AS", "nvarchar(20)", None, False, "=", "RangeSeek"),
        ("varchar(20)", "Latin1_General_CI_AS", "nvarchar(20)", None, False, "like", "ScanForced"),
        ("nvarchar(20)", "SQL_Latin1_General_CP1_CI_AS", "varchar(20)", None, False, "=", "SeekPreserved"),
        ("char(5)", "SQL_Latin1_General_CP1_CI_AS", "varchar(5)", None, False, "=", "SeekPreserved"),
        ("int", None, "bigint", None, False, "=", "SeekPreserved"),
        ("int", None, "real", None, False, "=", "ScanForced"),
        ("smallint", None, "float", None, False, "=", "SeekPreserved"),
        ("int", None, "varchar(10)", None, False, "=", "SeekPreserved"),
        ("varchar(10)", "SQL_Latin1_General_CP1_CI_AS", "int", None, True, "=", "ScanForced"),
        ("time(7)", None, "date", None, False, "=", "OperandClash"),
        ("xml", None, "int", None, False, "=", "Unknown"),
        ("int", None, "sql_variant", None, False, "=", "ScanForced"),
        ("varchar(20)", "Latin1_General_CI_AS", "varchar(20)", "French_CI_AS", False, "=", "OperandClash"),
        ("varchar(max)", "Latin1_General_CI_AS", "varchar(20)", None, False, "=", "RangeSeek"),
        ("varchar(20)", None, "varchar(20)", None, False, "=", "Unknown"),
        ("mystery", None, "int", None, False, "=", "Unknown"),
        ("varchar(5000)", "Latin1_General_CI_AS", "nvarchar(max)", None, False, "=", "ScanForced"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(k, *v[:6]) for k, v in enumerate(VERDICTS)], "k int, c string, cc string, o string, oc string, lit boolean, op string")
    df = df.select("k", T.parse_type(F.col("c"), F.col("cc")).alias("ct"), T.parse_type(F.col("o"), F.col("oc")).alias("ot"), "lit", "op")
    got = {r.k: r.verdict for r in T.verdicts(df, "ct", "ot", "lit", "op").collect()}
    assert [(v, got[k]) for k, v in enumerate(VERDICTS) if got[k] != v[6]] == []


LOSSES = [
        ("varchar(5)", "nvarchar(5)", None, True, "unicode-to-non-unicode"),
        ("varchar(5)", "nvarchar(5)", "N'abc'", True, None),
        ("varchar(5)", "nvarchar(5)", "N'é'", True, "unicode-to-non-unicode"),
        ("int", "float", None, True, "approximate-to-exact-truncation"),
        ("decimal(10,2)", "decimal(10,4)", None, True, "numeric-scale-narrowing"),
        ("decimal(10,2)", "decimal(10,4)", "1.2500", True, None),
        ("int", "money", None, True, "numeric-scale-narrowing"),
        ("date", "datetime", None, True, "temporal-precision-loss"),
        ("date", "varchar(10)", "'2024-01-01'", True, None),
        ("datetime2(7)", "datetimeoffset(7)", None, True, "temporal-offset-dropped"),
        ("time(2)", "time(7)", None, True, "temporal-scale-narrowing"),
        ("varchar(5)", "varchar(9)", None, True, "length-truncation"),
        ("varchar(5)", "varchar(9)", None, False, None),
]


def test_write_loss(spark):
    df = spark.createDataFrame([(k, *v[:4]) for k, v in enumerate(LOSSES)], "k int, t string, s string, l string, v boolean")
    df = df.select("k", T.parse_type(F.col("t")).alias("t"), T.parse_type(F.col("s")).alias("s"), "l", "v")
    got = {r.k: r.w for r in df.select("k", T.write_loss(F.col("t"), F.col("s"), F.col("l"), F.col("v")).alias("w")).collect()}
    assert [(v, got[k]) for k, v in enumerate(LOSSES) if got[k] != v[4]] == []


def test_typed_scan(spark):
    cols = spark.createDataFrame(
        [("dbo.t", "code", "varchar(20)", "SQL_Latin1_General_CP1_CI_AS", False, False, None, True), ("dbo.t", "ratio", "float", None, True, True, None, True), ("dbo.u", "doc", "xml", None, True, False, None, True)],
        "table_name string, column_name string, declared string, collation string, is_nullable boolean, is_masked boolean, encryption string, is_ansi_padded boolean",
    )
    mods = [
        (1, "create procedure dbo.p @n nvarchar(20), @l varchar(50) as select 1 from dbo.t where code = @n and t.code = @l and t.ratio = 0.5"),
        (2, "create procedure dbo.q as declare @d datetime, @x date set @x = @d select 1 from dbo.t x join dbo.u y on x.code = y.doc where x.code is null"),
        (3, "create procedure dbo.r as declare @big nvarchar(90) exec dbo.p @n = @big exec dbo.p @big"),
        (4, "create procedure dbo.s @v varchar(20) as select 1 from dbo.t where code = @v"),
    ]
    facts = engine.module_facts(spark.createDataFrame(mods, "module_id long, definition string"))
    hits = {(r.rule_id, r.module_id) for r in typed.typed_scan(facts, cols).collect()}
    assert {("verdict/scan-forced", 1), ("predicates/oversized-parameter", 1), ("predicates/float-equality", 1), ("predicates/dynamic-data-masking-predicate-exposure", 1)} <= hits
    assert {("write-loss/temporal-precision-loss", 2), ("correctness/not-null-predicate-contradiction", 2), ("predicates/xml-operand-not-comparable", 2)} <= hits
    assert ("call-graph/argument-type-mismatch", 3) in hits
    assert not [h for h in hits if h[1] == 4]


def test_scan_runs_the_typed_rules_of_variables_and_calls(spark):
    rows = [
        (1, "create procedure dbo.callee @p varchar(5) as begin set nocount on; select @p; end"),
        (2, "create procedure dbo.callee @p varchar(5) as begin set nocount on; select @p; end"),
        (3, "create procedure dbo.caller @long nvarchar(50) as begin set nocount on; declare @short varchar(10); set @short = @long; exec dbo.callee @p = @long; end"),
    ]
    found, broken = engine.scan(spark.createDataFrame(rows, "module_id long, definition string"))
    assert not broken
    hits = [(r.rule_id, r.module_id) for r in found.collect() if r.rule_id in typed.TYPED_RULES]
    assert sorted(hits) == [("call-graph/argument-type-mismatch", 3), ("write-loss/unicode-to-non-unicode", 3)]
