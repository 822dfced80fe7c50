from plumbline.operators.diff import diff

DDL = "k long, name string, cols array<string>, flag boolean, side string, loaded int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_kind_of_difference(spark):
    left = spark.createDataFrame([(1, "a", ["x"], True, "s", 1), (2, "", [], None, "s", 1), (3, "c", None, True, "s", 1), (4, "d", ["p", "q"], True, "s", 1), (4, "d", ["p", "q"], True, "s", 9)], DDL)
    right = spark.createDataFrame([(1, "a", ["x"], True, "s", 2), (2, None, None, None, "s", 2), (4, "D", ["q", "p"], False, "t", 2), (5, "e", ["x"], True, "s", 2)], DDL)
    got = rows(diff(left, right, "k", ("loaded",), partitions=3))
    assert got == [(2, "value", "cols"), (2, "value", "name"), (3, "missing_right", ""), (4, "value", "cols"), (4, "value", "flag"), (4, "value", "name"), (4, "value", "side"), (5, "missing_left", "")]


def test_null_keys_empty_copies_and_several_versions(spark):
    none = spark.createDataFrame([], DDL)
    one = spark.createDataFrame([(None, "a", None, None, None, 1), (7, "a", None, None, None, 1), (7, "b", None, None, None, 1)], DDL)
    assert rows(diff(none, none, "k")) == []
    got = {(r.row_key, r.diff_kind) for r in diff(one, none, "k").collect()}
    assert got == {(None, "missing_right"), (7, "missing_right")}
    same = spark.createDataFrame([(7, "b", None, None, None, 3), (7, "a", None, None, None, 2), (None, "a", None, None, None, 1)], DDL)
    assert rows(diff(one, same, "k", ("loaded",))) == []
    other = spark.createDataFrame([(7, "b", None, None, None, 3), (None, "a", None, None, None, 1)], DDL)
    assert rows(diff(one, other, "k", ("loaded",))) == [(7, "missing_right", "")]


def test_columns_of_one_copy_only_and_long_values(spark):
    long = "x" * 300_000
    left = spark.createDataFrame([(1, long, "l")], "k long, v string, only_left string")
    right = spark.createDataFrame([(1, long + "y", 5)], "k long, v string, only_right int")
    assert rows(diff(left, right, "k")) == [(1, "value", "only_left"), (1, "value", "only_right"), (1, "value", "v")]


def test_keys_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = spark.range(0, 500).selectExpr("id as k", "cast(id % 5 as string) as v")
        right = spark.range(3, 503).selectExpr("id as k", "case when id % 50 = 0 then 'z' else cast(id % 5 as string) end as v")
        got = diff(left, right, "k", partitions=2).groupBy("diff_kind").count().collect()
        assert {r[0]: r[1] for r in got} == {"missing_right": 3, "missing_left": 3, "value": 9}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_one_key_that_differ_in_their_combination(spark):
    left = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "k long, p string, q string")
    right = spark.createDataFrame([(1, "a", "y"), (1, "b", "x"), (2, "a", "x")], "k long, p string, q string")
    assert rows(diff(left, right, "k")) == [(1, "value", "q")]


def test_composite_keys_and_types(spark):
    left = spark.createDataFrame([(1, None, 5, 1.5, "1"), (1, "b", 6, 2.0, "2")], "k long, j string, w int, r float, t string")
    right = spark.createDataFrame([(1, None, 5, 1.5, 1), (1, "b", 7, 2.0, 2)], "k int, j string, w long, r double, t int")
    got = sorted((r.row_key.j or "", r.diff_kind, r.field) for r in diff(left, right, ["k", "j"]).collect())
    assert got == [("", "value", "t"), ("b", "value", "t"), ("b", "value", "w")]


def test_hot_keys_are_compared_alike(spark):
    def table(n, seed, gone=()):
        return [(1 if i % 3 == 0 else i % 7, f"v{(i * seed) % 50}", f"w{i % 4}") for i in range(n) if i not in gone]

    ddl = "k long, p string, q string"
    left, right = spark.createDataFrame(table(4000, 7), ddl), spark.createDataFrame(table(4000, 7, {0, 3}) + [(1, "new", None), (9, "only", "right")] * 500, ddl)
    got = rows(diff(left, right, "k", partitions=3))
    from plumbline.operators.diff import _differences

    want = set()
    sides = [{}, {}]
    for s, d in enumerate((left, right)):
        for k, p, q in d.collect():
            sides[s].setdefault(k, set()).add((p, q))
    for k in sides[0].keys() | sides[1].keys():
        a, b = sides[0].get(k, set()), sides[1].get(k, set())
        want |= {(k, "missing_left", "")} if not a else {(k, "missing_right", "")} if not b else {(k, *x) for x in _differences(a, b, ["p", "q"])}
    assert got == sorted(want)
