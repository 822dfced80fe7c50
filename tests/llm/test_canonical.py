import itertools
import random

import pytest

from plumbline.llm import canonical as C

BASE = """-- Team: red squad
-- Created: 2020-01-02
CREATE PROCEDURE [dbo].[usp_DoIt]
@a INT
AS
BEGIN
-- Late rows, last!
SELECT [t].[b], ISNULL([t].[a], 0) AS [x], [t].[c] * 2
FROM [dbo].[t] AS [t] WHERE [t].[k] IN ('One two', 3.5) AND [t].[z] >= @a;
END;"""

SAME = [
    BASE.upper(),
    BASE.replace("[", '"').replace("]", '"'),
    BASE.replace("[", "").replace("]", "").replace(";", ""),
    BASE.replace("\n", "\r\n").replace(" ", "\t "),
    BASE.replace("_", ""),
    "-- ====\n--  CREATED - 2020-01-02\n--  Team: red squad\n-- ====\n" + BASE.split("\n", 2)[2],
    "/*\n * Created: 2020-01-02\n * Team: red squad\n */\n" + BASE.split("\n", 2)[2],
    BASE.replace("-- Late rows, last!", "/* late rows last */"),
    BASE.replace("[t].[b], ISNULL([t].[a], 0) AS [x], [t].[c] * 2", "ISNULL([t].[a], 0) AS [x]\n , [t].[c] * 2\n , [t].[b]"),
]
OTHER = [
    BASE.replace(">=", ">"), BASE.replace("3.5", "35"), BASE.replace("@a;", "a;"), BASE.replace("One two", "One too"), BASE.replace("'One two', 3.5", "3.5, 'One two'"),
    BASE.replace("Late rows", "Early rows"), BASE.replace("* 2", "* 3"), BASE.replace("INT", "BIGINT"), BASE.replace("-- Late rows, last!", "Late rows, last!"), BASE.replace("red squad", "blue squad"),
]


@pytest.mark.parametrize("text", SAME)
def test_formatting_is_ignored(text):
    assert C.canonical(text) == C.canonical(BASE)


@pytest.mark.parametrize("text", OTHER)
def test_everything_else_counts(text):
    assert C.canonical(text) != C.canonical(BASE)


def test_select_lists_nested_and_plain_agree():
    items = ["a", "b + 1", "f(x, y)", "'p,q'", "[from]", "case when a in (1, 2) then b else c end", "(select max(z), w from u)"]
    forms = {C.canonical("select distinct top (5) " + ", ".join(p) + " from t order by a, b") for p in itertools.islice(itertools.permutations(items), 0, 5040, 97)}
    assert len(forms) == 1
    assert C.canonical("select a, b from t order by a, b") != C.canonical("select a, b from t order by b, a")
    assert C.canonical("insert into t (a, b) select a, b from u") != C.canonical("insert into t (b, a) select a, b from u")
    plain = "select a, b(c, d), 'x' from t where y in (1, 2)"
    head, code, kept = C._mask(plain)
    assert C._plain_lists(code, kept) == C._nested_lists(code, kept)


@pytest.mark.parametrize("text", ["", " ", "select", "select ,", "select (", "'open", "/* open", "[open", "((((", ")", "case end", "\x01\x02", "select a, b", "é" * 100_000, "select " + "a, " * 20_000 + "b from t"])
def test_odd_texts(text):
    C.canonical(text)


def brute(rows):
    key = {}
    for i, n, t in rows:
        if t is not None:
            key.setdefault((None if n is None else C.canonical_name(n), C.canonical(t)), []).append(i)
    return {i: (min(g), len(g)) for g in key.values() for i in g}


def test_copies_with_a_hot_group_nulls_and_empty_texts(spark):
    rng = random.Random(1)
    rows = [(i, "Usp_A" if i % 2 else "uspa", f"select {'a, b' if i % 3 else 'b, a'} from t") for i in range(40)]
    rows += [(100 + i, rng.choice([None, "x", "X ", ""]), rng.choice([None, "", " ", "select 1", "SELECT 1;"])) for i in range(60)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "module_id long, object_name string, definition string, keep_id string")
    got = {r.id: (r.keep_id, r.n_copies) for r in C.copies(df, "module_id", "object_name", "definition").collect()}
    assert got == brute(rows)
    assert C.copies(df.limit(0), "module_id", "object_name", "definition").count() == 0
    assert C.collisions(C.record_keys(df, "module_id", "object_name", "definition")).count() == 0
