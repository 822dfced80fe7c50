import pytest

from plumbline.tsql.facts import facts
from plumbline.tsql.lexer import batches, tokens


def rel(sql, name):
    return [f for f in facts(sql) if f[0] == name]


def test_tokens_and_nested_comments():
    code, comments = tokens("select [a]]b], \"c\"\"d\", N'it''s' /* x /* y */ z */ -- t\n<> 1.5e3 @v #t")
    assert [t.low for t in code] == ["select", "a]b", ",", 'c"d', ",", "n'it''s'", "<>", "1.5e3", "@v", "#t"]
    assert len(comments) == 2


def test_batches():
    sql = "select 1\nGO\nselect 'a\nGO\nb'\n  go 3 -- again\n/*\nGO\n*/ select [GO]\n"
    assert [(t.strip(), n) for t, _, n in batches(sql)] == [("select 1", 1), ("select 'a\nGO\nb'", 3), ("/*\nGO\n*/ select [GO]", 1)]
    assert batches("") == []


@pytest.mark.parametrize("text", ["", "   ", "(((", "))", "select", "begin", "end end", "if", "case when", "create procedure", "'open", "[open", "/* open", "exec", "with x as (", "declare @", "é" * 5000, "select " + "(" * 200 + "1" + ")" * 200])
def test_odd_texts_do_not_crash(text):
    facts(text)


def test_statement_borders():
    sql = """create procedure dbo.p @a int as
insert into t (a) select b from u union select c from v
update t set a = 1 where b = 2
merge t using s on t.i = s.i when matched then update set a = 1 when not matched then insert (a) values (1);
select a from t order by a offset 5 rows fetch next 5 rows only
declare c cursor local for select a from t
if exists (select 1 from t) delete from t where a = 1 else print 'x'"""
    kinds = [f[6] for f in rel(sql, "stmt") if f[6] not in ("dml", "merge action")]
    assert kinds == ["insert", "update", "merge", "select", "declare cursor", "delete", "print", "if"]


def test_predicate_facts():
    (p,) = rel("select 1 from t where year(t.d) between 1 and 2", "pred")
    assert p[7] == "between" and "l:call:year" in p[10] and "lcol:t.d" in p[10]
    assert any("catch_all" in f[10] for f in rel("select 1 from t where (a = @p or @p is null)", "pred"))
    assert any("contradiction" in f[10] for f in rel("select 1 from t where a > 5 and a < 3", "pred"))
    assert not any("contradiction" in f[10] for f in rel("select 1 from t where a > 3 and a < 5", "pred"))
