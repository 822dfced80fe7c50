"""Findings of modules: parse once, evaluate all rules on the facts, join where a rule needs more than one fact."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.rules.module_rules import FACT_RULES
from plumbline.session import cut, cut_columns, ship, spread

FACTS = "module_id long, rel string, line int, col int, stmt int, q int, pq int, a string, b string, c string, n long, f array<string>"
_ARROW = pa.schema([("module_id", pa.int64()), ("rel", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("stmt", pa.int32()), ("q", pa.int32()), ("pq", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("n", pa.int64()), ("f", pa.list_(pa.string()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plumbline.tsql.facts import facts

    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            rows = []
            for i, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                try:
                    found = facts(text)
                except Exception as ex:  # noqa: BLE001 - a module that breaks the walk is reported, the others go on
                    found = [("skipped", 1, 1, 0, 0, 0, type(ex).__name__, "", "", 0, [])]
                rows += [(i, *f) for f in found]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plumbline.tsql.facts import counts

    n: Counter[tuple[str | None, str]] = Counter()
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            for kind, text in zip(part["kind"].to_pylist(), part["text"].to_pylist(), strict=True):
                try:
                    found = counts(text)
                except Exception:  # noqa: BLE001 - a module that breaks the walk is one skipped fact
                    found = {"skipped": 1}
                for rel, k in found.items():
                    n[kind, rel] += k
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([r for _, r in n], pa.string()), pa.array(n.values(), pa.int64())], ["kind", "rel", "n"])


def module_facts(modules: DataFrame, ident: str = "module_id", text: str = "definition") -> DataFrame:
    """The facts of each module with a non-null text; a module that can't be read gives a ``skipped`` fact."""
    ship(modules.sparkSession)
    rows = modules.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    return spread(rows).mapInArrow(_parse, FACTS)


def fact_counts(modules: DataFrame, kind: str, text: str = "definition") -> DataFrame:
    """``(kind, rel, n)``: the facts of each relation in the modules of each kind. They are counted where they are found; no fact is moved."""
    ship(modules.sparkSession)
    rows = modules.select(F.col(f"`{kind}`").cast("string").alias("kind"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    return spread(rows).mapInArrow(_count, "kind string, rel string, n long").groupBy("kind", "rel").agg(F.sum("n").alias("n"))


def written_facts(modules: DataFrame) -> DataFrame:
    """``module_facts`` as a table in the shared folder, by relation, so that each rule reads the relations and columns it needs."""
    return cut_columns(module_facts(modules).sortWithinPartitions("rel", "module_id"))


def single_fact_findings(facts: DataFrame) -> DataFrame:
    """Findings of all rules that one fact decides, in one pass over the facts."""
    tests = []
    for rule, (rel, cond, confidence) in FACT_RULES.items():
        rels = rel.split("|")
        test = (F.col("rel") == rels[0]) if len(rels) == 1 else F.col("rel").isin(rels)
        tests.append(F.when(test & F.expr(f"({cond})"), F.struct(F.lit(rule).alias("rule_id"), F.lit(confidence).alias("confidence"))))
    # A few arrays side by side keep the generated code of each small.
    hits = F.flatten(F.array(*[F.array(*tests[i : i + 12]) for i in range(0, len(tests), 12)]))
    found = facts.select("module_id", "line", "col", F.concat_ws(" ", "a", "b", "c").alias("detail"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r"))
    return found.select("module_id", "r.rule_id", "line", "col", "r.confidence", "detail")


def _finding(df: DataFrame, rule: str, confidence: str = "High", detail=None) -> DataFrame:
    return df.select("module_id", F.lit(rule).alias("rule_id"), "line", "col", F.lit(confidence).alias("confidence"), (F.lit("") if detail is None else detail).alias("detail"))


def _rel(facts: DataFrame, *names: str) -> DataFrame:
    return facts.where(F.col("rel").isin(list(names)) if len(names) > 1 else F.col("rel") == names[0])


def _has(flag: str):
    return F.array_contains("f", flag)


def missing_nocount(facts: DataFrame) -> DataFrame:
    on = _rel(facts, "set_opt").where((F.col("a") == "nocount") & (F.col("b") == "on")).select("module_id").distinct()
    return _finding(_rel(facts, "module").where(F.col("a").isin("procedure", "trigger")).join(on, "module_id", "left_anti"), "statement-shape/missing-set-nocount-on")


def duplicated_literals(facts: DataFrame) -> DataFrame:
    content = F.length(F.regexp_extract("a", r"(?s)^[nN]?'(.*)'$", 1))
    lits = _rel(facts, "literal").where((F.col("c") == "string") & (content >= 3))
    g = lits.groupBy("module_id", "a").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("line", "col")).alias("p")).where(F.col("k") >= 3)
    return _finding(g.select("module_id", "p.line", "p.col", "a"), "duplication/duplicated-string-literal", "High", F.col("a"))


def unused_labels(facts: DataFrame) -> DataFrame:
    gotos = _rel(facts, "stmt").where("a = 'goto'").select("module_id", "b").distinct()
    return _finding(_rel(facts, "stmt").where("a = 'label'").join(gotos, ["module_id", "b"], "left_anti"), "dead-code/unused-label", "High", F.col("b"))


def disjoint_unions(facts: DataFrame) -> DataFrame:
    """UNION chains whose branches each fix one column of one table to another literal."""
    unions = _rel(facts, "query").where(_has("set_op")).groupBy("module_id", "q").agg(F.count(F.lit(1)).alias("k"), F.bool_and((F.col("a") == "union") & ~_has("all")).alias("plain"), F.min(F.struct("line", "col")).alias("p")).where("plain")
    eq = _rel(facts, "pred").where((F.col("b") == "=") & _has("where") & _has("l:column") & _has("r:literal") & ~_has("or") & ~_has("not"))
    eq = eq.groupBy("module_id", "pq", "q").agg(F.count(F.lit(1)).alias("e"), F.min("a").alias("a"), F.min(F.lower("c")).alias("lit"))
    refs = _rel(facts, "from_ref").groupBy("module_id", "pq", "q").agg(F.count(F.lit(1)).alias("r"), F.min("a").alias("tab"))
    both = refs.join(eq, ["module_id", "pq", "q"], "left").groupBy("module_id", "pq").agg(F.count(F.lit(1)).alias("m"), F.bool_and((F.col("r") == 1) & (F.coalesce("e", F.lit(0)) == 1)).alias("one"), F.count_distinct("a").alias("cols"), F.count_distinct("tab").alias("tabs"), F.count_distinct("lit").alias("lits"))
    j = unions.join(both.withColumnRenamed("pq", "q"), ["module_id", "q"])
    return _finding(j.where("m = k + 1 and one and cols = 1 and tabs = 1 and lits = m").select("module_id", "p.line", "p.col"), "query/union-of-provably-disjoint-branches")


def comma_joins(facts: DataFrame) -> DataFrame:
    """Comma joins of a query without any predicate between two columns."""
    comma = _rel(facts, "from_ref").where(_has("comma"))
    linked = _rel(facts, "pred").where(_has("l:column") & _has("r:column")).select("module_id", "q").distinct()
    first = comma.join(linked, ["module_id", "q"], "left_anti").groupBy("module_id", "q").agg(F.min(F.struct("line", "col")).alias("p"))
    return _finding(first.select("module_id", "p.line", "p.col"), "join/cartesian-comma-join")


def outer_collapse(facts: DataFrame) -> DataFrame:
    """A null-rejecting top-level WHERE conjunct on the side of an outer join that may be padded with nulls.

    That is the table after LEFT or FULL JOIN and every table before RIGHT or FULL JOIN, in the query itself.
    """
    refs = _rel(facts, "from_ref").where(~_has("merge_target")).select("module_id", "q", F.when(F.col("b") != "", F.col("b")).otherwise(F.element_at(F.split("a", "\\."), -1)).alias("alias"), F.struct("line", "col").alias("p"), F.element_at("f", 1).alias("how"))
    own = refs.where(F.col("how").rlike("^(left|full)")).select("module_id", "q", "alias")
    late = refs.where(F.col("how").rlike("^(right|full)")).groupBy("module_id", "q").agg(F.max("p").alias("last"))
    before = refs.join(late, ["module_id", "q"]).where(F.col("p") < F.col("last")).select("module_id", "q", "alias")
    preds = _rel(facts, "pred").where(_has("where") & ~_has("or") & ~_has("not") & F.col("b").isin("=", "<>", "!=", "<", "<=", ">", ">=", "like", "in", "between"))
    sides = F.array(F.when(_has("l:column"), F.col("a")), F.when(_has("r:column") & ~F.col("b").isin("in", "between", "like"), F.col("c")))
    cols = preds.select("module_id", "q", "line", "col", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("a")).withColumn("parts", F.split("a", " \\. ")).where(F.size("parts") >= 2)
    hit = cols.withColumn("alias", F.element_at("parts", -2)).join(own.unionByName(before).distinct(), ["module_id", "q", "alias"], "left_semi")
    return _finding(hit.dropDuplicates(["module_id", "line", "col"]), "join/outer-join-predicate-collapse", "High", F.col("a"))


def scalar_udfs(facts: DataFrame) -> DataFrame:
    """Calls of scalar functions that the corpus defines, in predicates and elsewhere."""
    udf = _rel(facts, "module").where("a = 'function'").select(F.col("b").alias("a")).distinct()
    use = _rel(facts, "call").where(_has("qualified")).join(udf, "a", "left_semi")
    filt = _has("where") | _has("on") | _has("having") | _has("merge_on")
    return use.select("module_id", F.when(filt, "scalar-udf/in-predicate").otherwise("scalar-udf/in-select-or-expression").alias("rule_id"), "line", "col", F.lit("High").alias("confidence"), F.col("a").alias("detail"))


def lock_order(facts: DataFrame) -> DataFrame:
    """Procedures whose transactions first write two tables in opposite orders."""
    writes = _rel(facts, "stmt").where((F.col("a") == "dml") & _has("in_tran") & _has("table")).groupBy("module_id", "b").agg(F.min(F.struct("line", "col")).alias("p"))
    pairs = writes.alias("x").join(writes.alias("y"), F.col("x.module_id") == F.col("y.module_id")).where("x.b < y.b")
    pairs = pairs.select(F.col("x.module_id").alias("module_id"), F.col("x.b").alias("t1"), F.col("y.b").alias("t2"), (F.col("x.p") < F.col("y.p")).alias("fwd"), F.least("x.p", "y.p").alias("p"))
    both = pairs.groupBy("t1", "t2").agg(F.count_distinct("fwd").alias("k")).where("k > 1")
    return _finding(pairs.join(both, ["t1", "t2"], "left_semi").select("module_id", "p.line", "p.col", "t1", "t2"), "cross-module/inconsistent-lock-order", "Medium", F.concat_ws(" ", "t1", "t2"))


def trigger_facts(facts: DataFrame) -> DataFrame:
    """Result-emitting triggers, triggers without an early way out, and single-row reads of inserted or deleted."""
    trg = _rel(facts, "module").where("a = 'trigger'").select("module_id", "line", "col")
    out = _rel(facts, "stmt").where("a in ('select','print') and b = ''").join(trg.select("module_id"), "module_id", "left_semi")
    assigns = _rel(facts, "query").where(_has("assigns")).select("module_id", "stmt").distinct()
    emits = out.join(assigns, ["module_id", "stmt"], "left_anti")
    guard = _rel(facts, "cond").where("c like '%inserted%' or c like '%deleted%' or c like '%@@rowcount%'").select("module_id").distinct()
    single = _rel(facts, "query").where(_has("assigns") & ~_has("where") & ~_has("top")).join(trg.select("module_id"), "module_id", "left_semi")
    pseudo = _rel(facts, "from_ref").where("a in ('inserted','deleted')").select("module_id", "stmt").distinct()
    return (
        _finding(emits, "control-flow/trigger-emits-output")
        .unionByName(_finding(trg.join(guard, "module_id", "left_anti"), "trigger/no-early-out-for-empty-invocation", "Medium"))
        .unionByName(_finding(single.join(pseudo, ["module_id", "stmt"], "left_semi"), "trigger/multi-row-unsafe-single-row-assignment"))
    )


def trigger_recursion(facts: DataFrame) -> DataFrame:
    """Triggers that write their own table, and cycles of up to eight triggers over several tables."""
    on = _rel(facts, "module").where("a = 'trigger'").select("module_id", "line", "col", F.col("c").alias("src"))
    to = _rel(facts, "stmt").where((F.col("a") == "dml") & _has("table")).select("module_id", F.col("b").alias("dst")).distinct()
    edges = on.join(to, "module_id")
    own = _finding(edges.where("src = dst"), "trigger/direct-recursive-trigger", "Low", F.col("src"))
    steps = edges.select("src", "dst").where("src <> dst").distinct()
    paths = steps.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    closed = None
    for _ in range(7):
        nxt = paths.join(steps.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at")
        done = nxt.where("to = start").select("start")
        closed = done if closed is None else closed.unionByName(done)
        paths = nxt.where(~F.array_contains("path", F.col("to"))).select("start", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    cyc = on.join(closed.distinct().withColumnRenamed("start", "src"), "src", "left_semi")
    return own.unionByName(_finding(cyc, "trigger/multi-hop-recursion-cycle", "High", F.col("src")))


def count_star_checks(facts: DataFrame) -> DataFrame:
    """COUNT(*) put in a variable that the next statement only compares with zero."""
    counts = _rel(facts, "assign").where("b rlike '^(\\\\( select )?count \\\\( \\\\* \\\\)'").select("module_id", F.col("a").alias("v"), "stmt", "line", "col")
    zero = _rel(facts, "pred").where(_has("if") & (F.col("c") == "0") & F.col("b").isin("=", ">", "<>", "!=")).select("module_id", F.col("a").alias("v"), (F.col("stmt") - 1).alias("stmt")).distinct()
    return _finding(counts.join(zero, ["module_id", "v", "stmt"], "left_semi"), "query/count-star-variable-existence-check", "High", F.col("v"))


def loop_facts(facts: DataFrame) -> DataFrame:
    """Single-row DML in loops and table variables read in a loop that also writes them."""
    dml = _rel(facts, "stmt").where(F.col("a").isin("update", "delete") & _has("in_loop"))
    keyed = _rel(facts, "pred").where((F.col("b") == "=") & _has("where") & _has("l:column") & _has("r:var")).select("module_id", "stmt").distinct()
    written = _rel(facts, "stmt").where((F.col("a") == "dml") & _has("in_loop") & _has("table_variable")).select("module_id", F.col("b").alias("a")).distinct()
    read = _rel(facts, "from_ref").where("c = 'table_variable'")
    return _finding(dml.join(keyed, ["module_id", "stmt"], "left_semi"), "query/rbar-single-row-loop-dml", "Medium", F.col("b")).unionByName(
        _finding(read.join(written, ["module_id", "a"], "left_semi"), "query/table-variable-stale-estimate-in-loop", "Medium", F.col("a"))
    )


def having_on_keys(facts: DataFrame) -> DataFrame:
    """HAVING conditions over group keys only."""
    keys = _rel(facts, "group_item").where("b = 'item'").select("module_id", "q", "a").distinct()
    return _finding(_rel(facts, "pred").where(_has("having") & ~_has("or") & _has("l:column")).join(keys, ["module_id", "q", "a"], "left_semi"), "query/non-aggregate-having-predicate", "High", F.col("a"))


def temp_tables(facts: DataFrame) -> DataFrame:
    """Temp tables made by SELECT INTO and joined or filtered later without an index on them."""
    made = _rel(facts, "stmt").where("a = 'select' and b like '#%'").select("module_id", "b", F.col("stmt").alias("made"))
    indexed = _rel(facts, "stmt").where("a = 'create index' or a = 'create clustered' or a = 'create nonclustered' or a = 'create unique'").select("module_id", F.regexp_extract("c", " on (#+\\w+)", 1).alias("b")).distinct()
    bare = made.join(indexed, ["module_id", "b"], "left_anti")
    use = _rel(facts, "from_ref").where("c = 'temp'").select("module_id", F.col("a").alias("b"), "stmt", "q", "line", "col", "f").join(bare, ["module_id", "b"]).where("stmt > made")
    joined = use.where(F.exists("f", lambda x: x.endswith("join")))
    filtered = use.where(~F.exists("f", lambda x: x.endswith("join"))).join(_rel(facts, "pred").where(_has("where")).select("module_id", "q").distinct(), ["module_id", "q"], "left_semi")
    return _finding(joined, "temp-table/unindexed-join-operand", "Medium", F.col("b")).unionByName(_finding(filtered, "temp-table/unindexed-where-filter", "Medium", F.col("b")))


def group_validity(facts: DataFrame) -> DataFrame:
    """Columns outside aggregates that a plain GROUP BY doesn't hold, in the select list, HAVING and ORDER BY of its query.

    A clause that repeats a whole group expression is valid, so only columns of clauses whose own columns are no keys count.
    """
    bare = lambda c: F.element_at(F.split(F.regexp_replace(c, " ", ""), "\\."), -1)
    plain = _rel(facts, "query").where(_has("group")).select("module_id", "q").distinct()
    odd = _rel(facts, "group_item").where("b = 'sets' and a <> ''").select("module_id", "q").distinct()
    keys = _rel(facts, "group_item").where("b = 'item'").select("module_id", "q", bare("a").alias("k")).distinct()
    computed = _rel(facts, "group_item").where("b = 'item' and a like '% %' and not a rlike '^[^ ]+( . [^ ]+)+$'").select("module_id", "q").distinct()
    names = _rel(facts, "select_item").select("module_id", "q", F.substring_index(F.try_element_at(F.filter("f", lambda x: x.startswith("name:")), F.lit(1)), ":", -1).alias("k")).where("k is not null").distinct()
    items = _rel(facts, "select_item").where("c = 'column'").select("module_id", "q", "line", "col", bare(F.regexp_replace("a", " (as )?[^ .]+$|^[^ ]+ = ", "")).alias("short"), bare("a").alias("whole"))
    items = items.select("module_id", "q", "line", "col", F.when(F.col("short") == "", F.col("whole")).otherwise(F.col("short")).alias("k"), F.lit("group-by/invalid-select-list-column").alias("rule_id"))
    having = _rel(facts, "pred").where(_has("having") & _has("l:column")).select("module_id", "q", "line", "col", bare("a").alias("k"), F.lit("group-by/invalid-having-column").alias("rule_id"))
    order = _rel(facts, "order_item").where(~_has("ordinal") & F.col("a").rlike(r"^[\w#$@]+( \. [\w#$@]+)*$")).select("module_id", "q", "line", "col", bare("a").alias("k"), F.lit("group-by/invalid-order-by-column").alias("rule_id")).join(names, ["module_id", "q", "k"], "left_anti")
    every = items.unionByName(having).unionByName(order.select(items.columns))
    bad = every.join(plain, ["module_id", "q"], "left_semi").join(odd, ["module_id", "q"], "left_anti").join(computed, ["module_id", "q"], "left_anti").join(keys, ["module_id", "q", "k"], "left_anti")
    args = _rel(facts, "call").where("a in ('grouping','grouping_id')").select("module_id", "q", "line", "col", F.explode(F.split("b", " , ")).alias("arg"))
    wrong = args.select("module_id", "q", "line", "col", bare("arg").alias("k")).join(plain, ["module_id", "q"], "left_semi").join(odd, ["module_id", "q"], "left_anti").join(keys, ["module_id", "q", "k"], "left_anti")
    found = bad.select("module_id", "rule_id", "line", "col", F.lit("High").alias("confidence"), F.col("k").alias("detail"))
    return found.unionByName(_finding(wrong, "query/grouping-argument-not-in-group-by-list", "High", F.col("k")))


def compile_flags(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """What the module's compile flags alone decide."""
    at = modules.select(F.col("module_id").cast("long").alias("module_id"), "is_recompiled", "object_type_code", "is_schema_bound", "uses_database_collation").withColumn("line", F.lit(1)).withColumn("col", F.lit(1))
    return _finding(at.where("is_recompiled"), "catalog/with-recompile").unionByName(_finding(at.where("object_type_code = 'TF' and not is_schema_bound and uses_database_collation"), "catalog/tvf-return-database-collation"))


def native_modules(facts: DataFrame) -> DataFrame:
    """Built-ins and callees that natively compiled modules can't use."""
    from plumbline.rules.module_rules import _NATIVE_DENIED

    native = _rel(facts, "module").where(_has("native_compilation")).select("module_id", "b")
    calls = _rel(facts, "call").join(native.select("module_id"), "module_id", "left_semi")
    denied = calls.where(F.expr(f"a in {_NATIVE_DENIED}"))
    errors = calls.where("a in ('error_message','error_number','error_severity','error_state','error_line','error_procedure')").where(~_has("in_catch"))
    others = _rel(facts, "module").where(~_has("native_compilation") & F.col("a").isin("procedure", "function")).select(F.col("b").alias("a")).distinct()
    callee = _rel(facts, "exec", "call").join(native.select("module_id"), "module_id", "left_semi").join(others, "a", "left_semi")
    return (
        _finding(denied, "predicate/natively-compiled-unsupported-builtin", "High", F.col("a"))
        .unionByName(_finding(errors, "predicate/natively-compiled-error-outside-catch", "High", F.col("a")))
        .unionByName(_finding(callee, "predicate/natively-compiled-interpreted-callee", "High", F.col("a")))
    )


def dangling_calls(facts: DataFrame) -> DataFrame:
    """EXEC of a two-part name that no module of the corpus has."""
    have = _rel(facts, "module").select(F.col("b").alias("a")).distinct()
    return _finding(_rel(facts, "exec").where(~_has("at")).where("a rlike '^[^.]+[.][^.]+$' and a not like 'sys.%'").join(have, "a", "left_anti"), "catalog/dangling-object-reference", "Low", F.col("a"))


JOIN_RULES: list[Callable[[DataFrame], DataFrame]] = [
    missing_nocount, duplicated_literals, unused_labels, disjoint_unions, comma_joins, outer_collapse, scalar_udfs, lock_order, trigger_facts, trigger_recursion,
    count_star_checks, loop_facts, having_on_keys, temp_tables, group_validity, native_modules, dangling_calls,
]


#: What typed rules read of catalog columns.
COLUMNS = "table_name string, column_name string, declared string, collation string, is_nullable boolean, is_masked boolean, encryption string, is_ansi_padded boolean"


def scan(modules: DataFrame, facts: DataFrame | None = None, columns: DataFrame | None = None, catalog: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """Findings of all module rules over ``modules`` (module_id, definition, …) and the rules that failed to build.

    A rule that breaks is left out and named; the others go on. The facts are written once and shared by all rules. ``catalog``
    holds relations as ``catalog_rules.SCHEMAS``; its columns, or ``columns`` (as ``COLUMNS``), serve the typed rules.
    Without columns the typed rules are those of variables, parameters and call sites, and rules over resolved columns,
    which could find nothing, are not run.
    """
    from plumbline.rules import scoped, typed

    facts = written_facts(modules) if facts is None else facts
    catalog = catalog or {}
    if columns is None and "cat_columns" in catalog:
        columns = catalog["cat_columns"].select("table_name", "column_name", "declared", "collation", "is_nullable", "is_masked", "encryption", F.lit(True).alias("is_ansi_padded"))
    none = facts.sparkSession.createDataFrame([], COLUMNS)
    flags = ["uses_quoted_identifier", "uses_ansi_nulls"]
    compiled = modules.select(F.col("module_id").cast("long").alias("module_id"), *[(F.coalesce(c, F.lit(True)) if c in modules.columns else F.lit(True)).alias(c) for c in flags])
    named = [r for r, (_, sql) in scoped.SCOPED_RULES.items() if "cat_columns" in catalog or not scoped.NEEDS_COLUMNS.search(sql)]
    single = (lambda f: single_fact_findings(f)) if columns is None else (lambda f: without_harmless_casts(single_fact_findings(f), f, columns))
    rules: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [("facts", single), *((r.__name__, r) for r in JOIN_RULES), ("calls", lambda f: typed.call_findings(f).distinct())]  # a callee installed in several databases counts once
    if columns is None:
        rules.append(("writes", lambda f: typed.write_findings(f, none).distinct()))
    else:
        rules += [("writes", lambda f: typed.write_findings(f, columns).distinct()), ("predicates", lambda f: typed.predicate_findings(cut(typed.typed_predicates(f, columns))).distinct())]
    if {"is_recompiled", "object_type_code", "is_schema_bound", "uses_database_collation"} <= set(modules.columns):
        rules.append(("compile flags", lambda f: compile_flags(f, modules)))
    tasks = [(name, lambda r=r: r(facts)) for name, r in rules]
    done, broken = together(tasks, ["module_id", "rule_id", "line", "col", "confidence", "detail"])
    more, failed = together(*scoped.scoped_tasks(scoped.Scopes(facts, catalog), compiled, named))
    return reduce(DataFrame.unionByName, [*done, *more]), broken + failed


#: Rules, or groups of them, that are run at one time.
AT_ONCE = 6


def together(tasks: list[tuple[str, Callable[[], DataFrame]]], columns: list[str]) -> tuple[list[DataFrame], list[str]]:
    """The tasks' frames, each written once, several at a time; those that fail, when planned or when run, are named."""

    def run(task: tuple[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, str]:
        try:
            return cut(task[1]().select(*columns)), ""
        except Exception as ex:  # noqa: BLE001 - containment: one rule must not stop the scan
            return None, f"{task[0]}: {str(ex)[:300]}"

    with ThreadPoolExecutor(AT_ONCE) as pool:
        got = list(pool.map(run, tasks))
    return [df for df, _ in got if df is not None], [why for _, why in got if why]


def without_harmless_casts(found: DataFrame, facts: DataFrame, columns: DataFrame) -> DataFrame:
    """``found`` without casts of columns that a seek sees through: one type, both numeric, or both dates without an offset."""
    from plumbline.functions import types as T
    from plumbline.rules import typed

    casts = _rel(facts, "cast").where("get(f, 2) = 'column'").select("module_id", "q", "line", "col", F.col("b").alias("left"), T.parse_type(F.col("a")).alias("to"))
    known = typed._columns(casts, "left", facts, columns)
    numeric = [*T.EXACTS, *T.APPROXIMATE]
    same = (F.col("ctype.name") == F.col("to.name")) | F.col("ctype.name").isin(numeric) & F.col("to.name").isin(numeric) | F.col("ctype.name").isin([d for d in T.DATES if d != "datetimeoffset"]) & F.col("to.name").isin(T.DATES)
    fine = known.where(~F.col("ctype.name").isin(T.STRINGS + T.BINARIES) & same).select("module_id", "line", "col", F.lit("tier1/cast-or-convert-on-column").alias("rule_id")).distinct()
    return found.join(fine, ["module_id", "rule_id", "line", "col"], "left_anti").select(found.columns)


def ranked(found: DataFrame, least: str = "Low") -> DataFrame:
    """Findings at or above a confidence, with family and a total order: confidence, rule, module, line, column."""
    rank = F.when(F.col("confidence") == "High", 0).when(F.col("confidence") == "Medium", 1).otherwise(2)
    limit = {"High": 0, "Medium": 1, "Low": 2}[least]
    kept = found.withColumn("family", F.substring_index("rule_id", "/", 1)).withColumn("rank", rank).where(F.col("rank") <= limit)
    return kept.orderBy("rank", "rule_id", "module_id", "line", "col", "detail")


def best_of_duplicates(found: DataFrame) -> DataFrame:
    """One finding for each rule and place, with its best confidence."""
    w = Window.partitionBy("module_id", "rule_id", "line", "col").orderBy(F.when(F.col("confidence") == "High", 0).when(F.col("confidence") == "Medium", 1).otherwise(2), "detail")
    return found.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
