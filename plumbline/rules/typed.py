"""Rules that need types: comparisons and assignments joined with declared variables, parameters and catalog columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import types as T
from plumbline.session import cut

#: Families of typed rules.
TYPED_RULES = ["verdict/scan-forced", "verdict/range-seek", "verdict/unknown", "verdict/operand-clash", "verdict/collation-conflict", "predicates/oversized-parameter", "predicates/under-length-parameter", "predicates/local-variable-predicate", "predicates/float-equality", "predicates/xml-operand-not-comparable", "predicates/json-operand-not-comparable", "predicates/legacy-lob-operand-not-comparable", "predicates/spatial-operand-not-comparable", "predicates/dynamic-data-masking-predicate-exposure", "predicates/ansi-padding-mismatch", "correctness/not-null-predicate-contradiction", "call-graph/argument-type-mismatch", *(f"write-loss/{k}" for k in ("unicode-to-non-unicode", "approximate-to-exact-truncation", "numeric-scale-narrowing", "temporal-precision-loss", "length-truncation", "temporal-scale-narrowing", "temporal-offset-dropped"))]
_KIND = {"xml": "xml", "json": "json", "text": "legacy-lob", "ntext": "legacy-lob", "image": "legacy-lob", "geometry": "spatial", "geography": "spatial"}


def _rel(facts: DataFrame, name: str) -> DataFrame:
    return facts.where(F.col("rel") == name)


def _flag(prefix: str):
    return F.substring_index(F.try_element_at(F.filter("f", lambda x: x.startswith(prefix)), F.lit(1)), ":", -1)


def variables(facts: DataFrame) -> DataFrame:
    """``(module_id, var, vtype, is_param)`` of declared variables and parameters."""
    one = _rel(facts, "var").select("module_id", F.col("a").alias("var"), T.parse_type(F.col("b")).alias("vtype"), F.lit(False).alias("is_param"))
    return one.unionByName(_rel(facts, "param").select("module_id", F.col("a").alias("var"), T.parse_type(F.col("b")).alias("vtype"), F.lit(True).alias("is_param")))


def scopes(facts: DataFrame) -> DataFrame:
    """``(module_id, stmt, alias, table_name, outer_side, alone)``: what names a statement's columns may be qualified with."""
    refs = _rel(facts, "from_ref").where("c = 'table'").select("module_id", "q", F.when(F.col("b") != "", F.col("b")).otherwise(F.element_at(F.split("a", "\\."), -1)).alias("alias"), F.col("a").alias("table_name"), F.exists("f", lambda x: x.rlike("^(left|full)")).alias("outer_side"))
    dml = _rel(facts, "stmt").where("a = 'dml' and c in ('update','delete')").select("module_id", "q", F.element_at(F.split("b", "\\."), -1).alias("alias"), F.col("b").alias("table_name"), F.lit(False).alias("outer_side"))
    every = refs.unionByName(dml.join(refs.select("module_id", "q").distinct(), ["module_id", "q"], "left_anti"))
    count = every.groupBy("module_id", "q").agg(F.count(F.lit(1)).alias("k"))
    return every.join(count, ["module_id", "q"]).withColumn("alone", F.col("k") == 1).drop("k")


def _columns(uses: DataFrame, ref: str, facts: DataFrame, columns: DataFrame) -> DataFrame:
    """``uses`` with the catalog column that ``ref`` (``a.b`` or ``b``) names; unqualified names only where one table is in scope."""
    cat = columns.select(
        F.lower("table_name").alias("table_name"), F.lower("column_name").alias("cname"), T.parse_type(F.col("declared"), F.col("collation")).alias("ctype"), F.coalesce("is_nullable", F.lit(True)).alias("is_nullable"), F.coalesce("is_masked", F.lit(False)).alias("is_masked"), F.col("encryption").isNotNull().alias("is_encrypted"), F.coalesce("is_ansi_padded", F.lit(True)).alias("is_ansi_padded")
    )
    parts = F.split(F.regexp_replace(F.col(ref), " ", ""), "\\.")
    q = uses.withColumn("cname", F.element_at(parts, -1)).withColumn("__q", F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))))
    s = scopes(facts)
    named = q.where(F.col("__q").isNotNull()).join(s.withColumnRenamed("alias", "__q"), ["module_id", "q", "__q"])
    bare = q.where(F.col("__q").isNull()).join(s.where("alone").drop("alias"), ["module_id", "q"])
    return named.unionByName(bare).drop("__q", "alone").join(cat, ["table_name", "cname"])


def _out(df: DataFrame, rule, confidence: str = "High") -> DataFrame:
    return df.select("module_id", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), "line", "col", F.lit(confidence).alias("confidence"), F.concat_ws(" ", "left", "op", "right").alias("detail"))


def typed_predicates(facts: DataFrame, columns: DataFrame) -> DataFrame:
    """Each comparison of a catalog column with a variable, literal or another column: ``ctype``, ``otype``, ``verdict``."""
    pred = _rel(facts, "pred").where(F.col("b").isin("=", "<>", "!=", "<", "<=", ">", ">=", "like", "is"))
    lk, rk = _flag("l:"), _flag("r:")
    base = pred.select("module_id", "q", "line", "col", F.col("a").alias("left"), F.col("b").alias("op"), F.col("c").alias("right"), lk.alias("lk"), rk.alias("rk"), F.array_contains("f", "negated").alias("negated"))
    flipped = base.where("rk = 'column'").select("module_id", "q", "line", "col", F.col("right").alias("left"), "op", F.col("left").alias("right"), F.col("rk").alias("lk"), F.col("lk").alias("rk"), "negated")
    sides = base.where("lk = 'column'").unionByName(flipped)
    mine = _columns(sides, "left", facts, columns)
    var = mine.where("rk = 'var'").join(variables(facts).withColumnRenamed("var", "right"), ["module_id", "right"], "left")
    keep = ["module_id", "q", "line", "col", "left", "op", "right", "lk", "rk", "negated", "ctype", "is_nullable", "is_masked", "is_encrypted", "is_ansi_padded", "outer_side"]
    every = var.select(*keep, F.col("vtype").alias("otype"), "is_param").unionByName(mine.where("rk in ('literal','null')").select(*keep, F.when(F.col("rk") == "literal", T.literal_type(F.col("right"))).alias("otype"), F.lit(None).cast("boolean").alias("is_param")))
    other = mine.where("rk = 'column'").select(*keep).drop("outer_side")
    theirs = _columns(other.withColumnsRenamed({"ctype": "c1", "is_nullable": "n1", "is_masked": "m1", "is_encrypted": "e1", "is_ansi_padded": "p1"}), "right", facts, columns)
    pairs = theirs.select("module_id", "q", "line", "col", "left", "op", "right", "lk", "rk", "negated", F.col("c1").alias("ctype"), F.col("n1").alias("is_nullable"), F.col("m1").alias("is_masked"), F.col("e1").alias("is_encrypted"), F.col("p1").alias("is_ansi_padded"), "outer_side", F.col("ctype").alias("otype"), F.lit(None).cast("boolean").alias("is_param"))
    done = every.unionByName(pairs).withColumn("is_literal", F.col("rk").isin("literal", "null"))
    return T.verdicts(done, "ctype", "otype", "is_literal", "op")


def predicate_findings(typed: DataFrame) -> DataFrame:
    """Findings of the comparison rules."""
    real = typed.where("rk <> 'null'")
    by = {"ScanForced": "verdict/scan-forced", "RangeSeek": "verdict/range-seek", "Unknown": "verdict/unknown", "OperandClash": "verdict/operand-clash"}
    rule = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col("verdict")]
    clash = (F.col("verdict") == "OperandClash") & (F.col("rk") == "column") & F.col("ctype.name").isin(T.STRINGS)
    out = _out(real.where(F.col("verdict") != "SeekPreserved"), F.when(clash, "verdict/collation-conflict").otherwise(rule))
    strings = (F.col("ctype.name").isin(T.NARROW_STRINGS) & F.col("otype.name").isin(T.NARROW_STRINGS) | F.col("ctype.name").isin(T.WIDE_STRINGS) & F.col("otype.name").isin(T.WIDE_STRINGS)) & ~F.col("ctype.is_max") & ~F.col("otype.is_max")
    params = real.where("rk = 'var'")
    kind = F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])[F.col("ctype.name")]
    return (
        out.unionByName(_out(params.where(strings & (F.col("otype.length") > F.col("ctype.length"))), "predicates/oversized-parameter", "Medium"))
        .unionByName(_out(params.where(strings & (F.col("otype.length") < F.col("ctype.length"))), "predicates/under-length-parameter", "Medium"))
        .unionByName(_out(params.where(~F.col("is_param")), "predicates/local-variable-predicate", "Medium"))
        .unionByName(_out(real.where(F.col("op").isin("=", "<>", "!=") & F.col("ctype.name").isin(T.APPROXIMATE)), "predicates/float-equality"))
        .unionByName(_out(real.where(kind.isNotNull() & (F.col("op") != "is")), F.concat(F.lit("predicates/"), kind, F.lit("-operand-not-comparable"))))
        .unionByName(_out(real.where("is_masked and op <> 'is'"), "predicates/dynamic-data-masking-predicate-exposure"))
        .unionByName(_out(real.where(~F.col("is_ansi_padded") & (F.col("op") == "like") & F.col("ctype.name").isin("varchar", "varbinary") & F.col("right").rlike(r"\s'$")), "predicates/ansi-padding-mismatch"))
        .unionByName(_out(typed.where("rk = 'null' and op = 'is' and not negated and not is_nullable and not outer_side"), "correctness/not-null-predicate-contradiction"))
    )


def write_findings(facts: DataFrame, columns: DataFrame) -> DataFrame:
    """Findings of assignments that may lose data: variables and updated columns, from variables, literals and columns."""
    src = _flag("src:")
    assign = _rel(facts, "assign").select("module_id", "q", "line", "col", F.col("a").alias("left"), F.lit("=").alias("op"), F.col("b").alias("right"), F.array_contains("f", "var").alias("to_var"), src.alias("sk"))
    v = variables(facts)
    to_var = assign.where("to_var").join(v.select("module_id", F.col("var").alias("left"), F.col("vtype").alias("target")), ["module_id", "left"])
    to_col = _columns(assign.where("not to_var"), "left", facts, columns).withColumnRenamed("ctype", "target")
    cols = ["module_id", "q", "line", "col", "left", "op", "right", "to_var", "sk", "target"]
    every = to_var.select(*cols).unionByName(to_col.select(*cols))
    lit = every.where("sk = 'literal'").withColumn("source", T.literal_type(F.col("right")))
    var = every.where("sk = 'var'").join(v.select("module_id", F.col("var").alias("right"), F.col("vtype").alias("source")), ["module_id", "right"])
    both = lit.select(*cols, "source").unionByName(var.select(*cols, "source"))
    loss = T.write_loss(F.col("target"), F.col("source"), F.when(F.col("sk") == "literal", F.col("right")), F.col("to_var"))
    found = both.withColumn("loss", loss).where(F.col("loss").isNotNull())
    return _out(found, F.concat(F.lit("write-loss/"), F.col("loss")))


def call_findings(facts: DataFrame) -> DataFrame:
    """EXEC call sites whose variable may lose data in the callee's parameter, by name or position."""
    procs = _rel(facts, "module").where("a = 'procedure'").select("module_id", F.col("b").alias("callee"))
    params = _rel(facts, "param").select("module_id", F.col("a").alias("pname"), F.col("n").alias("pos"), T.parse_type(F.col("b")).alias("target")).join(procs, "module_id").drop("module_id")
    args = _rel(facts, "exec").where("a <> '(dynamic)'").select("module_id", "line", "col", F.col("a").alias("callee"), F.posexplode(F.split("b", " , ")).alias("k", "arg"))
    arg = args.withColumn("pname", F.regexp_extract("arg", r"^(@\w+) = ", 1)).withColumn("right", F.regexp_extract("arg", r"(@\w+)(?: output| out)?$", 1)).where("right <> ''")
    named = arg.where("pname <> ''").join(params.drop("pos"), ["callee", "pname"])
    placed = arg.where("pname = ''").drop("pname").withColumn("pos", (F.col("k") + 1).cast("long")).join(params, ["callee", "pos"])
    cols = ["module_id", "line", "col", "callee", "right", "target", "pname"]
    every = named.select(*cols).unionByName(placed.select(*cols)).join(variables(facts).select("module_id", F.col("var").alias("right"), F.col("vtype").alias("source")), ["module_id", "right"])
    bad = every.where(T.write_loss(F.col("target"), F.col("source"), F.lit(None).cast("string"), F.lit(True)).isNotNull())
    return _out(bad.select("module_id", "line", "col", F.col("callee").alias("left"), F.col("pname").alias("op"), "right"), "call-graph/argument-type-mismatch")


def typed_scan(facts: DataFrame, columns: DataFrame) -> DataFrame:
    """All typed findings. ``columns``: table_name, column_name, declared, collation, is_nullable, is_masked, encryption, is_ansi_padded."""
    return predicate_findings(cut(typed_predicates(facts, columns))).unionByName(write_findings(facts, columns)).unionByName(call_findings(facts))
