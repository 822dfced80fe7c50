"""T-SQL types: families, precedence, results of decimal arithmetic, comparison verdicts and loss on write, as Column expressions.

A type is a struct ``(name, length, precision, scale, collation, is_max)``; ``name`` is lower case, null where it is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types in order of precedence, lowest first.
PRECEDENCE = "binary varbinary char varchar nchar nvarchar uniqueidentifier timestamp image text ntext bit tinyint smallint int bigint smallmoney money decimal real float time date smalldatetime datetime datetime2 datetimeoffset xml sql_variant userdefined json hierarchyid geometry geography vector".split()
# Precision and scale of exact numeric types.
EXACT = {"bit": (1, 0), "tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0), "smallmoney": (10, 4), "money": (19, 4)}
NARROW_STRINGS, WIDE_STRINGS = ["char", "varchar"], ["nchar", "nvarchar"]
STRINGS = NARROW_STRINGS + WIDE_STRINGS
BINARIES = ["binary", "varbinary"]
APPROXIMATE = ["real", "float"]
EXACTS = [*EXACT, "decimal"]
WITH_FRACTION = ["time", "datetime2", "datetimeoffset"]
DATES = ["date", "smalldatetime", "datetime", "datetime2", "datetimeoffset"]
OPAQUE = ["sql_variant", "xml", "userdefined", "text", "ntext", "image", "json", "vector", "geometry", "geography"]
_SYNONYMS = {"numeric": "decimal", "integer": "int", "dec": "decimal", "character": "char", "rowversion": "timestamp", "sysname": "nvarchar", "double": "float"}

TYPE = "struct<name:string,length:int,precision:int,scale:int,collation:string,is_max:boolean>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def parse_type(text: Column, collation: Column | None = None) -> Column:
    """The type that a declaration such as ``varchar(20)`` names; null for an unknown name."""
    own = F.lit(None).cast("string") if collation is None else collation

    def made(t: Column) -> Column:
        raw = F.regexp_extract(t, r"^([a-z_0-9]+)", 1)
        return _let(F.struct(t.alias("t"), F.coalesce(_lookup(_SYNONYMS, raw), raw).alias("name"), F.regexp_extract(t, r"\((\d+)", 1).try_cast("int").alias("a"), F.regexp_extract(t, r",(\d+)\)", 1).try_cast("int").alias("b")), build)

    def build(x: Column) -> Column:
        name, a = x["name"], x["a"]
        is_max = F.contains(x["t"], F.lit("(max)"))
        length = F.when(x["t"].startswith("sysname"), 128).when(~is_max & name.isin(STRINGS + BINARIES), F.coalesce(a, F.lit(1)))
        precision = F.when(name == "decimal", F.coalesce(a, F.lit(18))).otherwise(_lookup({n: p for n, (p, _) in EXACT.items()}, name))
        scale = F.when(name == "decimal", F.coalesce(x["b"], F.lit(0))).when(name.isin(WITH_FRACTION), F.coalesce(a, F.lit(7))).otherwise(_lookup({n: q for n, (_, q) in EXACT.items()}, name))
        whole = F.struct(name.alias("name"), length.cast("int").alias("length"), precision.cast("int").alias("precision"), scale.cast("int").alias("scale"), own.alias("collation"), is_max.alias("is_max"))
        return F.when(name.isin(PRECEDENCE), whole)

    return _let(F.lower(F.regexp_replace(text, r"\s|\[|\]|^dbo\.|notnull$|null$", "")), made)


def literal_type(text: Column) -> Column:
    """The type of a literal as written: '' has length 1, N'' is wide, whole numbers are int, others exact decimals."""
    body = F.length(F.regexp_extract(text, r"(?s)^[nN]?'(.*)'$", 1))
    string = text.rlike(r"(?s)^[nN]?'.*'$")
    wide = text.rlike("^[nN]'")
    digits = F.regexp_replace(text, r"^[+-]\s*|\.", "")
    whole = text.rlike(r"^[+-]?\s*\d+$")
    decimal = text.rlike(r"^[+-]?\s*\d*\.\d+$|^[+-]?\s*\d+\.$")
    name = F.when(string & wide, "nvarchar").when(string, "varchar").when(whole & (F.length(digits) <= 9), "int").when(whole | decimal, "decimal").when(text.rlike(r"(?i)^[+-]?[\d.]+e[+-]?\d+$"), "float").when(text.rlike("(?i)^0x"), "varbinary")
    scale = F.when(decimal, F.length(F.regexp_extract(text, r"\.(\d*)$", 1))).when(whole, 0)
    made = F.struct(name.alias("name"), F.when(string, F.greatest(F.lit(1), body)).cast("int").alias("length"), F.when(whole | decimal, F.length(digits)).cast("int").alias("precision"), scale.cast("int").alias("scale"), F.lit(None).cast("string").alias("collation"), F.lit(False).alias("is_max"))
    return F.when(name.isNotNull(), made)


def decimal_result(op: str, p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    """Precision and scale of ``decimal(p1,s1) op decimal(p2,s2)``; beyond 38 digits the scale gives way."""
    whole1, whole2, scale = p1 - s1, p2 - s2, max(s1, s2)
    if op in "+-":
        digits, scale = scale + max(whole1, whole2) + 1, scale
    elif op == "*":
        digits, scale = p1 + p2 + 1, s1 + s2
    elif op == "%":
        digits, scale = min(whole1, whole2) + scale, scale
    else:
        scale = max(6, s1 + p2 + 1)
        digits = whole1 + s2 + scale
    if digits <= 38:
        return digits, scale
    keep = (0, 39) if op in "+-" else (6, 38)
    return 38, min(scale, max(keep[0], keep[1] - (digits - scale)))


def merged_name(names: list[str]) -> str | None:
    """The type of the highest precedence, as CASE and COALESCE take it; null if one is unknown."""
    return max(names, key=PRECEDENCE.index) if names and all(n in PRECEDENCE for n in names) else None


def type_pairs(spark: SparkSession) -> DataFrame:
    """``(col_name, other_name, sql_collation, converts, clashes, range_seek)``: what comparing a column with another type does.

    Built from rules that agree with every published outcome; pairs without one have no row.
    """
    rows = []

    def add(c: str, o: str, converts: bool, clash: bool = False, seek: bool = False, sql: bool | None = None) -> None:
        rows.extend((c, o, s, converts, clash, seek) for s in ([sql] if sql is not None else [True, False]))

    others = [*EXACTS, *APPROXIMATE, "date", "smalldatetime", "datetime", "datetime2", "datetimeoffset", "time", "uniqueidentifier"]
    for c in STRINGS:
        for o in STRINGS:
            if c != o:
                up = c in NARROW_STRINGS and o in WIDE_STRINGS
                add(c, o, up, sql=True)
                add(c, o, up, seek=up, sql=False)
        for o in others:
            add(c, o, True)
            add(o, c, False)
    for c in EXACTS:
        for o in EXACTS:
            if c != o and PRECEDENCE.index(c) < PRECEDENCE.index(o) and o in ("int", "bigint"):
                add(c, o, False)
    for c, o, up in [("int", "real", True), ("bigint", "real", True), ("bigint", "float", True), ("smallmoney", "real", True), ("money", "float", True), ("decimal", "real", True), ("tinyint", "real", False), ("smallint", "float", False)]:
        add(c, o, up, seek=False)
    for c in DATES:
        for o in DATES:
            if c != o and DATES.index(c) < DATES.index(o) and o != "datetimeoffset":
                add(c, o, False)
        add("time", c, False, True)
    add("date", "time", False, True)
    return spark.createDataFrame(rows, "col_name string, other_name string, sql_collation boolean, converts boolean, clashes boolean, range_seek boolean")


def verdicts(pairs: DataFrame, col: str, other: str, is_literal: str, op: str) -> DataFrame:
    """``pairs`` with ``verdict`` and ``reason``: SeekPreserved, RangeSeek, ScanForced, OperandClash or Unknown."""
    c, o, lit = F.col(col), F.col(other), F.col(is_literal)
    table = type_pairs(pairs.sparkSession)
    sql = F.coalesce(c["collation"].startswith("SQL_"), F.lit(False))
    j = pairs.withColumn("__sql", sql).join(F.broadcast(table), (c["name"] == F.col("col_name")) & (o["name"] == F.col("other_name")) & (F.col("__sql") == F.col("sql_collation")), "left")
    both = c["name"].isin(STRINGS) & o["name"].isin(STRINGS)
    differ = both & c["collation"].isNotNull() & o["collation"].isNotNull() & (F.lower(c["collation"]) != F.lower(o["collation"]))
    opaque_c, opaque_o = c["name"].isin(OPAQUE), o["name"].isin(OPAQUE)
    long = c["name"].isin(NARROW_STRINGS) & ~c["is_max"] & (c["length"] > 4000) & o["name"].isin(WIDE_STRINGS) & o["is_max"]
    like = (F.lower(F.col(op)) == "like") & ~lit
    steps = [
        (c.isNull() | o.isNull(), "Unknown", "operand-type-unresolved"),
        ((c["name"] == "sql_variant") & ~opaque_o, "SeekPreserved", None),
        ((o["name"] == "sql_variant") & ~opaque_c, "ScanForced", None),
        (opaque_c | opaque_o, "Unknown", "out-of-model-category"),
        (~lit & differ, "OperandClash", None),
        ((c["name"] == o["name"]) & ~c["name"].isin(STRINGS), "SeekPreserved", None),
        ((c["name"] == o["name"]) & (c["is_max"] != o["is_max"]), "RangeSeek", None),
        ((c["name"] == o["name"]) & c["collation"].isNull(), "Unknown", "collation-unresolved"),
        ((c["name"] == o["name"]) & differ, "ScanForced", None),
        (c["name"] == o["name"], "SeekPreserved", None),
        (long, "ScanForced", None),
        (F.col("converts").isNull() | (both & c["collation"].isNull()), "Unknown", "no-probed-matrix-cell"),
        (F.col("clashes"), "OperandClash", None),
        (~F.col("converts"), "SeekPreserved", None),
        (~F.col("range_seek") | like, "ScanForced", None),
    ]
    verdict, reason = F.lit("RangeSeek"), F.lit(None).cast("string")
    for cond, v, r in reversed(steps):
        verdict, reason = F.when(cond, v).otherwise(verdict), F.when(cond, F.lit(r).cast("string")).otherwise(reason)
    return j.withColumn("verdict", verdict).withColumn("reason", reason).drop("__sql", "col_name", "other_name", "sql_collation", "converts", "clashes", "range_seek")


def write_loss(target: Column, source: Column, literal: Column, variable: Column) -> Column:
    """The first loss that an assignment risks, or null; ``literal`` is the source's text if it is a literal, else null."""
    t, s = target["name"], source["name"]
    ascii_only = F.coalesce(literal.rlike(r"(?s)^[nN]?'[\x00-\x7F]*'$"), F.lit(False))
    fits = F.coalesce(literal.rlike(r"^[+-]?\s*\d+$") | (F.length(F.rtrim(F.regexp_extract(literal, r"\.(\d*)$", 1), F.lit("0"))) <= target["scale"]) & literal.rlike(r"^[+-]?\s*\d*\.\d*$"), F.lit(False))
    date_only = F.coalesce(literal.rlike(r"^[nN]?'[^:tT]*'$"), F.lit(False))
    utf8 = F.coalesce(target["collation"].rlike("(?i)_UTF8"), F.lit(False))
    exact_t, exact_s = t.isin(EXACTS), s.isin(EXACTS)
    wider = s.isin("datetime", "datetime2", "smalldatetime", "datetimeoffset")
    same_family = t.isin(STRINGS) & s.isin(STRINGS) | t.isin(BINARIES) & s.isin(BINARIES)
    return (
        F.when(s.isin(WIDE_STRINGS) & t.isin(NARROW_STRINGS) & ~utf8 & ~ascii_only, "unicode-to-non-unicode")
        .when(exact_t & s.isin(APPROXIMATE) & ~fits, "approximate-to-exact-truncation")
        .when(exact_t & exact_s & (target["scale"] < source["scale"]) & ~fits, "numeric-scale-narrowing")
        .when((t == "date") & (wider | s.isin(STRINGS)) & ~date_only, "temporal-precision-loss")
        .when((s == "datetimeoffset") & t.isin("datetime2", "datetime", "smalldatetime", "date", "time"), "temporal-offset-dropped")
        .when(t.isin(WITH_FRACTION) & s.isin(WITH_FRACTION) & (target["scale"] < source["scale"]), "temporal-scale-narrowing")
        .when(variable & same_family & ~target["is_max"] & ~source["is_max"] & (target["length"] < source["length"]), "length-truncation")
    )
