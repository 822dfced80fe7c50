"""Differences between two copies of a dataset, field by field.

Both copies go through one range partitioning of the key (so the split points are shared), are sorted within each partition,
and a streaming two-pointer merge emits the keys missing on either side and the fields that differ. Repeated rows collapse
in the merge, where they are neighbours. Keys that hold more rows than a task should are compared apart: equal rows of the
two copies cancel out, the rest is numbered by ranged prefix sums and joined number by number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.chunked import prefix_sums
from plumbline.session import cut, parallelism, ship

MISSING_LEFT, MISSING_RIGHT, VALUE = "missing_left", "missing_right", "value"
#: A key with more than one in so many rows of a partition's share is compared apart; so few keys can be (they are broadcast).
HOT_PARTS = 4
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


def _exact_text(c: Column, kind: T.DataType, other: T.DataType) -> Column:
    """A string that is equal for two values exactly when they are equal; null stays null.

    Whole numbers compare by value whatever their width, floats too; values of types that differ otherwise are never equal.
    """
    if kind != other:
        if isinstance(kind, _WHOLE) and isinstance(other, _WHOLE):
            return c.cast("long").cast("string")
        if isinstance(kind, _REAL) and isinstance(other, _REAL):
            return c.cast("double").cast("string")
        return F.concat(F.lit(f"{kind.simpleString()}\u0000"), _exact_text(c, kind, kind))
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.MapType):
        c = F.array_sort(F.map_entries(c))
    elif not isinstance(kind, (T.ArrayType, T.StructType)):
        return c.cast("string")
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))


def _merge(batches: Iterator[pa.RecordBatch], keys: list[str], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (keys, side) in; differences out. The open key of a batch is carried into the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        starts = _starts(t, keys)
        last = int(starts[-1])
        rest = t.slice(last)
        if last:
            yield from _emit(t.slice(0, last), starts[:-1], keys, fields)
    if rest is not None:
        yield from _emit(rest.combine_chunks(), np.zeros(1, dtype=np.int64), keys, fields)


def _whole(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    n = t.num_rows
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    fresh = np.zeros(n - 1, dtype=bool)
    for k in keys:
        key = _whole(t[k])
        a, b = key.slice(0, n - 1), key.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        fresh |= ~np.asarray(same.to_numpy(zero_copy_only=False), dtype=bool)
    return np.concatenate([[0], np.flatnonzero(fresh) + 1]).astype(np.int64)


def _emit(t: pa.Table, starts: np.ndarray, keys: list[str], fields: list[str]) -> Iterator[pa.RecordBatch]:
    side = t["__side"].to_numpy()
    ends = np.append(starts[1:], t.num_rows)
    n_right = np.add.reduceat(side.astype(np.int64), starts)
    n_left = (ends - starts) - n_right

    def out(rows: np.ndarray, kind: str, field: str) -> Iterator[pa.RecordBatch]:
        if len(rows):
            cols = [_whole(t[k].take(pa.array(rows))) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([kind] * len(rows), pa.string()), pa.array([field] * len(rows), pa.string())], [*keys, "__kind", "__field"])

    yield from out(starts[n_left == 0], MISSING_LEFT, "")
    yield from out(starts[n_right == 0], MISSING_RIGHT, "")
    one = starts[(n_left == 1) & (n_right == 1)]
    li, ri = pa.array(one), pa.array(one + 1)
    for f in fields if len(one) else ():
        a, b = t[f].take(li), t[f].take(ri)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        yield from out(one[np.asarray(differ.to_numpy(), dtype=bool)], VALUE, f)
    many = np.flatnonzero((n_left > 0) & (n_right > 0) & (n_left + n_right > 2))
    hits: dict[tuple[str, str], list[int]] = {}
    if len(many):
        for g in many:
            s, m, e = int(starts[g]), int(starts[g] + n_left[g]), int(ends[g])
            rows = list(zip(*(t[f].slice(s, e - s).to_pylist() for f in fields), strict=True)) or [()] * (e - s)
            for hit in _differences(set(rows[: m - s]), set(rows[m - s :]), fields):
                hits.setdefault(hit, []).append(s)
    for (kind, field), rows in hits.items():
        yield from out(np.asarray(rows, dtype=np.int64), kind, field)


def _differences(left: set[tuple], right: set[tuple], fields: list[str]) -> set[tuple[str, str]]:
    """What differs between two sets of rows of one key: equal rows cancel out, the others are paired in order."""
    order = lambda row: [(v is not None, v or "") for v in row]
    a, b = sorted(left - right, key=order), sorted(right - left, key=order)
    found = {(VALUE, f) for x, y in zip(a, b, strict=False) for f, v, w in zip(fields, x, y, strict=True) if v != w}
    if len(a) > len(b):
        found.add((MISSING_RIGHT, ""))
    elif len(b) > len(a):
        found.add((MISSING_LEFT, ""))
    return found


def _hot_differences(both: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The same for keys of any size: the rows are cancelled, numbered and joined without a key being in one task."""
    left = F.max(F.when(F.col("__side") == 0, True).otherwise(False))
    right = F.max(F.when(F.col("__side") == 1, True).otherwise(False))
    rows = both.groupBy(*keys, *fields).agg(left.alias("__l"), right.alias("__r"))
    # Keys that one side lacks altogether are missing as a whole.
    sides = both.groupBy(*keys).agg(left.alias("kl"), right.alias("kr"))
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    lone = sides.where(~F.col("kl") | ~F.col("kr")).select(*keys, F.when(F.col("kl"), MISSING_RIGHT).otherwise(MISSING_LEFT).alias("__kind"), F.lit("").alias("__field"))
    odd = rows.where(F.col("__l") != F.col("__r")).alias("a").join(F.broadcast(sides.where(F.col("kl") & F.col("kr"))).alias("b"), match, "left_semi")
    odd = odd.withColumn("__o", F.struct(*keys, "__l", *fields)).withColumn("__one", F.lit(1).cast("long"))
    numbered = prefix_sums(odd, "__o", "__one", "__i", parallelism(both.sparkSession))
    first = numbered.groupBy(*keys, "__l").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    numbered = numbered.alias("a").join(F.broadcast(first).alias("b"), [*match, F.col("a.__l") == F.col("b.__l")]).select(*[F.col(f"a.{c}") for c in [*keys, "__l", *fields]], (F.col("__i") - F.col("__first")).alias("__k"))
    x, y = numbered.where("__l").alias("a"), numbered.where("not __l").alias("b")
    pairs = x.join(y, [*match, F.col("a.__k") == F.col("b.__k")], "full")
    got = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    kinds = F.when(F.col("b.__k").isNull(), F.array(F.struct(F.lit(MISSING_RIGHT).alias("__kind"), F.lit("").alias("__field")))).when(F.col("a.__k").isNull(), F.array(F.struct(F.lit(MISSING_LEFT).alias("__kind"), F.lit("").alias("__field"))))
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(VALUE).alias("__kind"), F.lit(f).alias("__field"))) for f in fields]), lambda v: v.isNotNull()) if fields else F.array().cast("array<struct<__kind:string,__field:string>>")
    found = pairs.select(*got, F.explode(F.coalesce(kinds, changed)).alias("__d")).select(*keys, "__d.__kind", "__d.__field").distinct()
    return lone.unionByName(found)


def diff(left: DataFrame, right: DataFrame, key: str | Sequence[str], ignore: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Rows ``(row_key, diff_kind, field)``: what differs between two copies of a dataset.

    ``missing_left``: a row is only in ``right``; ``missing_right``: only in ``left``; ``value``: one row per field whose
    value differs. ``key`` may be several columns; ``row_key`` is then a struct of them. Rows repeated within one copy (equal
    but for ``ignore``) count once. If a copy holds several different rows of a key, rows that both copies hold cancel out,
    the others are paired in the order of their values, and what is left over on one side is missing on the other. Null equals
    null only, null keys are one key, case, blanks and list order count; whole numbers of any width compare by value, values of
    types that differ otherwise are unequal. A column that one copy lacks is null there. Columns may have any name. Empty
    copies give missing rows only. A key may hold any part of the rows.
    """
    spark = left.sparkSession
    ship(spark)
    names = [key] if isinstance(key, str) else list(key)
    keys = [f"__k{i}" for i in range(len(names))]
    lkinds, rkinds = ({f.name: f.dataType for f in d.schema} for d in (left, right))
    shared = [c for c in [*left.columns, *(x for x in right.columns if x not in lkinds)] if c not in names and c not in ignore]
    inner = {c: f"f{i}" for i, c in enumerate(shared)}
    fields = list(inner.values())

    def side(df: DataFrame, s: int, mine: dict, theirs: dict) -> DataFrame:
        cols = [F.col(f"`{n}`").cast(lkinds[n]).alias(k) for n, k in zip(names, keys, strict=True)]
        text = [(_exact_text(F.col(f"`{c}`"), mine[c], theirs.get(c, mine[c])) if c in mine else F.lit(None).cast("string")).alias(inner[c]) for c in shared]
        return df.select(*cols, F.lit(s).alias("__side"), *text)

    both = side(left, 0, lkinds, rkinds).unionByName(side(right, 1, rkinds, lkinds))
    n = partitions or parallelism(spark)
    # Counts by key reach the shuffle pre-aggregated; only the keys are read for them.
    counts = cut(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 2))
    most = max(64, (left.count() + right.count()) // (HOT_PARTS * n))
    hot = counts.where(F.col("__n") > most).drop("__n")  # at most HOT_PARTS * n keys
    is_hot = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cold = both
    apart = None
    if hot.limit(1).count():
        cold = both.alias("a").join(F.broadcast(hot).alias("b"), is_hot, "left_anti")
        apart = _hot_differences(cut(both.alias("a").join(F.broadcast(hot).alias("b"), is_hot, "left_semi").groupBy(*keys, "__side", *fields).agg(F.lit(1).alias("__x")).drop("__x")), keys, fields)
    ordered = cold.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "__side")
    schema = T.StructType([*(T.StructField(k, lkinds[c]) for k, c in zip(keys, names, strict=True)), T.StructField("__kind", T.StringType()), T.StructField("__field", T.StringType())])
    found = ordered.mapInArrow(lambda it: _merge(it, keys, fields), schema)
    found = found if apart is None else found.unionByName(apart)
    back = F.create_map(*[F.lit(x) for c, f in inner.items() for x in (f, c)]) if inner else F.create_map(F.lit(""), F.lit(""))
    row_key = F.col(keys[0]) if isinstance(key, str) else F.struct(*[F.col(k).alias(c) for k, c in zip(keys, names, strict=True)])
    return found.select(row_key.alias("row_key"), F.col("__kind").alias("diff_kind"), F.coalesce(F.try_element_at(back, F.col("__field")), F.lit("")).alias("field"))
