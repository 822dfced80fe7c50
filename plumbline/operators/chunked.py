"""Per-key results when a few keys hold most rows: exact offset chunking.

Keys are laid out on one line in a fixed order, large keys as many small cells. Counting the cells per input partition and
summing the counts gives every cell its exact first row number; cutting the line every ``chunk`` rows gives chunks that are
equal to within a sixteenth, whatever the keys' sizes: no cell is larger, unless one id repeats that often, and such rows
collapse before the shuffle. Rows get their number from their cell, not one by one: a chunk needs only to know its own. Each
chunk is aggregated on its own, and the ordered states of keys that a cut divides are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plumbline.session import cut, parallelism, ship

#: Rows of a chunk at most, so chunks grow in number with the data and not in size; their split points are sent to the
#: executors, 8 bytes for so many rows.
CHUNK_ROWS = 1 << 24
#: Cells of a key that is larger than a part of a chunk; such keys, at most so many a chunk, are broadcast.
PARTS = 16
_LOW = 0xFFFF


def _chunk_of(splits: np.ndarray):
    @pandas_udf("long")
    def find(cell: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, cell.to_numpy(), side="right") - 1)

    return find


def prefix_sums(df: DataFrame, order: str, size: str, out: str, partitions: int) -> DataFrame:
    """``df`` with ``out``: the sum of ``size`` over all rows before, in the order of ``order`` (unique).

    Rows are range-partitioned; only one total per partition reaches the driver.
    """
    parted = df.repartitionByRange(partitions, order).withColumn("__pid", F.spark_partition_id())
    parted = cut(parted)
    totals = parted.groupBy("__pid").agg(F.sum(size).alias("t"), F.min(order).alias("lo")).orderBy("lo").collect()
    before, acc = {}, 0
    for r in totals:
        before[r["__pid"]] = acc
        acc += r["t"]
    base = df.sparkSession.createDataFrame(list(before.items()) or [(-1, 0)], "__pid int, __base long")  # one row for each partition
    run = F.sum(size).over(Window.partitionBy("__pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parted.withColumn("__run", F.coalesce(run, F.lit(0))).join(F.broadcast(base), "__pid").withColumn(out, (F.col("__run") + F.col("__base")).cast("long")).drop("__pid", "__run", "__base")


def keyed_stats(df: DataFrame, key: str, ident: str, kind: str, at: str, chunks: int | None = None) -> DataFrame:
    """Per ``key``: rows, distinct non-null ``ident`` and ``kind``, first and last ``at``; a null key is one key.

    Output columns: ``key, n_rows, n_ids, n_kinds, first_at, last_at``. Rows repeated in full count in ``n_rows``. An empty
    table gives no rows. The work per task is even although a key, or one ``ident`` of a key, may hold a third of all rows:
    such cells collapse to one row per (key, ident, kind) before the shuffle, all others are cut into equal chunks.
    """
    spark = df.sparkSession
    ship(spark)
    n_parts = parallelism(spark)
    k, i = F.col(f"`{key}`"), F.col(f"`{ident}`")
    rows = df.select(k.alias("key"), i.alias("id"), F.col(f"`{kind}`").alias("kind"), F.col(f"`{at}`").alias("at"), (F.xxhash64(F.coalesce(k.cast("string"), F.lit("\u0000null"))).bitwiseAND(F.lit(~_LOW))).alias("hkey"))

    # 1. Count keys per input partition (partial aggregates) and sum.
    per_key = rows.groupBy("hkey").agg(F.count(F.lit(1)).alias("n"))
    per_key = cut(per_key)
    total = per_key.agg(F.sum("n")).first()[0] or 0
    want = chunks or max(8 * n_parts, math.ceil(total / CHUNK_ROWS))
    chunk = max(1, math.ceil(total / want))
    # Keys of more than a part of a chunk: at most PARTS for each chunk. Their rows are spread over cells by ident.
    heavy = F.broadcast(per_key.where(F.col("n") > chunk // PARTS).select(F.col("hkey"), F.lit(1).alias("heavy")))
    spread = F.pmod(F.xxhash64("id"), F.lit(_LOW + 1))
    rows = rows.join(heavy, "hkey", "left").withColumn("cell", F.col("hkey").bitwiseOR(F.when(F.col("heavy") == 1, spread).otherwise(F.lit(0)))).drop("hkey", "heavy")

    # 2. Cells, their exact first row numbers, and the cells at which a new chunk begins.
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    numbered = cut(prefix_sums(cells, "cell", "n", "start", n_parts))
    ends = numbered.groupBy(F.floor(F.col("start") / chunk).alias("c")).agg(F.min("cell").alias("cell"))
    splits = np.array(sorted(r["cell"] for r in ends.select("cell").collect()), dtype=np.int64)  # at most `want` + 1
    hot = [r["cell"] for r in numbered.where(F.col("n") > 2 * chunk).select("cell").collect()]  # fewer than `want` / 2

    # 3. Cells that no cut can divide hold repeats of one ident: collapse them before the shuffle.
    one = rows.select("cell", "key", "id", "kind", F.lit(1).cast("long").alias("n"), F.col("at").alias("lo"), F.col("at").alias("hi"))
    if hot:
        is_hot = F.col("cell").isin(hot) if len(hot) <= 64 else F.array_contains(F.array(*map(F.lit, hot)), F.col("cell"))
        packed = one.where(is_hot).groupBy("cell", "key", "id", "kind").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        one = one.where(~is_hot).unionByName(packed)

    # 4. Equal chunks: one task processes whole chunks; ids of a cell never leave its chunk.
    find: Column = _chunk_of(splits)(F.col("cell"))
    placed = one.withColumn("chunk", find).drop("cell").repartition(max(n_parts, want // 64), "chunk")
    ids = placed.groupBy("chunk", "key", "id", "kind").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    per_id = ids.groupBy("chunk", "key", "id").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    states = per_id.groupBy("chunk", "key").agg(F.sum("n").alias("n"), F.count("id").alias("ids"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # 5. Merge the ordered boundary states; a key has one for each chunk it reaches into.
    merged = states.groupBy("key").agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).cast("long").alias("n_kinds"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))
    return merged
