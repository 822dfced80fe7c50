"""Mixing sources to target shares of the total size, by Pfair scheduling.

Each source is a stream of its documents, repeated as often as allowed, cut into blocks of equal size. Block k of a source
with share w is released at time floor(k / w) and due at ceil((k + 1) / w); earliest deadline first meets every window, so at
any point of the mix a source has had its share to within less than one block.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.chunked import prefix_sums
from plumbline.session import cut, parallelism

#: Most sources of a target list, least blocks of a mix, and tokens of a block at most once that gives more of them: so
#: the deviation from the shares stays below a fixed size however large the mix is.
MOST_SOURCES, BLOCKS, BLOCK_TOKENS = 10_000, 4096, 1 << 26


@dataclass
class Source:
    name: str
    share: float
    max_repeats: int
    tokens: int = 0
    quota: int = 0
    blocks: int = 0
    slots: list[int] = field(default_factory=list)


def allocate(sources: list[Source], total: int) -> None:
    """Set quotas that add up to ``total``: shares, where a source can't fill its share the rest goes to the others in proportion."""
    for s in sources:
        s.quota = 0
    room = {i: s.tokens * max(0, s.max_repeats) for i, s in enumerate(sources)}
    active = [i for i, s in enumerate(sources) if room[i] > 0 and s.share > 0]
    left = total
    while active:
        weight = sum(sources[i].share for i in active)
        full = [i for i in active if room[i] <= left * sources[i].share / weight]
        if not full:
            exact = {i: left * sources[i].share / weight for i in active}
            for i in active:
                sources[i].quota = int(exact[i])
            rest = left - sum(sources[i].quota for i in active)
            for i in sorted(active, key=lambda i: (int(exact[i]) - exact[i], i))[:rest]:
                sources[i].quota += 1
            return
        for i in full:
            sources[i].quota = room[i]
            left -= room[i]
        active = [i for i in active if i not in set(full)]


def schedule(sources: list[Source], block: int) -> int:
    """Give each block of each source its slot by earliest deadline first; returns the number of slots."""
    for s in sources:
        s.blocks, s.slots = -(-s.quota // block) if s.quota else 0, []
    total = sum(s.blocks for s in sources)
    waiting = [(0, i, 0) for i, s in enumerate(sources) if s.blocks]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // sources[i].blocks), i, k))
        _, i, k = heapq.heappop(ready)
        sources[i].slots.append(t)
        if k + 1 < sources[i].blocks:
            heapq.heappush(waiting, ((k + 1) * total // sources[i].blocks, i, k + 1))
    return total


def mix(sized: DataFrame, targets: DataFrame, blocks: int | None = None, seed: int = 7) -> DataFrame:
    """``(slot, source, doc_id, repeat_no, n_tokens, used_tokens, stream_start)``: the mix, in order of slot and stream_start.

    ``sized`` has ``doc_id, source, n_tokens``, ``targets`` ``source, target_share, max_repeats``. The sizes used add up to the
    tokens of all documents (also those of sources, or null sources, that the list leaves out, which are not used), unless
    the sources can't reach that size. The last document of a source is used in part where its quota ends, as ``used_tokens``
    tells. Within a source the order is a hash order. A document without tokens is used once at most. Sources without documents
    get nothing; what a source can't fill goes to the others in proportion to their shares. A null repeat cap is 1, a null share 0.
    """
    spark = sized.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    listed = wanted.orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the target list")
    sources = [Source(r["source"], float(r["share"]), int(r["most"])) for r in listed]
    index = {s.name: i for i, s in enumerate(sources)}
    names = spark.createDataFrame([(s.name, i) for s, i in ((s, index[s.name]) for s in sources)] or [("", -1)], "source string, __i int")
    rows = cut(sized.select("doc_id", "source", "n_tokens").join(F.broadcast(names), "source", "left"))
    total = 0
    for r in rows.groupBy("__i").agg(F.sum("n_tokens").alias("t")).collect():  # one row for each listed source
        total += r["t"] or 0
        if r["__i"] is not None and r["__i"] >= 0:
            sources[r["__i"]].tokens = r["t"] or 0
    allocate(sources, total)
    reached = sum(s.quota for s in sources)
    size = max(1, -(-reached // (blocks or max(BLOCKS, reached // BLOCK_TOKENS))))  # 10^13 tokens: 150,000 blocks to schedule
    schedule(sources, size)

    used = rows.where(F.col("__i") >= 0).withColumn("__o", F.struct("__i", F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", "n_tokens"))
    placed = prefix_sums(used, "__o", "n_tokens", "__start", parallelism(spark))
    base, plan = 0, []
    for i, s in enumerate(sources):
        passes = min(max(0, s.max_repeats), -(-s.quota // s.tokens)) if s.tokens else 0
        plan.append((i, base, s.tokens, s.quota, passes, s.slots))
        base += s.tokens
    facts = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0, [])], "__i int, base long, size long, quota long, passes int, slots array<int>")
    copies = placed.join(F.broadcast(facts), "__i").where(F.col("passes") > 0)
    copies = copies.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.when(F.col("n_tokens") > 0, F.col("passes") - 1).otherwise(0))))
    at = F.col("__start") - F.col("base") + F.col("repeat_no") * F.col("size")
    copies = copies.withColumn("stream_start", at).where(F.col("stream_start") < F.col("quota"))
    return copies.select(
        F.element_at("slots", (F.floor(F.col("stream_start") / size) + 1).cast("int")).cast("long").alias("slot"),
        "source",
        "doc_id",
        "repeat_no",
        "n_tokens",
        F.least("n_tokens", F.col("quota") - F.col("stream_start")).alias("used_tokens"),
        "stream_start",
    )


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source: its target and actual share of the mix, tokens and copies used, and the most uses of one document."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("used_tokens").alias("used"))
    per = per_doc.groupBy("source").agg(F.sum("used").alias("used_tokens"), F.sum("uses").alias("n_copies"), F.max("uses").alias("most_uses"))
    listed = targets.select("source").distinct()  # at most MOST_SOURCES; documents come from any number of others
    have = sized.join(F.broadcast(listed), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    all_used, all_tokens = per.agg(F.sum("used_tokens").alias("mix_tokens")), sized.agg(F.sum("n_tokens").alias("all_tokens"))
    zero = F.lit(0).cast("long")
    out = targets.select("source", "target_share", "max_repeats").join(F.broadcast(per), "source", "left").join(F.broadcast(have), "source", "left")
    out = out.join(F.broadcast(all_used)).join(F.broadcast(all_tokens))
    return out.select(
        "source",
        "target_share",
        (F.coalesce("used_tokens", zero) / F.col("mix_tokens")).alias("actual_share"),
        "max_repeats",
        F.coalesce("most_uses", zero).alias("most_uses"),
        F.coalesce("n_copies", zero).alias("n_copies"),
        F.coalesce("source_tokens", zero).alias("source_tokens"),
        F.coalesce("used_tokens", zero).alias("used_tokens"),
        "mix_tokens",
        "all_tokens",
    )
