"""Near-duplicates with small edits, by SuperMinHash signatures, banding, verification and union-find grouping.

SuperMinHash gives every element a random permutation of the slots; the element's value in the slot at rank j is j plus a
fraction. Ranks of one element are correlated, so slots share fewer elements and the estimate varies less than MinHash's,
and a document stops at the rank below which all its slots are filled. Signatures are cut into bands; rows that share a
band are candidates, checked first on a few bytes of the signatures and then exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, cut_columns, cut_with, parallelism, ship, spread

_WORD = re.compile(r"[\w@#]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A bucket with more rows is compared in blocks of this size, spread over tasks.
BLOCK = 64
#: Signature slots whose low bytes form the sketch that is compared before the exact check.
SKETCH = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_M1) % 2**64)


class Words:
    """64-bit hashes of words, remembered up to a bounded number."""

    def __init__(self, most: int = 200_000):
        self.most, self.seen = most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        try:
            return np.array([seen[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([seen[w] for w in words], dtype=np.uint64)


def word_runs(text: str, size: int, words: Words) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` successive words."""
    h = words(_WORD.findall(text.lower()))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc = _mix(acc * _M1 + h[k : k + n])
    return np.unique(acc)


def char_runs(text: str, size: int, words: Words) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` characters of the padded text, numbered when they repeat."""
    t = "\x02" * (size - 1) + text + "\x03" * (size - 1)
    met: dict[str, int] = {}
    grams = []
    for i in range(len(t) - size + 1):
        g = t[i : i + size]
        met[g] = k = met.get(g, 0) + 1
        grams.append(g if k == 1 else f"{g}\x00{k}")
    return np.unique(words(grams))


def superminhash(sets: list[np.ndarray], slots: int, seed: int = 1) -> np.ndarray:
    """Signatures (rows of 64-bit values, ``slots`` a power of two) of sets of 64-bit hashes; an empty set has all ones."""
    bits = slots.bit_length() - 1
    mask, half = np.uint64(slots - 1), np.uint64(max(1, bits // 2))
    n = len(sets)
    sig = np.full(n * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), sizes)
    el = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    el = _mix(el + _times(seed))
    el2 = _mix(el ^ _M3)
    for rank in range(slots):
        if not len(el):
            break
        # The element's own permutation of the slots, as two keyed rounds of multiply and shift.
        p = (np.uint64(rank) * (el | np.uint64(1)) + (el >> np.uint64(20))) & mask
        p ^= p >> half
        p = (p * (el2 | np.uint64(1)) + (el2 >> np.uint64(20))) & mask
        p ^= p >> half
        p = (p * ((el >> np.uint64(32)) | np.uint64(1)) + (el2 >> np.uint64(40))) & mask
        frac = _mix(el2 + _times(rank + 1)) >> np.uint64(16)
        np.minimum.at(sig, doc * slots + p.astype(np.int64), (np.uint64(rank) << np.uint64(48)) | frac)
        # Early stopping: a document whose slots all hold values of this rank or less can't change any more.
        full = (sig.reshape(n, slots).max(axis=1) >> np.uint64(48)) <= np.uint64(rank)
        keep = ~full[doc]
        doc, el, el2 = doc[keep], el[keep], el2[keep]
    return sig.reshape(n, slots)


def bands_of(sig: np.ndarray, bands: int, rows: int, level: int | None = None) -> np.ndarray:
    """A 64-bit hash for each band of each signature, of the first ``level`` of its ``rows``; at level 0 all share one band."""
    level = rows if level is None else level
    used = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    if not level:
        used, bands = used[:, :1], 1
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M1 + np.uint64(level), (len(sig), bands)).copy()
    for r in range(level):
        acc = _mix(acc * _M1 + used[:, :, r])
    return acc.view(np.int64)


@dataclass(frozen=True)
class Layout:
    """Signature layout: bands of so many rows, and the agreeing sketch bytes that are asked of a candidate pair."""

    bands: int
    rows: int
    least: int = 0

    def of(self, text: str) -> tuple[list[int], int]:
        """The levels (rows used of each band) at which a text is banded, and its least agreement; a pair's is the lesser one."""
        return [self.rows], self.least


@dataclass(frozen=True)
class NameLayout(Layout):
    """The layout for texts at most ``edits`` edits apart, banded by character pairs.

    A text of n characters shares at least the part ``share(n)`` of its character pairs with any text that is not shorter. It is
    banded with as many rows as that part allows at a recall of ``recall``, so one method serves every length; texts
    so short that ``edits`` may change all of them share a single band.
    """

    edits: int = 3
    recall: float = 0.995

    def share(self, n: int) -> float:
        return max(0.0, (n + 1 - 2 * self.edits) / (n + 1 + 2 * self.edits))

    def level(self, n: int) -> int:
        fits = [r for r in range(1, self.rows + 1) if 1 - (1 - self.share(n) ** r) ** self.bands >= self.recall]
        return max(fits, default=0)

    def of(self, text: str) -> tuple[list[int], int]:
        return _name_bands(self, len(text))


@lru_cache(maxsize=4096)
def _name_bands(layout: NameLayout, n: int) -> tuple[list[int], int]:
    share = layout.share(n)
    levels = {layout.level(k) for k in range(max(0, n - layout.edits), n + 1)}  # those of the shorter texts it may pair with
    return sorted(levels), max(0, int(SKETCH * share - 4 * (SKETCH * share * (1 - share)) ** 0.5))


def sign(batches: Iterator[pa.RecordBatch], runs: Callable, size: int, layout: Layout, extra: Callable | None) -> Iterator[pa.RecordBatch]:
    """``(id, text)`` in; id, set id, exact set, bands, sketch and up to three numbers of ``extra`` out. Texts without runs drop out."""
    bands, rows, words = layout.bands, layout.rows, Words()
    slots = 1 << (bands * rows - 1).bit_length()
    for b in batches:
        ids, texts = b["id"].to_pylist(), b["text"].to_pylist()
        names = b["name"].to_pylist() if extra else None
        for lo in range(0, len(ids), 512):
            part = [(i, runs(t, size, words), k) for k, (i, t) in enumerate(zip(ids[lo : lo + 512], texts[lo : lo + 512], strict=True)) if t is not None]
            part = [x for x in part if len(x[1])]
            if not part:
                continue
            sets = [x[1] for x in part]
            sig = superminhash(sets, slots)
            n = len(part)
            flat = [s.astype(np.uint32) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in flat])]).astype(np.int32)
            sid = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            plans = [layout.of(texts[lo + x[2]]) for x in part]
            by_level = {v: bands_of(sig, bands, rows, v) for v in {v for p in plans for v in p[0]}}
            banded = [np.concatenate([by_level[v][k] for v in p[0]]) for k, p in enumerate(plans)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in banded])]).astype(np.int32)
            cols = [
                pa.array([x[0] for x in part], b["id"].type),
                pa.array([(s >> 64) - (1 << 63) for s in sid], pa.int64()),
                pa.array([(s & (2**64 - 1)) - (1 << 63) for s in sid], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).view(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(banded))),
                pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * 8, 8, dtype=np.int32)), pa.array((sig[:, :SKETCH] & np.uint64(255)).astype(np.uint8).view(np.int64).ravel())),
            ]
            keys = [extra(names[lo + x[2]], texts[lo + x[2]]) for x in part] if extra else [(0, 0, 0)] * n
            cols += [pa.array(k, pa.int64()) for k in zip(*keys, strict=True)]
            cols.append(pa.array([p[1] for p in plans], pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "s1", "s2", "items", "bands", "sketch", "c1", "c2", "c3", "least"])


def _pairs(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Buckets sorted by (h, sid) in; ``(a, b, h)`` out: pairs of small buckets, and ``(sid, null, h)`` for members of large ones.

    The first and the last bucket of a partition may go on in its neighbours, so their members are passed on too.
    """
    rest_h, rest_s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    large: int | None = None
    first = True

    def members(h: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.nulls(len(s), pa.int64()), pa.array(h)], ["a", "b", "h"])

    def flush(h: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal large
        if not len(h):
            return
        starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        lens = np.diff(np.append(starts, len(h)))
        out_a, out_b = [], []
        two = starts[lens == 2]
        if large is not None:
            two = two[h[two] != large]
        out_a.append(s[two])
        out_b.append(s[two + 1])
        odd = (lens > 2) if large is None else (lens > 2) | (h[starts] == large)
        for st, ln in zip(starts[odd], lens[odd], strict=True):
            if ln > block or h[st] == large:
                yield members(h[st : st + ln], s[st : st + ln])
            elif ln > 2:
                i, j = np.triu_indices(ln, 1)
                out_a.append(s[st + i])
                out_b.append(s[st + j])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        ok = a != b
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.nulls(int(ok.sum()), pa.int64())], ["a", "b", "h"])
        large = None  # a bucket that was open has ended

    for batch in batches:
        h = np.concatenate([rest_h, batch["h"].to_numpy()])
        s = np.concatenate([rest_s, batch["s1"].to_numpy()])
        if not len(h):
            continue
        if first:
            large, first = int(h[0]), False
        last = int(np.searchsorted(h, h[-1], side="left"))
        yield from flush(h[:last], s[:last])
        rest_h, rest_s = h[last:], s[last:]
        if len(rest_h) > block or (large is not None and rest_h[0] == large):  # a large bucket is passed on as it comes
            yield members(rest_h, rest_s)
            large = int(rest_h[0])
            rest_h, rest_s = rest_h[:0], rest_s[:0]
    if len(rest_h):
        yield members(rest_h, rest_s)


def _block_pairs():
    def compare(t: pa.Table) -> pa.Table:
        s, side = t["s1"].to_numpy(), t["side"].to_numpy()
        sk = np.array(t["sketch"].to_pylist(), dtype=np.int64).view(np.uint8).reshape(-1, SKETCH)
        least = t["least"].to_numpy()
        ia = np.flatnonzero(side != 1)
        ib = np.flatnonzero(side != 0)
        out = []
        for i in ia:
            hit = ib[(sk[ib] == sk[i]).sum(axis=1) >= np.minimum(least[ib], least[i])]
            out += [(min(s[i], s[j]), max(s[i], s[j])) for j in hit if s[i] != s[j]]
        out = sorted(set(out))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return compare


def _large_buckets(members: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """Candidate pairs within large buckets: blocks against blocks, each pair of blocks a unit of work of its own."""
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = members.join(sizes, "h").join(sketches, "s1").withColumn("k", F.ceil(F.col("n") / (8 * block)).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("s1", "h"), F.col("k")).cast("int"))
    units = rows.select("h", "s1", "sketch", "least", "blk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    units = units.select("h", F.least("blk", "other").alias("u"), F.greatest("blk", "other").alias("v"), "s1", "sketch", "least", F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1).alias("side"))
    return units.groupBy("h", "u", "v").applyInArrow(_block_pairs(), "a long, b long")


def candidates(signed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``(a, b)`` of set ids ``s1`` that share a band and agree in enough of the sketch's bytes.

    Buckets are cut by ranges of their hash and the set id, so one that holds a large part of all sets spreads over tasks.
    """
    n = parallelism(signed.sparkSession)
    sets = signed.groupBy("s1").agg(F.first("bands").alias("bands"))  # exact copies have one set; they collapse here
    ordered = sets.select("s1", F.explode("bands").alias("h")).repartitionByRange(n, "h", "s1").sortWithinPartitions("h", "s1")
    raw = cut(ordered.mapInArrow(lambda it: _pairs(it, block), "a long, b long, h long"))
    sketches = signed.select("s1", "sketch", "least")
    pairs = raw.where(F.col("h").isNull()).select("a", "b")
    members = raw.where(F.col("h").isNotNull()).select("h", F.col("a").alias("s1"))
    met = members.select("s1").distinct()
    pairs = pairs.unionByName(_large_buckets(members, sketches.join(met, "s1", "left_semi").dropDuplicates(["s1"]), block)).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s1")).distinct()
    near = sketches.join(wanted, "s1", "left_semi").dropDuplicates(["s1"])
    both = pairs.join(near.select(F.col("s1").alias("a"), F.col("sketch").alias("x"), F.col("least").alias("p")), "a").join(near.select(F.col("s1").alias("b"), F.col("sketch").alias("y"), F.col("least").alias("q")), "b")
    return both.where(_agree(F.col("x"), F.col("y")) >= F.least("p", "q")).select("a", "b")


def _agree(x, y):
    """Bytes in which two sketches of eight longs agree: each byte of the difference folds to one bit, without additions."""
    differ = None
    for i in range(SKETCH // 8):
        v = x[i].bitwiseXOR(y[i])
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            v = v.bitwiseOR(F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(mask)))
        n = F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))
        differ = n if differ is None else differ + n
    return F.lit(SKETCH) - differ


def similar_sets(signed: DataFrame, share: float, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: pairs of set ids whose sets share at least ``share`` of their union, checked on the sets themselves."""
    pairs = cut(candidates(signed, block))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s1")).distinct()
    sets = signed.select("s1", "items").join(wanted, "s1", "left_semi").dropDuplicates(["s1"])
    both = pairs.join(sets.select(F.col("s1").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("s1").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= share * (F.size("x") + F.size("y") - common)).select("a", "b")


def signed_texts(df: DataFrame, ident: str, text: str, size: int, layout: Layout, name: str | None = None, extra: Callable | None = None, runs: Callable = word_runs) -> DataFrame:
    """One row for each text that has runs, written once: set id, set, bands, sketch and the numbers of ``extra(name, text)``.

    Later steps know a set by the 64 bits of ``s1``; where two sets have the same, told by further 64 bits, one gets others.
    """
    ship(df.sparkSession)
    cols = [F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")]
    cols += [F.col(f"`{name}`").cast("string").alias("name")] if name else []
    kind = "string" if dict(df.dtypes)[ident] == "string" else "long"
    source = df.select(*cols).where(F.col("text").isNotNull()).withColumn("id", F.col("id").cast(kind))
    schema = f"id {kind}, s1 long, s2 long, items array<int>, bands array<long>, sketch array<long>, c1 long, c2 long, c3 long, least int"
    return _own_ids(cut_columns(spread(source).mapInArrow(lambda it: sign(it, runs, size, layout, extra), schema)))


def _own_ids(signed: DataFrame) -> DataFrame:
    clash = cut(signed.groupBy("s1").agg(F.min("s2").alias("one"), F.max("s2").alias("other")).where(F.col("one") < F.col("other")).select("s1", "one"))
    if not clash.limit(1).count():  # two of 10^9 sets are expected to meet once in forty runs
        return signed
    met = signed.join(F.broadcast(clash), "s1", "left")
    return met.withColumn("s1", F.when(F.col("s2") != F.col("one"), F.xxhash64("s1", "s2")).otherwise(F.col("s1"))).drop("one")


def linked_classes(signed: DataFrame, pairs: DataFrame, same_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes ``(cid, s1, c1, c2, c3)`` of rows with one set and one extra key, and links ``(x, y)`` between classes.

    Classes of one set differ in the extra key only; they are linked with each other, and with those of a similar set. Similar
    sets with equal extra keys are linked only with ``same_key``: such copies are no pairs to report, but belong in one group.
    """
    classes = signed.groupBy("s1", "c1", "c2", "c3").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n"))
    a = classes.select(F.col("s1").alias("a"), F.col("cid").alias("x"), F.struct("c1", "c2", "c3").alias("cx"))
    b = classes.select(F.col("s1").alias("b"), F.col("cid").alias("y"), F.struct("c1", "c2", "c3").alias("cy"))
    across = pairs.join(a, "a").join(b, "b").where(F.lit(same_key) | (F.col("cx") != F.col("cy"))).select("x", "y")
    several = classes.groupBy("s1").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("s1")
    inside = classes.join(several, "s1", "left_semi")
    if same_key:  # for grouping, a star holds the classes of one set together
        least = inside.groupBy("s1").agg(F.min("cid").alias("x"))
        inside = inside.join(least, "s1").where(F.col("x") < F.col("cid")).select("x", F.col("cid").alias("y"))
    else:
        inside = inside.select("s1", F.col("cid").alias("x")).join(inside.select("s1", F.col("cid").alias("y")), "s1").where(F.col("x") < F.col("y")).select("x", "y")
    return classes, across.unionByName(inside)


def expand(signed: DataFrame, links: DataFrame, piece: int = 1000) -> DataFrame:
    """Pairs ``(p, q)`` of rows from links of classes; classes with many rows are joined in pieces."""
    key = ["s1", "c1", "c2", "c3"]
    classes = signed.groupBy(*key).agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n"))
    linked = classes.join(links.select(F.explode(F.array("x", "y")).alias("cid")).distinct(), "cid", "left_semi").withColumn("k", F.ceil(F.col("n") / piece).cast("int"))
    members = cut(signed.select("id", *key).join(linked, key).select("cid", "id", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("salt")))
    parts = linked.select("cid", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    left = links.join(parts.select(F.col("cid").alias("x"), F.col("salt").alias("sx")), "x")
    left = left.join(members.select(F.col("cid").alias("x"), F.col("salt").alias("sx"), F.col("id").alias("p")), ["x", "sx"]).select("p", "y")
    right = left.join(parts.select(F.col("cid").alias("y"), F.col("salt").alias("sy")), "y")
    return right.join(members.select(F.col("cid").alias("y"), F.col("salt").alias("sy"), F.col("id").alias("q")), ["y", "sy"]).select("p", "q")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: union-find over ``(x, y)`` by alternating large-star and small-star rounds; root is the least node."""
    edges, seen = cut_with(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where(F.col("u") != F.col("v")).distinct(), n=F.count(F.lit(1)))
    while True:
        # Large star: every greater neighbour of u hangs on u's least neighbour.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: u and its smaller neighbours hang on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before = seen["n"]
        nxt, seen = cut_with(small, n=F.count(F.lit(1)))
        same = before == seen["n"] and not nxt.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = nxt
        if same:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(roots.select(F.col("u").alias("node")), "node", "left_anti"))


def near_names(names: DataFrame, most: int, layout: NameLayout) -> DataFrame:
    """``(a, b)``, a < b: different texts of column ``name`` at an edit distance of ``most`` or less, case ignored.

    Candidates come from signatures of the lower-cased names' character pairs, whatever the names' length.
    """
    forms = cut(names.select("name").where(F.col("name").isNotNull()).distinct().withColumn("low", F.lower("name")))
    lows = forms.select("low").distinct().repartition(names.sparkSession.sparkContext.defaultParallelism)
    signed = signed_texts(lows, "low", "low", 2, layout, runs=char_runs)
    keyed = signed.select("s1", F.col("id").alias("low"))
    pairs = cut(candidates(signed))
    found = pairs.join(keyed.select(F.col("s1").alias("a"), F.col("low").alias("x")), "a").join(keyed.select(F.col("s1").alias("b"), F.col("low").alias("y")), "b").select("x", "y")
    same = keyed.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("s1")
    twin = keyed.join(same, "s1", "left_semi")  # names of the same pairs in another order: few of one set
    found = found.unionByName(twin.select("s1", F.col("low").alias("x")).join(twin.select("s1", F.col("low").alias("y")), "s1").where("x < y").select("x", "y"))
    close = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().where(F.col("x") != F.col("y"))
    close = close.where((F.abs(F.length("x") - F.length("y")) <= most) & (F.levenshtein("x", "y", most) >= 0))
    spelled = close.join(forms.select(F.col("low").alias("x"), F.col("name").alias("a")), "x").join(forms.select(F.col("low").alias("y"), F.col("name").alias("b")), "y").select("a", "b")
    cased = forms.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("low")
    cased = forms.join(cased, "low", "left_semi")
    cased = cased.select("low", F.col("name").alias("a")).join(cased.select("low", F.col("name").alias("b")), "low").where("a < b").select("a", "b")
    return spelled.unionByName(cased).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
