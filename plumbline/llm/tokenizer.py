"""Encoding with a public byte-level BPE vocabulary, as a tree reduction.

A text is halved down to leaves, leaves are encoded on their own, and neighbours are joined by re-encoding a window around
the seam that grows until both its ends are seams at which the pre-tokenizer always cuts. Tokens outside such a window
can't change: no pre-token crosses such a seam, whatever stands before or after it, and byte pairs merge within a pre-token only.
Texts too long for one task are cut into blocks first, which are encoded in parallel and joined the same way.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, ship, spread

#: Where the public vocabulary files lie.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of a leaf, and of a block that one task encodes.
LEAF, BLOCK = 2048, 1 << 20
#: Largest vocabulary file that is sent to the executors.
MOST_BYTES = 1 << 26
# Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def vocabulary_file(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> bytes:
    """The vocabulary file as it lies in ``folder`` of the driver; executors get these bytes, 1 MB or so, by broadcast."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def coder(data: bytes):
    """The encoder of a vocabulary file, made once in a worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _seam(text: str, at: int) -> bool:
    """Whether the pre-tokenizer cuts before ``at`` whatever surrounds the two characters there.

    No pre-token holds a character that isn't white space before one that is, nor a letter before one that isn't. The
    second character is asked to be ASCII, so that no version of the character tables can matter.
    """
    a, b = text[at - 1], text[at]
    if a.isspace() or not b.isascii() or b.isalpha():
        return False
    return b in " \t\n\r" or a.isalpha() and _letter(a)


@lru_cache(maxsize=1 << 14)
def _letter(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] == "L"


def _window(text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
    """Ends of the window around ``mid``: the nearest safe seams, or the ends of the text; it doubles until they are found."""
    size, p, q = 16, None, None
    while p is None or q is None:
        if p is None:
            edge = max(lo, mid - size)
            p = next((i for i in range(mid - 1, max(edge, lo + 1) - 1, -1) if _seam(text, i)), lo if edge == lo else None)
        if q is None:
            edge = min(hi, mid + size)
            q = next((i for i in range(mid + 1, min(edge, hi - 1) + 1) if _seam(text, i)), hi if edge == hi else None)
        size *= 2
    return p, q


def _drop(ids: np.ndarray, sizes: np.ndarray, n_bytes: int) -> int:
    """How many tokens at the end of ``ids`` make up exactly ``n_bytes``."""
    if not n_bytes:
        return 0
    tail, k = 0, 0
    while tail < n_bytes:
        k += 1
        tail += int(sizes[ids[len(ids) - k]])
    assert tail == n_bytes, "a token crosses a seam"
    return k


class Tree:
    """Encodes texts with one vocabulary."""

    def __init__(self, data: bytes, leaf: int = LEAF):
        self.enc, self.leaf = coder(data), max(2, leaf)
        self.sizes = _sizes(data)

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of ``text[lo:hi]`` from those of its two parts."""
        p, q = _window(text, lo, mid, hi)
        a = _drop(left, self.sizes, len(text[p:mid].encode("utf-8", "surrogatepass")))
        b = _drop(right[::-1], self.sizes, len(text[mid:q].encode("utf-8", "surrogatepass")))
        middle = np.asarray(self.enc.encode_ordinary(text[p:q]), dtype=np.int32)
        return np.concatenate([left[: len(left) - a], middle, right[b:]])

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Tokens of ``text[lo:hi]``."""
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return np.asarray(self.enc.encode_ordinary(text[lo:hi]), dtype=np.int32)
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes of the halves are concatenated up the tree."""
        return self.enc.decode_bytes(list(ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _sizes(data: bytes) -> np.ndarray:
    enc = coder(data)
    sizes = np.zeros(enc.max_token_value + 1, dtype=np.int64)
    for token, rank in enc._mergeable_ranks.items():
        sizes[rank] = len(token)
    return sizes


def _encoded(batches: Iterator[pa.RecordBatch], data, leaf: int, count: bool) -> Iterator[pa.RecordBatch]:
    tree = Tree(data.value, leaf)
    none = np.zeros(0, dtype=np.int32)
    for b in batches:
        keep = [c for c in b.schema.names if c != "text"]
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            ids = [tree.encode(t) if t else none for t in part["text"].to_pylist()]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            if count:
                out = pa.array(n)
            else:
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else none))
            yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [out], [*keep, "ids"])


def _joined(data, leaf: int):
    def reduce(t: pa.Table) -> pa.Table:
        """Blocks of one text, neighbours joined level by level. A text and its ids are one row before and after, so they fit a task."""
        tree = Tree(data.value, leaf)
        t = t.sort_by("k")
        nodes, at = [], 0
        text = "".join(t["part"].to_pylist())
        for part, ids in zip(t["part"].to_pylist(), t["ids"].to_pylist(), strict=True):
            nodes.append((at, at + len(part), np.asarray(ids, dtype=np.int32)))
            at += len(part)
        while len(nodes) > 1:
            up = [(a[0], b[1], tree.join(text, a[0], a[1], b[1], a[2], b[2])) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = up + nodes[len(nodes) - len(nodes) % 2 :]
        return pa.table({"row": t["row"].slice(0, 1), "ids": pa.array([nodes[0][2].tolist()], pa.list_(pa.int32()))})

    return reduce


def _over(rows: DataFrame, data: bytes, leaf: int, block: int, count: bool) -> DataFrame:
    """``rows`` with ``ids`` (or, with ``count``, their number) in place of ``text``.

    Texts of more than ``block`` characters are cut into blocks that are encoded in parallel, whatever their ids are: each
    such row is numbered, and written once, so that its number stays when a task runs again.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(data)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "text"}
    keep, head = list(kinds), ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    big = F.coalesce(F.length("text"), F.lit(0)) > block
    out = spread(rows.where(~big)).mapInArrow(lambda it: _encoded(it, sent, leaf, count), f"{head}, ids {'long' if count else 'array<int>'}")
    large = cut(rows.where(big).withColumn("row", F.monotonically_increasing_id()))
    parts = large.select("row", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / block).cast("int"))).alias("k"))
    parts = parts.select("row", "k", F.substring("text", F.col("k") * block + 1, F.lit(block)).alias("text")).repartition("row", "k")
    done = parts.select("row", "k", F.col("text").alias("part"), "text").mapInArrow(lambda it: _encoded(it, sent, leaf, False), "row long, k int, part string, ids array<int>")
    joined = done.groupBy("row").applyInArrow(_joined(sent, leaf), "row long, ids array<int>")
    ids = F.size("ids").cast("long").alias("ids") if count else F.col("ids")
    return out.unionByName(large.drop("text").join(joined, "row").select(*[F.col(f"`{c}`") for c in keep], ids))


def encode(df: DataFrame, ident: str, text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``(id, ids)`` of each row: the token ids of its text without special tokens.

    Null and empty texts have an empty list. Every row is kept and encoded on its own, rows with one id too.
    """
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return _over(rows, vocabulary_file(folder, vocabulary), leaf, block, False)


def count_tokens(df: DataFrame, text: str, *keep: str, folder: str = FOLDER, vocabulary: str = VOCABULARY, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``keep`` columns and ``ids``: the number of tokens of each text, 0 for null and empty texts."""
    rows = df.select(*keep, F.col(f"`{text}`").cast("string").alias("text"))
    return _over(rows, vocabulary_file(folder, vocabulary), leaf, block, True)
