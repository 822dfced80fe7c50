"""``.sql`` files as modules: recursive listing, decoding, and the batches between GO lines."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship

_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decode(raw: bytes) -> str:
    """The text of a file: by its byte order mark, else UTF-8, else Latin-1."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plumbline.tsql.lexer import batches as split

    for b in batches:
        rows = []
        for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
            rows += [(path, k, line, repeat, text) for k, (text, line, repeat) in enumerate(split(decode(raw)))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["source_path", "batch", "line", "repeats", "definition"])


def sql_files(spark: SparkSession, root: str) -> DataFrame:
    """``(module_id, source_path, batch, line, repeats, definition)`` of every batch of the ``*.sql`` files under ``root``.

    ``module_id`` is a hash of path and batch number. Files without a batch give no row.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").load(root)
    out = files.select("path", "content").mapInArrow(_split, "source_path string, batch int, line int, repeats int, definition string")
    return out.select(F.xxhash64("source_path", "batch").alias("module_id"), "*")
