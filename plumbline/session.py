"""Session helpers: reliable lineage cuts and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own,
    removed at exit; on a cluster a missing setting is an error, because a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_columns(df: DataFrame) -> DataFrame:
    """``cut`` as a Parquet table in the shared folder, for wide rows of which later steps read some columns each."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` together with aggregates of the rows, taken while they are written, so that a loop needs one job a round."""
    seen = Observation()
    done = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    return done, seen.get


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="plumbline-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "plumbline_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for root, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(root, f)
                    z.write(path, os.path.join("plumbline", os.path.relpath(path, here)))
    sc.addPyFile(target)


def parallelism(spark: SparkSession) -> int:
    """Partitions for exchanges that an operator sizes itself: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for a pass that costs much more than reading.

    A small file is one partition, and would be one task. Inputs whose files fill the cores at the session's partition size,
    and inputs that aren't files, are not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg({"length": "sum"}).first()[0] or 0  # lengths only, no content
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    most = int(re.sub(r"\D", "", limit)) << {"k": 10, "m": 20, "g": 30}.get(re.sub(r"[^kmg]", "", limit.lower())[:1], 0)
    return df if size >= cores * most else df.repartition(cores)
