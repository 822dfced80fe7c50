"""Incremental re-scan: modules that arrive in a stream are scanned micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.rules import engine


def rescan(modules: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the single-fact findings of each new module in the streaming ``modules`` to parquet in ``out``.

    The facts of a module don't depend on others, so a batch is complete in itself; a batch that is run again after a
    failure overwrites its own folder. Rules that join modules need the whole corpus: see ``engine.scan``.
    """

    def scan(batch: DataFrame, number: int) -> None:
        engine.single_fact_findings(engine.module_facts(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = modules.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
