"""Streaming form of the roll-up ledger: every micro-batch appends revisions and edges once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import revise


def ledger_writer(path: str, make: Callable[[DataFrame], DataFrame], key: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: aggregate a batch by make, add what differs to the ledger at path.

    Each batch writes its own folder (batch=<id>, overwritten), so a batch that runs again after a failure
    leaves one result; the ledger it compares with is that of the batches before it. No watermark: late
    rows are never dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = make(batch)
        known = None
        if number:
            schema = revise(None, new, key, values).schema
            known = spark.read.schema(schema.add("batch", "long")).option("basePath", path).parquet(f"{path}").where(f"batch < {number}").drop("batch")
        full = revise(known, new, key, values)
        fresh = full if known is None else full.join(known.select(*key, "revision"), [*key, "revision"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_ledger(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], key: list[str], values: list[str]) -> StreamingQuery:
    """Start the ledger over a stream, working off all there is."""
    writer = stream.writeStream.foreachBatch(ledger_writer(path, make, key, values))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_state(stream: DataFrame, key: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """The latest observation of each key, kept as streaming state (update mode)."""
    from pyspark.sql import functions as F

    rest = [c for c in stream.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.col(at)).alias("newest")
    return stream.withWatermark(at, delay).groupBy(*key).agg(best).select(*key, "newest.*")
