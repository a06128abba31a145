"""Streaming roll-up over four levels: slots, days, week segments and months, each revision promoted once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import time
from ..operators import rollup

SEEN = "peer_id long, cmid long, created_at long, value double"


def hierarchy_writer(path: str, clock: Callable[[int], date], zone: str = time.ZONE) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: messages (peer_id, cmid, created_at, value) into the levels at path; clock gives a batch's local day.

    Every micro-batch writes folders batch=<number> of its own: messages first seen, by day; each level's rows, edges and what
    waits for its period to close; last of all `done`. It reads only lower numbers, and of what waits only the one before, so a
    batch that stopped half-way and runs again leaves one result, and readers see whole batches alone. Messages are
    looked up among those of the batch's own days only (the list of these days is all that comes to the driver). Rows without
    peer_id, cmid or created_at are left out; a message counts once, by (peer_id, cmid, created_at).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def keep(frame: DataFrame, name: str, *by: str) -> DataFrame:
            folder = f"{path}/{name}/batch={number}"
            frame.write.mode("overwrite").partitionBy(*by).parquet(folder)
            return spark.read.schema(frame.schema).parquet(folder)

        def earlier(name: str, schema: str) -> DataFrame:
            full = StructType.fromDDL(schema)
            if not number:
                return spark.createDataFrame([], full)
            rows = spark.read.schema(full.add("batch", "integer")).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
            return rows.where(F.col("batch") < number).drop("batch")

        key = ["peer_id", "cmid", "created_at"]
        new = batch.select(*key, F.col("value").cast("double").alias("value")).dropna(subset=key).dropDuplicates(key)
        new = new.withColumn("day", time.local_date(F.col("created_at"), zone))
        days = [r["day"] for r in new.select("day").distinct().collect()]
        seen = earlier("seen", f"{SEEN}, day date").where(F.col("day").isin(days)) if days else earlier("seen", f"{SEEN}, day date").limit(0)
        new = keep(new.join(seen.select(*key, "day"), [*key, "day"], "left_anti").select(*key, "value", "day"), "seen", "day")

        rows = keep(rollup.batches(new, earlier("batch", rollup.LEVEL_ROWS), zone), "batch")
        before = F.lit(clock(number))
        for level in rollup.LEVELS[1:]:
            waiting = spark.createDataFrame([], StructType.fromDDL(rollup.LEVEL_ROWS))
            if number:
                waiting = spark.read.schema(rows.schema).parquet(f"{path}/waiting/{level}/batch={number - 1}")
            made, edges, left = rollup.promoted(rows.unionByName(waiting), earlier(level, rollup.LEVEL_ROWS), level, before)
            rows = keep(made, level)
            keep(edges, f"edges/{level}")
            keep(left, f"waiting/{level}")
        keep(spark.range(1).select(F.lit(number).alias("number")), "done")

    return write


def run_hierarchy(stream: DataFrame, path: str, checkpoint: str, clock: Callable[[int], date], zone: str = time.ZONE) -> StreamingQuery:
    """Start the roll-up over a stream of messages, working off all there is."""
    writer = stream.writeStream.foreachBatch(hierarchy_writer(path, clock, zone))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _whole(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    done = spark.read.option("basePath", f"{path}/done").schema("number long, batch int").parquet(f"{path}/done").select("batch").distinct()
    parts = [spark.read.schema(StructType.fromDDL(schema).add("batch", "integer")).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}") for name in names]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.join(done, "batch", "left_semi").drop("batch")


def levels(spark: SparkSession, path: str) -> DataFrame:
    """All revisions of all levels, of whole batches."""
    return _whole(spark, path, rollup.LEVELS, rollup.LEVEL_ROWS)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Which revision consumed which, of whole batches."""
    return _whole(spark, path, [f"edges/{level}" for level in rollup.LEVELS[1:]], rollup.EDGES)
