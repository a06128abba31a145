"""Input tables, and the chat relations read out of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


class Tables:
    """The parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def messages(self) -> DataFrame:
        """Messages as events carry them: peer_id, cmid, sender_id, created_at (epoch seconds), kind, reactions."""
        return self.events.select(
            (F.col("user_id") % 7).alias("peer_id"),
            F.col("event_id").alias("cmid"),
            F.col("user_id").alias("sender_id"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"),
            F.col("event_type").alias("kind"),
            F.get_json_object("props", "$.k").cast("long").alias("reactions"),
            "value",
        )

    def live(self) -> DataFrame:
        """The live feed: two thirds of the messages."""
        return self.messages().where("cmid % 3 <> 0")

    def archive(self) -> DataFrame:
        """The archive: two thirds, half of them also in the live feed."""
        return self.messages().where("cmid % 3 <> 1")


#: The same relations in SQL.
MESSAGES_SQL = """
messages as (
  select user_id % 7 peer_id, event_id cmid, user_id sender_id, floor(epoch(ts))::bigint created_at, event_type kind,
         json_extract_string(props, '$.k')::bigint reactions, value from events),
live as (select * from messages where cmid % 3 <> 0),
archive as (select * from messages where cmid % 3 <> 1)
"""
