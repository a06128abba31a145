"""Calendar roll-ups whose late data make a new revision, never a recount of what was promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import time


def wilson(successes: str, trials: str, z: float = 1.96) -> Column:
    """Lower bound of the success rate's 95 % interval, at least 0; 0 without trials."""
    n, p = F.col(trials), F.col(successes) / F.nullif(F.col(trials), F.lit(0))
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0)


def daily(messages: DataFrame, zone: str = time.ZONE) -> DataFrame:
    """(day, n, v, last_at) of messages (created_at, value) by local day."""
    return messages.groupBy(time.local_date(F.col("created_at"), zone).alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.max("created_at").alias("last_at"))


def segments(days: DataFrame) -> DataFrame:
    """Days summed to Monday weeks, cut at month ends."""
    seg = time.week_segment(F.col("day"))
    key = [F.date_format("day", "yyyy-MM").alias("month_key"), seg["start"].cast("string").alias("segment_start"), seg["end"].cast("string").alias("segment_end")]
    return days.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count("*").alias("days"))


def unconsumed(sources: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Source revisions that no edge to the target level has consumed."""
    return sources.join(edges.select(key).distinct(), key, "left_anti")


def revise(known: DataFrame | None, batch: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """known with a next revision for every key of the batch whose values differ from all it has.

    The same input again is a no-op; late data are appended, whatever their age.
    """
    digest = F.sha2(F.to_json(F.struct(*values)), 256)
    batch = batch.withColumn("input_hash", digest)
    if known is None:
        return batch.withColumn("revision", F.lit(1))
    new = batch.join(known.select(*key, "input_hash"), [*key, "input_hash"], "left_anti")
    last = known.groupBy(*key).agg(F.max("revision").alias("_last"))
    new = new.join(last, key, "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    return known.unionByName(new)


# -- four levels: slots of a day, days, Monday weeks cut at month ends, months

LEVELS = ["batch", "day", "segment", "month"]
#: Columns of a level's rows: a revision sums what it consumed alone, so a period's total is the sum of its revisions.
LEVEL_ROWS = "level string, peer_id long, period string, opens date, closes date, revision int, n long, v double, last_at long, sources long"
#: Columns of an edge: the revision that consumed another.
EDGES = "level string, peer_id long, period string, revision int, source_level string, source_period string, source_revision int"


def period(level: str, day: Column) -> Column:
    """struct(period, opens, closes) of the day's period at a level above batches."""
    segment, month = time.week_segment(day), F.to_date(F.date_trunc("month", day))
    found = {
        "day": (day.cast("string"), day, day),
        "segment": (segment["start"].cast("string"), segment["start"], segment["end"]),
        "month": (F.date_format(day, "yyyy-MM"), month, F.last_day(day)),
    }[level]
    return F.struct(*(c.alias(name) for c, name in zip(found, ("period", "opens", "closes"))))


def numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (peer_id, period, ...) with the revision that follows those of known (peer_id, period, revision)."""
    touched = known.join(rows.select("peer_id", "period").distinct(), ["peer_id", "period"], "left_semi")
    last = touched.groupBy("peer_id", "period").agg(F.max("revision").alias("_last"))
    return rows.join(last, ["peer_id", "period"], "left").withColumn("revision", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")


def batches(messages: DataFrame, known: DataFrame, zone: str = time.ZONE) -> DataFrame:
    """A revision of each slot that messages (peer_id, created_at, value), none of them seen before, fall in."""
    at = time.local(F.col("created_at"), zone)
    day = F.to_date(at)
    rows = messages.groupBy("peer_id", day.alias("opens"), time.slot(time.minute_of_day(at)).alias("_slot")).agg(
        F.count("*").alias("n"), F.sum("value").alias("v"), F.max("created_at").alias("last_at"), F.count("*").alias("sources")
    )
    rows = rows.withColumn("period", F.concat_ws(" ", F.col("opens").cast("string"), "_slot")).drop("_slot")
    return numbered(rows, known).withColumns({"level": F.lit("batch"), "closes": F.col("opens")}).to(_schema(LEVEL_ROWS))


def promoted(pending: DataFrame, known: DataFrame, level: str, before: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, edges, waiting): pending revisions of the level below, summed to one revision of each period that closed before a day.

    What belongs to a period that is still open waits. A late revision of a closed period makes the period's next
    revision, of that late part alone.
    """
    below = LEVELS[LEVELS.index(level) - 1]
    target = pending.withColumn("_t", period(level, F.col("opens")))
    closed = F.col("_t.closes") < before
    ready = target.where(closed).select("peer_id", "_t.*", F.col("period").alias("source_period"), F.col("revision").alias("source_revision"), "n", "v", "last_at")
    rows = ready.groupBy("peer_id", "period", "opens", "closes").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("last_at").alias("last_at"), F.count("*").alias("sources"))
    rows = numbered(rows, known).withColumn("level", F.lit(level)).to(_schema(LEVEL_ROWS))
    edges = ready.select("peer_id", "period", "source_period", "source_revision").join(rows.select("peer_id", "period", "revision"), ["peer_id", "period"])
    edges = edges.withColumns({"level": F.lit(level), "source_level": F.lit(below)}).to(_schema(EDGES))
    return rows, edges, target.where(~closed).drop("_t")


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)
