"""Periods that summaries are due for, and whether an earlier scan still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time

#: The periods of a week: (kind, ISO weekday of its end from Monday 0, hour, days back to its start, hour of the start).
WEEKLY = [("workweek", 4, 15, 4, 0), ("weekend", 6, 20, 2, 15), ("full-week", 6, 21, 6, 0)]
#: Seconds for which a period is caught up: of a week, and longer ones.
CATCH_UP = {"week": 7 * 86400, "long": 45 * 86400}
#: Hours at which months and seasons, and years, are due on the first of the next.
MONTH_HOUR, YEAR_HOUR = 11, 12


def catalogue(spark: SparkSession, first: str, last: str, zone: str = time.ZONE) -> DataFrame:
    """(kind, key, start_at, end_at, scheduled_at, catch_up) of all periods that end on the days from first to last.

    Work weeks, weekends and full weeks end at their hour and are due then. Months, seasons (from March on) and years end at
    midnight before a first and are due that day.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    d = F.col("d")
    at = lambda day, hour: time.instant(day, F.lit(hour * 60), zone)

    def row(kind: str, key: Column, start: Column, start_hour: int, end_hour: int, due: int, catch_up: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), at(start, start_hour).alias("start_at"), at(d, end_hour).alias("end_at"), at(d, due).alias("scheduled_at"), F.lit(catch_up).alias("catch_up"))

    each = [F.when(F.weekday(d) == weekday, row(kind, d.cast("string"), F.date_add(d, -back), hour0, hour, hour, CATCH_UP["week"])) for kind, weekday, hour, back, hour0 in WEEKLY]
    first_of, month, long_ = F.dayofmonth(d) == 1, F.month(d), CATCH_UP["long"]
    before = F.add_months(d, -1)
    season = F.add_months(d, -3)
    name = F.when(month == 3, "winter").when(month == 6, "spring").when(month == 9, "summer").otherwise("autumn")
    each += [
        F.when(first_of, row("calendar-month", F.date_format(before, "yyyy-MM"), before, 0, 0, MONTH_HOUR, long_)),
        F.when(first_of & (month == 1), row("calendar-year", (F.year(d) - 1).cast("string"), F.add_months(d, -12), 0, 0, YEAR_HOUR, long_)),
        F.when(first_of & month.isin(3, 6, 9, 12), row("calendar-season", F.concat_ws(":", name, season.cast("string")), season, 0, 0, MONTH_HOUR, long_)),
    ]
    return days.select(F.inline(F.array_compact(F.array(*each))))


def due(periods: DataFrame, now: Column) -> DataFrame:
    """The periods that are due at an instant and not older than their catch-up."""
    age = now - F.col("scheduled_at")
    return periods.where((age >= 0) & (age <= F.col("catch_up")))


def plans_due(periods: DataFrame, instants: DataFrame, now: str, within: int = 120) -> DataFrame:
    """instants with the plans (kind, key, start_at, snapshot_at) that became due within so many seconds before `now`; a snapshot
    is cut to the period's end. Both sides meet by minute, so there is no nested loop."""
    spread = periods.select("*", F.explode(F.sequence(F.floor(F.col("scheduled_at") / within), F.floor((F.col("scheduled_at") + within - 1) / within))).alias("_slot"))
    met = instants.withColumn("_slot", F.floor(F.col(now) / within)).join(spread, "_slot")
    found = met.where((F.col(now) >= F.col("scheduled_at")) & (F.col(now) < F.col("scheduled_at") + within))
    return found.select(*instants.columns, "kind", "key", "start_at", F.least("end_at", "scheduled_at").alias("snapshot_at"))


def checkpoint_reason(stored: dict[str, Column], current: dict[str, Column], forced: Column | None = None) -> Column:
    """Why a stored scan is or is not still valid: the first of these that applies.

    stored and current: peers (sorted array), inventory, messages (current only: count, stored: the count to reach), ceiling,
    covered and hash. What has grown is valid; a null ceiling or count is 0, a stored null inventory is no checkpoint.
    """
    zero = lambda x: F.coalesce(x, F.lit(0))
    grown = zero(current["covered"]) > zero(stored["covered"])
    return (
        F.when(forced if forced is not None else F.lit(False), "forced")
        .when(stored["inventory"].isNull(), "legacy-or-invalid-checkpoint")
        .when(~stored["peers"].eqNullSafe(current["peers"]), "peer-map-changed")
        .when(~stored["inventory"].eqNullSafe(current["inventory"]), "source-inventory-changed")
        .when(zero(current["messages"]) < zero(stored["messages"]), "message-count-regressed")
        .when(zero(current["ceiling"]) < zero(stored["ceiling"]), "coverage-ceiling-regressed")
        .when(zero(current["covered"]) < zero(stored["covered"]), "coverage-count-regressed")
        .when(~grown & ~stored["hash"].eqNullSafe(current["hash"]), "coverage-hash-mismatch")
        .when(grown, "checkpoint-valid-coverage-growth").otherwise("checkpoint-valid")
    )
