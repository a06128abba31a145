"""Predicates and choices over periods, venues, cities, times of day and scheduled runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds after its time at which a scheduled run is dropped. Fixed value.
GRACE = 600

#: Minutes up to which two times agree, and above which they conflict. Fixed values.
LIMITS = {"same": (60, 105), "doors and start": (150, 240), "one known": (90, 180), "unknown": (90, 150)}


def fully_contained(start: Column, end: Column, since: int, until: int) -> Column:
    """A source of positive length that lies within [since, until]; null bounds count as 0."""
    start, end = (F.coalesce(x, F.lit(0)) for x in (start, end))
    return (start >= since) & (end <= until) & (end > start)


def for_period(daily: DataFrame, batches: DataFrame, since: int, until: int) -> DataFrame:
    """The contained daily rows, and the overlapping batches of days that no such row covers.

    Both have day_key, start_at, end_at and the same other columns; the result adds level. Null days are
    one day. Repeated rows stay; an empty side gives the other alone.
    """
    day = F.coalesce(F.col("day_key").cast("string"), F.lit(""))
    kept = daily.where(fully_contained(F.col("start_at"), F.col("end_at"), since, until))
    covered = kept.select(day.alias("_day")).distinct()
    start, end = (F.coalesce(F.col(c), F.lit(0)) for c in ("start_at", "end_at"))
    open_days = batches.where((start < until) & (end > since)).withColumn("_day", day).join(covered, "_day", "left_anti").drop("_day")
    return kept.withColumn("level", F.lit("daily")).unionByName(open_days.withColumn("level", F.lit("batch")))


def best_venue(rows: DataFrame, tokens: str, group: str, wanted: list[str]) -> DataFrame:
    """The rows whose venue tokens answer the wanted ones best, if they all belong to one group.

    100 a matched token, 40 more if all match, 1 less for each other token. Only the best score of each
    group travels, and one row comes back. Null tokens or no wanted ones match nothing.
    """
    wanted = list(dict.fromkeys(wanted))
    own = F.array_distinct(tokens)
    matched = F.size(F.array_intersect(own, F.array(*map(F.lit, wanted)).cast("array<string>")))
    score = matched * 100 + F.when(matched == len(wanted), 40).otherwise(0) - (F.size(own) - matched)
    scored = rows.withColumn("score", F.when(matched > 0, score))
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    tops = scored.where("score is not null").groupBy(name.alias("_group")).agg(F.max("score").alias("_score"))
    best = tops.groupBy("_score").agg(F.count("*").alias("_n"), F.min("_group").alias("_group")).orderBy(F.desc("_score")).limit(1)
    one = best.where("_n = 1 and _score >= 100").select("_group", "_score")
    return scored.join(one, (name == F.col("_group")) & (F.col("score") == F.col("_score")), "left_semi")


def other_city(text: Column, theirs: list[str], ours: list[str]) -> Column:
    """Whether a text names one of their cities, as whole words, and none of ours; null text: false."""

    def named(words: list[str]) -> Column:
        if not words:
            return F.lit(False)
        return text.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])")

    return F.coalesce(named(theirs) & ~named(ours), F.lit(False))


def time_evidence(left: Column, left_role: Column, right: Column, right_role: Column) -> Column:
    """struct(similarity, compatible, conflict, delta) of two times of day in minutes and their roles.

    Null roles are unknown; a null minute gives a null struct.
    """
    a, b = (F.coalesce(r, F.lit("unknown")) for r in (left_role, right_role))
    pair = F.array_sort(F.array(a, b))
    kind = (
        F.when((a == b) & (a != "unknown"), "same").when(pair == F.array(F.lit("doors"), F.lit("start")), "doors and start")
        .when((a != "unknown") | (b != "unknown"), "one known").otherwise("unknown")
    )
    limit = F.create_map(*(x for k, v in LIMITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[kind]
    delta = F.abs(left - right)
    tiers = F.when(delta == 0, 1.0).when(delta <= 15, 0.98).when(delta <= 60, 0.90).when(delta <= limit[0], 0.74).when(delta <= limit[1], 0.28).otherwise(0.0)
    return F.when(delta.isNotNull(), F.struct(tiers.alias("similarity"), (delta <= limit[0]).alias("compatible"), (delta > limit[1]).alias("conflict"), delta.alias("delta")))


def stale(scheduled: Column, now: Column, grace: int = GRACE) -> Column:
    """Whether a run comes more than grace seconds late; unset times (null, 0 or less) are never stale."""
    when, at = (F.coalesce(x, F.lit(0)) for x in (scheduled, now))
    return (when > 0) & (at > 0) & (at - when > max(0, grace))


def newest_revision(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The row of each period with the highest revision: a grouped maximum, combined before the shuffle.

    The whole row breaks ties, so the result is fixed; rows without a revision come last.
    """
    rest = [c for c in rows.columns if c not in keys and c != revision]
    best = rows.groupBy(*keys).agg(F.max(F.struct(revision, *rest)).alias("_best"))
    return best.select(*keys, f"_best.{revision}", *(f"_best.{c}" for c in rest)).select(*rows.columns)
