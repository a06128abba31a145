"""Predicates, rule scores and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def faceted(venue: Column, tags: Column, venues: list[str], wanted: list[str], umbrella: dict[str, list[str]]) -> Column:
    """Any of the venues (an umbrella key stands for its children) and all of the wanted tags; no facet passes all."""
    keys = [k for v in venues for k in umbrella.get(v, [v])]
    ok = venue.isin(keys) if keys else F.lit(True)
    return ok & (F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0) if wanted else ok


def price_floor(text: Column) -> Column:
    """The least number in a price; 0 if it says free, null if it says nothing."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("long"))
    return F.when(F.lower(text).rlike(r"\bfree\b|бесплат"), F.lit(0).cast("long")).when(F.size(numbers) > 0, F.array_min(numbers))


def within_ceiling(floor: Column, limit: float | None) -> Column:
    """Without a limit (or a negative one) all pass; with one, unknown prices do not."""
    return F.lit(True) if limit is None or limit < 0 else F.coalesce(floor <= limit, F.lit(False))


def admission(seen: Column, changed: Column, future: Column, now: Column, recent_days: int, most_days: int = 183) -> Column:
    """Why a post is admitted or not; seen in epoch seconds, 0 if unknown; recent_days is 0 (off) or held to 2..3."""
    days = min(3, max(2, recent_days)) if recent_days > 0 else 0
    old = (seen > 0) & (seen < now - most_days * 86400) & ~future
    if not days:
        return F.when(old, "too-old").otherwise("window-disabled")
    return (
        F.when(old, "too-old").when(changed, "changed").when((seen > 0) & (seen >= now - days * 86400), "recent")
        .when(future, "future-date").when(seen == 0, "unknown-date").otherwise("stale")
    )


def admitted(reason: Column) -> Column:
    return ~reason.isin("too-old", "stale")


def weighted(rules: dict[str, tuple[int, Column]]) -> Column:
    """struct(score, reasons) of additive rules."""
    score = reduce(lambda a, b: a + b, (F.when(test, points).otherwise(0) for points, test in rules.values()))
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, (_, test) in rules.items())))
    return F.struct(score.alias("score"), reasons.alias("reasons"))


def reservoir(rows: DataFrame, kind: str, key: str, at: str, size: int, seed: int = 17, holdout: float = 0.2, embargo: int = 300) -> DataFrame:
    """`size` rows of each kind by a seeded draw, with part: train, embargo or test (the newest share).

    The draw is a hash of key and seed, so it does not depend on partitions or retries.
    """
    draw = Window.partitionBy(kind).orderBy(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256), key)
    some = rows.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= size)
    age = Window.partitionBy(kind).orderBy(F.desc(at), key)
    some = some.withColumn("_age", F.row_number().over(age)).withColumn("_size", F.count("*").over(Window.partitionBy(kind)))
    test = F.col("_age") <= F.floor(F.col("_size") * holdout)
    first = F.min(F.when(test, F.col(at))).over(Window.partitionBy(kind))
    close = F.unix_seconds(first.cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp")) < embargo
    return some.withColumn("part", F.when(test, "test").when(close, "embargo").otherwise("train")).drop("_draw", "_age", "_size")
