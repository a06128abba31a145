"""Calendar functions over epoch seconds, with an explicit zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Moscow"
#: The day's uneven slots, label by the minute at which each begins.
SLOTS = {0: "03:00", 180: "09:00", 540: "12:00", 720: "15:00", 900: "18:00", 1080: "21:00", 1260: "22:30", 1350: "23:59"}


def local(seconds: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)


def local_date(seconds: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(seconds, zone))


def minute_of_day(at: Column) -> Column:
    return F.hour(at) * 60 + F.minute(at)


def slot(minute: Column) -> Column:
    """The label of the slot that owns a minute; the last one owns the day up to 24:00, though it closes at 23:59."""
    out = F.lit(None).cast("string")
    for start, label in SLOTS.items():
        out = F.when(minute >= start, label).otherwise(out)
    return out


def slot_closed(day: Column, label: Column, now: Column) -> Column:
    """Whether a local day's slot has closed at local time now."""
    return F.to_timestamp(F.concat_ws(" ", day.cast("string"), label)) <= now


def week_segment(day: Column) -> Column:
    """(start, end) of the Monday week, cut to the day's month."""
    monday = F.to_date(F.date_trunc("week", day))
    return F.struct(F.greatest(monday, F.to_date(F.date_trunc("month", day))).alias("start"), F.least(F.date_add(monday, 6), F.last_day(day)).alias("end"))


def infer_year(month: Column, day: Column, reference: Column, far: int = 183) -> Column:
    """The date in the reference's year, or the next year's where that is more than `far` days before it."""
    this = F.make_date(F.year(reference), month, day)
    return F.when(F.datediff(reference, this) > far, F.make_date(F.year(reference) + 1, month, day)).otherwise(this)


def expand_range(start: Column, end: Column, most: int = 14) -> Column:
    """All days of a range, or just its two ends if it spans more than `most` days."""
    return F.when(F.datediff(end, start) > most, F.array(start, end)).otherwise(F.sequence(start, F.greatest(start, end)))


# -- local time to instants


def instant(day: Column, minute: Column, zone: str = ZONE) -> Column:
    """Epoch seconds of a local day's minute. A time that a change of clocks leaves out counts as that much later; of one
    that it repeats, the first is meant."""
    at = day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute)
    return F.unix_seconds(F.to_utc_timestamp(at.cast("timestamp"), zone))



def day_window(day: Column, zone: str = ZONE) -> Column:
    """struct(start, end) in epoch seconds of a local day: from its midnight to the next."""
    return F.struct(instant(day, F.lit(0), zone).alias("start"), instant(F.date_add(day, 1), F.lit(0), zone).alias("end"))


def clipped(start: Column, end: Column, today: Column) -> Column:
    """struct(start, end, past_only): a range without its days before today; one that ends before is past only and stays."""
    past = end < today
    return F.struct(F.when(past, start).otherwise(F.greatest(start, today)).alias("start"), end.alias("end"), past.alias("past_only"))


# -- slots of a schedule


def minutes(slots: list[str]) -> list[int]:
    return sorted(int(s[:2]) * 60 + int(s[3:]) for s in slots)


def next_slot(after: Column, slots: list[str], zone: str = ZONE) -> Column:
    """The first slot (epoch seconds) later than an instant, within three days."""
    day = local_date(after, zone)
    each = [[instant(F.date_add(day, n), F.lit(m), zone) for m in minutes(slots)] for n in range(4)]
    first = lambda instants: F.least(*(F.when(x > after, x) for x in [*instants, F.lit(None).cast("long"), F.lit(None).cast("long")]))
    # Of two days, as a gap of the clocks may put an evening's slot after the next morning's; the days behind them are seldom asked.
    return F.coalesce(first(each[0] + each[1]), first(each[2] + each[3]))


def _slots_until(at: Column, slots: list[str], zone: str) -> Column:
    """How many slots there have been up to an instant, by a count that begins in 1970."""
    here = local(at, zone)
    passed = sum((F.when(minute_of_day(here) >= m, 1).otherwise(0) for m in minutes(slots)), F.lit(0))
    return F.datediff(F.to_date(here), F.lit("1970-01-01").cast("date")) * len(slots) + passed


def coalesced(due: Column, now: Column, slots: list[str], zone: str = ZONE, most: int = 512) -> Column:
    """struct(scheduled_at, skipped): of a run's overdue slots the latest that is due (at most so many later), and how many are
    left out. A run that is not overdue, or never scheduled (0), stays."""
    behind = (due <= 0) | (now <= 0) | (due > now)
    skipped = F.least(F.lit(most), _slots_until(now, slots, zone) - _slots_until(due, slots, zone))
    day = local_date(now, zone)
    each = F.array(*(instant(F.date_add(day, -n), F.lit(m), zone) for n in range(2) for m in minutes(slots)))
    latest = F.greatest(due, F.array_max(F.filter(each, lambda x: x <= now)))
    return F.struct(F.when(behind, due).otherwise(latest).alias("scheduled_at"), F.when(behind, 0).otherwise(skipped).cast("int").alias("skipped"))


def run_window(scheduled: Column, slots: list[str], zone: str = ZONE) -> Column:
    """struct(day, slot, start, end): from the slot before a scheduled one, or midnight, to that one."""
    here, known = local(scheduled, zone), minutes(slots)
    day, minute = F.to_date(here), minute_of_day(here)
    before = F.lit(0)
    for earlier, this in zip([0, *known], known):
        before = F.when(minute == this, earlier).otherwise(before)
    return F.struct(day.alias("day"), F.date_format(here, "HH:mm").alias("slot"), instant(day, before, zone).alias("start"), scheduled.alias("end"))
