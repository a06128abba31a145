"""Queries on calendars: local times, dates in prose, schedule slots, periods that are due, checkpoints."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, time
from ..functions import mentions as places
from ..operators import periods
from ..sources.tables import Tables
from .registry import query

#: The event table lies in 2024, when the zone is three hours ahead of UTC all year.
SLOTS = list(time.SLOTS.values())
TODAY = "1997-05-14"


def _seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "ts")


@query("d2_local_to_utc", "select event_id, epoch(date_trunc('minute', ts))::bigint - 10800 as \"at\" from events")
def local_to_utc(t: Tables) -> DataFrame:
    """Event times read as local wall times."""
    day, minute = F.to_date("ts"), F.hour("ts") * 60 + F.minute("ts")
    return t.events.select("event_id", time.instant(day, minute).alias("at"))


@query("d3_day_window", "select event_id, epoch(date_trunc('day', ts + interval 3 hour))::bigint - 10800 start_at, epoch(date_trunc('day', ts + interval 3 hour))::bigint + 75600 end_at from events")
def day_windows(t: Tables) -> DataFrame:
    window = time.day_window(time.local_date(F.col("at")))
    return _seconds(t).select("event_id", window["start"].alias("start_at"), window["end"].alias("end_at"))


_RU = "['" + "','".join(dates.MONTHS) + "']"
_EN = "['" + "','".join(dates.ENGLISH) + "']"


@query("d8_date_mentions", """
with r as (select o_orderkey k, o_orderdate::date d from orders),
m as (select k, case k % 7 when 0 then [d] when 1 then [d] when 2 then [make_date(year(d), month(d), 5), make_date(year(d), month(d), 7)] when 3 then [d, d + 1] when 4 then [d] when 5 then []::date[]
  else [make_date(year(d) + (d - make_date(year(d), 1, 9) > 183)::int, 1, 9), d] end x from r)
select k, array_to_string(list_transform(list_sort(list_distinct(x)), lambda y: strftime(y, '%Y-%m-%d')), ',') as days from m""")  # fmt: skip
def date_mentions(t: Tables) -> DataFrame:
    """Dates written in seven ways, beside numbers that are none."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(day))
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    text = (
        F.when(key % 7 == 0, F.concat(F.lit("call 8-900-12.03.44 until "), F.date_format(day, "dd.MM.yyyy"), F.lit(" at 19:00")))
        .when(key % 7 == 1, F.concat(d, F.lit(" "), name(dates.MONTHS), F.lit(" "), y, F.lit(" года")))
        .when(key % 7 == 2, F.concat(F.lit("Фестиваль 5–7 "), name(dates.MONTHS)))
        .when(key % 7 == 3, F.lit("Сегодня или завтра, entry 10.50 руб"))
        .when(key % 7 == 4, F.concat(F.initcap(name(dates.ENGLISH)), F.lit(" "), d, F.lit("th, "), y))
        .when(key % 7 == 5, F.lit("10.50 руб, 45.99, in 19.00 hours, Mayday 5, 3.14% off"))
        .otherwise(F.concat(F.lit("from 9.01 to "), F.date_format(day, "d.M.yyyy")))
    )
    found = dates.mentions(text, day)
    return t.orders.select(key.alias("k"), F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("days"))


@query("d8_mention_places", f"""
with r as (select o_orderkey k, o_orderdate::date d, day(o_orderdate)::int dd, month(o_orderdate)::int mm, year(o_orderdate)::int yy, {_RU}[month(o_orderdate)] ru, {_EN}[month(o_orderdate)] en from orders),
m as (
  select k, 'absolute' kind, 29 as pos, 10 length, dd, mm, yy, strftime(d, '%d.%m.%Y') raw from r where k % 4 = 0
  union all select k, 'range-start', 10, 2, 20, mm, null, '20' from r where k % 4 = 1
  union all select k, 'absolute', 13, 3 + length(ru), 22, mm, null, '22 ' || ru from r where k % 4 = 1
  union all select k, 'range-end', 13, 2, 22, mm, null, '20–22 ' || ru from r where k % 4 = 1
  union all select k, 'absolute', 20, length(dd || ' ' || ru || ' ' || yy), dd, mm, yy, dd || ' ' || ru || ' ' || yy from r where k % 4 = 2
  union all select k, 'range-start', 9, length(en || ' 5-7, ' || yy), 5, mm, yy, en || ' 5-7, ' || yy from r where k % 4 = 3
  union all select k, 'range-end', 12 + length(en), 1, 7, mm, yy, en || ' 5-7, ' || yy from r where k % 4 = 3)
select m.k, kind, pos::int at_, length::int length, raw,
  case when yy is not null then strftime(make_date(yy, mm, m.dd), '%Y-%m-%d') else strftime(make_date(year(d) + (d - make_date(year(d), mm, m.dd) > 183)::int, mm, m.dd), '%Y-%m-%d') end as day from m join (select k, d from r) using (k)""")  # fmt: skip
def mention_places(t: Tables) -> DataFrame:
    """Where orders' texts name their dates, beside a telephone number, a street, and with ranges in two languages."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(day))
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("call +7 (900) 12.03.44 until "), F.date_format(day, "dd.MM.yyyy"), F.lit(" at 19:00")))
        .when(key % 4 == 1, F.concat(F.lit("Фестиваль 20–22 "), name(dates.MONTHS)))
        .when(key % 4 == 2, F.concat(F.lit("ул. 9 Января, 100 — "), d, F.lit(" "), name(dates.MONTHS), F.lit(" "), y))
        .otherwise(F.concat(F.lit("Shows on "), name(dates.ENGLISH), F.lit(" 5-7, "), y))
    )
    rows = t.orders.select(key.alias("k"), day.alias("_day"), F.explode(places.mention_places(text)).alias("m"))
    return rows.select("k", "m.kind", F.col("m.at").alias("at_"), "m.length", "m.raw", places.resolved(F.col("m"), F.col("_day")).cast("string").alias("day"))


#: Phrases, and what they mean on 14 May 1997, a Wednesday.
PHRASES = [
    ("что сегодня", "today", "1997-05-14", "1997-05-14"),
    ("тусы на завтра", "tomorrow", "1997-05-15", "1997-05-15"),
    ("на выходные", "weekend", "1997-05-16", "1997-05-18"),
    ("эта неделя", "week", "1997-05-14", "1997-05-18"),
    ("ближайшие дни", "nearWeekend", "1997-05-14", "1997-05-18"),
    ("ближайшие 10 дней", "nextDays", "1997-05-14", "1997-05-23"),
    ("в субботу", "weekday", "1997-05-17", "1997-05-17"),
    ("этот месяц", "currentMonth", "1997-05-14", "1997-05-31"),
    ("на месяц", "next30", "1997-05-14", "1997-06-13"),
    ("концерты в июле", "month", "1997-07-01", "1997-07-31"),
    ("5 марта", "date", "1998-03-05", "1998-03-05"),
    ("с 5 по 7 июня", "date-range", "1997-06-05", "1997-06-07"),
    ("01.08.1997 - 05.08.1997", "date-range", "1997-08-01", "1997-08-05"),
    ("афиша на две недели", "next14", "1997-05-14", "1997-05-27"),
    ("за все время", "all", "1997-05-14", "9999-12-31"),
]


@query("d9_phrase_ranges", "with p(phrase, kind, a, b) as (values " + ", ".join(f"('{p}', '{k}', date '{a}', date '{b}')" for p, k, a, b in PHRASES) + ") select phrase, kind, strftime(a, '%Y-%m-%d') as first, case when kind = 'all' then '9999-12-31' else strftime(b, '%Y-%m-%d') end as last, (select count(*) from orders where o_orderdate::date between a and b) n from p")
def phrase_ranges(t: Tables) -> DataFrame:
    """How many orders fall into what each phrase means: ranges are literals, and the orders are read once."""
    found = [(p, *dates.phrase(p, date.fromisoformat(TODAY))) for p, *_ in PHRASES]
    day = F.to_date("o_orderdate")
    counts = t.orders.agg(*(F.count_if((day >= F.lit(a)) & (day <= F.lit(b))).alias(f"n{i}") for i, (_, _, a, b) in enumerate(found)))
    rows = [F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("kind"), F.lit(a.isoformat()).alias("first"), F.lit(b.isoformat()).alias("last"), F.col(f"n{i}").alias("n")) for i, (p, k, a, b) in enumerate(found)]
    return counts.select(F.inline(F.array(*rows)))


@query("d10_clip_to_future", f"with r as (select o_orderkey k, o_orderdate::date a, o_orderdate::date + (o_orderkey % 30)::int b from orders) select k, strftime(case when b < date '{TODAY}' then a else greatest(a, date '{TODAY}') end, '%Y-%m-%d') as first, b < date '{TODAY}' past_only from r")
def clip(t: Tables) -> DataFrame:
    start = F.to_date("o_orderdate")
    found = time.clipped(start, F.date_add(start, (F.col("o_orderkey") % 30).cast("int")), F.lit(TODAY).cast("date"))
    return t.orders.select(F.col("o_orderkey").alias("k"), found["start"].cast("string").alias("first"), found["past_only"].alias("past_only"))


_SLOT_SQL = "m(s) as (values " + ", ".join(f"({x * 60})" for x in time.minutes(SLOTS)) + "), e as (select event_id, floor(epoch(ts))::bigint sec, (floor(epoch(ts))::bigint + 10800) // 86400 * 86400 - 10800 d from events)"


@query("d11_next_slot", f"with {_SLOT_SQL} select event_id, min(d + n * 86400 + s) next from e, m, (values (0), (1)) x(n) where d + n * 86400 + s > sec group by all")
def next_slots(t: Tables) -> DataFrame:
    return _seconds(t).select("event_id", time.next_slot(F.col("at"), SLOTS).alias("next"))


@query("d11_coalesced_slot", f"with {_SLOT_SQL}, g as (select event_id, sec - event_id % 5 * 40000 due, sec now, d from e), c as (select event_id, due, now, max(x) top, count_if(x > due) n from (select event_id, due, now, d - k * 86400 + s x from g, m, generate_series(0, 3) t(k)) where x <= now group by all) select event_id, case when due > now then due else greatest(due, top) end scheduled_at, case when due > now then 0 else n end::int skipped from c")
def coalesced(t: Tables) -> DataFrame:
    """Runs that were due up to two days ago."""
    found = time.coalesced(F.col("at") - F.col("event_id") % 5 * 40000, F.col("at"), SLOTS)
    return _seconds(t).select("event_id", found["scheduled_at"].alias("scheduled_at"), found["skipped"].alias("skipped"))


@query("d12_run_window", f"with {_SLOT_SQL}, x as (select event_id, d, min(s) s from e, m where d + s > sec group by all union all select event_id, d + 86400, (select min(s) from m) from e where not exists (select 1 from m where d + s > sec)) select event_id, strftime(to_timestamp(d + 10800) at time zone 'UTC', '%Y-%m-%d') as day, d + coalesce((select max(s) from m where m.s < x.s), 0) start_at, d + s end_at from x")
def run_windows(t: Tables) -> DataFrame:
    """The window of the run that follows each event."""
    window = time.run_window(time.next_slot(F.col("at"), SLOTS), SLOTS)
    return _seconds(t).select("event_id", window["day"].cast("string").alias("day"), window["start"].alias("start_at"), window["end"].alias("end_at"))


_DAY = "epoch({})::bigint - 10800"
_PERIODS = f"""
d as (select unnest(generate_series(date '2023-01-01', date '2024-12-31', interval 1 day))::date d),
p as (
  select 'workweek' kind, strftime(d, '%Y-%m-%d') k, {_DAY.format("d - 4")} s, {_DAY.format("d")} + 54000 e, {_DAY.format("d")} + 54000 due, 7 * 86400 c from d where isodow(d) = 5
  union all select 'weekend', strftime(d, '%Y-%m-%d'), {_DAY.format("d - 2")} + 54000, {_DAY.format("d")} + 72000, {_DAY.format("d")} + 72000, 7 * 86400 from d where isodow(d) = 7
  union all select 'full-week', strftime(d, '%Y-%m-%d'), {_DAY.format("d - 6")}, {_DAY.format("d")} + 75600, {_DAY.format("d")} + 75600, 7 * 86400 from d where isodow(d) = 7
  union all select 'calendar-month', strftime(d - interval 1 month, '%Y-%m'), {_DAY.format("d - interval 1 month")}, {_DAY.format("d")}, {_DAY.format("d")} + 39600, 45 * 86400 from d where day(d) = 1
  union all select 'calendar-year', (year(d) - 1)::varchar, {_DAY.format("d - interval 1 year")}, {_DAY.format("d")}, {_DAY.format("d")} + 43200, 45 * 86400 from d where day(d) = 1 and month(d) = 1
  union all select 'calendar-season', case month(d) when 3 then 'winter' when 6 then 'spring' when 9 then 'summer' else 'autumn' end || ':' || strftime(d - interval 3 month, '%Y-%m-%d'), {_DAY.format("d - interval 3 month")}, {_DAY.format("d")}, {_DAY.format("d")} + 39600, 45 * 86400
    from d where day(d) = 1 and month(d) in (3, 6, 9, 12))"""


@query("z7_period_catalogue", f"with {_PERIODS} select kind, k as key, s start_at, e end_at, due scheduled_at from p")
def catalogue(t: Tables) -> DataFrame:
    return periods.catalogue(t.spark, "2023-01-01", "2024-12-31").drop("catch_up")


@query("z7_due_periods", f"with {_PERIODS}, n as (select max(floor(epoch(ts))::bigint) now from events) select kind, k as key, due scheduled_at from p, n where now - due between 0 and c")
def due_periods(t: Tables) -> DataFrame:
    """What is due at the time of the last event."""
    now = _seconds(t).agg(F.max("at").alias("now"))  # one row
    found = periods.catalogue(t.spark, "2023-01-01", "2024-12-31").crossJoin(F.broadcast(now))
    return periods.due(found, F.col("now")).select("kind", "key", "scheduled_at")


@query("d13_plans_due", f"with {_PERIODS} select event_id, kind, k as key, least(e, due) snapshot_at from p, (select event_id, floor(epoch(ts))::bigint sec from events) where sec >= due and sec < due + 3600")
def plans_due(t: Tables) -> DataFrame:
    """Plans that became due in the hour before each event."""
    found = periods.plans_due(periods.catalogue(t.spark, "2023-01-01", "2024-12-31"), _seconds(t).select("event_id", "at"), "at", 3600)
    return found.select("event_id", "kind", "key", "snapshot_at")


@query("z2_slot_closed", "with e as (select event_id, ts + interval 3 hour l from events), s as (select event_id, l, case when hour(l) * 60 + minute(l) >= 1350 then '23:59' when hour(l) * 60 + minute(l) >= 1260 then '22:30' when hour(l) * 60 + minute(l) >= 1080 then '21:00' when hour(l) * 60 + minute(l) >= 900 then '18:00' when hour(l) * 60 + minute(l) >= 720 then '15:00' when hour(l) * 60 + minute(l) >= 540 then '12:00' when hour(l) * 60 + minute(l) >= 180 then '09:00' else '03:00' end slot from e) select event_id, slot, strptime(strftime(l, '%Y-%m-%d') || ' ' || slot, '%Y-%m-%d %H:%M') <= l + interval 2 hour closed from s")
def slot_closed(t: Tables) -> DataFrame:
    """Whether the slot that owns an event has closed two hours later."""
    here = time.local(F.col("at"))
    rows = _seconds(t).select("event_id", here.alias("here"), time.slot(time.minute_of_day(here)).alias("slot"))
    return rows.select("event_id", "slot", time.slot_closed(F.to_date("here"), F.col("slot"), F.col("here") + F.expr("interval 2 hours")).alias("closed"))


@query("z11_checkpoint_reasons", """
with r as (select o_orderkey k, o_custkey % 3 p, nullif(o_orderkey % 11, 5) i, o_orderkey % 7 m, o_orderkey % 5 c, o_orderkey % 4 v, o_orderkey % 2 h from orders)
select k, case when k % 97 = 0 then 'forced' when i is null then 'legacy-or-invalid-checkpoint' when p = 1 and k % 2 = 0 then 'peer-map-changed' when i = 3 then 'source-inventory-changed' when m < 2 then 'message-count-regressed'
  when 3 - c > 2 then 'coverage-ceiling-regressed' when v < 1 then 'coverage-count-regressed' when v > 1 then 'checkpoint-valid-coverage-growth' when h = 1 and k % 3 = 0 then 'coverage-hash-mismatch' else 'checkpoint-valid' end reason
from r""")  # fmt: skip
def checkpoint_reasons(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    inventory = F.when(k % 11 != 5, k % 11)
    peers = F.array(F.col("o_custkey") % 3)
    stored = {"peers": peers, "inventory": inventory, "messages": F.lit(2), "ceiling": 3 - k % 5, "covered": F.lit(1), "hash": F.lit("a")}
    current = {
        "peers": F.when((F.col("o_custkey") % 3 == 1) & (k % 2 == 0), F.array(F.lit(9).cast("long"))).otherwise(peers), "inventory": F.when(k % 11 == 3, F.lit(-1)).otherwise(k % 11),
        "messages": k % 7, "ceiling": F.lit(2), "covered": k % 4, "hash": F.when((k % 2 == 1) & (k % 3 == 0), "b").otherwise("a"),
    }
    return t.orders.select("o_orderkey", periods.checkpoint_reason(stored, current, k % 97 == 0).alias("reason")).withColumnRenamed("o_orderkey", "k")
