"""Queries on periods, venues, cities, times of day and scheduled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources.tables import MESSAGES_SQL, Tables
from .registry import query

SINCE, UNTIL = 857174400, 859852800  # March 1997


@query("f9_period_sources", f"""
with r as (select o_orderkey id, o_custkey % 400 day_key, epoch(o_orderdate)::bigint start_at, epoch(o_orderdate)::bigint + (o_orderkey % 9 - 1) * 86400 end_at from orders),
daily as (select * from r where id % 2 = 0 and start_at >= {SINCE} and end_at <= {UNTIL} and end_at > start_at)
select id, 'daily' as level from daily union all
select id, 'batch' from r where id % 2 = 1 and start_at < {UNTIL} and end_at > {SINCE} and day_key not in (select day_key from daily)
""")  # fmt: skip
def period_sources(t: Tables) -> DataFrame:
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 400).alias("day_key"), start.alias("start_at"), (start + (F.col("o_orderkey") % 9 - 1) * 86400).alias("end_at"))
    return ev.for_period(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), SINCE, UNTIL).select("id", "level")


@query("f11_best_venue", """
with s as (select p_partkey, p_name, list_distinct(string_split(lower(p_name), ' ')) v from part),
m as (select *, len(list_intersect(v, ['ring', 'red'])) n from s),
c as (select *, n * 100 + case when n = 2 then 40 else 0 end - (len(v) - n) score from m where n > 0)
select p_partkey, score::int score from c where score = (select max(score) from c) and score >= 100 and (select count(distinct p_name) from c where score = (select max(score) from c)) = 1
""")  # fmt: skip
def best_venue(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", F.split(F.lower("p_name"), " ").alias("tokens"))
    return ev.best_venue(rows, "tokens", "p_name", ["ring", "red"]).select("p_partkey", "score")


@query("f17_other_city", "select p_partkey, coalesce(list_contains(string_split(lower(p_name), ' '), 'red') and not list_has_any(string_split(lower(p_name), ' '), ['ring', 'bolt']), false) conflict from part")
def other_city(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ev.other_city(F.col("p_name"), ["Red"], ["Ring", "Bolt"]).alias("conflict"))


ROLE = "case l_partkey % 4 when 0 then 'doors' when 1 then 'start' when 2 then 'end' end"


@query("x25_time_evidence", f"""
with l as (select l_orderkey k, l_linenumber i, l_partkey % 600 as mi, coalesce({ROLE}, 'unknown') as ro from lineitem),
p as (select a.k, a.i, b.i j, abs(a.mi - b.mi) delta, case when a.ro = b.ro and a.ro <> 'unknown' then [60, 105] when a.ro in ('doors', 'start') and b.ro in ('doors', 'start') then [150, 240]
  when a.ro <> 'unknown' or b.ro <> 'unknown' then [90, 180] else [90, 150] end lim from l a join l b on a.k = b.k and b.i = a.i + 1)
select k, i, j, delta, delta <= lim[1] compatible, delta > lim[2] conflict,
  (case when delta = 0 then 1 when delta <= 15 then 0.98 when delta <= 60 then 0.9 when delta <= lim[1] then 0.74 when delta <= lim[2] then 0.28 else 0 end)::double similarity from p
""")  # fmt: skip
def time_evidence(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 600).alias("minute"), F.expr(ROLE).alias("role"))
    after = rows.select("k", (F.col("i") - 1).alias("i"), F.col("i").alias("j"), F.col("minute").alias("minute_b"), F.col("role").alias("role_b"))
    found = ev.time_evidence(F.col("minute"), F.col("role"), F.col("minute_b"), F.col("role_b"))
    return rows.join(after, ["k", "i"]).select("k", "i", "j", found.alias("e")).select("k", "i", "j", "e.*")


@query("z13_stale_runs", f"with {MESSAGES_SQL} select cmid from messages where created_at > 0 and cmid % 1300 > 600")
def stale_runs(t: Tables) -> DataFrame:
    at = F.col("created_at")
    return t.messages().where(ev.stale(at, at + F.col("cmid") % 1300)).select("cmid")


@query("w8_newest_revision", f"with {MESSAGES_SQL} select peer_id, created_at // 86400 as day_key, max(cmid) revision, arg_max(kind, cmid) kind from messages group by all")
def newest_revision(t: Tables) -> DataFrame:
    rows = t.messages().select("peer_id", F.expr("created_at div 86400").alias("day_key"), F.col("cmid").alias("revision"), "kind")
    return ev.newest_revision(rows, ["peer_id", "day_key"], "revision")
