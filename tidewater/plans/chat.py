"""Queries on the chat relations: activity, reactions, roll-ups, lineage."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import plain_name
from ..operators import activity as act
from ..operators import relations as rel
from ..operators import graph, rollup
from ..sources.tables import MESSAGES_SQL, Tables
from ..streaming import hierarchy
from .registry import query

#: The end of the event table's month, in epoch seconds; the window that the activity queries cover.
NOW, START, END = 1706659200, 1704240000, 1705449600

RECONCILED = f"{MESSAGES_SQL}, m as (select * from archive union all select l.* from live l where not exists (select 1 from archive a where a.peer_id = l.peer_id and a.cmid = l.cmid and a.sender_id = l.sender_id))"


def _messages(t: Tables) -> DataFrame:
    return act.reconciled(t.archive(), t.live(), ["peer_id", "cmid", "sender_id"])


@query("a1_inactive_participants", f"""
with {RECONCILED},
mem as (select sender_id, case kind when 'signup' then 'joined' else 'left' end event, created_at as seen, cmid from messages where kind in ('signup', 'error')),
last as (select sender_id, event, row_number() over (partition by sender_id order by seen desc, cmid desc, event desc) r from mem),
joined as (select sender_id, max(seen) joined_at from mem where event = 'joined' group by all),
a as (select sender_id, count(*) messages, max(created_at) last_at from m where kind = 'click' group by all)
select a.sender_id, c.c_name full_name, messages, greatest(last_at, coalesce(joined_at, 0)) seen_at
from a left join (select * from last where r = 1) l using (sender_id) left join joined using (sender_id)
left join customer c on c.c_custkey = a.sender_id
where messages >= 5 and greatest(last_at, coalesce(joined_at, 0)) <= {NOW} - 2 * 86400
  and coalesce(l.event not in ('left', 'kicked'), true) and coalesce(c.c_name, '') <> ''
""")  # fmt: skip
def inactive(t: Tables) -> DataFrame:
    members = t.messages().where("kind in ('signup', 'error')").select("sender_id", F.when(F.col("kind") == "signup", "joined").otherwise("left").alias("event"), F.col("created_at").alias("at"), "cmid")
    names = t.customer.select(F.col("c_custkey").alias("sender_id"), F.col("c_name").alias("full_name"))
    return act.inactive(_messages(t).where("kind = 'click'"), members, names, NOW, least=5, days=2)


@query("a2_top_senders", f"with {RECONCILED.replace('a.sender_id = l.sender_id', 'a.sender_id = l.sender_id and a.created_at = l.created_at')} select sender_id, count(*) messages from m where created_at >= {START} and created_at < {END} group by all order by messages desc, sender_id limit 30")
def top_senders(t: Tables) -> DataFrame:
    return act.top_senders(act.reconciled(t.archive(), t.live(), ["peer_id", "cmid", "sender_id", "created_at"]), START, END)


def _counters(t: Tables) -> DataFrame:
    """A reaction count of each message, with two users named; messages of kind view have no data."""
    users = F.array(F.col("sender_id") % 50, F.col("reactions") % 50)
    one = F.array(F.struct(F.lit(1).alias("reaction_id"), (F.col("reactions") % 3).cast("int").alias("count"), users.alias("user_ids")))
    return t.messages().where("kind <> 'view'").select("cmid", one.alias("counters"))


@query("a3_reactions", f"""
with {MESSAGES_SQL},
tracked as (select sender_id, count(*) messages from messages group by all order by messages desc, sender_id limit 30),
c as (select *, case when kind <> 'view' then reactions % 3 end n, case when kind <> 'view' then [sender_id % 50, reactions % 50] end users from messages),
r as (select sender_id, sum(coalesce(n, 0)) received, bool_and(n is not null) known from c group by all),
g as (select u sender_id, count(*) given from (select unnest(users) u from c) group by all)
select t.sender_id, messages, coalesce(received, 0)::bigint received, coalesce(known, true) received_known, coalesce(given, 0) given,
       (select bool_and(n is not null and len(users) >= n) from c) given_known
from tracked t left join r using (sender_id) left join g using (sender_id)
""")  # fmt: skip
def reactions(t: Tables) -> DataFrame:
    tracked = act.top_senders(t.messages(), 0, 2**62)
    return act.reactions(t.messages(), _counters(t), tracked)


@query("a4_anonymous_totals", f"""
with {MESSAGES_SQL}, s as (select cmid // 4 message_id, case when cmid % 4 = 0 and reactions % 2 = 0 then 0 else sender_id + 1 end actor, reactions n from messages)
select message_id, case when bool_or(actor = 0) then max(n) filter (actor = 0) else sum(n) end::bigint total, bool_or(actor = 0) anonymous from s group by all
""")  # fmt: skip
def anonymous(t: Tables) -> DataFrame:
    snap = t.messages().select(F.floor(F.col("cmid") / 4).alias("message_id"), F.when(F.expr("cmid % 4 = 0 and reactions % 2 = 0"), 0).otherwise(F.col("sender_id") + 1).alias("actor"), F.col("reactions").alias("n"))
    some = F.bool_or(F.col("actor") == 0)
    return snap.groupBy("message_id").agg(F.when(some, F.max(F.when(F.col("actor") == 0, F.col("n")))).otherwise(F.sum("n")).alias("total"), some.alias("anonymous"))


@query("a9_last_activity", f"with {MESSAGES_SQL} select peer_id, max(created_at) last_at, arg_max(kind, (created_at, cmid)) filter (kind <> 'view') title from messages group by all")
def last_activity(t: Tables) -> DataFrame:
    titled = F.when(F.col("kind") != "view", F.struct("created_at", "cmid"))
    return t.messages().groupBy("peer_id").agg(F.max("created_at").alias("last_at"), F.max_by("kind", titled).alias("title"))


@query("a11_reliability", f"""
with {MESSAGES_SQL}, g as (select peer_id, kind, count(*) n, count_if(reactions >= 50) k, max(created_at) last_at, count(distinct sender_id) origins, sum(value) latency from messages group by all)
select peer_id, kind, n, k, last_at, origins, round(latency, 2) latency,
       round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)), 6) reliability from g
""")  # fmt: skip
def reliability(t: Tables) -> DataFrame:
    g = t.messages().groupBy("peer_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("reactions") >= 50).alias("k"), F.max("created_at").alias("last_at"), F.countDistinct("sender_id").alias("origins"), F.round(F.sum("value"), 2).alias("latency"))
    return g.withColumn("reliability", F.round(rollup.wilson("k", "n"), 6))


@query("a14_dossiers", f"""
with {MESSAGES_SQL}, s as (select *, cmid % 5 chat_id from messages where length(kind) >= 5 and cmid % 6 <> 1 and kind <> 'signup'),
n as (select * from s qualify row_number() over (partition by sender_id order by created_at desc, cmid desc) <= 220)
select sender_id, count(*) messages, count(distinct chat_id) chats, max(created_at) last_at from n group by all
""")  # fmt: skip
def dossiers(t: Tables) -> DataFrame:
    """Every sixth message is the owner's own, signups are actions, and a fifth of all messages are in each of five chats."""
    said = t.messages().withColumns({"chat_id": F.col("cmid") % 5, "text": F.concat(F.lit(" "), "kind"), "outgoing": F.col("cmid") % 6 == 1, "action": F.when(F.col("kind") == "signup", "joined")})
    return act.dossiers(said, least=5)


@query("a16_content_hash", f"with {MESSAGES_SQL} select peer_id, count(*) n, sha256(string_agg(cmid || chr(1) || sender_id || chr(1) || created_at || chr(1) || kind || chr(10), '' order by cmid)) digest from messages group by all")
def content_hash(t: Tables) -> DataFrame:
    line = F.concat(F.concat_ws("\u0001", F.col("cmid").cast("string"), F.col("sender_id").cast("string"), F.col("created_at").cast("string"), "kind"), F.lit("\n"))
    return rel.ordered_digests(t.messages(), "peer_id", ["cmid"], line)


@query("w2_newest_three", f"with {MESSAGES_SQL} select sender_id, cmid, created_at from (select *, row_number() over (partition by sender_id order by created_at desc, cmid desc) r from messages) where r <= 3")
def newest(t: Tables) -> DataFrame:
    return act.latest(t.messages(), ["sender_id"], [F.desc("created_at"), F.desc("cmid")], 3).select("sender_id", "cmid", "created_at")


@query("w5_sliding_context", f"with {MESSAGES_SQL} select cmid, list(kind) over w around, lag(cmid) over o before, lead(cmid) over o after from messages window o as (partition by sender_id order by created_at, cmid), w as (partition by sender_id order by created_at, cmid rows between 2 preceding and 2 following)".replace("list(kind) over w around", "array_to_string(list(kind) over w, ',') around"))
def sliding(t: Tables) -> DataFrame:
    order = Window.partitionBy("sender_id").orderBy("created_at", "cmid")
    return t.messages().select("cmid", F.array_join(F.collect_list("kind").over(order.rowsBetween(-2, 2)), ",").alias("around"), F.lag("cmid").over(order).alias("before"), F.lead("cmid").over(order).alias("after"))


@query("f7_character_budget", f"with {MESSAGES_SQL}, s as (select peer_id, cmid, kind, sum(length(kind)) over (partition by peer_id order by created_at desc, cmid desc) total from messages) select peer_id, cmid, left(kind, greatest(0, least(length(kind), 400 - (total - length(kind))))::int) kept from s where total - length(kind) < 400")
def budget(t: Tables) -> DataFrame:
    order = Window.partitionBy("peer_id").orderBy(F.desc("created_at"), F.desc("cmid"))
    # Every text has a letter at least, so the newest 400 are enough; this limit applies before rows are shuffled.
    some = t.messages().where(F.length("kind") > 0).withColumn("_place", F.row_number().over(order)).where("_place <= 400")
    newest = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = some.withColumn("before", F.sum(F.length("kind")).over(newest) - F.length("kind")).where("before < 400")
    return rows.select("peer_id", "cmid", F.substr("kind", F.lit(1), F.least(F.length("kind"), 400 - F.col("before")).cast("int")).alias("kept"))


@query("j16_context_windows", f"""
with {MESSAGES_SQL}, n as (select *, row_number() over (partition by peer_id order by created_at, cmid) i, count(*) over (partition by peer_id) size from messages),
h as (select peer_id, greatest(i - 3, 1) first, least(i + 3, size) last from n where kind = 'error' and reactions > 90),
p as (select *, case when first <= max(last) over (partition by peer_id order by first, last rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end fresh from h),
q as (select *, sum(fresh) over (partition by peer_id order by first, last rows unbounded preceding) k from p)
select peer_id, min(first) first, max(last) last from q group by peer_id, k
""")  # fmt: skip
def context(t: Tables) -> DataFrame:
    hit = (F.col("kind") == "error") & (F.col("reactions") > 90)
    return rel.context(t.messages(), ["peer_id"], ["created_at", "cmid"], hit, 3)


@query("j18_preceding_rows", f"with {MESSAGES_SQL}, n as (select * from messages where cmid <= 5000 qualify row_number() over (partition by peer_id order by cmid desc) <= 20) select peer_id, cmid, row_number() over (partition by peer_id order by cmid) place from n")
def preceding(t: Tables) -> DataFrame:
    some = act.latest(t.messages().where("cmid <= 5000"), ["peer_id"], [F.desc("cmid")], 20)
    return some.select("peer_id", "cmid", F.row_number().over(Window.partitionBy("peer_id").orderBy("cmid")).cast("long").alias("place"))


@query("j19_reply_roots", """
with recursive l as (select event_id id, case when event_id % 10 > 0 and event_id % 97 > 0 then event_id - 1 - event_id % 3 end parent from events),
k as (select id, case when parent >= 0 then parent end parent from l),
r as (select id, id root, 0 hops from k where parent is null union all select k.id, r.root, r.hops + 1 from k join r on k.parent = r.id)
select id, root, hops, true complete from r
""")  # fmt: skip
def reply_roots(t: Tables) -> DataFrame:
    parent = F.expr("case when event_id % 10 > 0 and event_id % 97 > 0 and event_id - 1 - event_id % 3 >= 0 then event_id - 1 - event_id % 3 end")
    return rel.chain_roots(t.events.select(F.col("event_id").alias("id"), parent.alias("parent")))


@query("u3_lineage", "with b as (select * from orders where o_orderkey % 10 <> 3), a as (select * from orders where o_orderkey % 10 <> 7), t as (select max(o_orderdate) top from b), g as (select count(*) backup_only from b where o_orderkey not in (select o_orderkey from a)), n as (select o_orderdate from a where o_orderkey not in (select o_orderkey from b)) select backup_only, (select count_if(o_orderdate > top) from n, t) tail, (select count_if(o_orderdate <= top) from n, t) historical, backup_only > 0 regressed from g")
def lineage(t: Tables) -> DataFrame:
    return rel.lineage(t.orders.where("o_orderkey % 10 <> 3"), t.orders.where("o_orderkey % 10 <> 7"), ["o_orderkey"], "o_orderdate")


@query("u5_recovered", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 10 <> 7 union all select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 10 = 7")
def recovered(t: Tables) -> DataFrame:
    kept = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return rel.recovered(kept.where("o_orderkey % 10 <> 7"), t.orders.where("o_orderkey % 10 <> 3"), ["o_orderkey"])


@query("k3_newest_wins", f"with {MESSAGES_SQL}, b as (select *, 0 arrival from archive union all select *, 1 from live) select sender_id, kind, cmid, created_at from b qualify row_number() over (partition by sender_id, kind order by created_at desc, arrival desc) = 1")
def newest_wins(t: Tables) -> DataFrame:
    cols = ["sender_id", "kind", "cmid", "created_at"]
    return rel.upsert_newest(t.archive().select(cols), t.live().select(cols), ["sender_id", "kind"], "created_at")


@query("k1_upsert", "with a as (select * from orders where o_orderkey % 10 <> 7), b as (select o_orderkey, case when o_orderkey % 4 > 0 then 'new ' || o_orderstatus end s, o_totalprice - 1000 * (o_orderkey % 2 - 0.5) p from orders where o_orderkey % 10 <> 3) select coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, case when b.o_orderkey is null then o_orderstatus else s end o_orderstatus, round(greatest(o_totalprice, p), 2) o_totalprice from a full join b on a.o_orderkey = b.o_orderkey")
def upsert(t: Tables) -> DataFrame:
    """Orders written over by nine tenths of them, with another status, at times none, and the greater of two prices."""
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    key = F.col("o_orderkey")
    later = t.orders.where("o_orderkey % 10 <> 3").select("o_orderkey", F.when(key % 4 > 0, F.concat(F.lit("new "), "o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") - 1000 * (key % 2 - 0.5)).alias("o_totalprice"))
    merged = rel.upsert_last(t.orders.where("o_orderkey % 10 <> 7").select(cols), later, ["o_orderkey"], ["o_totalprice"])
    return merged.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("z9_incremental_skip", "with h as (select doc_id, sha256('v2:' || text) now, sha256(text) old from documents), k as (select doc_id, case doc_id % 5 when 0 then now when 1 then old when 2 then '' when 3 then 'other' end hash from h where doc_id % 7 > 0) select doc_id from h left join k using (doc_id) where not coalesce(hash = now or hash = old, false)")
def incremental(t: Tables) -> DataFrame:
    """Documents to read again: two fifths of six sevenths are known, by the current form of hash or the one before."""
    rows = t.documents.select("doc_id", F.sha2(F.concat(F.lit("v2:"), "text"), 256).alias("now"), F.sha2("text", 256).alias("old"))
    kind = F.col("doc_id") % 5
    known = rows.where("doc_id % 7 > 0").select("doc_id", F.when(kind == 0, F.col("now")).when(kind == 1, F.col("old")).when(kind == 2, "").when(kind == 3, "other").alias("hash"))
    return rel.changed(rows, known, ["doc_id"], ["now", "old"]).select("doc_id")


@query("k2_insert_absent", f"with {MESSAGES_SQL} select cmid, kind from archive union all select cmid, kind from live where cmid not in (select cmid from archive)")
def insert_absent(t: Tables) -> DataFrame:
    return rel.insert_absent(t.archive().select("cmid", "kind"), t.live().select("cmid", "kind"), ["cmid"])


@query("k4_monotone_merge", f"""
with {MESSAGES_SQL}, b as (select sender_id, min(created_at) first_at, max(created_at) last_at, max(case when kind = 'view' then kind end) h, 0 arrival from archive group by sender_id
 union all select sender_id, min(created_at), max(created_at), max(kind), 1 from live group by sender_id)
select sender_id, min(first_at) first_at, max(last_at) last_at, arg_min(h, arrival) filter (nullif(h, '') is not null) h from b group by all
""")  # fmt: skip
def monotone(t: Tables) -> DataFrame:
    def summary(rows: DataFrame, kind) -> DataFrame:
        return rows.groupBy("sender_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.max(kind).alias("h"))

    return rel.upsert_monotone(summary(t.archive(), F.when(F.col("kind") == "view", F.col("kind"))), summary(t.live(), F.col("kind")), ["sender_id"], ["first_at"], ["last_at"], ["h"])


SLOT_SQL = "case " + " ".join(f"when mod_ >= {s} then '{x}'" for s, x in reversed(time.SLOTS.items())) + " end"


@query("z1_slots", f"""
with s as (select event_id, ts + interval 3 hour as lt, extract(hour from ts + interval 3 hour) * 60 + extract(minute from ts + interval 3 hour) mod_ from events)
select strftime(lt, '%Y-%m-%d') day_key, {SLOT_SQL} slot, count(*) n from s group by all
""")  # fmt: skip
def slots(t: Tables) -> DataFrame:
    at = time.local(F.unix_seconds(F.col("ts").cast("timestamp")))
    return t.events.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day_key"), time.slot(time.minute_of_day(at)).alias("slot")).agg(F.count("*").alias("n"))


@query("z3_rollup", f"""
with s as (select value, ts + interval 3 hour as lt from events), d as (select date_trunc('day', lt)::date d, count(*) n, sum(value) v, max(lt) last from s group by all)
select strftime(d, '%Y-%m') month_key, strftime(greatest(date_trunc('week', d)::date, date_trunc('month', d)::date), '%Y-%m-%d') segment_start,
       strftime(least(date_trunc('week', d)::date + 6, last_day(d)), '%Y-%m-%d') segment_end, sum(n)::bigint n, round(sum(v), 4) v, count(*) as days from d group by all
""")  # fmt: skip
def weekly(t: Tables) -> DataFrame:
    return rollup.segments(rollup.daily(t.messages())).select("month_key", "segment_start", "segment_end", "n", F.round("v", 4).alias("v"), "days")


def _hierarchy(t: Tables) -> str:
    """The folder of a roll-up that the live feed came into on 18 January, and the rest, late or new, on 1 March."""
    folder = f"{graph.shared(t.spark)}/hierarchy-{uuid.uuid4().hex}"
    write = hierarchy.hierarchy_writer(folder, lambda number: date(2024, 3, 1) if number else date(2024, 1, 18))
    write(t.live(), 0)
    write(t.messages(), 1)
    return folder


def _level(name: str, source: str, period: str, opens: str, closes: str) -> str:
    return f"""
{name}0 as (select peer_id, {period} period, {opens} opens, case when step = 1 and {closes} < date '2024-01-18' then 1 else 2 end step, period source_period, revision source_revision, n, v from {source}),
{name} as (select '{name}' as level, peer_id, period, opens, step, (row_number() over (partition by peer_id, period order by step))::int revision, sum(n)::bigint n, sum(v) v, count(*) sources from {name}0 group by peer_id, period, opens, step)"""


HIERARCHY_SQL = f"""
with s as (select user_id % 7 peer_id, event_id, value, ts + interval 3 hour as lt, extract(hour from ts + interval 3 hour) * 60 + extract(minute from ts + interval 3 hour) mod_ from events),
batch as (
  select 'batch' as level, peer_id, lt::date::varchar || ' ' || {SLOT_SQL} period, lt::date opens, case when event_id % 3 <> 0 then 1 else 2 end step,
    (row_number() over (partition by peer_id, period order by case when event_id % 3 <> 0 then 1 else 2 end))::int revision, count(*) n, sum(value) v, count(*) sources
  from s group by peer_id, period, opens, step, case when event_id % 3 <> 0 then 1 else 2 end),
{_level("day", "batch", "opens::varchar", "opens", "opens")},
{_level("segment", "day", "greatest(date_trunc('week', opens)::date, date_trunc('month', opens)::date)::varchar", "greatest(date_trunc('week', opens)::date, date_trunc('month', opens)::date)", "least(date_trunc('week', opens)::date + 6, last_day(opens))")},
{_level("month", "segment", "strftime(opens, '%Y-%m')", "date_trunc('month', opens)::date", "last_day(opens)")}"""


@query("z3_four_levels", f"{HIERARCHY_SQL} select level, peer_id, period, revision, n, round(v, 4) v, sources from (select * from batch union all select * from day union all select * from segment union all select * from month)")
def four_levels(t: Tables) -> DataFrame:
    return hierarchy.levels(t.spark, _hierarchy(t)).select("level", "peer_id", "period", "revision", "n", F.round("v", 4).alias("v"), "sources")


@query("z4_edges", f"{HIERARCHY_SQL} " + " union all ".join(
    f"select '{x}' as level, peer_id, period, revision, '{y}' source_level, source_period, source_revision from {x}0 join {x} using (peer_id, period, step)" for x, y in (("day", "batch"), ("segment", "day"), ("month", "segment"))))
def promotion_edges(t: Tables) -> DataFrame:
    return hierarchy.edges(t.spark, _hierarchy(t))


@query("z4_promote_once", f"with {MESSAGES_SQL}, dd as (select sender_id peer_id, created_at // 86400 as day, count(*) n from messages group by all) select peer_id, day, n from dd where (peer_id + day) % 4 <> 0")
def promote(t: Tables) -> DataFrame:
    days = t.messages().groupBy(F.col("sender_id").alias("peer_id"), F.floor(F.col("created_at") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return rollup.unconsumed(days, days.where("(peer_id + day) % 4 = 0").select("peer_id", "day"), ["peer_id", "day"])


@query("z5_revisions", f"""
with {MESSAGES_SQL}, g as (select sender_id, created_at // 86400 as day, count(*) n, sum(case when cmid % 3 <> 0 then 1 else 0 end) live_n from messages group by all)
select sender_id, day, 1 revision, live_n::bigint n from g where live_n > 0
union all select sender_id, day, case when live_n > 0 then 2 else 1 end, n from g where live_n <> n
""")  # fmt: skip
def revisions(t: Tables) -> DataFrame:
    def batch(rows: DataFrame) -> DataFrame:
        return rows.groupBy("sender_id", F.floor(F.col("created_at") / 86400).alias("day")).agg(F.count("*").alias("n"))

    first = rollup.revise(None, batch(t.live()), ["sender_id", "day"], ["n"])
    return rollup.revise(first, batch(t.messages()), ["sender_id", "day"], ["n"]).select("sender_id", "day", "revision", "n")


@query("z8_cover", f"with {MESSAGES_SQL}, whole as (select distinct created_at // 86400 as day from messages where created_at // 86400 % 3 = 0), part as (select created_at // 86400 as day, peer_id, count(*) n from messages group by all) select day, -1::bigint peer_id, 0::bigint n from whole union all select * from part where day not in (select day from whole)")
def cover(t: Tables) -> DataFrame:
    day = F.floor(F.col("created_at") / 86400).alias("day")
    whole = t.messages().select(day).where("day % 3 = 0").distinct()
    part = t.messages().groupBy(day, "peer_id").agg(F.count("*").alias("n"))
    return whole.select("day", F.lit(-1).cast("long").alias("peer_id"), F.lit(0).cast("long").alias("n")).unionByName(part.join(whole, "day", "left_anti"))


@query("o5_unknown_last", f"with {MESSAGES_SQL} select sender_id, min(case when kind <> 'view' then (created_at // 60 % 1440)::int end) first_minute, coalesce(lpad((min(case when kind <> 'view' then (created_at // 60 % 1440)::int end) // 60)::varchar, 2, '0'), '23:59') shown from messages group by all")
def unknown_last(t: Tables) -> DataFrame:
    minute = F.min(F.when(F.col("kind") != "view", (F.floor(F.col("created_at") / 60) % 1440).cast("int")))
    return t.messages().groupBy("sender_id").agg(minute.alias("first_minute"), F.coalesce(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit("23:59")).alias("shown")).orderBy("shown", "sender_id")


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдёфгхийклмнопярстувъыэз"


@query("o5_collated_titles", f"""
with r as (select p_partkey, p_partkey % 30 as day, case when p_size % 5 > 0 then lpad((p_size % 24)::varchar, 2, '0') || ':00' end clock,
  case p_partkey % 4 when 0 then p_name when 1 then upper(p_name) when 2 then translate(p_name, '{LATIN}', '{CYRILLIC}') else upper(translate(p_name, '{LATIN}', '{CYRILLIC}')) end title from part)
select p_partkey, day, coalesce(clock, '23:59') shown, title, row_number() over (partition by day order by coalesce(clock, '23:59'), title collate ru, p_partkey)::int place from r""")  # fmt: skip
def collated(t: Tables) -> DataFrame:
    """A day's listing in the order of the hour, unknown ones last, and then of the title as Russian readers sort it: ё beside е, small letters first."""
    key, other = F.col("p_partkey"), F.translate("p_name", LATIN, CYRILLIC)
    title = F.when(key % 4 == 0, F.col("p_name")).when(key % 4 == 1, F.upper("p_name")).when(key % 4 == 2, other).otherwise(F.upper(other))
    hour = F.when(F.col("p_size") % 5 > 0, F.concat(F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lit(":00")))
    rows = t.part.select("p_partkey", (key % 30).alias("day"), hour.alias("at"), title.alias("title"))
    return act.listed(rows, ["day"], "at", "title", "p_partkey").select("p_partkey", "day", F.col("shown"), "title", "place")


@query("r7_display_names", "select c_custkey, left(trim(regexp_replace(c_name || ' ' || c_mktsegment, '[\\[\\]|<>*_`@]+', ' ', 'g')), 60) shown from customer")
def display(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", plain_name(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("shown"))
