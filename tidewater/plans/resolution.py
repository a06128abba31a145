"""Queries of entity resolution, on orders read as event records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, merging, posters
from ..operators import resolution as res
from ..sources.tables import Tables
from . import sqltext as sql
from .registry import query


def _records(t: Tables) -> DataFrame:
    """All orders as dated records, spread over all parts: the part is title and venue, the customer the participants; every fiftieth day is unknown."""
    parts = F.broadcast(t.part.agg(F.count("*").alias("_n")))  # one row
    key = F.col("o_orderkey")
    joined = t.orders.crossJoin(parts).join(t.part, F.col("p_partkey") == key % F.col("_n")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        key.alias("id"),
        F.when(key % 50 != 7, F.to_date("o_orderdate")).alias("day"),
        F.lower("p_name").alias("title"),
        F.lower(F.concat_ws(" ", "p_type", "o_orderpriority", "p_name")).alias("description"),
        F.lower(F.coalesce("c_name", F.lit(""))).alias("participants"),
        F.lower("p_brand").alias("venue"),
        F.when(key % 10 != 3, key * 7 % 48 * 30).cast("int").alias("minute"),
        F.when(key % 3 == 0, F.concat(F.lit("https://a.example/"), F.col("o_custkey").cast("string"))).otherwise("").alias("url"),
        F.when(key % 4 == 0, F.concat(F.lit("https://b.example/"), (F.col("o_custkey") % 40).cast("string"))).otherwise("").alias("link"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("publisher"),
        F.when(F.col("o_orderstatus") == "F", "tickets").when(F.col("o_orderstatus") == "O", "primary").otherwise("other").alias("source"),
        F.col("o_totalprice").alias("richness"),
        tx.words(F.col("p_name"), 4).alias("tokens"),
    )


RECORDS = f"""
r as (
  select o_orderkey id, case when o_orderkey % 50 <> 7 then o_orderdate::date end d, lower(p_name) title, lower(p_type || ' ' || o_orderpriority || ' ' || p_name) description,
    lower(coalesce(c_name, '')) participants, lower(p_brand) venue, case when o_orderkey % 10 <> 3 then (o_orderkey * 7 % 48 * 30)::int end as minute,
    case when o_orderkey % 3 = 0 then 'https://a.example/' || o_custkey else '' end url, case when o_orderkey % 4 = 0 then 'https://b.example/' || (o_custkey % 40) else '' end link,
    case when o_orderkey % 2 = 0 then o_orderpriority else '' end publisher
  from orders join part on p_partkey = o_orderkey % (select count(*) from part) left join customer on c_custkey = o_custkey),
n as (select id, d, {sql.normal("title")} title, {sql.normal("description")} description, {sql.normal("participants")} participants, {sql.normal("venue")} venue, minute, url, link, publisher from r),
k as (
  select distinct id, d, unnest(list_concat(
    list_filter(['title:' || title, 'venue:' || venue, 'participant:' || participants, 'url:' || regexp_replace(url, '/+$', '')], lambda x: length(x) - position(':' in x) >= 2),
    list_transform({sql.words("title", 3)}, lambda w: 'word:' || w))) key from n),
useful as (
  select * from k where key in (
    select key from k group by key having count(*) <= case when key like 'url:%' then 80 when key like 'title:%' then 60
      else greatest(24, least(120, ceil(4 * sqrt((select count(*) from n))))) end)),
w as (select id, d, unnest({sql.words("title", 3)}) word from n where d is not null),
sparse as (select id, d from n where d is not null and id not in (select id from useful))"""


def _candidates(days: int) -> str:
    return f"""
pairs as (
  select least(x.id, y.id) a, greatest(x.id, y.id) b from useful x join useful y on x.key = y.key and x.id < y.id and abs(x.d - y.d) <= {days}
  union select least(x.id, y.id), greatest(x.id, y.id) from w x join w y on x.d = y.d and x.word = y.word and x.id < y.id
  union select least(x.id, y.id), greatest(x.id, y.id) from n x join n y on x.d = y.d and x.participants = y.participants and x.participants <> '' and x.id < y.id
  union select least(x.id, y.id), greatest(x.id, y.id) from sparse x join n y on x.d = y.d and x.id <> y.id
  union select least(x.id, y.id), greatest(x.id, y.id) from useful x join useful y on x.key = y.key and x.d is null and x.id <> y.id)"""


@query("e6_blocking_keys", f"with {RECORDS} select key, id from useful")
def blocking(t: Tables) -> DataFrame:
    return res.blocks(_records(t)).select("key", "id")


@query("j12_candidate_pairs", f"with {RECORDS}, {_candidates(2)} select a, b from pairs")
def pairs(t: Tables) -> DataFrame:
    return res.candidates(_records(t))


@query("j14_unknown_dates", f"with {RECORDS} select distinct least(x.id, y.id) a, greatest(x.id, y.id) b from useful x join useful y on x.key = y.key and x.d is null and x.id <> y.id")
def unknown_dates(t: Tables) -> DataFrame:
    return res.unknown_date_pairs(_records(t))


@query("j15_same_day_pairs", f"with {RECORDS}, v as (select id, d, unnest({sql.words('title', 4)}) word from n where d is not null) select distinct x.id a, y.id b from v x join v y on x.d = y.d and x.word = y.word and x.id < y.id")
def same_day(t: Tables) -> DataFrame:
    return res.same_day_pairs(_records(t))


_SIMILAR = f"""
s as (
  select a, b, x.d = y.d same_day, x.d is not null and y.d is not null known, x.venue xv, y.venue yv, x.minute xm, y.minute ym, x.publisher xp, y.publisher yp,
    {sql.text_similarity("x.title", "y.title")} title, {sql.text_similarity("x.description", "y.description")} description,
    {sql.token_similarity(sql.tokens("x.description"), sql.tokens("y.description"))} ident,
    {sql.field_similarity("x.participants", "y.participants")} participants, {sql.field_similarity("x.venue", "y.venue")} venue,
    {sql.time_similarity("x.minute", "y.minute")} tm, (x.url <> '' and x.url = y.url)::int::double src, (x.link <> '' and x.link = y.link)::int::double link,
    {sql.distinctive("x.title || ' ' || x.participants || ' ' || x.description")} p, {sql.distinctive("y.title || ' ' || y.participants || ' ' || y.description")} q,
    len(list_intersect({sql.words("x.title", 3)}, {sql.words("y.title", 3)})) > 0 word
  from pairs join n x on x.id = a join n y on y.id = b),
c as (select *, len(list_intersect(p, q)) cnt, len(list_intersect(p, q)) / greatest(1, least(len(p), len(q))) held from s)"""


@query("e2_pair_scores", f"""
with {RECORDS}, {_candidates(0)}, {_SIMILAR},
z as (select *, 0.20 * title + 0.27 * description + 0.14 * participants + 0.10 * venue + 0.12 * tm + 0.04 * src + 0.08 * held + 0.05 * link score from c where same_day)
select a, b, round(score, 6) score,
  (link = 1 and tm >= 0.38) or (src = 1 and tm >= 0.38 and (title >= 0.52 or ident >= 0.55 or participants >= 0.62 or cnt >= 2)) or (description >= 0.70 and ident >= 0.62 and tm >= 0.38)
  or (title >= 0.76 and tm >= 0.56 and (participants >= 0.62 or venue >= 0.62 or description >= 0.46 or cnt >= 2)) or (participants >= 0.80 and venue >= 0.68 and tm >= 0.76)
  or (tm >= 0.76 and cnt >= 3 and held >= 0.34 and (description >= 0.42 or ident >= 0.48 or title >= 0.35)) or (tm = 1 and ident >= 0.58 and cnt >= 2)
  or (score >= 0.64 and greatest(title, description, participants, held) >= 0.60 and tm >= 0.38) duplicate
from z""")  # fmt: skip
def scores(t: Tables) -> DataFrame:
    records = _records(t)
    found = res.pair_score(res.compared(records))
    return found.select("a", "b", F.round("score", 6).alias("score"), "duplicate")


@query("e5_three_valued", f"""
with {RECORDS}, {_candidates(2)}, {_SIMILAR},
e as (
  select *, {sql.text_similarity("xv", "yv")} ven, xm is null or ym is null or tm >= 0.38 timed,
    0.40 * (case when same_day then 1 when known then 0 else 0.5 end)::double + 0.36 * title + 0.08 * {sql.text_similarity("xv", "yv")} + 0.08 * participants + 0.04 * description + 0.01 * 0 + 0.03 * tm score,
    (title >= 0.65)::int + ({sql.text_similarity("xv", "yv")} >= 0.82)::int + (participants >= 0.45)::int + (description >= 0.58)::int anchors
  from c)
select a, b,
  case when known and not same_day then 'different' when same_day and title = 1 and not (xv <> '' and yv <> '' and ven < 0.30) then 'same' when xv <> '' and yv <> '' and ven < 0.30 then 'different'
    when same_day and title >= 0.96 and timed and (ven >= 0.45 or participants >= 0.45 or description >= 0.45) then 'same'
    when same_day and participants >= 0.84 and ven >= 0.55 and timed and (title >= 0.45 or description >= 0.52) then 'same' when same_day and score >= 0.85 and anchors >= 2 and timed then 'same'
    when same_day and word then 'ambiguous' when not known and title >= 0.85 and (ven >= 0.72 or participants >= 0.80) and timed then 'ambiguous' when not known then 'different'
    when anchors = 0 and score < 0.60 then 'different' when score <= 0.50 then 'different' else 'ambiguous' end verdict,
  round(case when known and not same_day then 0 when same_day and title = 1 and not (xv <> '' and yv <> '' and ven < 0.30) then 1 when xv <> '' and yv <> '' and ven < 0.30 then 0
    when same_day and title >= 0.96 and timed and (ven >= 0.45 or participants >= 0.45 or description >= 0.45) then score
    when same_day and participants >= 0.84 and ven >= 0.55 and timed and (title >= 0.45 or description >= 0.52) then score when same_day and score >= 0.85 and anchors >= 2 and timed then score
    when same_day and word then greatest(score, 0.72) when not known and title >= 0.85 and (ven >= 0.72 or participants >= 0.80) and timed then greatest(score, 0.58) else score end, 6) score
from e""")  # fmt: skip
def three_valued(t: Tables) -> DataFrame:
    records = _records(t)
    far = res.verdict(res.beside(res.candidates(records, far=True), records))
    found = res.verdict(res.compared(records)).unionByName(far)
    return found.select("a", "b", "verdict", F.round("score", 6).alias("score"))


def _arbiter(t: Tables) -> DataFrame:
    """A table of verdicts on some pairs, as an outside arbiter would give them."""
    a, b = F.col("o_orderkey"), F.col("next")
    return t.orders.select(a.alias("a"), F.explode(F.sequence(a + 1, a + 40)).alias("next")).select("a", b.alias("b"), F.when((F.col("a") + b) % 3 == 0, "same").otherwise("different").alias("verdict"))


@query("e1_complete_link")
def groups(t: Tables) -> DataFrame:
    return res.complete_link(_records(t))


@query("e3_clusters")
def clustered(t: Tables) -> DataFrame:
    """Groups of duplicates, going on with merged records until none are left."""
    return merging.clusters(_records(t))


@query("e4_survivors")
def survivors(t: Tables) -> DataFrame:
    """One merged record of each complete-link group."""
    records = _records(t)
    found = merging.merged(records, res.complete_link(records).withColumnRenamed("keeper", "cluster"))
    return found.select("id", "title", "description", "participants", "venue", "minute", "source", "members", F.array_join("links", " ").alias("links"))


@query("e7_arbitrated_union")
def union(t: Tables) -> DataFrame:
    records = graph.spread(_records(t))
    return merging.united(records, res.agreed(records, _arbiter(t)))


@query("e8_fallback")
def fallback(t: Tables) -> DataFrame:
    """The pairs that the fallback accepts where no arbiter speaks."""
    records = graph.spread(_records(t))
    return res.agreed(records).select("a", "b")


@query("e9_passes")
def passes(t: Tables) -> DataFrame:
    """All contours; ticket sources are safe."""
    return merging.resolved(_records(t).withColumn("safe", F.col("source") == "tickets"), _arbiter(t))


@query("e14_schedule", f"with {RECORDS} select id // 6 as cluster, strftime(d, '%Y-%m-%d') as day, min(minute) as minute, arg_max(venue, length(venue) * 10000000 - id) venue from r where d is not null group by all")
def schedule(t: Tables) -> DataFrame:
    records = _records(t)
    found = res.schedule(records, records.select("id", F.floor(F.col("id") / 6).alias("cluster")))
    return found.select("cluster", F.col("day").cast("string").alias("day"), "minute", "venue")


@query("e10_cooldown", "with recent as (select o_custkey k from orders where o_orderdate > timestamp '1998-06-01'), f as (select distinct k from recent union select distinct 1499 - k from recent where k % 4 = 0 union select distinct 1499 - k from recent where (1499 - k) % 4 = 0) select o_orderkey from orders where o_custkey not in (select k from f)")
def cooldown(t: Tables) -> DataFrame:
    """Delivered customers go, and so do those that a verdict calls the same as a delivered one (k and 1499 - k for every fourth k)."""
    history = t.orders.select(F.col("o_custkey").alias("key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("delivered_at"))
    verdicts = t.orders.select(F.col("o_custkey").alias("a")).distinct().select("a", (1499 - F.col("a")).alias("b"), F.when(F.col("a") % 4 == 0, "same").otherwise("different").alias("verdict"))
    # 1998-06-01 00:00 and a cooldown that begins then.
    return res.not_delivered(t.orders.withColumn("key", F.col("o_custkey")), history, 896659200 + 6 * 3600, verdicts=verdicts).select("o_orderkey")


@query("e12_canonical", "select p_name, p_brand, p_partkey from part qualify row_number() over (partition by lower(p_type), p_brand order by p_retailprice desc, p_size desc, p_partkey) = 1")
def canonical(t: Tables) -> DataFrame:
    from ..operators.activity import latest

    rows = t.part.withColumn("canon", F.lower("p_type"))
    return latest(rows, ["canon", "p_brand"], [F.desc("p_retailprice"), F.desc("p_size"), F.col("p_partkey")]).select("p_name", "p_brand", "p_partkey")


@query("e13_best_poster", f"""
with r as (select o_orderkey id, o_orderdate::date d, lower(p_name) a from orders join part on p_partkey = o_orderkey % (select count(*) from part)),
f as (select o_orderkey poster, o_orderdate::date d, lower(p_name) b from orders join part on p_partkey = (o_orderkey * 3 + 1) % (select count(*) from part)),
s as (select id, poster, {sql.text_similarity("a", "b")} score from r join f using (d))
select id, poster from s where score >= 0.6 qualify row_number() over (partition by id order by score desc, poster) = 1""")  # fmt: skip
def best_posters(t: Tables) -> DataFrame:
    n = F.broadcast(t.part.agg(F.count("*").alias("_n")))  # one row
    dated = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")).crossJoin(n)
    name = t.part.select("p_partkey", F.lower("p_name").alias("title"))
    events = dated.join(name, F.col("p_partkey") == F.col("o_orderkey") % F.col("_n")).select(F.col("o_orderkey").alias("id"), "day", "title")
    facts = dated.join(name, F.col("p_partkey") == (F.col("o_orderkey") * 3 + 1) % F.col("_n")).select(F.col("o_orderkey").alias("poster"), "day", "title")
    return res.best_poster(events, facts)


def _tokens(x: str) -> str:
    return rf"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-zа-я0-9$]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 and not regexp_matches(w, '^\d+$')))"


def _enough(hits: str, size: str) -> str:
    return f"({hits} >= 1 and ({size} <= 2 or {hits} >= 2 or {hits} >= 0.6 * {size}))"


@query("e13_poster_binding", f"""
with b as (
  select o_orderkey k, o_custkey // 10 source, o_orderdate::date d, day(o_orderdate) dd, month(o_orderdate) mm, least(day(o_orderdate) + 5, day(last_day(o_orderdate::date))) de, p.p_name own, q.p_name other, c_mktsegment people, p.p_brand venue
  from orders join part p on p.p_partkey = o_orderkey % (select count(*) from part) join part q on q.p_partkey = (o_orderkey * 3 + 1) % (select count(*) from part) join customer on c_custkey = o_custkey),
e as (select source, k id, format('{{:02d}}-{{:02d}}', mm, dd) as key, {_tokens("own")} tl, {_tokens("people")} pl, {_tokens("venue")} vl, case when k % 9 = 0 then k + 1 else 0 end preferred, count(*) over (partition by source) events from b),
f0 as (
  select source, k + 1 as idx, k % 11 <> 4 and k % 13 <> 5 and k % 17 <> 3 and k % 60 + 50 >= 55 good, k % 60 + 50 confidence, case when k % 7 <> 0 then k % 100 end readability,
    {_tokens("case when k % 3 = 0 then other else own end")} tl, case when k % 2 = 0 then {_tokens("people")} else [] end pl, case when k % 2 = 1 then lower(venue) else '' end venue, false main,
    case k % 4 when 3 then [] when 2 then list_concat(list_transform(range(dd, de + 1), lambda x: format('{{:02d}}-{{:02d}}', mm, x)), case when de <= 12 then [format('{{:02d}}-{{:02d}}', de, dd)] else [] end) else [format('{{:02d}}-{{:02d}}', mm, dd)] end keys,
    case when k % 4 = 3 then [(format('{{:02d}}-{{:02d}}', mm, dd), {_tokens("own")}), (format('{{:02d}}-{{:02d}}', mm, dd % 28 + 1), {_tokens("other")})] else [] end cal from b
  union all
  select source, k + 10000001, true, 60 + k % 5, 60, {_tokens("own")}, {_tokens("people")}, '', k % 25 = 0, [format('{{:02d}}-{{:02d}}', mm, dd)], [] from b where k % 5 = 0),
f as (select * from f0 where good),
plain as (
  select e.source, id, idx, main, preferred, confidence, coalesce(readability, 0) readability, len(e.tl) n, len(list_distinct(list_concat(e.tl, e.pl))) size,
    len(list_intersect(e.tl, list_concat(f.tl, f.pl))) titles, len(list_intersect(e.pl, list_concat(f.tl, f.pl))) people, len(list_intersect(list_distinct(list_concat(e.tl, e.pl)), list_concat(f.tl, f.pl))) known,
    len(list_filter(vl, lambda w: contains(f.venue, w))) venues, floor(confidence / 10 + 0.5) + floor(coalesce(readability, 65) / 20 + 0.5) quality
  from e join f on e.source = f.source and list_contains(f.keys, e.key)),
rows as (select source, id, unnest(cal) c, idx, main, confidence, coalesce(readability, 0) readability, e.key, tl, pl, preferred from (select source, idx, cal, main, confidence, readability from f) join (select source, id, key, tl, pl, preferred from e) e using (source)),
lined as (
  select source, id, idx, main, preferred, confidence, readability, len(tl) n, len(list_distinct(list_concat(tl, pl))) size, len(list_intersect(tl, c[2])) titles, len(list_intersect(list_distinct(list_concat(tl, pl)), c[2])) known from rows where c[1] = key),
accepted as (
  select source, id, idx, main, preferred, confidence, readability, titles, known,
    (case when {_enough("titles", "n")} then 170 when known >= 2 then 145 else 130 end + titles * 22 + people * 12 + venues * 2 + quality)::int score,
    case when {_enough("titles", "n")} then case when titles >= 2 then 'date+title-majority' else 'date+distinctive-title' end when known >= 2 then 'date+identity-tokens' else 'date+distinctive-identity' end reason
  from plain where {_enough("titles", "n")} or known >= 2 or (known = 1 and size <= 2)
  union all
  select source, id, idx, main, preferred, confidence, readability, titles, known, (220 + 22 * known)::int, 'calendar-date+program' from lined where {_enough("titles", "n")} or known >= 2 or (known = 1 and size <= 2)),
placed as (
  select *, preferred = idx chosen, row_number() over w place, lead(main) over w main2, lead(titles) over w titles2, lead(known) over w known2, lead(score) over w score2
  from accepted window w as (partition by source, id order by main desc, preferred = idx desc, score desc, confidence desc, readability desc, idx)),
best as (
  select source, id, arg_min(idx, place) idx, arg_min(reason, place) reason, arg_min(score, place) score,
    bool_or(place = 1 and score2 is not null and not ((main and not main2) or chosen or titles > titles2 or known > known2 or score - score2 >= 18)) doubtful,
    string_agg(idx || ':' || score, ',' order by place) filter (place <= 4) review
  from placed group by all)
select e.source, e.id, case when b.id is null or doubtful then 0 else idx end::bigint poster,
  case when b.id is null then 'no_safe_poster' when doubtful then 'poster_review_required' when events > 1 then 'verified_multi_event_poster' else 'verified_single_event_source_media' end status,
  case when b.id is null then 'no-safe-poster' when doubtful then 'multiple-date-compatible-posters' else b.reason end reason,
  case when b.id is null then 0 else score end::int score, case when doubtful then review end review
from e left join best b using (source, id)""")  # fmt: skip
def poster_binding(t: Tables) -> DataFrame:
    """Ten customers' orders are a post: each order an event and a picture (some none, some a calendar of two days), each fifth a second one."""
    n = F.broadcast(t.part.agg(F.count("*").alias("_n")))  # one row
    k, at = F.col("o_orderkey"), F.to_date("o_orderdate")
    own = t.part.select(F.col("p_partkey").alias("_own"), F.col("p_name").alias("own"), F.col("p_brand").alias("brand"))
    other = t.part.select(F.col("p_partkey").alias("_other"), F.col("p_name").alias("other"))
    base = t.orders.crossJoin(n).join(own, F.col("_own") == k % F.col("_n")).join(other, F.col("_other") == (k * 3 + 1) % F.col("_n")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    base = base.select(F.expr("o_custkey div 10").alias("source"), k.alias("k"), at.alias("day"), "own", "other", F.col("c_mktsegment").alias("people"), "brand")
    k, d, month = F.col("k"), F.dayofmonth("day"), F.date_format("day", "MMMM")
    events = base.select("source", k.alias("id"), "day", F.col("own").alias("title"), F.col("people").alias("participants"), F.col("brand").alias("venue"), F.when(k % 9 == 0, k + 1).otherwise(0).alias("preferred"))
    last = F.least(d + 5, F.dayofmonth(F.last_day("day")))
    dates = F.when(k % 4 == 0, F.date_format("day", "dd.MM.yyyy")).when(k % 4 == 1, F.concat_ws(" ", d, month)).when(k % 4 == 2, F.concat(d, F.lit("-"), last, F.lit(" "), month)).otherwise("")
    calendar = F.concat(F.lit("Афиша на "), month, F.lit("\n"), d, F.lit(" "), month, F.lit(" "), F.col("own"), F.lit("\n"), d % 28 + 1, F.lit(" "), month, F.lit(" "), F.col("other"))
    facts = base.select(
        "source", (k + 1).alias("index"), F.when(k % 13 != 5, k % 11 != 4).alias("poster"), F.when(k % 17 == 3, "photo").otherwise("poster").alias("image_type"),
        (k % 60 + 50).alias("confidence"), F.when(k % 7 != 0, k % 100).alias("readability"), F.when(k % 3 == 0, F.col("other")).otherwise(F.col("own")).alias("title"), dates.alias("dates"),
        F.when(k % 2 == 1, F.col("brand")).alias("venue"), F.when(k % 2 == 0, F.col("people")).alias("participants"), F.when(k % 4 == 3, calendar).alias("recognized"), F.lit(False).alias("main"), F.lit(False).alias("sole"),
    )
    again = base.where(k % 5 == 0).select(
        "source", (k + 10000001).alias("index"), F.lit(True).alias("poster"), F.lit("poster").alias("image_type"), (k % 5 + 60).alias("confidence"), F.lit(60).cast("long").alias("readability"), F.col("own").alias("title"),
        F.date_format("day", "dd.MM").alias("dates"), F.lit("").alias("venue"), F.col("people").alias("participants"), F.lit("").alias("recognized"), (k % 25 == 0).alias("main"), F.lit(False).alias("sole"),
    )
    bound = posters.bind_posters(events, facts.unionByName(again))
    shown = F.array_join(F.transform("review", lambda r: F.concat_ws(":", r["index"], r["score"])), ",")
    return bound.select("source", "id", F.col("poster").cast("long").alias("poster"), "status", "reason", "score", shown.alias("review"))
