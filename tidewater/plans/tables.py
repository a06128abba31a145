"""Queries on the star schema: filters, joins, aggregates, sorting, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import adhoc, filters
from ..operators import relations as rel
from ..sources.tables import Tables
from .registry import query


@query("f1_adhoc", "select o_orderkey, o_orderpriority, o_totalprice from orders where lower(o_orderpriority) like '%high%' and o_totalprice >= 100000 and o_orderstatus <> 'P' order by o_totalprice desc, o_orderkey limit 40 offset 20")
def ask(t: Tables) -> DataFrame:
    tests = [{"column": "o_orderpriority", "op": "contains", "value": "HIGH"}, {"column": "o_totalprice", "op": "gte", "value": 100000}, {"column": "o_orderstatus", "op": "ne", "value": "P"}]
    return adhoc.ask(t.orders, ["o_orderkey", "o_orderpriority", "o_totalprice"], tests, "o_totalprice", offset=20)


@query("f2_half_open_range", "select l_orderkey, l_linenumber from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-02-01' and l_quantity between 10 and 20 and l_returnflag in ('A', 'N')")
def half_open(t: Tables) -> DataFrame:
    date = F.col("l_shipdate")
    some = t.lineitem.where((date >= F.lit("1996-01-01").cast("timestamp_ntz")) & (date < F.lit("1996-02-01").cast("timestamp_ntz")) & F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "N"))
    return some.select("l_orderkey", "l_linenumber")


@query("f8_interval_overlap", "select o_orderkey from orders where o_orderdate <= timestamp '1997-03-31' and o_orderdate + interval (o_orderkey % 10) day >= timestamp '1997-03-01'")
def overlapping(t: Tables) -> DataFrame:
    end = F.expr("o_orderdate + make_dt_interval(o_orderkey % 10)")
    return t.orders.where((F.col("o_orderdate") <= F.lit("1997-03-31").cast("timestamp_ntz")) & (end >= F.lit("1997-03-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("f10_facets", "select p_partkey from part where (p_brand in ('Brand#1', 'Brand#2', 'Brand#3')) and list_has_all(string_split(lower(p_type), ' '), ['economy'])")
def facets(t: Tables) -> DataFrame:
    tags = F.split(F.lower("p_type"), " ")
    return t.part.where(filters.faceted(F.col("p_brand"), tags, ["west", "Brand#3"], ["economy"], {"west": ["Brand#1", "Brand#2"]})).select("p_partkey")


@query("f12_price_ceiling", "with p as (select item_id, case when item_id % 5 = 0 then 'free entry' when item_id % 5 = 1 then 'unknown' else 'from ' || item_id * 30 || ' to ' || item_id * 50 || ' units' end price from benchmark) select item_id, case when item_id % 5 = 0 then 0 else item_id * 30 end::bigint floor_price from p where item_id % 5 = 0 or (item_id % 5 > 1 and item_id * 30 <= 600)")
def ceiling(t: Tables) -> DataFrame:
    price = F.expr("case when item_id % 5 = 0 then 'free entry' when item_id % 5 = 1 then 'unknown' else concat('from ', item_id * 30, ' to ', item_id * 50, ' units') end")
    rows = t.benchmark.select("item_id", filters.price_floor(price).alias("floor_price"))
    return rows.where(filters.within_ceiling(F.col("floor_price"), 600))


@query("f13_admission", """
with s as (select o_orderkey, epoch(o_orderdate)::bigint * (o_orderkey % 11 > 0)::int seen, o_orderkey % 7 = 0 changed, o_orderkey % 5 = 0 future from orders), n as (select 896659200 now)
select o_orderkey, case when seen > 0 and seen < now - 183 * 86400 and not future then 'too-old' when changed then 'changed' when seen > 0 and seen >= now - 3 * 86400 then 'recent' when future then 'future-date' when seen = 0 then 'unknown-date' else 'stale' end reason from s, n
""")  # fmt: skip
def admission(t: Tables) -> DataFrame:
    seen = F.when(F.col("o_orderkey") % 11 > 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).otherwise(0)
    return t.orders.select("o_orderkey", filters.admission(seen, F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 5 == 0, F.lit(896659200), 3).alias("reason"))


@query("f14_weighted_rules", "select item_id, 100 * regexp_matches(text, '[0-9]')::int + 24 * contains(lower(text), 'the')::int + 12 * (length(text) > 200)::int score from benchmark")
def weighted(t: Tables) -> DataFrame:
    rules = {"date": (100, F.col("text").rlike("[0-9]")), "keyword": (24, F.contains(F.lower("text"), F.lit("the"))), "long": (12, F.length("text") > 200)}
    return t.benchmark.select("item_id", filters.weighted(rules)["score"].alias("score"))


@query("f18_due", "select c_custkey from customer where c_nationkey % 2 = 0 and c_acctbal > 0 and c_acctbal <= 2500 order by c_acctbal, c_custkey")
def due(t: Tables) -> DataFrame:
    return t.customer.where("c_nationkey % 2 = 0 and c_acctbal > 0 and c_acctbal <= 2500").orderBy("c_acctbal", "c_custkey").select("c_custkey")


@query("f20_image_sets", "select a.p_partkey a, b.p_partkey b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey ")
def image_sets(t: Tables) -> DataFrame:
    hashes = F.array_sort(F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    sets = t.part.select("p_partkey", hashes.alias("hashes"))
    a, b = sets.alias("a"), sets.alias("b")
    return a.join(b, (F.col("a.hashes") == F.col("b.hashes")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


@query("j1_inner_max", "select o_custkey, l_returnflag, o_orderstatus, max(l_shipdate) last from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by all")
def inner_max(t: Tables) -> DataFrame:
    joined = t.orders.where("o_orderstatus = 'F'").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey", "l_returnflag", "o_orderstatus").agg(F.max("l_shipdate").alias("last"))


@query("j4_unconsumed", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def unconsumed(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("j5_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1998-06-01')")
def semi(t: Tables) -> DataFrame:
    late = t.orders.where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    return t.customer.join(late, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j7_json_key", "select event_id, s_name, n_name from events join supplier on s_suppkey = json_extract_string(props, '$.k')::bigint join nation on n_nationkey = s_nationkey")
def json_key(t: Tables) -> DataFrame:
    keyed = t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("s_suppkey"))
    return keyed.join(t.supplier, "s_suppkey").join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("event_id", "s_name", "n_name")


@query("j9_scalar_aggregates", "select c_custkey, coalesce((select count(*) from orders where o_custkey = c_custkey), 0) orders, coalesce((select round(sum(o_totalprice), 2) from orders where o_custkey = c_custkey), 0) total from customer")
def scalars(t: Tables) -> DataFrame:
    sums = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("j11_name_fallback", "select o_orderkey, coalesce(c_name, s_name, 'Participant ' || o_custkey) who from orders left join (select * from customer where c_nationkey > 12) on c_custkey = o_custkey left join supplier on s_suppkey = o_custkey")
def fallback(t: Tables) -> DataFrame:
    cache = t.customer.where("c_nationkey > 12")
    joined = t.orders.join(cache, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("o_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_name", "s_name", F.concat(F.lit("Participant "), F.col("o_custkey").cast("string"))).alias("who"))


@query("j13_band_join", "with o as (select o_orderkey id, epoch(o_orderdate)::bigint // 86400 s, epoch(o_orderdate)::bigint // 86400 + o_orderkey % 3 e from orders) select x.id a, y.id b from o x join o y on x.id < y.id and x.s <= y.e + 2 and y.s <= x.e + 2")
def band(t: Tables) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), day.alias("s"), (day + F.col("o_orderkey") % 3).alias("e"))
    return rel.band_pairs(rows, "id", "s", "e", 2, 5)


@query("j20_outer_overlay", "with a as (select p_partkey k, p_name n, case when p_partkey % 2 = 0 then [p_brand] else [] end tags from part where p_partkey % 3 <> 0), b as (select p_partkey k, p_type n, case when p_partkey % 4 = 0 then [p_type] else [] end tags from part where p_partkey % 3 <> 1) select coalesce(a.k, b.k) k, coalesce(b.n, a.n) n, array_to_string(case when len(b.tags) > 0 then b.tags else coalesce(a.tags, b.tags) end, ',') tags from a full join b on a.k = b.k")
def outer_overlay(t: Tables) -> DataFrame:
    empty = F.array().cast("array<string>")
    a = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(empty).alias("tags"))
    b = t.part.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("n"), F.when(F.col("p_partkey") % 4 == 0, F.array("p_type")).otherwise(empty).alias("tags"))
    return rel.overlay(a, b, "k", ["tags"]).withColumn("tags", F.array_join("tags", ","))


@query("a5_usage", "select coalesce(l_returnflag, '?') flag, l_linestatus status, l_linenumber line, count(*) requests, round(sum(greatest(l_quantity, 0)), 2) qty, round(sum(l_extendedprice), 2) price, round(sum(case when l_discount > 0.05 then l_extendedprice else 0 end), 2) cut_price, count_if(l_tax = 0) untaxed from lineitem group by all")
def usage(t: Tables) -> DataFrame:
    key = [F.coalesce("l_returnflag", F.lit("?")).alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")]
    return t.lineitem.groupBy(*key).agg(
        F.count("*").alias("requests"),
        F.round(F.sum(F.greatest("l_quantity", F.lit(0.0))), 2).alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("cut_price"),
        F.count_if(F.col("l_tax") == 0).alias("untaxed"),
    ).orderBy(F.desc("price"), F.desc("requests"), "flag")


@query("a6_counts_across_files", "with u as (select 'o' f, o_custkey k, o_orderdate d from orders union all select 'l', l_suppkey, l_shipdate from lineitem) select k, count(*) n, min(d) first, max(d) last, count(distinct f) files from u group by all")
def across(t: Tables) -> DataFrame:
    both = t.orders.select(F.lit("o").alias("f"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d")).unionByName(t.lineitem.select(F.lit("l").alias("f"), F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("d")))
    return both.groupBy("k").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.countDistinct("f").alias("files"))


@query("a8_status_counts", "select o_orderstatus, count(*) n from orders group by all")
def statuses(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a10_conditional_counts", "select o_custkey, count_if(o_orderstatus = 'F') good, count_if(o_orderstatus <> 'F') bad from orders group by all")
def conditional(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count_if(F.col("o_orderstatus") != "F").alias("bad"))


@query("a15_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
def distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("a17_next_number", "select c_custkey, coalesce(max(o_orderkey), 0) + 1 next from customer left join orders on o_custkey = c_custkey group by all")
def next_number(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next"))


@query("w3_renumber", "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::int place from part")
def renumber(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))


@query("w4_best_of_group", "select p_brand, p_partkey, row_number() over (partition by p_brand, p_size order by p_retailprice desc, p_partkey) = 1 enabled from part")
def best_of_group(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.select("p_brand", "p_partkey", (place == 1).alias("enabled"))


@query("o2_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderdate desc, o_orderkey desc limit 5")
def top_k(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", "o_totalprice")


@query("o3_page", "select c_custkey from customer order by c_acctbal desc, c_custkey limit 21 offset 40")
def page(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(21).select("c_custkey")


@query("o6_seeded_reservoir", """
with s as (select *, row_number() over (partition by o_orderstatus order by sha256(o_orderkey || ':17'), o_orderkey) draw from orders),
a as (select *, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey) age, count(*) over (partition by o_orderstatus) n from s where draw <= 80),
t as (select *, min(case when age <= floor(n * 0.2) then o_orderdate end) over (partition by o_orderstatus) first from a)
select o_orderkey, o_orderstatus, case when age <= floor(n * 0.2) then 'test' when epoch(first) - epoch(o_orderdate) < 300 then 'embargo' else 'train' end part from t""")  # fmt: skip
def reservoir(t: Tables) -> DataFrame:
    """80 orders of each status by a seeded draw; the newest fifth is held out, 300 s of embargo before it."""
    return filters.reservoir(t.orders, "o_orderstatus", "o_orderkey", "o_orderdate", 80).select("o_orderkey", "o_orderstatus", "part")


@query("u2_union_distinct", "select o_custkey k from orders union select c_custkey from customer")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()


@query("d14_expand_range", "with r as (select o_orderkey, o_orderdate::date s, o_orderdate::date + (o_orderkey % 20)::int e from orders) select o_orderkey, strftime(unnest(case when e - s > 14 then [s, e] else generate_series(s, e, interval 1 day)::date[] end), '%Y-%m-%d') as day from r")
def expand(t: Tables) -> DataFrame:
    from ..functions.time import expand_range

    start = F.to_date("o_orderdate")
    days = t.orders.select("o_orderkey", F.explode(expand_range(start, F.date_add(start, (F.col("o_orderkey") % 20).cast("int")))).alias("day"))
    return days.withColumn("day", F.col("day").cast("string"))


@query("d7_missing_year", "with r as (select o_orderkey, o_orderdate::date ref, make_date(year(o_orderdate), 1 + (o_orderkey % 12)::int, 1 + (o_orderkey % 28)::int) d from orders) select o_orderkey, strftime(case when ref - d > 183 then make_date(year(d) + 1, month(d), day(d)) else d end, '%Y-%m-%d') as day from r")
def missing_year(t: Tables) -> DataFrame:
    from ..functions.time import infer_year

    day = infer_year((1 + F.col("o_orderkey") % 12).cast("int"), (1 + F.col("o_orderkey") % 28).cast("int"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", day.cast("string").alias("day"))


@query("d4_month_arithmetic", "select o_orderkey, strftime(o_orderdate::date + interval 1 month, '%Y-%m-%d') next, strftime(last_day(o_orderdate), '%Y-%m-%d') last, (isodow(o_orderdate) - 1)::int weekday from orders")
def months(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.add_months(day, 1).cast("string").alias("next"), F.last_day(day).cast("string").alias("last"), F.weekday(day).alias("weekday"))
