"""Queries on small predicates, samples, audits, terms, tags, nested records, and sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph
from ..operators import records as rec
from ..operators import relations as rel
from ..sources import files, html
from ..sources.tables import Tables
from . import sqltext as sql
from .registry import query


def _folder(t: Tables, name: str) -> str:
    """A new folder among those that driver and executors share."""
    return f"{graph.shared(t.spark)}/tidewater/{name}-{uuid.uuid4().hex}"


@query("f3_optional", "select event_id from events where event_type = 'click' and user_id = 8")
def optional(t: Tables) -> DataFrame:
    return t.events.where(rec.optional(F.col("event_type"), "click") & rec.optional(F.col("user_id"), 8) & rec.optional(F.col("event_id"), 0)).select("event_id")


@query("f5_blank", "select o_orderkey from orders where nullif(case o_orderstatus when 'P' then '' when 'F' then null else o_orderstatus end, '') is null")
def blank(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return t.orders.where(rec.blank(kind)).select("o_orderkey")


@query("f16_pools", "select c_custkey, case when c_custkey % 17 = 0 then 'secondary' when c_custkey % 3 > 0 then case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'secondary' else 'primary' end when c_custkey % 5 = 0 or c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey % 2 = 0 then 'secondary' else 'primary' end pool from customer")
def pools(t: Tables) -> DataFrame:
    key, kind = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.when(key % 2 == 0, F.concat(F.lit("from "), kind, F.lit(" source")))
    found = rec.pool(F.when(key % 3 > 0, F.lower(kind)), F.when(key % 5 == 0, "secondary"), text, key % 17 == 0, ["building", "machinery"])
    return t.customer.select("c_custkey", found.alias("pool"))


@query("f19_active", "select c_custkey from customer where c_nationkey % 2 = 1 and (c_custkey % 4 = 0 or c_acctbal > 5000)")
def active(t: Tables) -> DataFrame:
    ends = F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_acctbal"))
    return t.customer.where(rec.active(F.col("c_nationkey") % 2, ends, F.lit(5000))).select("c_custkey")


@query("n1_numbers", "select event_id, case event_id % 4 when 0 then greatest(10, least(60, case when value = 0 then 10 else trunc(value) end)) else 10 end::bigint clamped, round(case event_id % 4 when 0 then greatest(value, 0) else 0 end, 6) safe from events")
def numbers(t: Tables) -> DataFrame:
    """Numbers as texts, of which three in four are none."""
    raw = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "many").when(F.col("event_id") % 4 == 2, "")
    return t.events.select("event_id", rec.clamped(raw, 10, 60).alias("clamped"), F.round(rec.safe_count(raw), 6).alias("safe"))


@query("n3_alternative_names", "select event_id, case when event_id % 5 = 4 then 0 else json_extract_string(props, '$.k')::double end tokens from events")
def alternatives(t: Tables) -> DataFrame:
    """One number under any of four names, one of them nested; the fifth kind has a negative one."""
    names = ["prompt_tokens", "input_tokens", "details.cached_tokens", "promptTokenCount"]
    value = F.get_json_object("props", "$.k")
    record = F.when(F.col("event_id") % 5 == 4, '{"prompt_tokens": -3, "other": 7}')
    for i, name in enumerate(names):
        inner = F.concat(F.lit(f'{{"{name.split(".")[-1]}": '), value, F.lit("}"))
        record = F.when(F.col("event_id") % 5 == i, F.concat(F.lit('{"details": '), inner, F.lit("}")) if "." in name else inner).otherwise(record)
    return t.events.select("event_id", rec.first_number(record, names).alias("tokens"))


@query("j17_neighbours", "select event_id, user_id from events where event_id between 460 and 540 order by event_id limit 85")
def neighbours(t: Tables) -> DataFrame:
    return rec.near(t.events, "event_id", 500, 40).select("event_id", "user_id")


@query("j21_checkpoint_overlay", "with a as (select p_partkey k, p_name n, p_brand cache from part where p_partkey % 3 <> 0), b as (select p_partkey k, p_type n, case when p_partkey % 2 = 0 then '' else p_type end cache from part where p_partkey % 3 <> 1) select coalesce(a.k, b.k) k, coalesce(b.n, a.n) n, coalesce(nullif(b.cache, ''), a.cache, b.cache) cache from a full join b on a.k = b.k")
def checkpoint_overlay(t: Tables) -> DataFrame:
    a = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_brand").alias("cache"))
    b = t.part.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("n"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")).alias("cache"))
    return rel.overlay(a, b, "k", [], keep=["cache"])


@query("o8_priority", "select o_orderkey, 6 - substr(o_orderpriority, 1, 1)::int priority from orders order by priority desc, o_orderkey")
def priority(t: Tables) -> DataFrame:
    return rec.by_priority(t.orders.select("o_orderkey", (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority")), "priority", "o_orderkey")


@query("o9_retention", "select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 15)")
def retention(t: Tables) -> DataFrame:
    return rec.outlived(t.orders, "o_orderkey", "o_orderdate").select("o_orderkey")


@query("o10_reservoirs", "select o_orderkey, o_orderstatus, count(*) over (partition by o_orderstatus) seen from orders qualify row_number() over (partition by o_orderstatus order by sha256(o_orderkey || ':17'), o_orderkey) <= case o_orderstatus when 'F' then 400 when 'O' then 10 else 80 end")
def reservoirs(t: Tables) -> DataFrame:
    return rec.reservoirs(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", {"F": 400, "O": 10, "P": 80})


_CARDS = "c as (select l_orderkey id, list_distinct(list(l_partkey)) images, coalesce(list_distinct(list(l_partkey) filter (where l_tax > 0.02)), []) described, case when max(l_discount) > 0.08 then 'low-score' when max(l_discount) > 0.06 then 'no-text' end reason from lineitem group by all), v as (select *, len(images) n, len(list_filter(images, lambda x: not list_contains(described, x))) bare from c)"


def _cards(t: Tables) -> DataFrame:
    reason = F.when(F.max("l_discount") > 0.08, "low-score").when(F.max("l_discount") > 0.06, "no-text")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("images"), F.collect_set(F.when(F.col("l_tax") > 0.02, F.col("l_partkey"))).alias("described"), reason.alias("reason"))


@query("a13_quality_counts", f"with {_CARDS} select count(*) cards, count_if(n > 0) with_images, count_if(reason is null) safe, count_if(reason is not null) unverified, count_if(bare > 0) missing_metadata, sum(n)::bigint images, sum(bare)::bigint bare_images, greatest(0, count_if(bare > 0 or reason is not null) - 500)::bigint issues_cut from v")
def quality_counts(t: Tables) -> DataFrame:
    return rec.audit(_cards(t))[0]


@query("a13_quality_reasons", f"with {_CARDS} select reason, count(*) cards from v where reason is not null group by all")
def quality_reasons(t: Tables) -> DataFrame:
    return rec.audit(_cards(t))[1]


@query("a13_quality_issues", f"with {_CARDS} select id, n::int images, bare::int bare, coalesce(reason, 'verified') status from v where bare > 0 or reason is not null order by id limit 500")
def quality_issues(t: Tables) -> DataFrame:
    return rec.audit(_cards(t))[2]


@query("x3_title_tokens", f"select p_partkey, array_to_string(list_sort(list_filter({sql.words('p_name', 4)}, lambda w: w not in ('small', 'ring', 'bolt'))), ' ') tokens from part")
def title_tokens(t: Tables) -> DataFrame:
    found = rec.title_tokens(F.col("p_name"), ["Small"], ["ring", "bolt"])
    return t.part.select("p_partkey", F.array_join(F.array_sort(found), " ").alias("tokens"))


LETTERS, READ = "abcdefghijklmnopqrstuvwxyz", "абцдёфгхийжлмнощчрстуюьшыэ"
LATIN_SQL = f"translate(translate(lower(text), '{LETTERS}', '{READ}'), 'абвгдеёзийклмнопрстуфыэ', 'abvgdeezijklmnoprstufye')"
for _a, _b in (("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ь", ""), ("ю", "yu")):
    LATIN_SQL = f"replace({LATIN_SQL}, '{_a}', '{_b}')"


@query("x5_transliteration", f"select conv_id, turn, {LATIN_SQL} latin from conversations")
def transliteration(t: Tables) -> DataFrame:
    """Every turn, with its letters read as Cyrillic ones, and then as Latin ones again."""
    return t.conversations.select("conv_id", "turn", tx.translit(F.translate(F.lower("text"), LETTERS, READ)).alias("latin"))


@query("x19_word_with_endings", r"select conv_id, turn from conversations where regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])the(?:а|я|у|ю|е|и|ы|ой|ом|ем|ов|ев|ам|ям|ами|ями|ах|ях)?(?:$|[^\p{L}\p{N}_])') or regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])tion')")
def endings(t: Tables) -> DataFrame:
    return t.conversations.where(rec.names_term(F.col("text"), "the") | rec.names_term(F.col("text"), "tion", prefix=True)).select("conv_id", "turn")


_PLACES = {"hall": ["Red Hall", "big ring"], "club": ["small club", "bolt"], "bar": ["widget bar"]}


@query("x24_venue_keys", "select p_partkey, case when contains(p_name, 'bolt') then 'club' when contains(p_name, 'ring') then 'hall' when regexp_matches(p_name, '(^| )small( |$)') then 'club' when regexp_matches(p_name, '(^| )widget( |$)') then 'bar' else '' end venue from part where p_name not like '%big ring%' and p_name not like '%bigring%'")
def venue_keys(t: Tables) -> DataFrame:
    """Venues by alias (bolt), else by a shared word of four letters (ring, small, widget)."""
    rows = t.part.where(~F.contains("p_name", F.lit("big ring")) & ~F.contains("p_name", F.lit("bigring")))
    return rows.select("p_partkey", rec.venue_key(F.col("p_name"), _PLACES).alias("venue"))


@query("r6_tags", "select p_partkey, array_to_string(list_filter(['metal', 'round', 'tint'], lambda x: case x when 'metal' then contains(p_name, 'bolt') or contains(p_name, 'rod') when 'round' then contains(p_name, 'ring') or contains(p_name, 'bluering') else contains(p_name, 'red') or contains(p_name, 'blue') end), ',') tags from part")
def tagged(t: Tables) -> DataFrame:
    taxonomy = {"metal": ["bolt", "rod"], "round": ["ring"], "tint": ["red", "blue"]}
    return t.part.select("p_partkey", F.array_join(rec.tags(F.col("p_name"), taxonomy), ",").alias("tags"))


@query("r5_metadata", """
select o_orderkey k, strftime(o_orderdate, '%Y-%m-%d') as days, case when o_orderkey % 3 = 0 then '19:30' when o_orderkey % 3 = 1 then '09:05' end as time, case when o_orderkey % 4 = 0 then 0 when o_orderkey % 4 = 1 then 200 + o_orderkey % 50 end::bigint price,
  case when o_orderkey % 5 = 0 then 18 when o_orderkey % 5 = 1 then 6 end::int age, case when o_orderkey % 2 = 0 then 'https://t.example/' || o_orderkey else '' end links, case when o_orderkey % 7 = 0 then 'hall' else '' end venue from orders""")  # fmt: skip
def metadata(t: Tables) -> DataFrame:
    """What announcements made of orders say, beside numbers that mean something else."""
    key = F.col("o_orderkey")
    word = key.cast("string")
    parts = [
        F.when(key % 7 == 0, "Red  Hall,").otherwise("Elsewhere,"),
        F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.when(key % 3 == 0, "at 19:30").when(key % 3 == 1, "at 9:05").otherwise("at 19:300"),
        F.when(key % 4 == 0, "Бесплатно").when(key % 4 == 1, F.concat(F.lit("900 руб or "), (200 + key % 50).cast("string"), F.lit("₽"))).otherwise("50 seats"),
        F.when(key % 5 == 0, "18+").when(key % 5 == 1, "from 6 +").otherwise("7+ or +18"),
        F.when(key % 2 == 0, F.concat(F.lit("(https://t.example/"), word, F.lit(")"))).otherwise("https:/no"),
    ]
    found = rec.metadata(F.concat_ws(" ", *parts), F.to_date("o_orderdate"), {"hall": ["Red Hall"]})
    rows = t.orders.select(key.alias("k"), found.alias("m"))
    return rows.select("k", F.array_join(F.transform("m.days", lambda d: d.cast("string")), ",").alias("days"), "m.time", "m.price", "m.age", F.array_join("m.links", ",").alias("links"), "m.venue")


@query("t3_expanded_search", "select conv_id, turn from conversations where regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:then|tion|what then about tion)(?:а|я|у|ю|е|и|ы|ой|ом|ем|ов|ев|ам|ям|ами|ями|ах|ях)?(?:$|[^\\p{L}\\p{N}_])')")
def expanded_search(t: Tables) -> DataFrame:
    """Rows that hold any term of a question."""
    terms = rec.expanded("what then about tion", {"what", "about"})
    hit = F.lit(False)
    for term in terms:
        hit = hit | rec.names_term(F.col("text"), term)
    return t.conversations.where(hit).select("conv_id", "turn")


@query("r2_references", "select event_id, case when event_id % 4 = 3 then '' when event_id = 0 then array_to_string(list_sort([2, 3]), ',') else array_to_string(list_sort(list_distinct([event_id, event_id + 1, event_id + 2, event_id + 3])), ',') end ids from events")
def references(t: Tables) -> DataFrame:
    """Ids at three depths, among look-alikes; one record in four is cut off."""
    i = F.col("event_id").cast("string")
    n = lambda k: (F.col("event_id") + k).cast("string")
    record = F.concat(F.lit('{"text": "cmid: 99", "cmid": '), i, F.lit(', "a": [{"sourceCmid": "'), F.when(F.col("event_id") == 0, "0").otherwise(n(1)), F.lit('"}, {"b": {"cmids": ['), n(2), F.lit(", -4, true], "), F.lit('"conversation_message_id": '), n(3), F.lit("}}]"), F.when(F.col("event_id") % 4 == 3, "").otherwise("}"))
    return t.events.select("event_id", F.array_join(rec.references(record), ",").alias("ids"))


@query("r3_photos", "select event_id, case when event_id % 6 = 5 then 'mismatched-original' else 'ok' end integrity, case when event_id % 6 in (4, 5) then '' when event_id % 2 = 0 then 'b' || event_id else 'a' || event_id end urls from events")
def photos(t: Tables) -> DataFrame:
    """The larger of two sizes; a document beside it, an empty list, another sender."""
    i, key = F.col("event_id").cast("string"), F.col("event_id")
    wide = F.when(key % 2 == 0, "300").otherwise("20")
    photo = F.concat(F.lit('{"type": "photo", "photo": {"id": 1, "sizes": [{"url": "", "width": 900, "height": 900}, {"url": "a'), i, F.lit('", "width": 100, "height": 50}, {"url": "b'), i, F.lit('", "width": '), wide, F.lit(', "height": 60}]}}'))
    record = F.concat(F.lit('{"from_id": '), F.when(key % 6 == 5, "99999999").otherwise(F.col("user_id").cast("string")), F.lit(', "attachments": [{"type": "doc"}'), F.when(key % 6 == 4, "").otherwise(F.concat(F.lit(", "), photo)), F.lit("]}"))
    found = rec.photos(record, F.greatest("user_id", F.lit(1)), key)
    rows = t.events.withColumn("user_id", F.greatest("user_id", F.lit(1)))
    return rows.select("event_id", found["integrity"].alias("integrity"), F.array_join(F.transform(found["photos"], lambda p: p["url"]), ",").alias("urls"))


# -- sources and sinks


@query("s3_keyset_page", "select o_orderkey from orders where o_orderkey > 299 order by o_orderkey limit 100")
def keyset(t: Tables) -> DataFrame:
    return rec.after(t.orders.select("o_orderkey"), "o_orderkey", 299, 100)


@query("s5_files")
def discovered(t: Tables) -> DataFrame:
    """All table files below the folder."""
    return files.discovered(t.spark, t.folder, "*.parquet").select("name", "bytes")


@query("s6_json_lines", "select o_orderkey id, o_orderpriority text, o_orderkey % 9 = 4 bad from orders")
def json_lines(t: Tables) -> DataFrame:
    """Orders written as lines, of which every ninth is broken, and read back."""
    folder = _folder(t, "lines")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text")))
    t.orders.select(F.when(F.col("o_orderkey") % 9 == 4, F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_orderpriority"), F.lit("{"))).otherwise(line)).write.text(folder)
    rows = files.read_jsonl(t.spark, folder, "id long, text string")
    raw = F.col("_corrupt_record")
    return rows.select(F.coalesce("id", F.split_part(raw, F.lit("|"), F.lit(1)).try_cast("long")).alias("id"), F.coalesce("text", F.rtrim(F.split_part(raw, F.lit("|"), F.lit(2)), F.lit("{"))).alias("text"), raw.isNotNull().alias("bad"))


@query("s9_channel_posts", "select conv_id page_id, turn + 1 message_id, 1700000000 + turn published_at, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations where regexp_matches(text, '^[A-Za-z0-9 .,]*$')")
def channel_posts(t: Tables) -> DataFrame:
    """Conversations set as channel pages, a turn a post, beside a post of another channel, and read again."""
    n = F.col("turn")
    stamp = F.date_format(F.timestamp_seconds(1700000000 + n), "yyyy-MM-dd'T'HH:mm:ss+00:00")
    post = F.concat(F.lit('<div class="tgme_widget_message" data-post="Chan/'), (n + 1).cast("string"), F.lit('"><div class="tgme_widget_message_text">'), F.col("text"), F.lit('</div><time>0:10</time><time datetime="'), stamp, F.lit('"></time></div>'))
    pages = t.conversations.where(F.col("text").rlike("^[A-Za-z0-9 .,]*$")).groupBy(F.col("conv_id").alias("page_id")).agg(F.concat_ws("", F.array_sort(F.collect_list(post)), F.lit('<div class="tgme_widget_message" data-post="other/5"><div class="tgme_widget_message_text">no</div></div>')).alias("html"))
    return html.channel_posts(pages, "chan").select("page_id", "message_id", "published_at", "text")


@query("s13_catalog", "select table_name as \"table\", column_name as \"column\" from information_schema.columns where table_name in ('nation', 'orders', 'region')")
def catalog(t: Tables) -> DataFrame:
    return files.catalog({name: getattr(t, name) for name in ("region", "nation", "orders")}).select("table", "column")


@query("s14_salvage", "select count_if(o_orderkey % 13 <> 5) good, count_if(o_orderkey % 13 = 5) bad, min(case when o_orderkey % 13 = 5 then o_orderkey end) first_bad from orders")
def salvage(t: Tables) -> DataFrame:
    """What is whole of a damaged copy, and where the damage begins."""
    line = F.when(F.col("o_orderkey") % 13 == 5, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"))))
    return files.salvage(t.orders.select(F.col("o_orderkey").alias("place"), line.alias("value")), "id long")[1]


@query("k5_two_tables", "select 'order' kind, count(*) n from orders union all select 'line', count(*) from lineitem")
def two_tables(t: Tables) -> DataFrame:
    """Two tables of one commit: both are seen, or none, as the commit's mark is written last; a second attempt changes nothing."""
    folder = _folder(t, "commit")
    rows = {"order": t.orders.select("o_orderkey"), "line": t.lineitem.select("l_orderkey", "l_linenumber")}
    for _ in range(2):
        files.commit(t.spark, folder, "1", rows)
    seen = [files.committed(t.spark, folder, name).agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name in rows]
    return seen[0].unionByName(seen[1])


@query("k6_append_lines", "select o_orderstatus, 2 * count(*) n from orders group by all")
def append_lines(t: Tables) -> DataFrame:
    folder = _folder(t, "journal")
    for _ in range(2):
        files.append_jsonl(t.orders.select("o_orderstatus"), folder)
    return files.read_jsonl(t.spark, folder, "o_orderstatus string").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("k7_snapshot", "select o_orderstatus, count(*) n from orders group by all")
def snapshot(t: Tables) -> DataFrame:
    """A copy in a folder of its own, unchanged by what is written to the table's next one."""
    folder = _folder(t, "snapshots")
    first = files.snapshot(t.orders, folder, "v1")
    files.snapshot(t.orders.limit(1), folder, "v2")
    return first.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("k8_calendar_texts", "select o_orderkey, case when o_orderkey % 2 = 0 then 'DTSTART:' || strftime(o_orderdate, '%Y%m%d') || 'T193000' else 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') end start_line, 'SUMMARY:' || replace(o_orderpriority, ',', '\\,') title_line from orders")
def calendar_texts(t: Tables) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 2 == 0, "19:30").otherwise("")
    ics = files.calendar(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.to_date("o_orderdate"), at, F.lit("Hall"))
    lines = F.split(ics, "\r\n")
    pick = lambda start: F.element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(start))), 1)
    return t.orders.select("o_orderkey", pick("DTSTART").alias("start_line"), pick("SUMMARY").alias("title_line"))
