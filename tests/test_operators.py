"""Small literal cases."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewater.functions import text as tx
from tidewater.functions import time
from tidewater.operators import activity, adhoc, filters, relations, resolution, rollup, search
from tidewater.sources import files, html
from tidewater.streaming import revisions


def test_activity_window_and_reactions(spark):
    live = spark.createDataFrame([(1, 10, 100), (2, 10, 101), (3, 20, 102), (4, 20, 99), (5, 20, 200)], "cmid long, sender_id long, created_at long")
    archive = live.where("cmid = 1")
    messages = activity.reconciled(archive, live, ["cmid", "sender_id"])
    top = activity.top_senders(messages, 100, 200)
    assert [tuple(r) for r in top.collect()] == [(10, 2), (20, 1)]
    kind = "cmid long, counters array<struct<reaction_id:int,count:int,user_ids:array<bigint>>>"
    counters = spark.createDataFrame([(1, [(1, 2, [20, 30])]), (2, []), (3, [])], kind)
    inside = messages.where("created_at >= 100 and created_at < 200")
    got = {r["sender_id"]: r for r in activity.reactions(inside, counters, top).collect()}
    assert (got[10]["received"], got[10]["received_known"], got[20]["given"], got[20]["given_known"]) == (2, True, 1, True)


def test_missing_reactions_are_not_zero(spark):
    messages = spark.createDataFrame([(1, 10), (2, 10)], "cmid long, sender_id long")
    counters = spark.createDataFrame([(1, [(1, 3, [20])])], "cmid long, counters array<struct<reaction_id:int,count:int,user_ids:array<bigint>>>")
    tracked = spark.createDataFrame([(10, 2)], "sender_id long, messages long")
    row = activity.reactions(messages, counters, tracked).withColumn("shown", activity.shown("received", "received_known")).first()
    assert not row["received_known"] and not row["given_known"] and row["shown"] == "≥3"


def test_adhoc_rejects_unknown_names(spark):
    rows = spark.createDataFrame([(i, f"Name {i}") for i in range(50)], "id long, name string")
    assert [r[0] for r in adhoc.ask(rows, ["id"], [{"column": "name", "op": "contains", "value": "NAME 4"}], "id", limit=3).collect()] == [49, 48, 47]
    with pytest.raises(adhoc.QueryError):
        adhoc.ask(rows, ["id; drop table x"])
    with pytest.raises(adhoc.QueryError):
        adhoc.ask(rows, ["id"], [{"column": "id", "op": "like", "value": 1}])


def test_folded_search_is_literal(spark):
    rows = spark.createDataFrame([("100% Ёлка",), ("1000 елок",)], "t string").select(tx.fold(tx.nfkc("t")).alias("t"))
    assert rows.where(adhoc.matches(F.col("t"), ["0%"])).count() == 1
    assert rows.where(adhoc.matches(F.col("t"), ["ЁЛ"])).count() == 2
    assert rows.where(adhoc.matches(F.col("t"), ["x"])).count() == 0


def test_islands_and_chains(spark):
    spans = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 8, 9), (2, 1, 10), (2, 2, 3)], "k long, s long, e long")
    assert sorted(map(tuple, relations.islands(spans, ["k"], "s", "e").collect())) == [(1, 1, 6), (1, 8, 9), (2, 1, 10)]
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], "id long, parent long")
    got = {r["id"]: (r["root"], r["hops"], r["complete"]) for r in relations.chain_roots(links, 64).collect()}
    assert got[1] == (1, 0, True) and got[3] == (1, 2, True) and not got[4][2] and not got[5][2]


def test_upserts(spark):
    a = spark.createDataFrame([(1, 5, ""), (2, 9, "x")], "k long, at long, v string")
    b = spark.createDataFrame([(1, 5, "new"), (2, 8, "old"), (3, 1, "z")], "k long, at long, v string")
    assert sorted(map(tuple, relations.upsert_newest(a, b, ["k"], "at").collect())) == [(1, 5, "new"), (2, 9, "x"), (3, 1, "z")]
    merged = relations.upsert_monotone(a, b, ["k"], [], ["at"], ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, 5, "new"), (2, 9, "x"), (3, 1, "z")]


def test_complete_link_is_not_transitive(spark):
    kind = "id long, day string, tokens array<string>, source string, richness double"
    rows = spark.createDataFrame([(1, "d", ["a", "b"], "other", 1.0), (2, "d", ["b", "c"], "tickets", 0.0), (3, "d", ["c", "d"], "primary", 5.0), (4, None, ["a"], "other", 1.0), (5, "e", ["a"], "other", 1.0)], kind)
    got = dict(map(tuple, resolution.complete_link(rows).collect()))
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}


def test_ranked_memory(spark):
    rows = spark.createDataFrame([(1, "blue whale song", 1), (2, "blue bird", 2), (3, "nothing here", 3)], "id long, text string, created_at long")
    got = search.rank(rows, "blue whale").collect()
    # Words 6 + 6 / (1 + log2 2) = 9, the phrase 8, full coverage 8.
    assert [(r["id"], r["score"]) for r in got] == [(1, 25.0)]


def test_similarities(spark):
    pairs = spark.createDataFrame([("martha", "marhta"), ("abc", "abc"), ("aaaa", "aaab")], "a string, b string")
    got = pairs.select("a", tx.jaro_winkler("a", "b").alias("jw"), tx.multiset_dice("a", "b").alias("d")).collect()
    assert round(got[0]["jw"], 4) == 0.9611 and got[1]["jw"] == 1.0 and got[2]["d"] == 0.5


def test_slots_and_closing(spark):
    rows = spark.range(1).select(time.slot(F.lit(1349)).alias("a"), time.slot(F.lit(1439)).alias("b"), time.slot(F.lit(0)).alias("c"), time.slot_closed(F.lit("2024-01-01"), F.lit("23:59"), F.lit("2024-01-01 23:59:00").cast("timestamp")).alias("d"))
    assert tuple(rows.first()) == ("22:30", "23:59", "03:00", True)


def test_admission(spark):
    day = 86400
    row = spark.range(1).select(
        filters.admission(F.lit(1), F.lit(False), F.lit(False), F.lit(200 * day), 3).alias("a"),
        filters.admission(F.lit(0), F.lit(False), F.lit(False), F.lit(200 * day), 3).alias("b"),
        filters.admission(F.lit(196 * day), F.lit(False), F.lit(False), F.lit(200 * day), 9).alias("c"),
        filters.admission(F.lit(100 * day), F.lit(False), F.lit(False), F.lit(200 * day), 0).alias("d"),
    ).first()
    assert tuple(row) == ("too-old", "unknown-date", "stale", "window-disabled")


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n\n{broken\n')
    got = files.read_jsonl(spark, str(tmp_path), StructType([StructField("id", LongType()), StructField("text", StringType())])).collect()
    assert sorted((r["id"] or 0, r["_corrupt_record"]) for r in got) == [(0, "{broken"), (1, None)]


def test_calendar_folds_lines(spark):
    row = spark.range(1).select(files.calendar(F.lit("7"), F.lit("ж" * 60 + "; a"), F.lit("2024-05-01"), F.lit(""), F.lit("Hall, 1")).alias("ics")).first()
    assert max(len(line.encode()) for line in row["ics"].split("\r\n")) <= 74
    assert "DTSTART;VALUE=DATE:20240501" in row["ics"] and "LOCATION:Hall\\, 1" in row["ics"] and "\\;" in row["ics"].replace("\r\n ", "")


def test_pages(spark):
    rows = spark.createDataFrame([(1, "<title>A&amp;B</title><h1>H</h1><p>one<script>x</script><a href='/q'>two</a>"), (2, None)], "page_id long, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in html.pages(rows).collect()}
    assert got == {1: ("A&B", "H", 1, "onetwo"), 2: ("", "", 0, "")}


def test_late_data_make_revisions_in_batch_and_stream(spark, tmp_path):
    def make(rows):
        return rows.groupBy("k").agg(F.sum("v").alias("v"))

    batches = [[("a", 1), ("b", 2)], [("a", 5)], [("a", 5)], [("c", 1)]]
    kind, known = "k string, v long", None
    for rows in batches:
        known = rollup.revise(known, make(spark.createDataFrame(rows, kind)), ["k"], ["v"])
    want = sorted((r["k"], r["revision"], r["v"]) for r in known.collect())
    assert want == [("a", 1, 1), ("a", 2, 5), ("b", 1, 2), ("c", 1, 1)]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(source))
        revisions.run_ledger(stream, f"{tmp_path}/ledger", f"{tmp_path}/state", make, ["k"], ["v"]).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/ledger")
    assert sorted((r["k"], r["revision"], r["v"]) for r in got.collect()) == want
