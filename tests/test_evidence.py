"""Operators on periods, venues, cities, times of day and revisions, by hand-made cases."""

from pyspark.sql import functions as F

from tidewater.operators import evidence as ev


def test_period_sources(spark):
    kind = "id long, day_key string, start_at long, end_at long"
    daily = spark.createDataFrame([(1, "a", 10, 20), (2, "b", 10, 31), (3, None, 12, 15), (4, "c", 15, 15), (5, "d", None, None)], kind)
    batches = spark.createDataFrame([(6, "a", 5, 15), (7, "b", 5, 15), (8, None, 12, 13), (9, "c", 30, 40), (10, "c", 29, 40), (10, "c", 29, 40)], kind)
    rows = lambda x: sorted((r["id"], r["level"]) for r in x.collect())
    assert rows(ev.for_period(daily, batches, 10, 30)) == [(1, "daily"), (3, "daily"), (7, "batch"), (10, "batch"), (10, "batch")]
    assert rows(ev.for_period(daily.limit(0), batches.where("id = 6"), 10, 30)) == [(6, "batch")]
    assert rows(ev.for_period(daily.where("id = 1"), batches.limit(0), 10, 30)) == [(1, "daily")]


def test_best_venue(spark):
    rows = [(1, ["old", "hall"], "x"), (2, ["hall"], "y"), (3, ["hall", "old", "big"], "z"), (4, None, "x"), (5, [], None), (6, ["hall", "old", "old"], "x")]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>, place string")
    ids = lambda wanted, some=docs: sorted(r["id"] for r in ev.best_venue(some, "tokens", "place", wanted).collect())
    assert ids(["old", "hall"]) == [1, 6]
    assert ids(["hall"]) == [2]
    assert ids(["old"]) == [1, 6]
    assert ids(["none"]) == ids([]) == ids(["old"], docs.limit(0)) == []
    tied = docs.union(spark.createDataFrame([(7, ["old", "hall"], "w")], docs.schema))
    assert ids(["old", "hall"], tied) == []


def test_columns(spark):
    row = spark.range(1).select(
        *(ev.other_city(F.lit(t), ["Ulm", "Bad Ems"], ["Köln"]).alias(f"c{i}") for i, t in enumerate(["in ULM!", "Ulmer", "Ulm, KÖLN", "bad ems", ""])),
        ev.other_city(F.lit(None).cast("string"), ["Ulm"], ["Köln"]).alias("c5"),
        ev.other_city(F.lit("in Ulm"), [], ["Köln"]).alias("c6"),
        ev.other_city(F.lit("in Ulm"), ["Ulm"], []).alias("c7"),
        ev.time_evidence(F.lit(600), F.lit("doors"), F.lit(740), F.lit("start")).alias("t0"),
        ev.time_evidence(F.lit(600), F.lit("start"), F.lit(706), F.lit("start")).alias("t1"),
        ev.time_evidence(F.lit(600), F.lit(None).cast("string"), F.lit(600), F.lit("start")).alias("t2"),
        ev.time_evidence(F.lit(None).cast("int"), F.lit("start"), F.lit(600), F.lit("start")).alias("t3"),
        ev.time_evidence(F.lit(0), F.lit(None).cast("string"), F.lit(151), F.lit(None).cast("string")).alias("t4"),
        *(ev.stale(F.lit(a), F.lit(b)).alias(f"s{i}") for i, (a, b) in enumerate([(100, 701), (100, 700), (0, 900), (900, 100)])),
    ).first()
    assert [row[f"c{i}"] for i in range(8)] == [True, False, False, True, False, False, False, True]
    assert tuple(row["t0"]) == (0.74, True, False, 140) and tuple(row["t1"]) == (0.0, False, True, 106)
    assert tuple(row["t2"]) == (1.0, True, False, 0) and row["t3"] is None and tuple(row["t4"]) == (0.0, False, True, 151)
    assert [row[f"s{i}"] for i in range(4)] == [True, False, False, False]


def test_newest_revision(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "w"), (None, 2, "v"), (None, 1, "u")]
    got = ev.newest_revision(spark.createDataFrame(rows, "k string, revision int, text string"), ["k"], "revision")
    assert set(map(tuple, got.collect())) == {("a", 3, "z"), ("b", None, "w"), (None, 2, "v")}
