"""The roll-up over four levels: late data at every level, reruns, failed batches, and no message twice."""

from collections import Counter
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewater.operators import rollup
from tidewater.streaming import hierarchy

ROW = "peer_id long, cmid long, created_at long, value double"


def at(day, hour=12):
    return int(datetime.fromisoformat(f"{day}T{hour:02d}:00:00+00:00").timestamp())


def state(spark, path):
    rows = sorted(hierarchy.levels(spark, path).select("level", "peer_id", "period", "revision", "n", "v", "sources").collect())
    edges = sorted(tuple(r) for r in hierarchy.edges(spark, path).collect())
    return [tuple(r) for r in rows], edges


#: Messages by micro-batch; January's second half comes late, 1 February opens a segment of its own.
ARRIVALS = [
    [(1, 1, at("2024-01-29"), 1.0), (1, 2, at("2024-01-29", 13), 2.0), (1, 3, at("2024-01-30"), 4.0), (2, 1, at("2024-01-30"), 8.0), (1, 1, at("2024-01-29"), 1.0)],
    [(1, 4, at("2024-02-01"), 16.0), (1, 1, at("2024-01-29"), 1.0), (None, 9, at("2024-02-01"), 1.0), (1, 9, None, 1.0)],
    [(1, 5, at("2024-01-29", 13), 32.0), (2, 2, at("2024-01-31", 22), None)],
]
CLOCK = [date(2024, 1, 30), date(2024, 2, 5), date(2024, 3, 1)]


def feed(spark, path, number, clock=CLOCK.__getitem__):
    hierarchy.hierarchy_writer(path, clock)(spark.createDataFrame(ARRIVALS[number], ROW), number)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('levels')}"
    for number in range(3):
        feed(spark, path, number)
    return path


def test_late_data_make_revisions_at_every_level(spark, run):
    rows, edges = state(spark, run)
    of = lambda level: [r[1:] for r in rows if r[0] == level]
    # The slot from 15:00 to 18:00 local time has two messages at first, and then the fifth one late.
    assert (1, "2024-01-29 18:00", 1, 2, 3.0, 2) in of("batch") and (1, "2024-01-29 18:00", 2, 1, 32.0, 1) in of("batch")
    # 29 January closes in the first batch, its late part is a second revision of the day, the segment and the month.
    assert [r for r in of("day") if r[:2] == (1, "2024-01-29")] == [(1, "2024-01-29", 1, 2, 3.0, 1), (1, "2024-01-29", 2, 1, 32.0, 1)]
    assert [r for r in of("segment") if r[:2] == (1, "2024-01-29")] == [(1, "2024-01-29", 1, 3, 7.0, 2), (1, "2024-01-29", 2, 1, 32.0, 1)]
    assert [r for r in of("month") if r[:2] == (1, "2024-01")] == [(1, "2024-01", 1, 3, 7.0, 1), (1, "2024-01", 2, 1, 32.0, 1)]
    # A week is cut at the month's end; 22:00 UTC on the 31st is the next month in Moscow. Both wait until March.
    assert [r for r in of("segment") if r[1] == "2024-02-01"] == [(1, "2024-02-01", 1, 1, 16.0, 1), (2, "2024-02-01", 1, 1, None, 1)]
    assert [r for r in of("month") if r[1] == "2024-02"] == [(1, "2024-02", 1, 1, 16.0, 1), (2, "2024-02", 1, 1, None, 1)]
    # All messages with a key are in each level once, the repeated ones too.
    assert {level: sum(r[4] for r in rows if r[0] == level) for level in rollup.LEVELS} == dict.fromkeys(rollup.LEVELS, 7)
    for level, below in zip(rollup.LEVELS[1:], rollup.LEVELS):
        used = Counter((e[1], e[5], e[6]) for e in edges if e[0] == level)
        assert set(used.values()) == {1} and set(used) == {(r[1], r[2], r[3]) for r in rows if r[0] == below}


def test_a_batch_that_failed_half_way_shows_nothing_and_runs_again(spark, tmp_path, run):
    path = f"file://{tmp_path}/levels"
    feed(spark, path, 0)
    before = state(spark, path)

    def broken(number):
        raise OSError("lost")

    with pytest.raises(OSError):
        feed(spark, path, 1, broken)
    assert state(spark, path) == before
    for number in (1, 1, 2):
        feed(spark, path, number)
    assert state(spark, path) == state(spark, run)


def test_stream_equals_plain_sums(spark, tmp_path):
    start = datetime(2024, 1, 20, tzinfo=timezone.utc)
    rows = [(i % 3, i, int((start + timedelta(hours=7 * i % 500)).timestamp()), float(i)) for i in range(120)]
    for number in range(2):
        spark.createDataFrame(rows[number::2], ROW).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    path = f"file://{tmp_path}/levels"
    hierarchy.run_hierarchy(stream, path, f"{tmp_path}/state", lambda number: date(2024, 6, 1)).awaitTermination()
    got = {(r["level"], r["peer_id"], r["period"]): (r["n"], r["v"]) for r in hierarchy.levels(spark, path).groupBy("level", "peer_id", "period").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    want = {}
    for peer, _, created, value in rows:
        day = (datetime.fromtimestamp(created, timezone.utc) + timedelta(hours=3)).date()
        monday = day - timedelta(day.weekday())
        for key in (("day", peer, str(day)), ("segment", peer, str(max(monday, day.replace(day=1)))), ("month", peer, f"{day:%Y-%m}")):
            n, v = want.get(key, (0, 0.0))
            want[key] = (n + 1, v + value)
    assert {k: v for k, v in got.items() if k[0] != "batch"} == want
