"""Date mentions: kinds, places and guards by hand, and the column form against the plain scanner on whole documents."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewater.functions import mentions as dm


def short(text):
    return [(kind, text[at : at + n], day, month, year) for kind, at, n, day, month, year, _, _ in dm.scan(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Концерт 20.09.2026 и 21.9", [("absolute", "20.09.2026", 20, 9, 2026), ("absolute", "21.9", 21, 9, None)]),
        ("31.02, 29.02, 45.13, 19:00, 2026-09-20, 1.2.3.4", [("absolute", "29.02", 29, 2, None)]),
        ("тел. +7 900 12.03 55", []),
        ("8 (900) 123-45-67 12.03", []),
        ("звоните 8 12.03 55", [("absolute", "12.03", 12, 3, None)]),
        ("ул. 9 Января, 100; версия 2.10; v2.10; скидка 11.11", []),
        ("скидка на концерт 11.11", [("absolute", "11.11", 11, 11, None)]),
        ("5.10% и 5.10 процентов", []),
        ("двадцать первое марта 2025, Седьмое мая, четвёртое июня", [("absolute", "двадцать первое марта 2025", 21, 3, 2025), ("absolute", "Седьмое мая", 7, 5, None), ("absolute", "четвёртое июня", 4, 6, None)]),
        ("20–22 сентября", [("range-start", "20", 20, 9, None), ("absolute", "22 сентября", 22, 9, None), ("range-end", "22", 22, 9, None)]),
        ("с 5 по 7 марта 2026", [("range-start", "5", 5, 3, 2026), ("absolute", "7 марта 2026", 7, 3, 2026), ("range-end", "7", 7, 3, 2026)]),
        ("20, 21 и 22 мая", [("range-start", "20", 20, 5, None), ("range-day", "21", 21, 5, None), ("absolute", "22 мая", 22, 5, None), ("range-end", "22", 22, 5, None)]),
        ("May 16th, Mayday 5, XMay16, 16 Sept. 2026", [("absolute", "May 16th", 16, 5, None), ("absolute", "16 Sept. 2026", 16, 9, 2026)]),
        ("March 5-7; 7-5 March; Feb 30", [("range-start", "March 5-7", 5, 3, None), ("range-end", "7", 7, 3, None)]),
        ("May 5, 20261", []),
        ("сегодня, завтра, в пятницу", []),
        ("", []),
    ],
)
def test_kinds_places_and_guards(text, want):
    assert short(text) == want


def test_columns_equal_the_scanner(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Ёлка 5 марта, 7-9 марта и 12.03 " * 3000), (-4, "с 5 по 7 марта 20, 21 и 22 мая")], rows.schema)
    both = rows.unionByName(more).withColumn("at", F.lit("extra"))
    got = {r["doc_id"]: [tuple(x) for x in r["m"]] for r in both.select("doc_id", dm.mention_places("text").alias("m")).collect()}
    assert got == {r["doc_id"]: dm.scan(r["text"] or "") for r in both.collect()}
    assert got[-1] == got[-2] == [] and len(got[-3]) == 3000 * 5


def test_dates_of_mentions(spark):
    rows = spark.createDataFrame([("5 марта", date(2024, 1, 10)), ("5 марта", date(2024, 12, 1)), ("5 марта 2023", date(2024, 1, 10)), ("29.02", date(2023, 1, 10)), ("29.02", date(2024, 1, 10)), (None, date(2024, 1, 1))], "t string, day date")
    got = rows.select(F.transform(dm.mention_places("t"), lambda m: dm.resolved(m, F.col("day"))).alias("d")).collect()
    assert [r["d"] for r in got] == [[date(2024, 3, 5)], [date(2025, 3, 5)], [date(2023, 3, 5)], [None], [date(2024, 2, 29)], []]
