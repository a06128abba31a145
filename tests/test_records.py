"""Small operators, dates and sources by hand-made cases."""

import io
import zipfile
from datetime import date

from pyspark.sql import functions as F

from tidewater.functions import dates, time
from tidewater.operators import records as rec
from tidewater.operators import search
from tidewater.operators.relations import ordered_digests
from tidewater.plans import calendar
from tidewater.sources import files, html


def test_phrases_mean_what_the_list_says():
    today = date.fromisoformat(calendar.TODAY)
    assert today.weekday() == 2
    for phrase, kind, first, last in calendar.PHRASES:
        assert dates.phrase(phrase, today) == (kind, date.fromisoformat(first), date.fromisoformat(last)), phrase
    assert dates.phrase("привет", today) is None and dates.phrase("", today) is None
    assert dates.phrase("31.02", today) is None


def test_mentions_of_odd_texts(spark):
    texts = {"29.02.2023": "", "29.02.2024": "2024-02-29", "1.13.2024": "", "on May 3rd - 5, 2024": "2024-05-03,2024-05-05", "3 мая и 4 мая": "2024-05-03,2024-05-04", "+7.903.11.12": "", "Завтрак": "", "": ""}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", dates.mentions(F.col("t"), F.lit("2024-05-01").cast("date")).alias("d"))
    got = {r["t"]: ",".join(map(str, r["d"] or [])) for r in rows.collect()}
    assert got == texts | {None: ""}


def test_local_instants_and_slots(spark):
    slots = ["09:00", "18:00"]
    row = spark.range(1).select(
        time.instant(F.lit("2024-01-01").cast("date"), F.lit(90), "Europe/Berlin").alias("a"),
        time.day_window(F.lit("2024-03-31").cast("date"), "Europe/Berlin").alias("b"),
        time.next_slot(F.lit(1704067200), slots, "UTC").alias("c"),
        time.coalesced(F.lit(1704067200 + 9 * 3600), F.lit(1704067200 + 40 * 3600), slots, "UTC").alias("d"),
        time.coalesced(F.lit(0), F.lit(5), slots, "UTC").alias("e"),
        time.run_window(F.lit(1704067200 + 18 * 3600), slots, "UTC").alias("f"),
    ).first()
    assert row["a"] == 1704067200 + 90 * 60 - 3600 and row["b"]["end"] - row["b"]["start"] == 23 * 3600
    assert row["c"] == 1704067200 + 9 * 3600
    assert tuple(row["d"]) == (1704067200 + 33 * 3600, 2) and tuple(row["e"]) == (0, 0)
    assert row["f"]["slot"] == "18:00" and row["f"]["start"] == 1704067200 + 9 * 3600


def test_references_and_photos(spark):
    deep = '{"a":' * 13 + '{"cmid": 9}' + "}" * 13
    rows = spark.createDataFrame([('{"cmid": "4", "x": [{"cmids": [5, 0, "7", 5]}], "b": {"cmid": -1}}',), (deep,), ("{",), (None,)], "j string")
    assert [r[0] for r in rows.select(rec.references("j")).collect()] == [[4, 5, 7], [], [], []]
    photo = '{"from_id": 3, "attachments": [{"type": "photo", "photo": {"id": 1, "sizes": [{"url": "s", "width": 1, "height": 9}, {"url": "m", "width": 4, "height": 4}, {"width": 99, "height": 99}]}}, {"type": "doc"}]}'
    rows = spark.createDataFrame([(photo, 3), (photo, 4), (None, 1), ("x", 1)], "j string, s long")
    got = [(r["p"]["integrity"], [x["url"] for x in r["p"]["photos"]]) for r in rows.select(rec.photos(F.col("j"), F.col("s"), F.lit(0)).alias("p")).collect()]
    assert got == [("ok", ["m"]), ("mismatched-original", []), ("ok", []), ("ok", [])]


def test_terms_tags_and_stems(spark):
    rows = spark.createDataFrame([("Сова летит",), ("с совами",), ("совок",), ("SOVA",), (None,)], "t string")
    assert [r[0] for r in rows.select(rec.names_term(F.col("t"), "сов")).collect()] == [True, True, False, False, False]
    assert rec.expanded("кто знает Владиславом или сову", {"или", "кто"})[:3] == ["кто знает Владиславом или сову", "знает", "Владиславом"]
    assert rec.expanded("кто хочет гулять с Владиславом", {"кто"}) == ["кто хочет гулять с Владиславом", "хочет", "гулять", "гуля", "Владиславом", "Владислав"]
    assert rec.expanded("Владислейв", set()) == ["Владислейв", "Владислэйв"] and rec.expanded(" ", set()) == []
    assert rec.alternatives("гитара или барабаны либо бас и Гитара", {"кто"}) == ["гитара", "барабаны", "барабан"]
    assert rec.clause_terms("кто сегодня идёт встретиться?", {"кто"}) == ["встретиться", "встрети", "встретитьс"] and rec.clause_terms("сегодня, завтра", set()) == ["сегодня", "сегодн", "завтра"]
    row = spark.range(1).select(rec.tags(F.lit("Post-Punk night, DEATHCORE"), {"post-punk": ["post punk"], "deathcore": ["death core"], "x": ["nope"]}).alias("a"), rec.venue_key(F.lit("at the big barn"), {"hall": ["old hall"], "barn": ["red barn"]}).alias("b")).first()
    assert row["a"] == ["deathcore", "post-punk"] and row["b"] == "barn"
    words = spark.createDataFrame([("совами",), ("стихов",), ("ночь",), ("сердцем",), ("дом5ами",)], "w string")
    assert [r[0] for r in words.select(search.stem(F.col("w"))).collect()] == ["совам", "стих", "ночь", "сердц", "дом5ами"]


def test_ranges_that_have_begun_stay_upright():
    from datetime import date, timedelta

    from tidewater.functions.dates import phrase

    for text, days in (("5-7 марта", 2), ("05.03 - 07.03", 2), ("с 5 по 7 марта", 2), ("30.12 - 02.01", 3)):
        for n in range(366):
            today = date(2023, 3, 1) + timedelta(n)
            kind, first, last = phrase(text, today)
            assert kind == "date-range" and first >= today and (last - first).days == days
    assert phrase("5-7 марта", date(2024, 3, 6))[1:] == (date(2025, 3, 5), date(2025, 3, 7))
    assert phrase("5-7 марта 2024", date(2024, 3, 6))[1:] == (date(2024, 3, 5), date(2024, 3, 7))
    assert phrase("31 апреля", date(2024, 3, 6)) is None


def test_digests_of_keys(spark):
    import hashlib

    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 1, "z"), ("b", 1, None)], "k string, at int, line string")
    got = {r["k"]: (r["n"], r["digest"]) for r in ordered_digests(rows, "k", ["at"], F.col("line")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"a": (2, sha("xy")), None: (1, sha("z")), "b": (1, sha(""))}


def workbook(rows):
    strings, cells = [], []
    for i, row in enumerate(rows, 1):
        line = ""
        for c, value in zip("ABC", row):
            if value is not None and i % 2:
                line += f'<c r="{c}{i}" t="inlineStr"><is><t>{value}</t></is></c>'
            elif value is not None:
                strings.append(value)
                line += f'<c r="{c}{i}" t="s"><v>{len(strings) - 1}</v></c>'
        cells.append(f'<row r="{i}">{line}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark):
    content = workbook([("Name", "Web Site", "Город"), ("Old Hall", "x.example", None), (None, None, None), ("Barn &amp; Co", None, "Ulm")])
    rows = spark.createDataFrame([("a.xlsx", content), ("b.xlsx", b"no zip"), ("c.xlsx", None)], "path string, content binary")
    got = files.workbook_rows(rows, {"title": ["title", "name"], "site": ["website"], "city": ["город"]}).orderBy("row").collect()
    assert [tuple(r) for r in got] == [("a.xlsx", 1, "Old Hall", "x.example", ""), ("a.xlsx", 3, "Barn & Co", "", "Ulm")]


def test_commits_snapshots_and_salvage(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = {"a": spark.range(3), "b": spark.range(5)}
    assert files.commit(spark, folder, "1", rows) and not files.commit(spark, folder, "1", rows) and files.commit(spark, folder, "2", rows)
    spark.range(100).write.parquet(f"{folder}/a/batch=3")  # an attempt that left no mark
    assert files.committed(spark, folder, "a").count() == 6 and files.committed(spark, folder, "b").count() == 10
    good, report = files.salvage(spark.createDataFrame([(1, '{"id": 1}'), (2, "{"), (3, ""), (4, "x")], "place long, value string"), "id long")
    assert [r["id"] for r in good.collect()] == [1] and tuple(report.first()) == (1, 2, 2)
    assert set(files.discovered(spark, folder, "*.parquet").columns) == {"path", "name", "bytes"}


def test_channel_pages(spark):
    page = '<div data-post="C/1"><div class="message_text">a<br/>b &amp; <b>c</b></div><time>0:10</time><time datetime="2024-01-01T00:00:00+00:00"></time><img src="x"/></div><div data-post="C/1"><div class="message_text">again</div></div><div data-post="D/2"></div>'
    got = html.channel_posts(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "c").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, "again", 0)]


def test_later_fields_win_and_known_hashes_are_skipped(spark):
    from tidewater.operators import relations as rel

    kind = "k int, a string, at int"
    old, new = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (None, "z", 1)], kind), spark.createDataFrame([(2, None, 3), (3, "w", None), (None, "v", 9)], kind)
    got = {r["k"]: (r["a"], r["at"]) for r in rel.upsert_last(old, new, ["k"], ["at"]).collect()}
    assert got == {1: ("x", 5), 2: (None, 5), 3: ("w", None), None: ("v", 9)}
    assert rel.upsert_last(old.limit(0), new, ["k"], ["at"]).count() == 3 and rel.upsert_last(old, new.limit(0), ["k"]).count() == 3

    rows = spark.createDataFrame([(1, "n1", "o1"), (2, "n2", "o2"), (3, "n3", "o3"), (4, "n4", "o4"), (5, None, None), (None, "n", "o")], "k int, now string, old string")
    known = spark.createDataFrame([(1, "n1"), (2, "o2"), (3, "n1"), (5, ""), (6, "n6"), (None, "n")], "k int, hash string")
    assert sorted(str(r["k"]) for r in rel.changed(rows, known, ["k"], ["now", "old"]).collect()) == ["3", "4", "5", "None"]
    assert rel.changed(rows, known.limit(0), ["k"], ["now"]).count() == 6 and rel.changed(rows.limit(0), known, ["k"], ["now"]).count() == 0
