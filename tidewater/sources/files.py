"""File sources and sinks: JSON lines with bad rows kept apart, calendars."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; a line that is no such object has its text in _corrupt_record. Blank lines are skipped."""
    return parsed_lines(spark.read.text(path), schema).drop("value")


def parsed_lines(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """lines (value and any other columns) with the fields of the object that each is, and _corrupt_record."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    full = StructType([*fields]).add("_corrupt_record", StringType())
    lines = lines.where(F.trim("value") != "")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("*", parsed.alias("_row")).select(*lines.columns, "_row.*")


def salvage(lines: DataFrame, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """What is whole of lines (place, value), and a report of one row: good, bad and the place of the first bad line."""
    rows = parsed_lines(lines, schema)
    bad = F.col("_corrupt_record").isNotNull()
    report = rows.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("place"))).alias("first_bad"))
    return rows.where(~bad).drop("value", "_corrupt_record"), report


def discovered(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, bytes) of the files below a folder, at any depth, whose name fits a pattern; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, kind) of the tables that may be asked about. A few rows: built from schemas, no data is read."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, frame in sorted(tables.items()) for f in frame.schema]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, column string, kind string")


def snapshot(rows: DataFrame, folder: str, version: str) -> DataFrame:
    """rows as a version in a folder of its own, which is written once and never changed."""
    path = f"{folder}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _exists(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, place, store.exists(place)


def commit(spark: SparkSession, folder: str, batch: str, tables: dict[str, DataFrame]) -> bool:
    """Append to several tables at once: the batch counts when its mark is there, which is written last. False: it was there before.

    A failed attempt leaves no mark, and the next one overwrites what it wrote."""
    store, mark, done = _exists(spark, f"{folder}/_commits/{batch}")
    if done:
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    store.mkdirs(mark.getParent())
    store.create(mark, False).close()
    return True


def committed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table's committed batches."""
    store, place, _ = _exists(spark, f"{folder}/_commits")
    batches = [status.getPath().getName() for status in store.listStatus(place)]
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*(f"{folder}/{table}/batch={b}" for b in batches))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _folded(line: str) -> str:
    """Continuation lines of at most 74 bytes, cut between characters."""
    out, size = [], 0
    for char in line:
        n = len(char.encode())
        if size + n > 74:
            out.append("\r\n ")
            size = 1
        out.append(char)
        size += n
    return "".join(out)


@F.pandas_udf(StringType())
def _event(id_: pd.Series, title: pd.Series, day: pd.Series, time: pd.Series, venue: pd.Series) -> pd.Series:
    def text(value: str | None) -> str:
        return (value or "").replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\n", "\\n")

    def one(i, t, d, at, v) -> str:
        stamp = str(d).replace("-", "")
        start = f"DTSTART:{stamp}T{at.replace(':', '')}00" if at else f"DTSTART;VALUE=DATE:{stamp}"
        lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//tidewater//EN", "BEGIN:VEVENT", f"UID:{i}@tidewater", start, f"SUMMARY:{text(t)}"]
        lines += [f"LOCATION:{text(v)}"] if v else []
        return "\r\n".join(map(_folded, [*lines, "END:VEVENT", "END:VCALENDAR"])) + "\r\n"

    return pd.Series([one(*row) for row in zip(id_, title, day, time, venue)])


def calendar(id_: Column, title: Column, day: Column, time: Column, venue: Column) -> Column:
    """An event as iCalendar text; without a time it lasts all day."""
    return _event(id_, title, day.cast("string"), time, venue)


#: The namespace of a sheet's elements and of its links.
SHEET, LINK = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheet(content: bytes) -> list[dict[str, str]]:
    """The first sheet's rows by their normalised headings; no workbook has no rows."""

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{SHEET}t"))

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = set(book.namelist())
            tree = lambda name: ElementTree.fromstring(book.read(name))
            strings = [text(s) for s in tree("xl/sharedStrings.xml").iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
            place = "xl/worksheets/sheet1.xml"
            if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names and (first := next(tree("xl/workbook.xml").iter(f"{SHEET}sheet"), None)) is not None:
                targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in tree("xl/_rels/workbook.xml.rels")}
                target = targets.get(first.get(f"{LINK}id"), "worksheets/sheet1.xml")
                place = target if target.startswith("xl/") else f"xl/{target}"
            rows = []
            for row in tree(place).iter(f"{SHEET}row"):
                cells = {}
                for cell in row.iter(f"{SHEET}c"):
                    column = "".join(c for c in cell.get("r", "") if c.isalpha())
                    value = cell.findtext(f"{SHEET}v") or ""
                    if cell.get("t") == "s":
                        value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
                    cells[column] = text(cell) if cell.get("t") == "inlineStr" else value
                rows.append(cells)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    if not rows:
        return []
    heads = {column: re.sub(r"[\s_-]+", "", value.strip().lower().replace("ё", "е")) for column, value in rows[0].items()}
    return [{heads[c]: v.strip() for c, v in row.items() if heads.get(c) and v.strip()} for row in rows[1:]]


def workbook_rows(files: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(path, row, the columns) of the first sheet of workbooks (path, content): a column is the first of its headings that a row fills.

    Headings fit in any case and with or without spaces; files that are no workbooks have no rows, rows of empty cells none either.
    """
    heads = {name: [re.sub(r"[\s_-]+", "", h.lower().replace("ё", "е")) for h in options] for name, options in columns.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                for number, row in enumerate(_sheet(content or b""), 1):
                    found = [next((row[h] for h in options if h in row), "") for options in heads.values()]
                    if any(found):
                        out.append((path, number, *found))
            yield pd.DataFrame(out, columns=["path", "row", *columns])

    return files.select("path", "content").mapInPandas(run, "path string, row int, " + ", ".join(f"`{c}` string" for c in columns))
