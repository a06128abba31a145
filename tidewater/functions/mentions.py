"""Date mentions in prose with their places: kinds, offsets and the words as written, without numbers that are no dates."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .dates import ENGLISH, MONTHS
from .time import infer_year

#: Spoken days, and abbreviated months.
SPOKEN = "первое второе третье четвертое пятое шестое седьмое восьмое девятое десятое одиннадцатое двенадцатое тринадцатое четырнадцатое пятнадцатое шестнадцатое семнадцатое восемнадцатое девятнадцатое двадцатое".split()
SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
#: Beginnings of what stands before numbers that are no dates: streets, versions, reductions, measures; and of what an event is called.
STREETS = "ул ул. улица улице улицы улицу проспект просп. пр-т пер пер. переулок наб наб. набережная набережной шоссе бульвар бул бул. пл пл. площадь".split()
VERSIONS = "версия версии version build сборка сборки релиз release".split()
REDUCTIONS = "скидк промокод promo акция акции купон sale".split()
MEASURES = "размер формат верси ip порт модель артикул sku частот hz гц".split()
EVENTS = "концерт вечерин мероприят событи начало дата когда".split()

NAMES = ("kind", "at", "length", "day", "month", "year", "raw", "range")
KINDS = ArrayType(StructType([StructField(n, StringType() if n in ("kind", "raw") else IntegerType()) for n in NAMES]))
_DAYS = {w: n for n, w in enumerate(SPOKEN, 1)} | {"тридцатое": 30, "тридцать первое": 31} | {f"двадцать {w}": 20 + n for n, w in enumerate(SPOKEN[:9], 1)}
_EN = ENGLISH | SHORT


def _any(words) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


_NUMERIC = re.compile(r"(?<![\d./:])(\d{1,2})\.(\d{1,2})(?:\.(\d{4}|\d{2}))?(?![\d./:])")
_ONE = re.compile(rf"(?i)(?:(?<!\d)(\d{{1,2}})(?:-?го)?|(?<!\w)({_any(_DAYS)}))[ \t]+({_any(MONTHS)})(?:[ \t]+(\d{{4}}))?(?!\d)")
_SPAN = re.compile(rf"(?i)(?:(?<!\d)(\d{{1,2}})\s*[—–-]\s*|(?<!\w)с\s+(\d{{1,2}})\s+по\s+)(\d{{1,2}})\s+({_any(MONTHS)})(?:\s+(\d{{4}}))?")
_LIST = re.compile(rf"(?i)(?<!\d)(\d{{1,2}}(?:\s*,\s*\d{{1,2}})+(?:\s*,?\s*(?:и|and)\s*\d{{1,2}})?)\s+({_any(MONTHS)})(?:\s+(\d{{4}}))?")
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?(?:[ \t]*[—–-][ \t]*(\d{1,2})(?:st|nd|rd|th)?)?"
_YEAR = r"(?:(?:[ \t]*,[ \t]*|[ \t]+)(\d{4})(?!\d))?(?!\w)"
_ENGLISH = re.compile(rf"(?i)(?<!\w)({_any(_EN)})\.?\s+{_DAY}{_YEAR}"), re.compile(rf"(?i)(?<!\w){_DAY}\s+({_any(_EN)})\.?{_YEAR}")
_STREET = re.compile(rf"(?i)(?:^|\s)(?:{_any(STREETS)})\s*$")
_VERSION = re.compile(rf"(?i)(?:{_any(VERSIONS)}|(?:^|\s)v)\s*[:#-]?\s*$")
_REDUCTION, _EVENT = re.compile(rf"(?i)(?:{_any(REDUCTIONS)})\S*[^\n]{{0,28}}$"), re.compile(f"(?i){_any(EVENTS)}")
_MEASURE = re.compile(rf"(?i)(?:{_any(MEASURES)})\S*[^\n]{{0,24}}$")
_RATE = re.compile(r"(?i)\s*(?:%|процент|скидк)")
_PHONE_RIGHT = re.compile(r"[+\d\s().-]*")


def _phone(text: str, start: int, end: int) -> bool:
    """Whether the run of digits and their signs around a place is a telephone number."""
    left = start
    while left and (text[left - 1] in "+().-" or text[left - 1].isdigit() or text[left - 1].isspace()):
        left -= 1
    run = text[left : _PHONE_RIGHT.match(text, end).end()]
    return "+" in run or (sum(c.isdigit() for c in run) >= 10 and ("(" in run or ")" in run))


def _no_date(text: str, start: int, end: int) -> bool:
    """Whether what stands around a place says that it is an address, a version, a reduction or a measure."""
    left, right = text[max(0, start - 70) : start], text[end : end + 70]
    if _STREET.search(left) or _VERSION.search(left) or _MEASURE.search(left) or _RATE.match(right):
        return True
    return bool(_REDUCTION.search(left)) and not _EVENT.search(f"{left} {text[start:end]} {right}")


def _year(text: str | None) -> int | None:
    return int(text) + (2000 if len(text) == 2 else 0) if text else None


def scan(text: str) -> list[tuple]:
    """(kind, at, length, day, month, year, raw, range) in the order of places: kind is absolute, range-start, range-day or range-end,
    the parts of one range share its number; a day that no leap year has is none. At counts code points from 0."""
    said, found, ranges = text.replace("ё", "е").replace("Ё", "Е"), [], 0

    def add(kind: str, at: int, length: int, day: int, month: int, year: int | None, raw: str, number: int | None = None) -> None:
        if 1 <= month <= 12 and 1 <= day <= calendar.monthrange(2000, month)[1]:
            found.append((kind, at, length, day, month, year, raw, number))

    for m in _NUMERIC.finditer(said):
        if not _phone(said, *m.span()) and not _no_date(said, *m.span()):
            add("absolute", m.start(), len(m[0]), int(m[1]), int(m[2]), _year(m[3]), text[slice(*m.span())])
    for m in _ONE.finditer(said):
        if not _no_date(said, *m.span()):
            add("absolute", m.start(), len(m[0]), int(m[1]) if m[1] else _DAYS[m[2].lower()], MONTHS[m[3].lower()], _year(m[4]), text[slice(*m.span())])
    for n, pattern in enumerate(_ENGLISH):
        for m in pattern.finditer(said):
            first, last, name = (2, 3, 1) if n == 0 else (1, 2, 3)
            month, year, raw = _EN[m[name].lower()], _year(m[4]), text[slice(*m.span())]
            days = [int(m[first]), int(m[last] or m[first])]
            long_year = not year and re.match(r"[ \t]*,?[ \t]*\d{4}", said[m.end() :])
            if _no_date(said, *m.span()) or long_year or days[0] > days[1] or days[1] > calendar.monthrange(year or 2000, month)[1]:
                continue
            ranges += bool(m[last])
            add("range-start" if m[last] else "absolute", m.start(), len(m[0]), days[0], month, year, raw, ranges if m[last] else None)
            if m[last]:
                add("range-end", m.start(last), len(m[last]), days[1], month, year, raw, ranges)
    for m in _SPAN.finditer(said):
        first = 1 if m[1] else 2
        ranges += 1
        add("range-start", m.start(first), len(m[first]), int(m[first]), MONTHS[m[4].lower()], _year(m[5]), m[first], ranges)
        add("range-end", m.start(3), len(m[3]), int(m[3]), MONTHS[m[4].lower()], _year(m[5]), text[slice(*m.span())], ranges)
    for m in _LIST.finditer(said):
        days = list(re.finditer(r"\d+", m[1]))
        if len(days) == 2 and len(days[1][0]) == 1:
            continue  # 4, 5 марта: the first number may be anything
        ranges += 1
        for i, d in enumerate(days):
            kind = "range-start" if i == 0 else "range-end" if i == len(days) - 1 else "range-day"
            add(kind, m.start() + d.start(), len(d[0]), int(d[0]), MONTHS[m[2].lower()], _year(m[3]), text[slice(*m.span())] if kind == "range-end" else d[0], ranges)
    return sorted(set(found), key=lambda x: (x[1], x[0] != "range-start", x[0], x[2], x[7] or 0))


@F.pandas_udf(KINDS)
def mention_places(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each text's mentions (see scan), whole texts in one pass; null and empty texts have none."""
    for batch in texts:
        yield batch.map(lambda t: [dict(zip(NAMES, x)) for x in scan(t)] if t else [])


def resolved(mention: Column, reference: Column) -> Column:
    """The date of a mention: of its own year, else the reference's or the next (see infer_year); null if that year lacks the day."""
    own = F.try_to_date(F.format_string("%04d-%02d-%02d", mention["year"], mention["month"], mention["day"]), "yyyy-MM-dd")
    here = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(reference), mention["month"], mention["day"]), "yyyy-MM-dd")
    return F.when(mention["year"].isNotNull(), own).when(here.isNotNull(), infer_year(mention["month"], mention["day"], reference))
