"""Dates in prose: mentions in texts as columns, and phrases for a range as dates."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import infer_year

#: Month names, in the case that follows a day, and their numbers.
MONTHS = {"января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12}
ENGLISH = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12}
#: Month names by themselves, and weekdays as they follow "on".
NAMES = {"январь": 1, "февраль": 2, "март": 3, "апрель": 4, "май": 5, "июнь": 6, "июль": 7, "август": 8, "сентябрь": 9, "октябрь": 10, "ноябрь": 11, "декабрь": 12}
WEEKDAYS = ["понедельник", "вторник", "среду", "четверг", "пятницу", "субботу", "воскресенье"]

_RU, _EN = "|".join(MONTHS), "|".join(ENGLISH)
#: Patterns of a mention: day, month (number or name), year (may be empty). Phone numbers, clock times and prices hold no dates.
NUMERIC = r"(?<![\d./:+-])(\d{1,2})\.(\d{1,2})(?:\.(\d{4}|\d{2}))?(?![\d./:]|\s*(?:руб|₽|%))"
NAMED = rf"(?i)(?<![\d\p{{L}}])(?:(\d{{1,2}})\s*[-–—]\s*)?(\d{{1,2}})(?:-?го|st|nd|rd|th)?\s+({_RU}|{_EN})\.?(?:,?\s+(\d{{4}}))?(?![\p{{L}}\d])"
MONTH_FIRST = rf"(?i)(?<![\d\p{{L}}])({_EN})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*[-–—]\s*(\d{{1,2}}))?(?:,?\s+(\d{{4}}))?(?![\p{{L}}\d])"


def _number(month: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in (MONTHS | ENGLISH).items() for x in pair)), F.lower(month))


def _date(day: Column, month: Column, year: Column, reference: Column) -> Column:
    """The date, with a two-digit year of this century, or the year that the reference implies; null if there is none such."""
    given = F.when(F.length(year) == 2, F.lit("20")).otherwise("")
    full = F.when(year != "", F.concat(given, year)).try_cast("int")
    day, month = day.try_cast("int"), month.try_cast("int")
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    exact = F.when(ok & full.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", full, month, day), "yyyy-MM-dd"))
    # A day that the reference's year lacks (29 February) is no date.
    here = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(reference), month, day), "yyyy-MM-dd")
    return F.coalesce(exact, F.when(ok & full.isNull() & here.isNotNull(), infer_year(month, day, reference)))


def mentions(text: Column, reference: Column) -> Column:
    """Sorted distinct dates that a text names: numbers (05.03, 5.3.98), a day and a month's name in either language and order,
    both ends of a range of days (5-7 марта), and today and tomorrow by the reference date. Without a year it is the reference's, or the
    next where that is over half a year past. Null text or reference gives no dates."""
    hit = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    part = lambda x, p, i: F.regexp_extract(x, p, i)
    # Inside a match alone the guards hold, so parts are read with the same pattern.
    # They are bound to names once a match.
    parts = lambda p, n: F.transform(hit(p), lambda x: F.struct(*(part(x, p, i).alias(f"g{i}") for i in range(1, n + 1))))
    numbered = lambda p, month: F.transform(parts(p, 4), lambda x: F.struct(*(x[f"g{i}"].alias(f"g{i}") for i in range(1, 5)), _number(x[month]).cast("string").alias("month")))
    numeric = F.transform(parts(NUMERIC, 3), lambda x: _date(x["g1"], x["g2"], x["g3"], reference))
    of = lambda x, i: _date(x[i], x["month"], x["g4"], reference)
    named = F.flatten(F.transform(numbered(NAMED, "g3"), lambda x: F.array(of(x, "g1"), of(x, "g2"))))
    named = F.concat(named, F.flatten(F.transform(numbered(MONTH_FIRST, "g1"), lambda x: F.array(of(x, "g2"), of(x, "g3")))))
    low = F.lower(text)
    near = F.array(*(F.when(low.rlike(rf"(?<!\p{{L}}){w}(?!\p{{L}})"), F.date_add(reference, n)) for w, n in (("сегодня", 0), ("today", 0), ("завтра", 1), ("tomorrow", 1))))
    found = F.concat(*(F.coalesce(x, F.array().cast("array<date>")) for x in (numeric, named, near)))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def phrase(text: str, today: date) -> tuple[str, date, date] | None:
    """(kind, first, last) of what a phrase asks for, None if it names no time.

    Weekends begin on Friday, a week is what is left of it, a month by its name is this year's, and a date without a year that
    has passed is the next year's.
    """
    said = " ".join(text.lower().replace("ё", "е").split())
    has = lambda p: re.search(rf"(?<![\w]){p}(?![\w])", said)
    days = lambda n: today + timedelta(n)
    left = 6 - today.weekday()

    def on(day: str, month: int, year: str | None) -> date | None:
        try:
            if year:
                return date(int(year) + (2000 if len(year) == 2 else 0), month, int(day))
            found = date(today.year, month, int(day))
            return found if found >= today else date(today.year + 1, month, int(day))
        except ValueError:
            return None

    def span(day: str, month: int, year: str | None, start: date | None) -> date | None:
        """The end of a range without a year of its own: the first such day from its start on."""
        if year or start is None:
            return on(day, month, year)
        for y in (start.year, start.year + 1):
            try:
                if date(y, month, int(day)) >= start:
                    return date(y, month, int(day))
            except ValueError:
                pass
        return None

    found, before = [], 0
    for m in re.finditer(r"(?<![\d.])(\d{1,2})\.(\d{1,2})(?:\.(\d{4}|\d{2}))?(?![\d.])", said):
        joined = found and re.fullmatch(r"\s*(?:[-–—]|по|до)\s*", said[before : m.start()])
        found.append(span(m[1], int(m[2]), m[3], found[-1]) if joined else on(m[1], int(m[2]), m[3]))
        before = m.end()
    for a, b, m, y in re.findall(rf"(?<!\d)(?:(\d{{1,2}})\s*(?:[-–—]|по|до)\s*)?(\d{{1,2}})\s+({_RU})(?:\s+(\d{{4}}))?", said):
        start = on(a, MONTHS[m], y or None) if a else None
        found += [start, span(b, MONTHS[m], y or None, start)]
    found = [x for x in found if x]
    if found:
        return ("date" if len(found) == 1 else "date-range", min(found), max(found))
    if m := has(r"(?:ближайш|следующ)(?:ие|их) (\d{1,3}) дн(?:я|ей)"):
        return "nextDays", today, days(min(365, max(1, int(m[1]))) - 1)
    if has("сегодня"):
        return "today", today, today
    if has("завтра"):
        return "tomorrow", days(1), days(1)
    if has("ближайшие дни"):
        return "nearWeekend", today, days(left)
    if has("(?:выходные|выходных)"):
        return "weekend", days(max(0, 4 - today.weekday())), days(left)
    if has("недел[юяе]") and not has("две недели"):
        return "week", today, days(left)
    for n, name in enumerate(WEEKDAYS):
        if has(name):
            at = days((n - today.weekday()) % 7)
            return "weekday", at, at
    if has("эт(?:от|ом) месяц[е]?"):
        return "currentMonth", today, date(today.year, today.month, calendar.monthrange(today.year, today.month)[1])
    if has("месяц"):
        year, month = today.year + today.month // 12, today.month % 12 + 1
        return "next30", today, date(year, month, min(today.day, calendar.monthrange(year, month)[1])) - timedelta(1)
    for name, n in NAMES.items():
        if m := has(rf"(?:{name}|{name[:-1]}е)(?: (\d{{4}}))?"):
            year = int(m[1]) if m[1] else today.year
            return "month", date(year, n, 1), date(year, n, calendar.monthrange(year, n)[1])
    if has("(?:за все время|все будущие)"):
        return "all", today, date(9999, 12, 31)
    if has("(?:скоро|две недели|ближайшее время|афиша)"):
        return "next14", today, days(13)
    return None
