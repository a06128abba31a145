"""Poster binding against a plain Python reading of the same rules, and its defined edge cases."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewater.operators import posters as po

EVENTS = "source long, id long, day date, title string, participants string, venue string, preferred int"
FACTS = "source long, index int, poster boolean, image_type string, confidence int, readability int, title string, dates string, venue string, participants string, recognized string, main boolean, sole boolean"


def words(text):
    found = re.sub("[^a-zа-я0-9$]+", " ", (text or "").lower().replace("ё", "е")).split()
    return [w for w in dict.fromkeys(found) if len(w) >= 3 and not w.isdigit() and w not in po._WEAK]


def keys(text):
    text, out = (text or "").lower().replace("ё", "е"), set()
    add = lambda d, m: out.add(f"{m:02d}-{d:02d}") if 1 <= d <= 31 and 1 <= m <= 12 else None
    for d, m in re.findall(r"(?<!\d)([0-3]?\d)[./-]([01]?\d)(?:[./-]\d{2,4})?(?!\d)", text):
        add(int(d), int(m))
    for d, m in re.findall(rf"(?<!\w)([0-3]?\d)\s+({po._WORDS})(?!\w)", text):
        add(int(d), po._NUMBER[m])
    for a, b, m in re.findall(rf"(?<!\w)([0-3]?\d)\s*(?:[–—-]|по)\s*([0-3]?\d)\s+({po._WORDS})(?!\w)", text):
        for d in range(int(a), int(b) + 1):
            try:
                date(2000, po._NUMBER[m], d)
            except ValueError:
                continue
            if 1 <= int(a) and int(b) <= 31:
                add(d, po._NUMBER[m])
    return out


def judged(e, f, alone):
    """(score, reason, title words, known words) of a pair, or None."""
    if f["poster"] is not True or re.search("|".join(po.NO_POSTER), (f["image_type"] or "").lower()) or (f["confidence"] is not None and f["confidence"] < 55):
        return None
    title, people = words(e["title"]), words(e["participants"])
    size = len(set(title) | set(people))
    want = e["day"] and e["day"].strftime("%m-%d")
    enough = lambda n: n >= 1 and (len(title) <= 2 or n >= 2 or n >= 0.6 * len(title))
    seen = (f["recognized"] or "").lower().replace("ё", "е")
    head = re.search(rf"(?:афиша|расписание|программа)[^\n]{{0,100}}?(?:на|в)\s+({po._WORDS})(?!\w)", seen)
    headed = False
    if head and want:
        months = {po._NUMBER[m] for m in re.findall(rf"(?<!\w)({po._WORDS})(?!\w)", seen[head.start() :].split("\n")[0])}
        if len(months) == 1:
            month = po._NUMBER[head[1]]
            if month != e["day"].month:
                return None
            starts = list(re.finditer(rf"^[ \t]*([0-3]?\d)[ \t]+(?:{'|'.join(po.WEEKDAYS)}|{po._WORDS})(?!\w)", seen, re.M))
            ends = [m.start() for m in starts[1:]] + [len(seen)]
            own = [seen[m.start() : end] for m, end in zip(starts, ends) if int(m[1]) == e["day"].day]
            headed = bool(starts)
            if headed:
                if not own:
                    return None
                pool = set(words("\n".join(own)))
                t, k = len(pool & set(title)), len(pool & (set(title) | set(people)))
                if enough(t) or k >= 2 or (k == 1 and size <= 2):
                    return 220 + 22 * k, "calendar-date+program", t, k
                if keys(f["dates"]) != {want} or not enough(len(set(words(f["title"])) & set(title))):
                    return None
    if alone and f["sole"] and not headed:
        return 125, "single-event-single-source-image", 0, 0
    if want not in keys(f"{f['dates'] or ''}\n{f['recognized'] or ''}"):
        return None
    pool = set(words(f["title"])) | set(words(f["participants"]))
    t, p, k = len(pool & set(title)), len(pool & set(people)), len(pool & (set(title) | set(people)))
    place = re.sub("[^a-zа-я0-9$]+", " ", (f["venue"] or "").lower().replace("ё", "е")).strip()
    quality = int((70 if f["confidence"] is None else f["confidence"]) / 10 + 0.5) + int((65 if f["readability"] is None else f["readability"]) / 20 + 0.5)
    extra = 22 * t + 12 * p + 2 * sum(w in place for w in words(e["venue"])) + quality
    if enough(t):
        return 170 + extra, "date+title-majority" if t >= 2 else "date+distinctive-title", t, k
    if k >= 2:
        return 145 + extra, "date+identity-tokens", t, k
    return (130 + extra, "date+distinctive-identity", t, k) if k == 1 and size <= 2 else None


def bound(events, facts):
    out = []
    for e in events:
        own = [f for f in facts if f["source"] == e["source"] and e["source"] is not None]
        mates = sum(x["source"] == e["source"] for x in events)
        found = [(f, m) for f in own if (m := judged(e, f, mates == 1 and len(own) == 1))]
        first = lambda x: (not x[0]["main"], x[0]["index"] != e["preferred"], -x[1][0], -(x[0]["confidence"] or 0), -(x[0]["readability"] or 0), x[0]["index"])
        found.sort(key=first)
        if not found:
            out.append((e["id"], 0, "no_safe_poster", "no-safe-poster" if own else "missing-vision-facts", 0, None))
            continue
        (f, m), two = found[0], found[1] if len(found) > 1 else None
        leads = not two or (f["main"] and not two[0]["main"]) or f["index"] == e["preferred"] or m[2] > two[1][2] or m[3] > two[1][3] or m[0] - two[1][0] >= 18
        if leads:
            out.append((e["id"], f["index"], "verified_multi_event_poster" if mates > 1 else "verified_single_event_source_media", m[1], m[0], None))
        else:
            out.append((e["id"], 0, "poster_review_required", "multiple-date-compatible-posters", m[0], [x["index"] for x, _ in found[:4]]))
    return sorted(out)


def rows_of(frame):
    return sorted((r["id"], r["poster"], r["status"], r["reason"], r["score"], r["review"] and [x["index"] for x in r["review"]]) for r in frame.collect())


def frames(spark, events, facts):
    e, f = [x.split()[0] for x in EVENTS.split(", ")], [x.split()[0] for x in FACTS.split(", ")]
    return spark.createDataFrame([[x[c] for c in e] for x in events], EVENTS), spark.createDataFrame([[x[c] for c in f] for x in facts], FACTS)


def event(source, id, day, title, participants="", venue="", preferred=0):
    return dict(source=source, id=id, day=day, title=title, participants=participants, venue=venue, preferred=preferred)


def fact(source, index, title="", dates="", participants="", recognized="", **more):
    base = dict(source=source, index=index, poster=True, image_type="афиша", confidence=90, readability=80, title=title, dates=dates, venue="", participants=participants, recognized=recognized, main=False, sole=False)
    return base | more


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_python(spark, seed):
    r = random.Random(seed)
    names = ["Ночные Снайперы", "Ёлка", "Black Cat Quartet", "Концерт памяти Цоя", "Тихий Дон live", "malina party", "dj Малина", ""]
    texts = ["5 марта", "05.03.2024", "5-7 марта", "с 30 по 31 октября", "6 mar", "31.10", "тел. 5-10-22", "7 марта; 31 октября", "", None]
    ocr = ["Афиша на март\n5 марта Ночные Снайперы\n6 суббота Black Cat\n 7 марта Малина", "программа в октябре\nчто-то", "расписание на октябрь\n31 октября Ёлка", "Афиша на март и октябрь\n5 марта Ёлка", "5 марта Тихий Дон", "", None]
    days = [date(2024, 3, 5), date(2024, 3, 6), date(2024, 3, 7), date(2024, 10, 31), date(2024, 10, 5), None]
    events = [event(r.choice([*range(1, 25), r.randint(30, 99), None]), i, r.choice(days), r.choice([*names, None]), r.choice(names), r.choice(["Клуб Малина Lounge", ""]), r.choice([0, 0, 1, 2])) for i in range(300)]
    facts = [
        fact(s, i, r.choice([*names, None]), r.choice(texts), r.choice([*names, None]), r.choice(ocr), poster=r.choice([True] * 6 + [False, None]), image_type=r.choice(["афиша", "poster", None, "обычное фото"]),
             confidence=r.choice([None, 54, 55, 70, 95]), readability=r.choice([None, 10, 30, 90]), venue=r.choice(["", "малина lounge", None]), main=r.random() < 0.1, sole=r.random() < 0.5)
        for s in range(1, 100) for i in range(1, r.choice([1, 8, 12]) if s < 30 else 2)
    ]
    e, f = frames(spark, events, facts)
    got = rows_of(po.bind_posters(e, f))
    assert got == bound(events, facts)
    assert len({x[3] for x in got}) >= 6


def test_one_poster_serves_dated_cards_and_ties_are_not_guessed(spark):
    day, next_day = date(2026, 9, 18), date(2026, 9, 19)
    events = [event(1, 1, day, "Северный ветер"), event(1, 2, next_day, "Северный ветер"), event(2, 3, day, "Северный ветер"), event(3, 4, day, "Другое имя"), event(4, 5, day, "Кто угодно"), event(5, 6, day, "Концерт")]
    facts = [fact(1, 1, "Северный ветер", "18 и 19 сентября, 18.09 19.09"), fact(2, 1, "Северный ветер", "18.09"), fact(2, 2, "Северный ветер", "18 сентября"), fact(3, 1, "Северный ветер", "18.09"), fact(4, 1, sole=True), fact(5, 1, "Концерт", "18.09")]
    got = {r[0]: r[1:4] for r in rows_of(po.bind_posters(*frames(spark, events, facts)))}
    assert got[1][0] == got[2][0] == 1 and got[1][1] == "verified_multi_event_poster"
    assert got[3] == (0, "poster_review_required", "multiple-date-compatible-posters")
    assert got[4] == got[6] == (0, "no_safe_poster", "no-safe-poster")  # a day alone, or a weak word, is no identity
    assert got[5] == (1, "verified_single_event_source_media", "single-event-single-source-image")


def test_repeats_extra_columns_and_empty_tables(spark):
    events, facts = [event(1, 1, date(2024, 3, 5), "Ёлка"), event(None, 2, None, None)], [fact(1, 1, "Елка", "5 марта")]
    e, f = frames(spark, events, facts)
    want = [(1, 1), (2, 0)]
    odd = po.bind_posters(e.withColumn("key", F.lit(1)).withColumn("fact", F.lit(2)), f.unionByName(f).withColumn("id", F.lit(9)).withColumn("score", F.lit(1)))
    assert [r[:2] for r in rows_of(odd)] == want
    assert rows_of(po.bind_posters(e.limit(0), f)) == []
    assert {r[3] for r in rows_of(po.bind_posters(e, f.limit(0)))} == {"missing-vision-facts"}
