"""Posters bound to events: facts read off a post's pictures, scored against each event of the same post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from . import graph

#: Words for months, by number.
MONTH_WORDS = {
    1: "январь января янв january jan", 2: "февраль февраля фев february feb", 3: "март марта мар march mar", 4: "апрель апреля апр april apr",
    5: "май мая may", 6: "июнь июня июн june jun", 7: "июль июля июл july jul", 8: "август августа авг august aug",
    9: "сентябрь сентября сен сент september sep sept", 10: "октябрь октября окт october oct", 11: "ноябрь ноября ноя november nov", 12: "декабрь декабря дек december dec",
}
#: Words that say nothing about which event it is (besides the Russian words for months).
WEAK_WORDS = (
    "концерт гиг gig пати party вечеринка туса тусовка шоу show live фестиваль фест event событие мероприятие выступление презентация альбом альбома "
    "программа воронеж воронеже воронежа группа группы bar бар pub паб club клуб hall холл rock рок кафе ресторан центр площадка сцена дом дк арт музыка music dj диджей"
).split()
#: Parts of image types that are no posters, weekdays, and words that head a calendar.
NO_POSTER = ["photo", "фото", "репортаж", "logo", "логотип", "avatar", "аватар", "album[- ]?cover", "обложк", "ui", "interface", "интерфейс", "sticker", "emoji"]
WEEKDAYS = "понедельник вторник среда четверг пятница суббота воскресенье".split()
HEADINGS = ["афиша", "расписание", "программа"]

_NUMBER = {word: n for n, words in MONTH_WORDS.items() for word in words.split()}
_WORDS = "|".join(sorted(_NUMBER, key=len, reverse=True))
_WEAK = [*WEAK_WORDS, *(w for w in _NUMBER if not w.isascii())]
NUMERIC = r"(?<!\d)[0-3]?\d[./-][01]?\d(?:[./-]\d{2,4})?(?!\d)"
NAMED = rf"(?<![\p{{L}}\p{{N}}])[0-3]?\d\s+(?:{_WORDS})(?![\p{{L}}\p{{N}}])"
RANGE = rf"(?<![\p{{L}}\p{{N}}])[0-3]?\d\s*(?:[–—-]|по)\s*[0-3]?\d\s+(?:{_WORDS})(?![\p{{L}}\p{{N}}])"
HEADING = rf"((?:{'|'.join(HEADINGS)})[^\n]{{0,100}}?(?:на|в)\s+({_WORDS})(?!\p{{L}})[^\n]*)"
DAY_LINE = rf"^[ \t]*[0-3]?\d[ \t]+(?:{'|'.join(WEEKDAYS)}|{_WORDS})(?!\p{{L}})"

LEAST_CONFIDENCE, LEAST_LEAD, SHOWN = 55, 18, 4


def identity_words(text: Column) -> Column:
    """Distinct words of 3 letters or more that tell one event from another: no numbers, no weak words. Null has none."""
    each = F.split(F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-zа-я0-9$]+", " ")), " ")
    return F.array_distinct(F.filter(each, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & w.rlike("[a-zа-я0-9]") & ~w.isin(*_WEAK)))


def _month(word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _NUMBER.items() for x in pair)), word)


def _key(day: Column, month: Column) -> Column:
    day, month = day.try_cast("int"), month.try_cast("int")
    return F.when(day.between(1, 31) & month.between(1, 12), F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")))


def date_keys(text: Column) -> Column:
    """Distinct days (MM-dd) that a folded text names: 5.03, 05/03/24, 5 марта, 5 mar; of a range with one month (5-7 марта) all days."""
    hits = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    # The parts of a hit first, as what is made of them names them several times.
    parts = F.transform(hits(NUMERIC), lambda x: F.split(x, "[./-]"))
    numeric = F.transform(F.transform(parts, lambda x: F.struct(x[0].try_cast("int").alias("d"), x[1].try_cast("int").alias("m"))), lambda x: _key(x["d"], x["m"]))
    word = lambda x: _month(F.regexp_extract(x, r"(\p{L}+)$", 1))
    first = lambda x: F.regexp_extract(x, r"^\d+", 0).try_cast("int").alias("first")
    named = F.transform(F.transform(hits(NAMED), lambda x: F.struct(first(x), word(x).alias("m"))), lambda x: _key(x["first"], x["m"]))
    spans = F.transform(hits(RANGE), lambda x: F.struct(first(x), F.regexp_extract(x, r"(\d+)\s+\p{L}+$", 1).cast("int").alias("last"), word(x).alias("m")))

    def all_days(x: Column) -> Column:
        ok = (x["first"] >= 1) & (x["last"] <= 31) & (x["first"] <= x["last"])
        days = F.sequence(F.when(ok, x["first"]).otherwise(1), F.when(ok, x["last"]).otherwise(1))
        last_day = F.dayofmonth(F.last_day(F.make_date(F.lit(2000), x["m"], F.lit(1))))  # a leap year
        return F.transform(days, lambda d: F.when(ok & (d <= last_day), _key(d, x["m"])))

    ranges = F.flatten(F.transform(spans, all_days))
    return F.coalesce(F.array_distinct(F.array_compact(F.concat(numeric, named, ranges))), F.array().cast("array<string>"))


def read_facts(facts: DataFrame) -> DataFrame:
    """Posters among the facts, with their keys: keys (days that may bind), words (word, in_title), calendar (key, word), headed (bool).

    A picture may be a calendar: a heading for one month over lines that begin with a day. Then the heading's month and
    the lines decide: another month or a day without a line does not bind, and a day's line must name the event (calendar). The
    title alone may stand for the line only where the date field names just that day (headed).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = fold(text("image_type"))
    good = F.col("poster") & ~kind.rlike("|".join(NO_POSTER)) & (F.coalesce(F.col("confidence"), F.lit(100)) >= LEAST_CONFIDENCE)
    rows = facts.where(good & (F.col("index") > 0)).withColumn("_seen", fold(text("recognized"))).withColumn("_dates", fold(text("dates")))

    line = F.split(F.regexp_extract("_seen", HEADING, 1), "\n")[0]
    months = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(rf"(?<!\p{{L}})({_WORDS})(?!\p{{L}})"), F.lit(1)), _month))
    rows = rows.withColumn("_month", F.when(F.size(months) == 1, _month(F.regexp_extract("_seen", HEADING, 2))))
    sections = F.filter(F.split("_seen", f"(?m)(?={DAY_LINE})"), lambda s: s.rlike(DAY_LINE))
    rows = rows.withColumn("_sections", F.when(F.col("_month").isNotNull(), sections).otherwise(F.array().cast("array<string>")))

    day_of = lambda s: _key(F.regexp_extract(s, r"^[ \t]*(\d+)", 1), F.col("_month"))
    # Columns of their own for what is used more than once: in a function of arrays it would be worked out for each element.
    rows = rows.withColumns({
        "_lines": F.transform("_sections", lambda s: F.struct(day_of(s).alias("key"), identity_words(s).alias("words"))),
        "_scalar": date_keys(F.col("_dates")), "_all": date_keys(F.concat_ws("\n", "_dates", "_seen")),
        "_title": identity_words(F.col("title")), "_people": identity_words(F.col("participants")),
    })
    lines = F.flatten(F.transform("_lines", lambda s: F.transform(s["words"], lambda w: F.struct(s["key"].alias("key"), w.alias("word")))))
    headed = F.size("_sections") > 0
    listed, scalar = F.col("_lines.key"), F.col("_scalar")
    of_month = F.filter("_all", lambda k: F.col("_month").isNull() | (F.substring(k, 1, 2).cast("int") == F.col("_month")))
    keys = F.when(headed, F.when(F.size(scalar) == 1, F.array_intersect(F.array_intersect(of_month, scalar), listed)).otherwise(F.array().cast("array<string>"))).otherwise(of_month)
    words = F.transform(F.array_union("_title", "_people"), lambda w: F.struct(w.alias("word"), F.array_contains("_title", w).alias("in_title")))
    confidence, readability = F.coalesce(F.col("confidence"), F.lit(70)), F.coalesce(F.col("readability"), F.lit(65))
    return rows.select(
        "source", "fact", "index", keys.alias("keys"), words.alias("words"), F.array_distinct(lines).alias("calendar"), headed.alias("headed"), F.col("_month").alias("month"),
        (F.floor(confidence / 10 + 0.5) + F.floor(readability / 20 + 0.5)).cast("int").alias("quality"),
        F.trim(F.regexp_replace(fold(text("venue")), "[^a-zа-я0-9$]+", " ")).alias("place"),
        F.coalesce("main", F.lit(False)).alias("main"), F.coalesce("sole", F.lit(False)).alias("sole"),
        F.coalesce(F.col("confidence"), F.lit(0)).cast("double").alias("confidence"), F.coalesce(F.col("readability"), F.lit(0)).cast("double").alias("readability"),
    )


def _enough(hits: Column, size: Column) -> Column:
    """Whether so many words of a title are enough to know it by."""
    return (hits >= 1) & ((size <= 2) | (hits >= 2) | (hits >= 0.6 * size))


def candidates(events: DataFrame, posters: DataFrame) -> DataFrame:
    """(source, id, fact, index, score, reason, titles, known): posters that may stand for an event, of read_facts' rows.

    Events and posters meet on source, day and a word in one equi-join, so no pair is made that shares no word; the pair's
    counts are summed before the shuffle, and only what is accepted meets its rows again.
    """
    title, people = F.col("_title"), F.col("_people")
    wide = events.withColumns({"_title": identity_words(F.col("title")), "_people": identity_words(F.col("participants"))}).select(
        "source", "id", "preferred", "only_one", F.date_format("day", "MM-dd").alias("key"), F.month("day").alias("in_month"), identity_words(F.col("venue")).alias("places"),
        F.size(title).alias("title_size"), F.size(F.array_union(title, people)).alias("size"),
        F.transform(F.array_union(title, people), lambda w: F.struct(w.alias("word"), F.array_contains(title, w).alias("t"), F.array_contains(people, w).alias("p"))).alias("words"),
    )
    asked = wide.where("key is not null").select("source", "id", "key", "title_size", "size", F.inline("words"))
    entry = lambda key, line, w, t: F.struct(key.alias("key"), F.lit(line).alias("line"), w.alias("word"), t.alias("in_title"))
    plain = F.flatten(F.transform("keys", lambda k: F.transform("words", lambda w: entry(k, False, w["word"], w["in_title"]))))
    lines = F.transform("calendar", lambda c: entry(c["key"], True, c["word"], F.lit(True)))
    offered = posters.select("source", "fact", "headed", F.inline(F.concat(plain, lines))).where("key is not null")

    met = asked.join(offered, ["source", "key", "word"])
    count = lambda c: F.count_if(c)
    line, t, p = F.col("line"), F.col("t"), F.col("p")
    pairs = met.groupBy("source", "id", "fact", "headed", "title_size", "size").agg(
        count(line & t).alias("line_titles"), count(line).alias("line_known"),
        count(~line & t).alias("titles"), count(~line & p).alias("people"), count(~line).alias("known"), count(~line & t & F.col("in_title")).alias("own_titles"),
    )
    n, size = F.col("title_size"), F.col("size")
    by_line = _enough(F.col("line_titles"), n) | (F.col("line_known") >= 2) | ((F.col("line_known") == 1) & (size <= 2))
    by_facts = _enough(F.col("titles"), n) | (F.col("known") >= 2) | ((F.col("known") == 1) & (size <= 2))
    by_facts = by_facts & (~F.col("headed") | _enough(F.col("own_titles"), n))
    pairs = pairs.withColumn("line", by_line).where(by_line | by_facts)

    rest = posters.select("source", "fact", "index", "quality", "place", "main", "confidence", "readability")
    full = pairs.join(rest, ["source", "fact"]).join(wide.select("source", "id", "places", "preferred"), ["source", "id"])
    venues = F.size(F.filter("places", lambda w: F.contains(F.col("place"), w)))
    bonus = F.col("titles") * 22 + F.col("people") * 12 + venues * 2 + F.col("quality")
    base = F.when(_enough(F.col("titles"), n), 170).when(F.col("known") >= 2, 145).otherwise(130)
    reason = F.when(F.col("titles") >= 2, "date+title-majority").otherwise("date+distinctive-title")
    reason = F.when(_enough(F.col("titles"), n), reason).when(F.col("known") >= 2, "date+identity-tokens").otherwise("date+distinctive-identity")
    order = ["main", "preferred", "confidence", "readability"]
    by_words = full.select(
        "source", "id", "fact", "index", *order,
        F.when(F.col("line"), 220 + 22 * F.col("line_known")).otherwise(base + bonus).cast("int").alias("score"),
        F.when(F.col("line"), "calendar-date+program").otherwise(reason).alias("reason"),
        F.when(F.col("line"), F.col("line_titles")).otherwise(F.col("titles")).cast("int").alias("titles"),
        F.when(F.col("line"), F.col("line_known")).otherwise(F.col("known")).cast("int").alias("known"),
    )
    # The one picture of a post with one event needs no words.
    lone = posters.where("sole and not headed").join(wide.where("only_one"), "source").where("coalesce(month = in_month, true)")
    alone = lone.select("source", "id", "fact", "index", *order, F.lit(125).alias("score"), F.lit("single-event-single-source-image").alias("reason"), F.lit(0).alias("titles"), F.lit(0).alias("known"))
    return by_words.join(alone.select("source", "id", "fact"), ["source", "id", "fact"], "left_anti").unionByName(alone)


def bind_posters(events: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, id, poster, status, reason, score, review) of each event (source, id, day, title, participants, venue, preferred).

    facts are (source, index, poster, image_type, confidence, readability, title, dates, venue, participants, recognized, main, sole),
    a row for each time a picture of a post was read; main says that it shows the whole event, sole that it is the post's one source picture. A
    picture may serve several events. First is the main poster, then the preferred one, then by score, confidence, readability and
    smaller index. Ids are unique within a post. A best one that leads by neither role, preference, words in common nor 18 points is not
    guessed: poster is 0, the status poster_review_required and review holds up to four (index, score, reason). Events without
    day, source or match get poster 0 and no_safe_poster; repeated facts count once; empty tables give no rows or no posters.
    Texts are NFKC already. More columns of either side do not matter.
    """
    events = events.select("source", "id", "day", "title", "participants", "venue", F.coalesce("preferred", F.lit(0)).alias("preferred"))
    seen = ["index", "poster", "image_type", "confidence", "readability", "title", "dates", "venue", "participants", "recognized", "main", "sole"]
    facts = facts.select("source", *seen, F.xxhash64(F.to_json(F.struct(*seen), {"ignoreNullFields": "false"})).alias("fact")).dropDuplicates(["source", "fact"])
    posts = events.where("source is not null").groupBy("source").agg(F.count("*").alias("_events"))
    shown = facts.where("source is not null and index > 0").groupBy("source").agg(F.count("*").alias("_facts"))
    events = events.join(posts.join(shown, "source", "left"), "source", "left")
    events = events.withColumn("only_one", (F.col("_events") == 1) & (F.col("_facts") == 1))

    # Cut here, as texts are read by many patterns, and what is read is asked for three times.
    found = candidates(graph.cut(events), graph.cut(read_facts(facts))).withColumn("chosen", (F.col("preferred") > 0) & (F.col("preferred") == F.col("index")))
    order = [F.desc("main"), F.desc("chosen"), F.desc("score"), F.desc("confidence"), F.desc("readability"), F.asc("index"), F.asc("fact")]
    place = F.row_number().over(Window.partitionBy("source", "id").orderBy(*order))
    few = found.withColumn("place", place).where(F.col("place") <= SHOWN)
    best = few.groupBy("source", "id").agg(F.array_sort(F.collect_list(F.struct("place", "index", "score", "reason", "titles", "known", "main", "chosen"))).alias("row"))
    first, second = F.col("row")[0], F.try_element_at("row", F.lit(2))
    leads = (first["main"] & ~second["main"]) | first["chosen"] | (first["titles"] > second["titles"]) | (first["known"] > second["known"]) | (first["score"] - second["score"] >= LEAST_LEAD)
    doubtful = (F.size("row") > 1) & ~leads
    best = best.select("source", "id", first.alias("first"), doubtful.alias("doubtful"), F.transform("row", lambda r: F.struct(r["index"].alias("index"), r["score"].alias("score"), r["reason"].alias("reason"))).alias("row"))
    out = events.join(best, ["source", "id"], "left")
    none, unsure = F.col("first").isNull(), F.coalesce(F.col("doubtful"), F.lit(False))
    status = F.when(none, "no_safe_poster").when(unsure, "poster_review_required").when(F.col("_events") > 1, "verified_multi_event_poster").otherwise("verified_single_event_source_media")
    missing = F.when(F.coalesce(F.col("_facts"), F.lit(0)) == 0, "missing-vision-facts").otherwise("no-safe-poster")
    return out.select(
        "source", "id",
        F.when(none | unsure, 0).otherwise(F.col("first.index")).alias("poster"),
        status.alias("status"),
        F.when(none, missing).when(unsure, "multiple-date-compatible-posters").otherwise(F.col("first.reason")).alias("reason"),
        F.when(none, 0).otherwise(F.col("first.score")).alias("score"),
        F.when(unsure, F.col("row")).alias("review"),
    )
