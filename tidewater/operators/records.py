"""Small predicates and readings of records: optional tests, pools, retention, samples, audits, terms, tags, nested JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import dates
from ..functions import text as tx

#: Case endings that a searched word may have.
CASE_ENDINGS = ["а", "я", "у", "ю", "е", "и", "ы", "ой", "ом", "ем", "ов", "ев", "ам", "ям", "ами", "ями", "ах", "ях"]
#: Names under which a nested record refers to a message, and under which it lists several.
REFERENCES, LISTS = ["cmid", "sourceCmid", "conversation_message_id"], ["cmids"]


# -- predicates


def optional(column: Column, value) -> Column:
    """Equality with a value, or no test at all where there is none (None, 0 or empty)."""
    return column == value if value else F.lit(True)


def blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def active(flag: Column, expires: Column, now: Column) -> Column:
    """Switched on, and either without an end (0) or not yet at it."""
    return F.coalesce((flag == 1) & ((expires == 0) | (expires > now)), F.lit(False))


def pool(source: Column, stored: Column, text: Column, repertoire: Column, secondary: list[str]) -> Column:
    """primary or secondary. A repertoire is secondary; a known source decides; without one a stored label of secondary holds,
    and so does the name of a secondary source in the text."""
    named = F.coalesce(source, F.lit(""))
    listed = F.arrays_overlap(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\w:-]+"), F.array(*map(F.lit, secondary)).cast("array<string>"))
    return (
        F.when(F.coalesce(repertoire, F.lit(False)), "secondary").when(named != "", F.when(named.isin(secondary), "secondary").otherwise("primary"))
        .when((F.coalesce(stored, F.lit("")) == "secondary") | listed, "secondary").otherwise("primary")
    )


def clamped(value: Column, least: int, most: int) -> Column:
    """A whole number held between two bounds; what is no number, or 0, is the lower one."""
    number = value.try_cast("double")
    return F.greatest(F.lit(least), F.least(F.lit(most), F.when(number.isNull() | F.isnan(number) | (number == 0), least).otherwise(number.try_cast("long")))).cast("long")


def safe_count(value: Column) -> Column:
    """A number of 0 or more; 0 for what is none."""
    number = value.try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number).otherwise(0.0)


def first_number(record: Column, names: list[str]) -> Column:
    """The first of these fields (JSON paths) of a record that is a number of 0 or more, else 0."""
    each = [F.get_json_object(record, f"$.{n}").try_cast("double") for n in names]
    return F.coalesce(*(F.when((x >= 0) & (x < float("inf")), x) for x in each), F.lit(0.0))


# -- order, retention, samples


def by_priority(rows: DataFrame, priority: str, sequence: str) -> DataFrame:
    """The most urgent first, of equally urgent ones the earliest."""
    return rows.orderBy(F.desc(priority), F.asc(sequence))


def near(rows: DataFrame, key: str, at: int, radius: int, most: int = 85) -> DataFrame:
    """Rows whose key lies within a radius, in order, so many at most (the feature's own limit)."""
    return rows.where(F.col(key).between(at - radius, at + radius)).orderBy(key).limit(most)


def after(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page of so many rows behind the last key seen (None: the first page)."""
    return (rows if last is None else rows.where(F.col(key) > last)).orderBy(key).limit(size)


def outlived(rows: DataFrame, key: str, at: str, keep: int = 15) -> DataFrame:
    """What retention removes: all but the newest so many rows. Only the kept ones travel."""
    kept = rows.select(key, at).orderBy(F.desc(at), F.desc(key)).limit(keep)
    return rows.join(F.broadcast(kept.select(key)), key, "left_anti")


def draw(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys, the same on every partition and retry."""
    return F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 256)


def reservoirs(rows: DataFrame, kind: str, key: str, sizes: dict[str, int], seed: int = 17) -> DataFrame:
    """rows of each kind by a seeded draw of the size that the kind has, with how many of the kind were seen."""
    order = Window.partitionBy(kind).orderBy(draw(F.col(key), seed), key)
    size = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))
    seen = rows.where(F.col(kind).isin(list(sizes))).groupBy(kind).agg(F.count("*").alias("seen"))
    # The limit by rank applies in each partition before rows are shuffled.
    some = rows.where(F.col(kind).isin(list(sizes))).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max(sizes.values()))
    return some.where(F.col("_place") <= size[F.col(kind)]).drop("_place").join(F.broadcast(seen), kind)


# -- audit


def audit(cards: DataFrame, most_issues: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counters (one row), how often each reason for an unsafe poster occurs, and the first issues by id.

    cards: id, images (distinct paths), described (paths with metadata), reason (why the poster is unsafe, null if it is safe).
    """
    bare = F.size(F.array_except("images", "described"))
    n = F.size("images")
    unsafe = (n > 0) & F.col("reason").isNotNull()
    rows = cards.withColumns({"_n": n, "_bare": bare, "_unsafe": unsafe})
    counts = rows.agg(
        F.count("*").alias("cards"), F.count_if(F.col("_n") > 0).alias("with_images"), F.count_if(F.col("reason").isNull()).alias("safe"), F.count_if("_unsafe").alias("unverified"),
        F.count_if(F.col("_bare") > 0).alias("missing_metadata"), F.sum("_n").cast("long").alias("images"), F.sum("_bare").cast("long").alias("bare_images"),
        F.greatest(F.lit(0).cast("long"), F.count_if((F.col("_bare") > 0) | F.col("_unsafe")) - most_issues).alias("issues_cut"),
    )
    reasons = rows.where("_unsafe").groupBy("reason").agg(F.count("*").alias("cards"))
    issues = rows.where("_bare > 0 or _unsafe").orderBy("id").limit(most_issues).select("id", F.col("_n").alias("images"), F.col("_bare").alias("bare"), F.coalesce("reason", F.lit("verified")).alias("status"))
    return counts, reasons, issues


# -- terms and tags


def names_term(text: Column, term: str, prefix: bool = False) -> Column:
    """Whether a text has a term as a word, which may bear a case ending (several words: as they stand), or begins a word with it."""
    clean = " ".join(term.split())
    if not clean:
        return F.lit(False)
    ending = "" if prefix or " " in clean else f"(?:{'|'.join(CASE_ENDINGS)})?"
    close = "" if prefix and " " not in clean else r"(?=$|[^\p{L}\p{N}_])"
    escaped = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", clean)
    return F.coalesce(text.rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_]){escaped}{ending}{close}"), F.lit(False))


def _variants(word: str) -> list[str]:
    """A word, a long verb without its infinitive's ending, a long name without its case's, and both spellings of the one nickname."""
    # The endings that are taken off, and the nickname.
    bare = [word]
    if len(word) >= 5 and len(stem := re.sub(r"(?i)(?:ться|тись|ть|ти)$", "", word)) >= 4:
        bare.append(stem)
    if len(word) >= 7 and len(stem := re.sub(r"(?i)(?:ами|ями|ом|ем|а|я|у|ю|е|и|ы)$", "", word)) >= 6:
        bare.append(stem)
    nick = re.compile(r"(?i)(владисл)[еэ](йв)")
    return bare + [nick.sub(rf"\1{x}\2", w) for w in bare if nick.search(w) for x in "эе"]


def _terms(words: list[str], most: int) -> list[str]:
    """The first of each spelling, letters' case aside."""
    found: dict[str, str] = {}
    for w in words:
        found.setdefault(w.lower(), w)
    return [w for k, w in found.items() if k][:most]


def _words(text: str, least: int, stop: set[str], keep: str = "") -> list[str]:
    clean = (re.sub(rf"[^\w{keep}]+", "", w) for w in text.split())
    return [w for w in clean if len(w) >= least and w.lower() not in stop]


def expanded(question: str, stop: set[str], most: int = 10) -> list[str]:
    """Search terms of a question, all of which are alternatives: itself, its words of 3 letters or more that are no stop words,
    and long words without an ending."""
    return _terms([" ".join(question.split()), *(x for w in _words(question, 3, stop) for x in _variants(w))], most)


def alternatives(question: str, stop: set[str], most: int = 24) -> list[str]:
    """Terms of a question that names several things: each part between или, либо and и, of 4 letters or more, with its variants."""
    parts = [re.sub(r"[^\w-]+", "", p) for p in re.split(r"(?i)\s+(?:или|либо|и)\s+", " ".join(question.split()))]
    return _terms([x for p in parts if len(p) >= 4 and p.lower() not in stop for x in _variants(p)], most)


def clause_terms(clause: str, stop: set[str], most: int = 8) -> list[str]:
    """Terms of a clause: its words without those that only tell the time or that one goes, unless it has no others."""
    # Words that are left out.
    weak = "сегодня завтра вчера сейчас идет идёт пойдет пойдёт будет".split()
    words = _words(re.sub(r"[,:;!?()\[\]{}—–-]+", " ", clause), 3, stop)
    return _terms([x for w in [w for w in words if w.lower() not in weak] or words for x in _variants(w)], most)


def _holds(text: Column, compact: Column, alias: str) -> Column:
    name = " ".join(re.split(r"[^\w]+", alias.lower())).strip()
    return F.contains(text, F.lit(name)) | F.contains(compact, F.lit(name.replace(" ", "")))


def tags(text: Column, taxonomy: dict[str, list[str]], most: int = 16) -> Column:
    """Sorted tags of whose aliases a text holds one, with or without spaces, so many at most (the feature's own limit)."""
    body = tx.normal(text)
    compact = F.replace(body, F.lit(" "), F.lit(""))
    hits = [F.when(F.array_max(F.array(*(_holds(body, compact, a) for a in names))), F.lit(tag)) for tag, names in sorted(taxonomy.items())]
    return F.slice(F.array_compact(F.array(*hits)), 1, most)


def venue_key(text: Column, venues: dict[str, list[str]]) -> Column:
    """The venue whose longest alias a text holds; else the first that shares a word of 4 letters or more; else empty."""
    body = tx.normal(text)
    compact = F.replace(body, F.lit(" "), F.lit(""))
    pairs = sorted(((a, k) for k, names in venues.items() for a in names), key=lambda x: (-len(x[0]), x[0]))
    words = tx.words(text, 4)
    out = F.lit("")
    for key, names in reversed(list(venues.items())):
        own = sorted({w for a in names for w in re.split(r"[^\w]+", a.lower()) if len(w) >= 4})
        if own:
            out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, own))), key).otherwise(out)
    for alias, key in reversed(pairs):
        out = F.when(_holds(body, compact, alias), key).otherwise(out)
    return out


def metadata(text: Column, reference: Column, venues: dict[str, list[str]]) -> Column:
    """struct(days, time, price, age, links, venue) that a text says of an event: dates as `dates.mentions` reads them, the first
    clock time, the least price in roubles (0 if it says free), the age from which one is let in, addresses, the venue's key.
    What is not said is null, or empty for arrays and the venue; a null text says nothing."""
    said = F.coalesce(text, F.lit(""))
    first = lambda p, g=1: F.nullif(F.regexp_extract(said, p, g), F.lit(""))
    clock = r"(?<![\d:.])([01]?\d|2[0-3]):([0-5]\d)(?![\d:])"
    prices = F.transform(F.regexp_extract_all(said, F.lit(r"(?i)(?<![\d.])(\d{1,6})\s*(?:₽|руб)"), F.lit(1)), lambda x: x.cast("long"))
    price = F.when(F.lower(said).rlike(r"(?<!\p{L})(?:free|бесплатн)"), F.lit(0).cast("long")).when(F.size(prices) > 0, F.array_min(prices))
    return F.struct(
        dates.mentions(said, reference).alias("days"),
        F.when(first(clock).isNotNull(), F.concat(F.lpad(first(clock), 2, "0"), F.lit(":"), first(clock, 2))).alias("time"),
        price.alias("price"),
        first(r"(?<![\d+])(0|6|12|16|18)\s?\+(?!\d)").cast("int").alias("age"),
        F.array_distinct(F.regexp_extract_all(said, F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))).alias("links"),
        venue_key(said, venues).alias("venue"),
    )


def title_tokens(title: Column, venues: list[str], stop: list[str]) -> Column:
    """Words of a title that may name an event: without venues' names, of over 3 letters, no numbers, no stop or format words."""
    body = F.concat(F.lit(" "), tx.normal(title), F.lit(" "))
    for name in sorted(venues, key=len, reverse=True):
        body = F.replace(body, F.lit(f" {' '.join(re.split(r'[^\w]+', name.lower())).strip()} "), F.lit(" "))
    return F.filter(tx.words(body, 4), lambda w: ~w.isin(stop)) if stop else tx.words(body, 4)


# -- nested records


@F.pandas_udf(ArrayType(LongType()))
def references(record: pd.Series) -> pd.Series:
    """Sorted message ids that a JSON record names at any depth up to 12; what is no JSON names none."""

    def walk(value, out: set[int], depth: int) -> None:
        if depth > 12 or not isinstance(value, (dict, list)):
            return
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
            if key in REFERENCES and _positive(inner):
                out.add(_positive(inner))
            elif key in LISTS and isinstance(inner, list):
                out.update(filter(None, map(_positive, inner)))
            else:
                walk(inner, out, depth + 1)

    def one(text: str | None) -> list[int]:
        out: set[int] = set()
        try:
            walk(json.loads(text or "null"), out, 0)
        except (ValueError, RecursionError):
            pass
        return sorted(out)

    return record.map(one)


def _positive(value) -> int:
    try:
        return int(value) if not isinstance(value, bool) and 0 < int(value) < 2**63 and float(value) == int(value) else 0
    except (TypeError, ValueError, OverflowError):
        return 0


PHOTOS = "from_id long, conversation_message_id long, attachments array<struct<type:string, photo:struct<id:long, sizes:array<struct<url:string, width:long, height:long>>>>>"


def photos(record: Column, sender: Column, cmid: Column, most: int = 7) -> Column:
    """struct(integrity, photos) of a JSON message: of each photo the largest size that has an address, so many at most (the
    feature's own limit); none if the message names another sender or number than its row."""
    body = F.from_json(record, PHOTOS)
    differs = lambda raw, real: F.coalesce((raw != 0) & (real != 0) & (raw != real), F.lit(False))
    wrong = differs(body["from_id"], sender) | differs(body["conversation_message_id"], cmid)
    area = lambda s: F.coalesce(s["width"], F.lit(0)) * F.coalesce(s["height"], F.lit(0))
    best = lambda p: F.element_at(F.array_sort(F.filter(p["sizes"], lambda s: s["url"] != ""), lambda a, b: F.when(area(a) > area(b), -1).when(area(a) < area(b), 1).otherwise(0)), 1)
    own = F.filter(body["attachments"], lambda a: (a["type"] == "photo") & a["photo"].isNotNull() & (F.size(F.filter(a["photo"]["sizes"], lambda s: s["url"] != "")) > 0))
    each = F.transform(own, lambda a: F.struct(a["photo"]["id"].alias("id"), best(a["photo"])["url"].alias("url")))
    kind = "array<struct<id:bigint,url:string>>"
    none = F.array().cast(kind)
    return F.struct(F.when(wrong, "mismatched-original").otherwise("ok").alias("integrity"), F.when(wrong, none).otherwise(F.slice(F.coalesce(each.cast(kind), none), 1, most)).alias("photos"))
