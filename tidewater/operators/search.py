"""Ranked text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, normal

#: Endings that the light stemmer takes off, in the order in which they are tried.
ENDINGS = [
    "иями", "ями", "ами", "евами", "овами", "иями", "ого", "его", "ому", "ему", "ыми", "ими", "иях", "ах", "ях", "ов", "ев", "ей", "ий", "ый", "ой", "ая", "яя", "ое", "ее", "ие", "ые",
    "ую", "юю", "ам", "ям", "ом", "ем", "им", "ым", "их", "ых", "ою", "ею", "ы", "и", "а", "я", "у", "ю", "е", "о", "ь",
]
POINTS = {"exact": 6.0, "stem": 3.2, "prefix": 1.8}


def stem(word: Column) -> Column:
    """Words of 5 letters or more, without digits, lose the first of the endings after which 4 letters stay."""
    out = word
    for ending in reversed(ENDINGS):
        left = F.length(word) - len(ending)
        out = F.when(F.endswith(word, F.lit(ending)) & (left >= 4), F.substr(word, F.lit(1), left)).otherwise(out)
    return F.when((F.length(word) < 5) | word.rlike(r"\d|^@"), word).otherwise(out)


def rank(rows: DataFrame, question: str, limit: int = 5, least: float = 8.0) -> DataFrame:
    """(id, score, coverage) of the best rows (id, text, created_at) for a question.

    Each word of the question counts its best match in a row: the word itself, its stem, or a common
    prefix of 4 or more, times the rarity 1 / (1 + log2 of the row frequency). Phrases of 2 to 4 words
    add min(12, 4 + 2 words), coverage adds 8, a single exact word 3. A row needs `least` points, and an
    exact word or two others.
    """
    asked = list(dict.fromkeys(w for w in _words(question) if len(w) > 1))
    if not asked:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage")).limit(0)
    phrases = [" ".join(asked[i : i + n]) for n in (2, 3, 4) for i in range(len(asked) - n + 1)]
    spark = rows.sparkSession
    texts = rows.select("id", "created_at", normal(F.col("text")).alias("text"))
    words = texts.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''")
    wanted = spark.createDataFrame([(w,) for w in asked], "asked string").select("asked", stem(F.col("asked")).alias("asked_stem"))
    # A word matches by itself, its stem or a prefix of 4 letters, and each of these has the first letters of a question word.
    starts = sorted({w[: min(4, len(w))] for w in asked})
    words = words.where(F.col("word").isin(asked) | reduce(lambda p, q: p | q, (F.startswith("word", F.lit(x)) for x in starts)))
    # The question is a handful of words, and what is left meets each: a filter, not a join of large sides.
    kind = (
        F.when(F.col("word") == F.col("asked"), "exact").when(stem(F.col("word")) == F.col("asked_stem"), "stem")
        .when((F.least(F.length("word"), F.length("asked")) >= 4) & (F.startswith("word", "asked") | F.startswith("asked", "word")), "prefix")
    )
    hits = words.crossJoin(F.broadcast(wanted)).withColumn("kind", kind).where("kind is not null")
    frequency = hits.select("word", "id").distinct().groupBy("word").agg(F.count("*").alias("df"))
    order = F.when(F.col("kind") == "exact", 3).when(F.col("kind") == "stem", 2).otherwise(1)
    points = F.when(F.col("kind") == "exact", POINTS["exact"]).when(F.col("kind") == "stem", POINTS["stem"]).otherwise(POINTS["prefix"])
    best = hits.join(frequency, "word").groupBy("id", "asked").agg(F.max(F.struct(order.alias("order"), F.col("word"), (points / (1 + F.log2("df"))).alias("points"))).alias("best"))
    sums = best.groupBy("id").agg(F.sum("best.points").alias("points"), F.count("*").alias("matched"), F.count_if(F.col("best.order") == 3).alias("exact"))
    phrase = sum((F.when(F.contains("text", F.lit(p)), min(12, 4 + 2 * len(p.split()))).otherwise(0) for p in phrases), F.lit(0))
    coverage = F.col("matched") / len(asked)
    score = F.col("points") + phrase + 8 * coverage + F.when((F.col("exact") == 1) & F.lit(len(asked) == 1), 3).otherwise(0)
    found = sums.join(texts, "id").select("id", "created_at", F.round(score, 3).alias("score"), F.round(coverage, 3).alias("coverage"), "exact", "matched")
    found = found.where((F.col("score") >= least) & ((F.col("exact") > 0) | (F.col("matched") >= 2)))
    return found.orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(limit).select("id", "score", "coverage")


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in folded(text)).split()
