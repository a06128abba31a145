"""Near-duplicates in the ledger of what was processed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Weights of text and of the rest in the score, and of the rest's parts.
TEXT, REST = 0.85, 0.15
PARTS = {"source": 0.40, "item or url": 0.20, "attachments": 0.20, "observed": 0.20}


def attachments_similarity(a: Column, b: Column) -> Column:
    """Of arrays of addresses: those that both have, by the larger number; 1 if there are none on either side."""
    x, y = (F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda u: u != "")) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def near_duplicates(current: DataFrame, seen: DataFrame, threshold: float = 0.97) -> DataFrame:
    """(id, seen_id, similarity): for each current record the best of the ledger, if it is good enough.

    Both sides: id, source, item, url, text, attachments (array), observed (epoch seconds, 0 if unknown). From a threshold
    of 0.94 on the source must be the same, and so must the item, or the address, or (with equal attachments) the time to 5
    minutes, since otherwise the parts cannot add up. So partners are met by three equi-joins, and nothing is left out. From 0.97 on, those
    that only the time brings together need texts with all trigrams in common, and these are a key, too.
    Ties go to the smaller seen_id; null texts are empty.
    """
    if threshold <= TEXT + REST * 0.6:
        raise ValueError("the joins need a threshold above 0.94")
    rows = [
        r.select("id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("item", F.lit("")).alias("item"), tx.canonical_url(F.coalesce("url", F.lit(""))).alias("url"), tx.normal(F.coalesce("text", F.lit(""))).alias("text"), "attachments", F.coalesce("observed", F.lit(0)).alias("observed"))
        for r in (current, seen)
    ]
    x, y = rows[0].alias("x"), rows[1].alias("y")
    slot = F.floor(F.col("observed") / 300)
    # Without item and url the rest is 0.8 at most; two texts of unlike trigrams are never that near 1.
    equal = threshold >= TEXT + REST * 0.8 - 1e-12
    told = [r.where("observed > 0").withColumn("grams", F.xxhash64(F.array_sort(tx.grams(F.col("text")))) if equal else F.lit(0).cast("long")) for r in rows]
    timed = told[0].withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("x"), told[1].withColumn("slot", slot).alias("y")
    same = F.col("x.source") == F.col("y.source")
    arms = [
        x.join(y, same & (F.col("x.item") == F.col("y.item"))),
        x.join(y, same & (F.col("x.url") == F.col("y.url")) & (F.col("x.url") != "")),
        timed[0].join(timed[1], same & (F.col("x.slot") == F.col("y.slot")) & (F.col("x.grams") == F.col("y.grams")) & (F.abs(F.col("x.observed") - F.col("y.observed")) <= 300)),
    ]
    both = reduce(DataFrame.unionByName, (a.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")) for a in arms)).distinct()
    joined = both.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    text = F.when((F.col("x.text") == "") & (F.col("y.text") == ""), 1.0).when((F.col("x.text") == "") | (F.col("y.text") == ""), 0.0).when(F.col("x.text") == F.col("y.text"), 1.0).otherwise(tx.gram_dice(F.col("x.text"), F.col("y.text")))
    known = (F.col("x.observed") > 0) & (F.col("y.observed") > 0)
    near = (F.col("x.item") == F.col("y.item")) | ((F.col("x.url") != "") & (F.col("x.url") == F.col("y.url")))
    rest = PARTS["source"] + F.when(near, PARTS["item or url"]).otherwise(0.0) + PARTS["attachments"] * attachments_similarity(F.col("x.attachments"), F.col("y.attachments"))
    rest = rest + PARTS["observed"] * F.when(known, tx.observed_similarity(F.col("x.observed"), F.col("y.observed"))).otherwise(0.0)
    scored = joined.select(F.col("a").alias("id"), F.col("b").alias("seen_id"), (TEXT * text + REST * rest).alias("similarity")).where(F.col("similarity") >= threshold)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "seen_id"))
    return scored.withColumn("_place", place).where("_place = 1").drop("_place")
