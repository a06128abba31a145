"""Participant activity over a live feed and an archive of the same messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconciled(archive: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """The archive, and those live messages whose key it lacks.

    The key decides what counts as the same message: with created_at, a reused id is a message of its own.
    """
    return archive.unionByName(live.join(archive.select(key).distinct(), key, "left_anti"))


def activity(messages: DataFrame) -> DataFrame:
    """(sender_id, messages, last_at)."""
    return messages.groupBy("sender_id").agg(F.count("*").alias("messages"), F.max("created_at").alias("last_at"))


def latest(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def listed(rows: DataFrame, keys: list[str], at: str, title: str, unique: str, collation: str = "ru") -> DataFrame:
    """rows with `shown` (the time, 23:59 if unknown) and their place in each key's listing: by time, title under a collation, and the unique column."""
    rows = rows.withColumn("shown", F.coalesce(at, F.lit("23:59")))
    order = Window.partitionBy(*keys).orderBy("shown", F.collate(F.col(title), collation), unique)
    return rows.withColumn("place", F.row_number().over(order))


def dossiers(messages: DataFrame, most: int = 220, least: int = 6) -> DataFrame:
    """(sender_id, messages, chats, last_at): how many of a person's newest messages count, and in how many chats they stand.

    messages: sender_id, chat_id, created_at, cmid, text, outgoing, action. Only text of so many characters counts, neither sent by the
    archive's owner nor an action of the chat; the bound on the newest ones is the feature's own. Rows leave their partition only if
    they are among its newest, so a person with a third of all messages costs no more than others.
    """
    said = (F.length(F.trim("text")) >= least) & ~F.coalesce("outgoing", F.lit(False)) & (F.coalesce("action", F.lit("")) == "")
    newest = latest(messages.where(said & F.col("sender_id").isNotNull()), ["sender_id"], [F.desc("created_at"), F.desc("cmid")], most)
    return newest.groupBy("sender_id").agg(F.count("*").alias("messages"), F.countDistinct("chat_id").alias("chats"), F.max("created_at").alias("last_at"))


def inactive(messages: DataFrame, membership: DataFrame, names: DataFrame, now: int, least: int = 16, days: int = 14) -> DataFrame:
    """Named participants with enough messages, silent for so many days, who have not left.

    membership: sender_id, event (joined, left, kicked), at, cmid; names: sender_id, full_name.
    """
    last = latest(membership, ["sender_id"], [F.desc("at"), F.desc("cmid"), F.desc("event")]).select("sender_id", "event")
    joined = membership.where("event = 'joined'").groupBy("sender_id").agg(F.max("at").alias("joined_at"))
    found = activity(messages).join(last, "sender_id", "left").join(joined, "sender_id", "left").join(names, "sender_id", "left")
    seen = F.greatest("last_at", F.coalesce("joined_at", F.lit(0)))
    ok = (F.col("messages") >= least) & (seen <= now - days * 86400) & ~F.coalesce(F.col("event").isin("left", "kicked"), F.lit(False))
    return found.where(ok & (F.coalesce("full_name", F.lit("")) != "")).select("sender_id", "full_name", "messages", seen.alias("seen_at"))


def top_senders(messages: DataFrame, start: int, end: int, limit: int = 30) -> DataFrame:
    """Most messages in [start, end), ties to the smaller id."""
    inside = messages.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    return inside.groupBy("sender_id").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "sender_id").limit(limit)


def reactions(messages: DataFrame, counters: DataFrame, tracked: DataFrame) -> DataFrame:
    """Reactions given and received by the tracked senders, each with whether it is fully known.

    counters: cmid, counters array<struct<reaction_id int, count int, user_ids array<bigint>>>, null where a
    message has no data. Missing is not zero: received is known if every message of the author has data,
    given only if every message has data and every count names all its users.
    """
    data = messages.join(counters, "cmid", "left")
    each = data.select("cmid", "sender_id", "counters", F.explode_outer("counters").alias("c"))
    received = each.groupBy("sender_id").agg(F.sum(F.coalesce("c.count", F.lit(0))).alias("received"), F.bool_and(F.col("counters").isNotNull()).alias("received_known"))
    complete = each.agg(
        F.coalesce(F.bool_and(F.col("counters").isNotNull() & (F.col("c").isNull() | (F.size("c.user_ids") >= F.col("c.count")))), F.lit(True)).alias("given_known")
    )
    given = each.select(F.explode("c.user_ids").alias("sender_id")).groupBy("sender_id").agg(F.count("*").alias("given"))
    found = tracked.join(received, "sender_id", "left").join(given, "sender_id", "left").crossJoin(F.broadcast(complete))  # one row
    return found.select("sender_id", "messages", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("received_known", F.lit(True)).alias("received_known"), F.coalesce("given", F.lit(0)).alias("given"), "given_known")


def shown(count: str, known: str) -> Column:
    """n if known, >=n if not but above 0, else a dash."""
    return F.when(F.col(known), F.col(count).cast("string")).when(F.col(count) > 0, F.concat(F.lit("≥"), F.col(count).cast("string"))).otherwise("—")
