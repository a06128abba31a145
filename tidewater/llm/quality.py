"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are strings of `ORDER` bytes of UTF-8 text as it stands, so no vocabulary is needed
and a context has 256 successors at most. Texts stay in blocks. A block sends each of its distinct
n-grams once, with its count in trusted text. The counts are summed by shard; from there on all is joins
and aggregates on n-gram tables: adjusted counts of the lower orders, counts of counts and the three
discounts of every order, backoff weights of the contexts, and the probability of every n-gram that any
document holds, from the unigrams upward. All keys of these joins are met by 256 rows at most. The
logarithms go back to the blocks that asked, where each document's are added up.

A document's perplexity is per byte, with `PRIOR` bytes of its language's usual text added, since a few
bytes tell little. The threshold of a language comes from quantiles of the perplexity of trusted texts
that the model has not seen (every eighth): the median, plus `SPREAD` times the way from there to the
95 % quantile. Documents above it are rejected. A language without such texts takes the quantiles of all.

Defined cases: a null text is empty; a text of fewer than ORDER bytes has its language's usual
perplexity; rows without doc_id are scored but never trusted; label rows that are repeated or whose
quality is not 1 do not add trust; without any trusted text nothing is rejected, threshold and
perplexity are null; a null lang is a language of its own; each row has its own result; extra columns
are ignored; empty tables give an empty result. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import MESSAGES, Buckets, answers, arrays, joined, message, messages, packed, planes, rows
from .common import NULL_ID, real_id, table, written

ORDER, PRIOR, SPREAD, FOLD = 5, 64, 3.0, 8
BLOCK_BYTES, PART_BYTES, CHUNK = 12 << 20, 4 << 20, 1 << 18
#: Names that a block gathers before it merges equal ones.
GATHERED = 1 << 20
#: Slots of a block's table of logarithms.
SLOTS = 20


def grams(data: np.ndarray) -> np.ndarray:
    """The number of the ORDER bytes at each position."""
    n = len(data) - ORDER + 1
    out = data[:n].astype(np.uint64)
    for k in range(1, ORDER):
        out <<= np.uint64(8)
        out |= data[k : k + n]
    return out


def inside(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Marks the positions below n where an n-gram of one of these texts begins."""
    edge = np.zeros(n + 1, np.int8)
    some = size >= ORDER
    edge[start[some]] += 1
    edge[start[some] + size[some] - ORDER + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def distinct(row: dict, trusted: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams, sorted, and how often trusted text has each."""
    data = np.frombuffer(row["data"], np.uint8)
    dk, start, size = (np.frombuffer(row[c], np.int64) for c in ("dk", "start", "size"))
    trust = np.array([x in trusted for x in dk.tolist()], bool)
    n = max(0, len(data) - ORDER + 1)
    every, good = inside(start, size, n), inside(start[trust], size[trust], n)
    found, count = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a in range(0, n, CHUNK):
        some = every[a : a + CHUNK]
        codes = grams(data[a : a + CHUNK + ORDER - 1])[: len(some)] << np.uint64(1) | good[a : a + CHUNK]
        code, times = np.unique(codes[some], return_counts=True)
        found.append(code >> np.uint64(1))
        count.append(times * (code & np.uint64(1)).astype(np.int64))
        if sum(map(len, found[1:])) > GATHERED:
            name, total = _merged(found, count)
            found, count = [name], [total]
    return _merged(found, count)


def _merged(found: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    name, of = np.unique(np.concatenate(found), return_inverse=True)
    return name, np.bincount(of, weights=np.concatenate(count), minlength=len(name)).astype(np.int64)


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                name, count = distinct(row, {dk for dk, fold in answers(row, 1).items() if fold == b"train"})
                buckets = Buckets(name, parts)
                count = count[buckets.order]
                yield messages([message(p, row["block"], buckets.name[s], count[s]) for p, s in buckets.slices()])

    return run


def _sum(group: pa.Table) -> pa.Table:
    got = [arrays(b, np.uint64, np.int64) for b in group.column("body").to_pylist()]
    name, of = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate([n for _, n in got]), minlength=len(name)).astype(np.int64)
    part = np.full(len(name), group.column("part")[0].as_py())
    return pa.table({"part": pa.array(part), "gram": pa.array(name.view(np.int64)), "n": pa.array(total)})


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    gram = known.column("gram").to_numpy()
    order = np.argsort(gram)
    gram, logs = gram[order].view(np.uint64), known.column("p").to_numpy()[order].astype(np.float32)
    out = []
    for part, block, body in zip(*(asked.column(c).to_pylist() for c in ("part", "block", "body"))):
        name = arrays(body, np.uint64, np.int64)[0]
        out.append((part, block, planes(logs[np.searchsorted(gram, name)])))
    return pa.Table.from_batches([messages(out)])


# -- the model


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of one order from its counts of counts (0.5 of a count where those are missing)."""
    n = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = counts.agg(*n).first()
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def _by_count(count: Column, values: tuple[float, float, float]) -> Column:
    return F.when(count == 1, values[0]).when(count == 2, values[1]).otherwise(values[2])


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(part, gram, p): the natural logarithm of each n-gram's last byte's probability after the others.

    counts: part, gram, n, where n counts trusted text and may be 0.
    """
    low = lambda k: F.col("gram").bitwiseAND(F.lit(256**k - 1))
    seen, need = {order: counts.where("n > 0").select("gram", "n")}, {order: counts.select("part", "gram")}
    for k in range(order - 1, 0, -1):
        seen[k] = written(seen[k + 1].groupBy(low(k).alias("gram")).agg(F.count("*").alias("n")))
        need[k] = need[k + 1].select(low(k).alias("gram")).distinct()
    below = None
    for k in range(1, order + 1):
        d = discounts(seen[k])
        cut = seen[k].withColumn("cut", _by_count(F.col("n"), d))
        context = cut.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        p = need[k].join(cut, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(context, "context", "left")
        own = F.coalesce((F.col("n") - F.col("cut")) / F.col("total"), F.lit(0.0))
        rest = F.coalesce(F.col("left") / F.col("total"), F.lit(1.0))
        if below is None:
            p = p.withColumn("p", own + rest / 256)
        else:
            p = p.withColumn("suffix", low(k - 1)).join(below, "suffix").withColumn("p", own + rest * F.col("lower"))
        if k < order:
            below = written(p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")))
    return p.select("part", "gram", F.log("p").alias("p"))


# -- scores


def log_sums(row: dict, name: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Per text of a block, the sum of its n-grams' logarithms."""
    data = np.frombuffer(row["data"], np.uint8)
    start, size = (np.frombuffer(row[c], np.int64) for c in ("start", "size"))
    slot = lambda g: (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
    first = np.zeros(1 << SLOTS, np.int32)
    first[slot(name)] = np.arange(len(name))
    n = max(0, len(data) - ORDER + 1)
    every, at = inside(start, size, n), 0.0
    ends = np.stack([start, start + np.maximum(size - ORDER + 1, 0)]).clip(0, n)
    before = np.zeros(ends.shape)  # the sum of all that stands before these positions
    for a in range(0, n, CHUNK):
        code = grams(data[a : a + CHUNK + ORDER - 1])
        index = first[slot(code)]
        lost = np.nonzero((name[index] != code) & every[a : a + CHUNK])[0]
        index[lost] = np.searchsorted(name, code[lost])
        sums = np.cumsum(np.where(every[a : a + CHUNK], logs[index], 0), dtype=np.float64)
        here = (ends > a) & (ends <= a + len(code))
        before[here] = at + sums[ends[here] - a - 1]
        at += sums[-1]
    return np.where(size >= ORDER, before[1] - before[0], 0.0)


SCORES = "dk long, th long, lang string, n_bytes long, n long, logs double"


def _score(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                # Replies are logarithms in the order of the block's names, which are found once more: cheaper than sent.
                buckets = Buckets(distinct(row, set())[0], parts)
                logs = buckets.answered(answers(row, 1), np.float32)[buckets.of]
                name = buckets.name[buckets.of]
                logs = log_sums(row, name, logs) if len(name) else np.zeros(len(row["lang"]))
                start, size = (np.frombuffer(row[c], np.int64) for c in ("start", "size"))
                th = [xxhash.xxh64_intdigest(row["data"][a : a + n], 42) for a, n in zip(start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["dk"], np.int64)), pa.array(np.array(th, np.uint64).view(np.int64)), pa.array(row["lang"], pa.string()), pa.array(size), pa.array(np.maximum(size - ORDER + 1, 0)), pa.array(logs)],
                    ["dk", "th", "lang", "n_bytes", "n", "logs"],
                )

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in rows(batch):
            dk = np.frombuffer(row["dk"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dk), row["block"])), pa.array(dk)], ["block", "dk"])


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(dk, th, lang, n_bytes, perplexity, threshold, kept) of each row; trusted: doc_id of trusted documents.

    th is xxhash64 of the text, so that (dk, th) tells rows apart as far as their results differ.
    """
    blocks = packed(docs, ORDER, BLOCK_BYTES, "lang" if "lang" in docs.columns else None)
    parts = max(1, int(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // PART_BYTES)
    body = blocks.select("block", "data", "dk", "start", "size", "lang")
    fold = F.when(F.pmod(F.xxhash64("dk"), F.lit(FOLD)) == FOLD - 1, "test").otherwise("train")
    trusted = trusted.select(F.col("doc_id").cast("long").alias("dk")).where("dk is not null").distinct().withColumn("fold", fold)
    owners = blocks.select("block", "dk").mapInArrow(_owners, "block long, dk long").where(F.col("dk") != NULL_ID)
    told = owners.join(trusted, "dk").select(F.col("dk").alias("part"), "block", F.col("fold").cast("binary").alias("body"))
    asked = written(joined(body, told.distinct()).mapInArrow(_ask(parts), MESSAGES))
    counts = written(asked.groupBy("part").applyInArrow(_sum, "part long, gram long, n long"))
    known = probabilities(counts)
    replies = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_answer, MESSAGES)
    scores = written(joined(body, replies).mapInArrow(_score(parts), SCORES).withColumn("tongue", F.coalesce("lang", F.lit(""))))
    # Usual text of a language: that of its trusted documents, or of all trusted documents.
    unseen = scores.join(trusted.where("fold = 'test'"), "dk").select("tongue", "n", "logs")
    means = written(unseen.groupBy("tongue").agg((F.sum("logs") / F.sum("n")).alias("mean")))
    overall = unseen.agg(F.sum("logs") / F.sum("n")).first()[0]
    overall = F.lit(overall).cast("double")

    def measured(rows_: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", overall)
        return rows_.join(means, "tongue", "left").withColumn("perplexity", F.exp(-(F.col("logs") + PRIOR * mean) / (F.col("n") + PRIOR)))

    middle, high = (F.percentile_approx("perplexity", q, 10_000) for q in (0.5, 0.95))
    cut = (middle + SPREAD * (high - middle)).alias("threshold")
    tested = measured(unseen)
    by_lang = written(tested.groupBy("tongue").agg(cut))
    general = F.lit(tested.agg(cut).first()[0]).cast("double")
    found = measured(scores).join(by_lang, "tongue", "left").withColumn("threshold", F.coalesce("threshold", general))
    return found.select("dk", "th", "lang", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexities(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return found.select(real_id(), "n_bytes", "perplexity", "threshold", "kept")
