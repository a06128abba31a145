"""Exact top-k search with a bit-sliced index.

Rows are packed into blocks. A block holds, for each component, the bit slices of its quantised value
as bitmaps over the block's rows. For a query, the slices of all components are added with bitmap
arithmetic: component weights are broken into powers of two, equal powers are summed by carry-save
adders over whole bitmaps, and the result is the bit-sliced score of every row in the block. Only the
upper slices of the components are added, so this is the score up to a known slack. Walking from the
most significant score slice downward gives the k-th highest value; the rows that the slack leaves
possible are the boundary rows, whose scores are then computed exactly from the block's integers.

Queries are packed into blocks too, of QUERIES each, and dealt to every group of index blocks, so the work is a
stated query set against all rows, block by block, and an index block is read once for so many queries; nothing is broadcast or collected. Each block yields at
most k rows a query, and partial limits apply before the final ranking is shuffled.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take
no part, nor do vectors whose length is not dim (None: the most frequent length); ties go to the
smaller vec_id; rows that bear the query's vec_id are not its candidates; repeated rows are candidates
each, repeated queries give one result; empty tables give an empty result; extra columns are ignored.
Quantised components beyond 2^62 - 1 in size count as that number, and scores beyond 64 bits as the nearest
64-bit number; up to there all is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ints, shuffle_partitions, table, written
from .vectors import matrix

#: Rows of a block, queries of a query block, slices of a component that are added.
ROWS, QUERIES, UPPER = 8192, 1024, 5
#: The largest size of a quantised component.
MOST = 2**62 - 1


def dimension(rows: DataFrame) -> int:
    """The most frequent length of a vector (ties: the smaller); 0 without vectors."""
    found = rows.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        whole = np.floor(scale * values)
    inside = np.abs(whole) < float(MOST)
    return np.where(inside, np.where(inside, whole, 0).astype(np.int64), np.where(whole > 0, MOST, -MOST))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with a query, as far as 64 bits hold them."""
    if len(rows) and float(np.abs(rows).max()) * float(np.abs(query).astype(np.float64).sum()) >= 2.0**62:
        wide = rows.astype(object) @ query.astype(object)
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in wide], np.int64)
    return rows @ query


def narrow(values: np.ndarray) -> bytes:
    """Integers as 32-bit ones where they fit, else as 64-bit ones."""
    return values.astype(np.int32 if values.size == 0 or np.abs(values).max() < 2**31 else np.int64).tobytes()


def widened(body: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(body, np.int64 if n * dim and len(body) == 8 * n * dim else np.int32).reshape(n, dim)


def _pack(dim: int, scale: float, limit: int):
    """Blocks of at most limit rows, each sorted by vec_id: ids, integers, and their bit slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = np.empty(0, np.int64), np.empty((0, dim), np.int64)

        def block(size: int) -> pa.RecordBatch:
            nonlocal ids, values
            order = np.argsort(ids[:size], kind="stable")
            some, ints_ = ids[:size][order], values[:size][order]
            ids, values = ids[size:], values[size:]
            low = ints_.min(axis=0)
            width = max(1, int(ints_.max() - low.min()).bit_length()) if size else 1
            above = ints_ - low
            slices = np.stack([np.packbits((above >> b & 1).astype(np.uint8).T, axis=1, bitorder="little") for b in range(width)])
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x], pa.binary()) for x in (some.tobytes(), narrow(ints_), low.tobytes(), slices.tobytes()))],
                ["n", "width", "ids", "ints", "low", "slices"],
            )

        for batch in batches:
            rows, vectors = matrix(batch.column("embedding"), dim)
            ids = np.concatenate([ids, ints(batch.column("vec_id"))[rows].astype(np.int64)])
            values = np.concatenate([values, quantised(vectors, scale)])
            while len(ids) >= limit:
                yield block(limit)
        if len(ids):
            yield block(len(ids))

    return run


BLOCK = "n int, width int, ids binary, ints binary, low binary, slices binary"


def _words(bits: np.ndarray) -> np.ndarray:
    """Bitmaps as rows of 64-bit words."""
    pad = -bits.shape[-1] % 8
    return np.ascontiguousarray(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])).view(np.uint64)


def added(maps: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bit slices, least first, of the sum of all bitmaps, each counted 2**weight times."""
    out, weight = [], 0
    while weight <= max(maps, default=-1):
        stack = np.concatenate(maps.get(weight) or [np.zeros((0, words), np.uint64)])
        carries = maps.setdefault(weight + 1, []) if len(stack) > 1 else []
        while len(stack) > 2:
            t = len(stack) // 3
            a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
            half = a ^ b
            carries.append(a & b | c & half)
            stack = np.concatenate([half ^ c, stack[3 * t :]])
        if len(stack) == 2:
            carries.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        weight += 1
    return out


def kth(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th highest value among rows, from the most significant slice downward."""
    equal, value, need = rows, 0, k
    for weight in range(len(slices) - 1, -1, -1):
        ones = equal & slices[weight]
        count = int(np.bitwise_count(ones).sum())
        if count >= need:
            equal = ones
            value |= 1 << weight
        else:
            need -= count
            equal = equal & ~slices[weight]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose value is at least so much."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for weight in range(len(slices) - 1, -1, -1):
        if value >> weight & 1:
            equal = equal & slices[weight]
        else:
            above = above | equal & slices[weight]
            equal = equal & ~slices[weight]
    return above | equal


def search_block(block: dict, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query row, block row, score) of each query's k best rows of a block."""
    n, dim = block["ints"].shape
    width, words = block["slices"].shape[0], block["slices"].shape[2]
    every = _words(np.packbits(np.ones(n, bool), bitorder="little")[None])[0]
    lower = max(0, width - UPPER)
    upper = block["slices"][lower:]  # (slice, component, words)
    for q, (query, own) in enumerate(zip(queries, query_ids)):
        mine = np.searchsorted(block["ids"], own, "left"), np.searchsorted(block["ids"], own, "right")
        rows = every
        if mine[0] < mine[1]:
            bits = np.ones(n, bool)
            bits[mine[0] : mine[1]] = False
            rows = _words(np.packbits(bits, bitorder="little")[None])[0]
        live = n - (mine[1] - mine[0])
        if live <= 0:
            continue
        # A negative weight counts the complement of a slice, which shifts all scores alike.
        size = np.abs(query)
        signed = upper ^ np.where(query < 0, np.uint64(2**64 - 1), np.uint64(0))[None, :, None]
        maps: dict[int, list[np.ndarray]] = {}
        for power in range(int(size.max()).bit_length()):
            some = np.nonzero(size >> power & 1)[0]
            if len(some):
                for s in range(len(upper)):
                    maps.setdefault(power + s, []).append(signed[s, some])
        score = added(maps, words)
        # What the lower slices can add lies between 0 and slack, in units of 2**lower.
        slack = sum(size.tolist()) * (2**lower - 1)
        floor = kth(score, rows, min(k, live)) - -(-slack // 2**lower) - 1
        bits = at_least(score, rows, floor)
        found = np.nonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little"))[0]
        exact = products(block["ints"][found].astype(np.int64), query)
        best = np.argsort(~exact, kind="stable")[:k]  # ~x falls as x rises; rows are in the order of vec_id
        yield np.full(len(best), q), found[best], exact[best]


def _search(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], dim, -1)
                block = {"ids": np.frombuffer(row["ids"], np.int64), "ints": widened(row["ints"], n, dim), "slices": _words(slices)}
                query_ids = np.frombuffer(row["q_ids"], np.int64)
                queries = widened(row["q_ints"], len(query_ids), dim).astype(np.int64)
                found = list(search_block(block, queries, query_ids, k))
                if found:
                    q, r, score = map(np.concatenate, zip(*found))
                    number = row["q_block"] * QUERIES + q
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(query_ids[q]), pa.array(block["ids"][r]), pa.array(score)], ["q", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, scale: float = 1024.0, dim: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products among all rows."""
    spark = rows.sparkSession
    pick = [F.col("vec_id").cast("long").alias("vec_id"), "embedding"]
    rows, queries = rows.select(pick).where("vec_id is not null"), queries.select(pick).where("vec_id is not null")
    dim = dim or dimension(rows)
    index = written(rows.mapInArrow(_pack(dim, scale, ROWS), BLOCK).withColumn("block", F.monotonically_increasing_id()))
    asked = queries.dropDuplicates(["vec_id", "embedding"]).mapInArrow(_pack(dim, scale, QUERIES), BLOCK)
    asked = written(asked.select(F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints")))
    slots = max(1, min(index.count(), 4 * shuffle_partitions(spark)))
    left = index.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    right = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    found = left.join(right, "slot").select("n", "width", "ids", "ints", "slices", "q_block", "q_ids", "q_ints").mapInArrow(_search(dim, k), "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 100 = 0),
s as (
  select q.vec_id query_id, v.vec_id, list_inner_product(q.e::double[], v.e::double[])::bigint score
  from q join v on q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
select query_id, "rank"::int "rank", vec_id, score from r where "rank" <= 10
"""
