"""Texts in blocks that stay where they are, and names that travel instead.

Texts are packed into blocks of bounded size, bucketed on the block's number. A block sends each of its
distinct names once, sorted, to the part that owns it; a part answers each block; the answers are joined
to the bucketed blocks, so the texts are not shuffled. A name that very many texts hold is one entry a
block. A single text longer than a block is a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ints, keyed, scratch, shuffle_partitions, utf8

MESSAGES = "part long, block long, body binary"
#: Stands between texts; no UTF-8 text holds this byte.
PAD = 0xFF
A = np.uint64(0x9E3779B97F4A7C15)


def part_of(name: np.ndarray, parts: int) -> np.ndarray:
    mixed = (name ^ (name >> np.uint64(32))) * A
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Byte planes, which compress well where values are small."""
    flat = np.ascontiguousarray(values)
    return flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes() if len(flat) else b""


def values(body: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not body:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).ravel()


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.nonzero(new)[0]


BLOCKS = "block long, n_bytes long, data binary, dk binary, start binary, size binary, lang array<string>"


def _pack(length: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad, number, held, keys, langs, total = bytes([PAD]) * length, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.int64)
            starts = length + np.concatenate([[0], np.cumsum(sizes + length)])[:-1]
            name = TaskContext.get().partitionId() << 32 | number
            cells = [pad + b"".join(x for t in held for x in (t, pad)), np.array(keys, np.int64).tobytes(), starts.tobytes(), sizes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total]), *(pa.array([c], pa.binary()) for c in cells), pa.array([langs], pa.list_(pa.string()))], ["block", "n_bytes", "data", "dk", "start", "size", "lang"])

        for batch in batches:
            body, at = utf8(batch.column("text"))
            dk, lang = ints(batch.column("dk")), batch.column("lang").to_pylist()
            for i in range(batch.num_rows):
                if held and total + at[i + 1] - at[i] > block_bytes:
                    yield block()
                    number, held, keys, langs, total = number + 1, [], [], [], 0
                held.append(body[at[i] : at[i + 1]].tobytes())
                keys.append(dk[i])
                langs.append(lang[i])
                total += int(at[i + 1] - at[i])
        if held:
            yield block()

    return run


def packed(docs: DataFrame, length: int, block_bytes: int, lang: str | None = None) -> DataFrame:
    """The texts as a table of blocks, bucketed on the block's number; `length` pad bytes part the texts."""
    spark = docs.sparkSession
    name = f"tidewater_blocks_{uuid.uuid4().hex}"
    blocks = keyed(docs, F.col(lang).cast("string").alias("lang") if lang else F.lit(None).cast("string").alias("lang")).mapInArrow(_pack(length, block_bytes), BLOCKS)
    path = f"{scratch(spark)}/{name}"
    blocks.write.bucketBy(shuffle_partitions(spark), "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalog's entry only: the files are read by those who hold the table
    return table


class Buckets:
    """Names of a block, distinct and ordered by part: what is sent, and where answers belong."""

    def __init__(self, name: np.ndarray, parts: int):
        part = part_of(name, parts)
        order = np.lexsort((name, part))
        first = runs(name[order]) if len(name) else np.empty(0, np.int64)
        self.name = name[order][first]
        self.part = part[order][first]
        self.count = np.diff(np.append(first, len(name))).astype(np.uint32)
        self.of = np.empty(len(name), np.int64)  # each given name's place among the distinct ones
        self.of[order] = np.repeat(np.arange(len(first)), self.count)
        self.order, self.first = order, first

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def slices(self) -> Iterator[tuple[int, slice]]:
        edges = np.append(runs(self.part), len(self.part)) if len(self.part) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(self.part[a]), slice(a, b)

    def answered(self, answers: dict[int, bytes], kind) -> np.ndarray:
        """The answers in this order; 0 where there is none."""
        out = np.zeros(len(self.name), kind)
        for part, where in self.slices():
            if part in answers:
                out[where] = values(answers[part], kind)
        return out


def message(part: int, block: int, *arrays: np.ndarray) -> tuple[int, int, bytes]:
    return part, block, np.int64(len(arrays[0])).tobytes() + b"".join(map(planes, arrays))


def arrays(body: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(values(body[at : at + size], kind) if n else np.empty(0, kind))
        at += size
    return out


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, block, body = map(list, zip(*rows)) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], ["part", "block", "body"])


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def answers(row: dict, number: int) -> dict[int, bytes]:
    return {x["part"]: x["body"] for x in row["told"] or [] if x["round"] == number}


def joined(blocks: DataFrame, *rounds: DataFrame, first: int = 1) -> DataFrame:
    """blocks with what each round told them; the bucketed side doesn't move."""
    told = None
    for number, answers in enumerate(rounds, first):
        some = answers.select("block", F.struct(F.lit(number).alias("round"), "part", "body").alias("x"))
        told = some if told is None else told.unionByName(some)
    return blocks.join(told.groupBy("block").agg(F.collect_list("x").alias("told")).hint("shuffle_hash"), "block", "left")


