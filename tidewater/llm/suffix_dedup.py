"""Suffix-array dedup by bucket-pointer refinement: repeated byte strings across documents.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. Suffixes are never sorted whole; only the buckets they fall in are named and refined:

1. Initial q-gram buckets. A bucket's identifier is a 64-bit name; the name of 2n bytes is made from
   the names of n bytes here and n bytes later, so every level reuses the one before. Of the suffixes,
   those count whose q-gram has the least name among the q-grams of some window of `length` bytes
   (about one in 14): equal windows choose equal suffixes, so none is lost.
2. Buckets of one suffix are done. The others are refined by the name of their full context (the bytes
   that any window around the suffix could cover): whatever shares its context with a smaller
   document is settled as a whole.
3. Buckets that still hold several contexts are refined to single windows of `length` bytes, by the
   least document of each context only.

Texts are packed into blocks, bucketed on their number, and stay where they are: each round sends
sorted names, once for a block, to the parts that own them, and joins the answers to the bucketed
blocks. A name that a third of all documents hold is one entry a block. A bucket with more than `HOT`
suffixes is not compared in one group: its windows are dealt by their own names. Parts grow in number
with the text, so their size, and the chance that two of the names in one collide, stay the same.

Defined cases: a null text is empty; documents shorter than `length` lose nothing; rows with the same
doc_id are one document, which cannot remove its own bytes; rows without doc_id have no smaller
document and are smaller than none, so they neither lose nor remove; repeated rows each get a result;
extra columns are ignored; an empty table gives an empty result. Long texts are one block of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import MESSAGES, PAD, A, Buckets, answers, arrays, joined, message, messages, packed, part_of, planes, rows, runs, values
from .common import NULL_ID, real_id, table, written

#: Bytes of a q-gram; bytes of text in a block; bytes of text a part; suffixes of a bucket compared in one group.
Q, BLOCK_BYTES, PART_BYTES, HOT = 24, 4 << 20, 2 << 20, 4096
#: Positions handled at a time.
CHUNK = 1 << 17
B = np.uint64(0xD6E8FEB86659FD93)


# -- names


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two strings from the names of both."""
    z = left * A
    z += right
    z ^= z >> np.uint64(31)
    z *= B
    return z


def _single(data: np.ndarray) -> np.ndarray:
    z = (data.astype(np.uint64) + np.uint64(1)) * B
    z ^= z >> np.uint64(29)
    return z * A


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of so many bytes along the last axis, by doubling."""
    found, size = _single(data), 1
    while 2 * size <= length:
        found, size = _pair(found[..., :-size], found[..., size:]), 2 * size
    if size < length:
        late = length - size
        found = _pair(found[..., :-late], found[..., late:])
    return found


def chosen(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the suffixes that the windows choose: windows marks each window's start."""
    wide = length - Q + 1  # q-grams of a window
    at, name = [], []
    for start in range(0, len(windows), CHUNK):
        mine = windows[start : start + CHUNK]
        if not mine.any():
            continue
        grams = names(data[start : start + len(mine) + length - 1], Q)
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= wide:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < wide:
            late = wide - size
            low = np.minimum(low[:-late], low[late:])
        best = (low[: len(mine)][mine] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        best = best[np.concatenate([[True], best[1:] != best[:-1]])]
        at.append(best + start)
        name.append(grams[best])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, name = np.concatenate(at), np.concatenate(name)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return at[new], name[new]


# -- blocks


class Block:
    """A block's bytes, its rows, and the suffixes chosen in it."""

    def __init__(self, row: dict, length: int):
        self.number, self.length = row["block"], length
        self.data = np.frombuffer(row["data"], np.uint8)
        self.dk, self.start, self.size = (np.frombuffer(row[c], np.int64) for c in ("dk", "start", "size"))
        self.left, self.width = length - Q, 2 * length - Q  # a context begins so far before its suffix

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        some = (self.size >= self.length) & (self.dk != NULL_ID)
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.start[some]] += 1
        edge[self.start[some] + self.size[some] - self.length + 1] -= 1
        windows = np.cumsum(edge, dtype=np.int8)[: len(self.data) - self.length + 1] > 0
        return chosen(self.data, windows, self.length)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return self.dk[np.searchsorted(self.start, at, "right") - 1]

    def contexts(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, self.width)[at - self.left]

    def context_names(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        for i in range(0, len(at), CHUNK):
            wide = np.zeros((len(at[i : i + CHUNK]), -(-self.width // 8) * 8), np.uint8)
            wide[:, : self.width] = self.contexts(at[i : i + CHUNK])
            found = np.zeros(len(wide), np.uint64)
            for column in wide.view(np.uint64).T:
                found = _pair(found, column)
            out[i : i + CHUNK] = found ^ found >> np.uint64(32)
        return out


# -- round 1: how many suffixes has each q-gram's bucket?


def _ask_grams(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                block = Block(row, length)
                buckets = Buckets(block.suffixes()[1], parts)
                # Within a part 32 bits tell buckets apart well enough: this round only filters.
                yield messages([message(p, block.number, buckets.name[s].astype(np.uint32), buckets.count[s]) for p, s in buckets.slices()])

    return run


def _answer_grams(group: pa.Table) -> pa.Table:
    """The size of every bucket, 0 for those of a single suffix."""
    got = [arrays(b, np.uint32, np.uint32) for b in group.column("body").to_pylist()]
    found, of = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate([n for _, n in got]), minlength=len(found)).astype(np.uint32)
    total[total < 2] = 0
    part, out, at = group.column("part")[0].as_py(), [], 0
    for block, (keys, _) in zip(group.column("block").to_pylist(), got):
        mine = total[of[at : at + len(keys)]]
        at += len(keys)
        if mine.any():
            out.append((part, block, planes(mine)))
    return pa.Table.from_batches([messages(out)])


# -- round 2: which is the least document of each context?


def _refined(block: Block, parts: int, answers: dict[int, bytes]):
    """Suffixes in buckets of several: positions, their buckets' names and sizes, buckets of contexts."""
    at, name = block.suffixes()
    buckets = Buckets(name, parts)
    size = buckets.answered(answers, np.uint32)[buckets.of]
    some = size > 0
    at, name, size = at[some], name[some], size[some]
    return at, name, size, Buckets(block.context_names(at), parts)


def _ask_contexts(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                block = Block(row, length)
                at, _, _, contexts = _refined(block, parts, answers(row, 1))
                least = contexts.least(block.owner(at))
                yield messages([message(p, block.number, contexts.name[s], least[s], contexts.count[s]) for p, s in contexts.slices()])

    return run


def _answer_contexts(group: pa.Table) -> pa.Table:
    """Each context's least document and number of suffixes, as (document, number) pairs."""
    got = [arrays(b, np.uint64, np.int64, np.uint32) for b in group.column("body").to_pylist()]
    name, dk, count = map(np.concatenate, zip(*got))
    found, of = np.unique(name, return_inverse=True)
    total = np.bincount(of, weights=count, minlength=len(found)).astype(np.int64)
    least = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(least, of, dk)
    part, out, at = group.column("part")[0].as_py(), [], 0
    for block, (keys, _, _) in zip(group.column("block").to_pylist(), got):
        mine = of[at : at + len(keys)]
        at += len(keys)
        out.append((part, block, planes(np.stack([least[mine], total[mine]], axis=1).view("V16").ravel())))
    return pa.Table.from_batches([messages(out)])


# -- round 3: which windows start in a smaller document?


class Questions:
    """The windows asked for: contexts of small buckets go to their bucket's part, those of large ones window by window."""

    def __init__(self, block: Block, at: np.ndarray, bucket: np.ndarray, hot: np.ndarray, parts: int):
        self.block, self.parts, self.at, self.hot = block, parts, at, hot
        cold = at[~hot]
        part, context = part_of(bucket[~hot], parts), block.context_names(cold)
        self.order = np.lexsort((context, part))
        # Equal contexts of one document are asked once.
        self.first = runs(context[self.order])
        self.group = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(cold))))
        self.cold, self.part = cold, part[self.order][self.first]
        wide = block.contexts(at[hot])
        self.shape = len(wide), block.left + 1
        valid = _no_pad(wide, block.length)
        self.windows = Buckets(names(wide, block.length)[valid], parts) if len(wide) else Buckets(np.empty(0, np.uint64), parts)
        self.valid = valid

    def messages(self) -> Iterator[tuple[int, int, bytes]]:
        block, asked = self.block, self.cold[self.order][self.first]
        edges = np.append(runs(self.part), len(self.part)) if len(self.part) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            some = asked[a:b]
            yield int(self.part[a]), block.number, np.int64(b - a).tobytes() + block.owner(some).tobytes() + block.contexts(some).tobytes()
        if self.hot.any():
            dk = np.broadcast_to(block.owner(self.at[self.hot])[:, None], self.shape)[self.valid]
            least = self.windows.least(dk)
            for p, s in self.windows.slices():
                yield message(self.parts + p, block.number, self.windows.name[s], least[s])

    def starts(self, answers: dict[int, bytes]) -> np.ndarray:
        """Positions at which a window starts that a smaller document has too."""
        block, out = self.block, []
        flags = np.zeros(len(self.part), np.uint64)
        edges = np.append(runs(self.part), len(self.part)) if len(self.part) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            if int(self.part[a]) in answers:
                flags[a:b] = np.frombuffer(answers[int(self.part[a])], np.uint64)
        for shift in range(block.left + 1):
            hit = (flags >> np.uint64(shift) & np.uint64(1)).astype(bool)[self.group]
            out.append(self.cold[self.order][hit] - block.left + shift)
        if self.hot.any():
            late = {p - self.parts: body for p, body in answers.items() if p >= self.parts}
            least = self.windows.answered(late, np.int64)
            has = np.zeros(len(self.windows.name), bool)
            for p, s in self.windows.slices():
                has[s] = p in late
            row, shift = np.nonzero(self.valid)
            hit = has[self.windows.of] & (least[self.windows.of] < block.owner(self.at[self.hot])[row])
            out.append(self.at[self.hot][row[hit]] - block.left + shift[hit])
        return np.concatenate(out)


def _no_pad(wide: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each context lie inside one text."""
    pads = np.cumsum(np.pad(wide == PAD, [(0, 0), (1, 0)]), axis=1)
    return pads[:, length:] == pads[:, : pads.shape[1] - length]


def _ask_windows(length: int, parts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                block = Block(row, length)
                at, name, size, contexts = _refined(block, parts, answers(row, 1))
                told = contexts.answered(answers(row, 2), "V16").view(np.int64).reshape(-1, 2)
                least, total = told[contexts.of].T if len(at) else (at, at)
                settled = least < block.owner(at)
                # A context that isn't its whole bucket may share some windows with the others.
                open_ = ~settled & (total < size)
                yield messages([(-1, block.number, _state(at[settled], at[open_], name[open_], size[open_] > hot)), *Questions(block, at[open_], name[open_], size[open_] > hot, parts).messages()])

    return run


def _state(settled: np.ndarray, *open_: np.ndarray) -> bytes:
    return np.array([len(settled), len(open_[0])], np.int64).tobytes() + planes(np.diff(settled, prepend=0)) + b"".join(planes(x) for x in open_)


def _known(body: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(body, np.int64, 2).tolist()
    out, at = [], 16
    for count, kind in ((n, np.int64), (m, np.int64), (m, np.uint64), (m, np.bool_)):
        size = count * np.dtype(kind).itemsize
        out.append(values(body[at : at + size], kind) if count else np.empty(0, kind))
        at += size
    return [np.cumsum(out[0]), *out[1:]]


def _answer_windows(length: int, parts: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        blocks, bodies = group.column("block").to_pylist(), group.column("body").to_pylist()
        out, at = [], 0
        if part >= parts:
            got = [arrays(b, np.uint64, np.int64) for b in bodies]
            name, dk = map(np.concatenate, zip(*got))
            found, of = np.unique(name, return_inverse=True)
            least = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(least, of, dk)
            for block, (keys, _) in zip(blocks, got):
                out.append((part, block, planes(least[of[at : at + len(keys)]])))
                at += len(keys)
            return pa.Table.from_batches([messages(out)])
        width = 2 * length - Q
        counts = [int(np.frombuffer(b, np.int64, 1)[0]) for b in bodies]
        dk = np.concatenate([np.frombuffer(b, np.int64, n, 8) for b, n in zip(bodies, counts)])
        wide = np.concatenate([np.frombuffer(b, np.uint8, n * width, 8 + 8 * n).reshape(n, width) for b, n in zip(bodies, counts)])
        flags = np.zeros(len(dk), np.uint64)
        valid, name = _no_pad(wide, length), names(wide, length)
        for shift in range(length - Q + 1):
            order = np.argsort(name[:, shift], kind="stable")
            first = runs(name[order, shift])
            least = np.repeat(np.minimum.reduceat(dk[order], first), np.diff(np.append(first, len(dk))))
            hit = np.empty(len(dk), bool)
            hit[order] = least < dk[order]
            flags |= (hit & valid[:, shift]).astype(np.uint64) << np.uint64(shift)
        for block, n in zip(blocks, counts):
            if flags[at : at + n].any():
                out.append((part, block, flags[at : at + n].tobytes()))
            at += n
        return pa.Table.from_batches([messages(out)])

    return run


# -- results


def _result(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                block, told = Block(row, length), answers(row, 3)
                settled, at, name, hot = _known(told.pop(-1)) if -1 in told else _known(bytes(16))
                parts = row["parts"]
                starts = Questions(block, at, name, hot, parts).starts(told)
                edge = np.zeros(len(block.data) + 1, np.int32)
                np.add.at(edge, settled - block.left, 1)
                np.add.at(edge, settled - block.left + block.width, -1)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = {"dk": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for dk, start, size in zip(block.dk.tolist(), block.start.tolist(), block.size.tolist()):
                    drop, body = gone[start : start + size], block.data[start : start + size]
                    n = int(drop.sum())
                    kept = (body[~drop] if n else body).tobytes()
                    for column, value in zip(out.values(), (dk, size, n, int((drop[1:] > drop[:-1]).sum()) + int(size > 0 and drop[0]), hashlib.sha256(kept).hexdigest() if digest else kept)):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string() if digest else pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def without_repeats(docs: DataFrame, length: int = 50, digest: bool = False, hot: int = HOT) -> DataFrame:
    """(dk, n_bytes, n_removed, n_spans, kept): each row's bytes without those that smaller documents have.

    kept is the rest as bytes (a cut may fall inside a character), or with digest its SHA-256 in hex.
    length lies between 32 and 87, so that a context's windows fit in 64 bits.
    """
    if not 32 <= length <= 87:
        raise ValueError("length must lie between 32 and 87")
    blocks = packed(docs, length, BLOCK_BYTES)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, int(total) // PART_BYTES)
    body = blocks.select("block", "data", "dk", "start", "size")
    asked = body.mapInArrow(_ask_grams(length, parts), MESSAGES)
    grams = written(asked.groupBy("part").applyInArrow(_answer_grams, MESSAGES))
    asked = joined(body, grams).mapInArrow(_ask_contexts(length, parts), MESSAGES)
    contexts = written(asked.groupBy("part").applyInArrow(_answer_contexts, MESSAGES))
    asked = written(joined(body, grams, contexts).mapInArrow(_ask_windows(length, parts, hot), MESSAGES))
    windows = asked.where("part >= 0").groupBy("part").applyInArrow(_answer_windows(length, parts), MESSAGES)
    last = asked.where("part < 0").unionByName(windows)
    told = joined(body, last, first=3).withColumn("parts", F.lit(parts))
    return told.mapInArrow(_result(length, digest), f"dk long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select(real_id(), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
