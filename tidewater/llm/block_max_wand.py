"""Ranked lexical search: Block-Max WAND over segments of an inverted index.

Index. Documents are gathered into segments of SEGMENT_BYTES of text. A segment has a list of postings for
each of its terms, cut into blocks of BLOCK postings. A block is compressed (variable-byte gaps, then
variable-byte frequencies) and has a header that is read without decompression: its first and last
document, its sizes, and its competitive pairs, which are the (frequency, document length) pairs that no
other pair of the block beats in both. Whatever the collection's statistics are, the greatest impact in the
block is that of one of these pairs; so maximum impacts are exact, and segments stay valid as the
collection grows. Segments are rows of a table that is bucketed by slot and don't move afterwards.

Search. Items are packed, at most ITEMS of PACK_BYTES together, and packs are dealt to all slots: a stated query set
against all rows, in blocks. A first pass adds up the document frequencies of a pack's terms. In the second
a segment answers each item: the headers of the item's blocks divide the segment's documents into
intervals, in which no list's pointer changes its block; the sum of the blocks' maximum impacts bounds every
document of an interval. Shallow pointers move along the intervals, over those that stay below the
threshold (the k-th best score so far, also of the task's earlier segments), without decompressing anything.
In what remains the lists are visited from the strongest to the weakest. A document stays alive while what visited
lists gave it and what the blocks of the others could give reach the threshold; a block without a living document in
its range stays compressed, and one whose documents are all dead keeps its frequencies so. All
arithmetic is in 64-bit integers. Each segment returns k rows an item at most.

Defined cases: null or empty texts have no terms and are not counted; rows without doc_id count and rank with a null
doc_id, before others of the same score; repeated documents are documents each; equal scores go to the smaller
doc_id; items that are repeated (same id and text) give one result, items without terms none; a term that no document
has adds nothing; extra columns are ignored; empty tables give an empty result. Whole texts are indexed; a long text is
split in slices, and one longer than a segment is a segment of its own.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import planes, runs, values
from .common import keyed, real_id, scratch, shuffle_partitions, table, written
from .words import Vocabulary, texts

BLOCK, SEGMENT_BYTES = 128, 12 << 20
#: Items of a pack and bytes of their texts; packs that a task remembers.
ITEMS, PACK_BYTES, REMEMBERED = 1024, 1 << 20, 64
#: Documents that the pointers pass at once, at first and at most.
STEP, MOST_STEP = 256, 1 << 15
#: Terms are the runs of digits, letters and all that isn't ASCII; only A-Z is lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SEGMENT = "segment long, n_docs long, n_terms long, terms binary, df binary, dk binary, size binary, first binary, last binary, gap_bytes binary, tf_bytes binary, pairs binary, pair_tf binary, pair_n binary, gaps binary, tfs binary"


# -- the index


def encoded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of whole numbers below 2^63, and each one's bytes."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        more = numbers >> np.int64(7 * k)
        if not more.any():
            break
        size += more > 0
    out = np.empty(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        some = size > k
        going_on = (size[some] > k + 1).astype(np.uint8) << 7
        out[at[some] + k] = (numbers[some] >> np.int64(7 * k) & 127).astype(np.uint8) | going_on
    return out, size


def decoded(body: np.ndarray) -> np.ndarray:
    final = body < 128
    if final.all():
        return body.astype(np.int64)
    ends = np.nonzero(final)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = np.arange(len(body)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((body & 127).astype(np.int64) << 7 * shift, starts)


def competitive(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of the pairs that no pair of the same block beats (greater or equal tf, smaller or equal n), by block."""
    order = np.lexsort((n, -tf, block))
    # Later blocks lie lower, so that a running minimum starts anew with each.
    level = n[order] - block[order] * (int(n.max(initial=0)) + 1)
    low = np.minimum.accumulate(level)
    return order[np.append(True, level[1:] < low[:-1])] if len(order) else order


def segment_row(number: int, held: list[np.ndarray], dk: list[int], vocabulary: Vocabulary) -> tuple:
    """A segment from its documents' term numbers, none of them empty."""
    size = np.array([len(x) for x in held], np.int64)
    code = np.concatenate(held).astype(np.int64) << 32 | np.repeat(np.arange(len(held)), size)
    held.clear()
    code.sort()
    start = runs(code)
    tf = np.diff(np.append(start, len(code)))
    code = code[start]
    term, doc = code >> 32, code & 0xFFFFFFFF
    df = np.bincount(term, minlength=len(vocabulary))
    head = (np.arange(len(doc)) - (np.cumsum(df) - df)[term]) % BLOCK == 0
    begin = np.nonzero(head)[0]
    end = np.append(begin[1:], len(doc))
    gaps, gap_size = encoded(np.diff(doc, prepend=0)[~head])
    widths = np.zeros(len(doc), np.int64)
    widths[~head] = gap_size
    tfs, tf_size = encoded(tf)
    block = np.repeat(np.arange(len(begin)), end - begin)
    best = competitive(block, tf, size[doc])
    cells = [
        b"\n".join(vocabulary), planes(df.astype(np.uint32)), np.array(dk, np.int64).tobytes(), planes(size),
        planes(doc[begin].astype(np.uint32)), planes(doc[end - 1].astype(np.uint32)),
        planes(np.add.reduceat(widths, begin).astype(np.uint16)), planes(np.add.reduceat(tf_size, begin).astype(np.uint16)),
        planes(np.bincount(block[best], minlength=len(begin)).astype(np.uint8)), planes(tf[best]), planes(size[doc[best]]),
        gaps.tobytes(), tfs.tobytes(),
    ]
    return number, len(dk), int(size.sum()), *cells


def _segments(limit: int):
    names = [f.split()[0] for f in SEGMENT.split(", ")]

    def row(held, dk, vocabulary, number) -> pa.RecordBatch:
        name = TaskContext.get().partitionId() << 32 | number
        cells = segment_row(name, held, dk, vocabulary)
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary() if isinstance(c, bytes) else pa.int64()) for c in cells], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, keys, total, number = Vocabulary(), [], [], 0, 0
        for batch in batches:
            for dk, text in texts(batch):
                if held and total + len(text) > limit:
                    yield row(held, keys, vocabulary, number)
                    vocabulary, held, keys, total, number = Vocabulary(), [], [], 0, number + 1
                found = vocabulary.numbers(text.translate(FOLD))
                if len(found):
                    held.append(found)
                    keys.append(dk)
                    total += len(text)
        if held:
            yield row(held, keys, vocabulary, number)

    return run


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all documents: a row a segment, bucketed by slot."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = keyed(docs).mapInArrow(_segments(segment_bytes), SEGMENT)
    name = f"tidewater_segments_{uuid.uuid4().hex}"
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64("segment"), F.lit(4 * parts)))
    slotted.write.bucketBy(parts, "slot").option("path", f"{scratch(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalog's entry only: the files are read by those who hold the table
    return found


# -- the items


class Pack:
    """Items with their terms: `terms` are the distinct ones, `items` has for each item (place in the pack, terms, repeats)."""

    def __init__(self, bodies: list[bytes]):
        self.terms = Vocabulary()
        self.items = []
        for place, body in enumerate(bodies):
            found = self.terms.numbers(body.translate(FOLD))
            if len(found):
                term, times = np.unique(found, return_counts=True)
                self.items.append((place, term, times.astype(np.int64)))


class Packs:
    """The packs that a task met last."""

    def __init__(self, make):
        self.make, self.held = make, OrderedDict()

    def __call__(self, row: dict):
        if row["pack"] not in self.held:
            self.held[row["pack"]] = self.make(row)
            if len(self.held) > REMEMBERED:
                self.held.popitem(last=False)
        self.held.move_to_end(row["pack"])
        return self.held[row["pack"]]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, bodies, total, number = [], [], 0, 0

    def row() -> pa.RecordBatch:
        name = TaskContext.get().partitionId() << 32 | number
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([bodies], pa.list_(pa.binary()))], ["pack", "item_ids", "bodies"])

    for batch in batches:
        for key, (_, text) in zip(batch.column("item_id").to_pylist(), texts(batch)):
            if bodies and (len(bodies) == ITEMS or total + len(text) > PACK_BYTES):
                yield row()
                ids, bodies, total, number = [], [], 0, number + 1
            ids.append(key)
            bodies.append(text)
            total += len(text)
    if bodies:
        yield row()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs = Packs(lambda row: Pack(row["bodies"]))
    for batch in batches:
        for row in batch.to_pylist():
            wanted, df = packs(row).terms, values(row["df"], np.uint32)
            found = [(wanted[t], i) for i, t in enumerate(row["terms"].split(b"\n")) if t in wanted]
            if found:
                term, at = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), row["pack"])), pa.array(term), pa.array(df[at].astype(np.int64))], ["pack", "term", "df"])


# -- the search


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Segment:
    """A segment's headers, its blocks as they are decompressed, and pointers over them."""

    def __init__(self, row: dict, wanted, documents: int, terms: int):
        """wanted: the terms that are looked up; documents and terms: N and L."""
        self.numbers = {t: i for i, t in enumerate(row["terms"].split(b"\n")) if t in wanted}
        self.dk = np.frombuffer(row["dk"], np.int64)
        self.scaled = lambda n: 75 + 25 * n * documents // terms
        self.m = self.scaled(values(row["size"], np.int64))
        self.df = values(row["df"], np.uint32).astype(np.int64)
        blocks = -(-self.df // BLOCK)
        self.block = np.concatenate([[0], np.cumsum(blocks)])  # each term's first block
        self.first, self.last = (values(row[c], np.uint32).astype(np.int64) for c in ("first", "last"))
        self.gap_at, self.tf_at = (np.concatenate([[0], np.cumsum(values(row[c], np.uint16).astype(np.int64))]) for c in ("gap_bytes", "tf_bytes"))
        self.gaps, self.tfs = (np.frombuffer(row[c], np.uint8) for c in ("gaps", "tfs"))
        pairs = values(row["pairs"], np.uint8).astype(np.int64)
        best = impact(values(row["pair_tf"], np.int64), self.scaled(values(row["pair_n"], np.int64)))
        self.most = np.maximum.reduceat(best, np.cumsum(pairs) - pairs)  # each block's maximum impact
        self.docs_of: dict[int, np.ndarray] = {}
        self.impacts_of: dict[int, np.ndarray] = {}

    def docs(self, block: int) -> np.ndarray:
        if block not in self.docs_of:
            gaps = decoded(self.gaps[self.gap_at[block] : self.gap_at[block + 1]])
            self.docs_of[block] = np.cumsum(np.concatenate([self.first[block : block + 1], gaps]))
        return self.docs_of[block]

    def impacts(self, block: int) -> np.ndarray:
        if block not in self.impacts_of:
            tf = decoded(self.tfs[self.tf_at[block] : self.tf_at[block + 1]])
            self.impacts_of[block] = impact(tf, self.m[self.docs(block)])
        return self.impacts_of[block]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of at least floor (1 or more), best first.

        terms: the numbers of distinct terms of this segment; weights: theirs, repeats included.
        """
        low, high = self.block[terms], self.block[terms + 1]
        count = high - low
        block = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        factor = np.repeat(weights, count)
        bound = factor * self.most[block]
        edge = np.unique(np.concatenate([self.first[block], self.last[block] + 1]))
        enters, leaves = np.searchsorted(edge, self.first[block]), np.searchsorted(edge, self.last[block] + 1)
        change = np.zeros(len(edge), np.int64)
        np.add.at(change, enters, bound)
        np.subtract.at(change, leaves, bound)
        upper = np.cumsum(change)[:-1]  # of the documents from edge[i] up to edge[i + 1]
        owner = np.repeat(np.arange(len(terms)), count)
        top, score = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, STEP if floor <= 1 else MOST_STEP
        while at < len(upper):
            threshold = max(floor, int(score[-1]) if len(score) == k else 1)
            # Shallow moves: over all intervals that stay below the threshold.
            ahead = upper[at:] >= threshold
            jump = int(ahead.argmax())
            if not ahead[jump]:
                break
            at += jump
            end = max(at + 1, int(np.searchsorted(edge, edge[at] + step, "right")) - 1)
            step = min(2 * step, MOST_STEP)
            begin, width = int(edge[at]), int(edge[end] - edge[at])
            here = np.nonzero((enters < end) & (leaves > at))[0]
            left = np.maximum(self.first[block[here]] - begin, 0)
            right = np.minimum(self.last[block[here]] + 1 - begin, width)
            # What a document has, and what lists not yet visited could give it.
            could = np.repeat(upper[at:end], np.diff(edge[at : end + 1]))
            lists, start = np.unique(owner[here], return_index=True)
            stop = np.append(start[1:], len(here))
            strongest = np.argsort(-np.maximum.reduceat(bound[here], start), kind="stable")
            numbers, bounds, factors = block[here].tolist(), bound[here].tolist(), factor[here].tolist()
            left, right = left.tolist(), right.tolist()
            for a, b in zip(start[strongest].tolist(), stop[strongest].tolist()):
                for i in range(a, b):
                    span = could[left[i] : right[i]]
                    alive = span >= threshold
                    span -= bounds[i]
                    if alive.any():
                        docs = self.docs(numbers[i])
                        inside = slice(*np.searchsorted(docs, (begin + left[i], begin + right[i])))
                        docs = docs[inside] - (begin + left[i])
                        good = alive[docs]
                        if good.any():
                            span[docs[good]] += factors[i] * self.impacts(numbers[i])[inside][good]
            found = np.nonzero(could >= threshold)[0]
            if len(found):
                top, score = np.concatenate([top, found + begin]), np.concatenate([score, could[found]])
                order = np.lexsort((self.dk[top], -score))[:k]
                top, score = top[order], score[order]
            at = end
        return top, score


def _search(documents: int, terms: int, k: int):
    def make(row: dict):
        pack = Pack(row["bodies"])
        df = np.zeros(len(pack.terms), np.int64)
        for x in row["known"]:
            df[x["term"]] = x["df"]
        weights = np.array([weight(documents, d) if d else 0 for d in df.tolist()], np.int64)
        # The k best scores so far of each item, in this task.
        return pack, weights, np.zeros((len(row["bodies"]), k), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs(make)
        for batch in batches:
            for row in batch.to_pylist():
                pack, weights, scores = packs(row)
                segment = Segment(row, pack.terms, documents, terms)
                number = np.full(len(pack.terms), -1)
                for term, i in segment.numbers.items():
                    number[pack.terms[term]] = i
                number[weights <= 0] = -1
                out = []
                for place, term, times in pack.items:
                    here = number[term] >= 0
                    if here.any():
                        found, score = segment.best(number[term[here]], (weights[term] * times)[here], k, max(1, int(scores[place].min())))
                        scores[place] = np.sort(np.concatenate([scores[place], score]))[-k:]
                        out.append((np.full(len(found), place), segment.dk[found], score))
                if out:
                    place, dk, score = map(np.concatenate, zip(*out))
                    ids = np.array(row["item_ids"], object)[place]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), row["pack"])), pa.array(place), pa.array(ids, pa.int64()), pa.array(dk), pa.array(score)], ["pack", "place", "item_id", "dk", "score"])

    return run


FOUND = "pack long, place long, item_id long, dk long, score long"


def search(index: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents; items: item_id, text."""
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    documents, terms = int(total["n"] or 0), int(total["l"] or 0)
    slots = 4 * shuffle_partitions(index.sparkSession)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = asked.distinct().select("item_id", F.lit(0).cast("long").alias("dk"), "text")
    packs = written(asked.mapInArrow(_packs, "pack long, item_ids array<long>, bodies array<binary>"))

    def met(packs_: DataFrame, *columns: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))
        return index.select("slot", *columns).join(packs_.withColumn("slot", every).hint("shuffle_hash"), "slot").drop("slot")

    counted = met(packs.select("pack", "bodies"), "terms", "df").mapInArrow(_frequencies, "pack long, term long, df long")
    known = counted.groupBy("pack", "term").agg(F.sum("df").alias("df")).groupBy("pack").agg(F.collect_list(F.struct("term", "df")).alias("known"))
    ready = written(packs.join(known, "pack"))
    columns = [c for c in index.columns if c not in ("slot", "segment", "n_docs", "n_terms")]
    found = met(ready, *columns).mapInArrow(_search(documents, terms, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("pack", "place").orderBy(F.desc("score"), "dk"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("item_id", "rank", real_id(), "score")


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 20)


OP12_SQL = r"""
with d as (
  select row_number() over () r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') terms
  from documents),
total as (select count(*)::bigint n_docs, sum(len(terms))::bigint n_terms from d where len(terms) > 0),
p as (select r, any_value(doc_id) doc_id, any_value(n) n, term, count(*)::bigint tf
  from (select r, doc_id, len(terms)::bigint n, unnest(terms) term from d) group by r, term),
df as (select term, count(*)::bigint df from p group by term),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint w from df, total),
q as (select distinct item_id, text from benchmark),
i as (select item_id, text, term, count(*)::bigint times from (
  select item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from q)
  group by item_id, text, term),
s as (select i.item_id, i.text, p.r, any_value(p.doc_id) doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint score
  from i join w using (term) join p using (term), total group by i.item_id, i.text, p.r),
k as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls first) "rank" from s where score > 0)
select item_id, "rank"::int "rank", doc_id, score from k where "rank" <= 20
"""
