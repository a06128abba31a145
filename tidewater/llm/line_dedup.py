"""Line dedup: range-partitioned line hashes, streamed in (hash, document, position) order.

Every line is reduced to a 128-bit hash of its key. The hashes are range-partitioned on
(hash, document, position), so a line that a third of all documents hold is spread over many
partitions, and sorted. One streaming pass per partition decides every run of equal hashes that
lies inside it. Only the first and last run of a partition can continue elsewhere: their rows are
settled by a small aggregate (at most two hashes a partition). What comes back is a compressed
keep bitmap per document; text never travels with the hashes.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; rows with the
same doc_id and text are one document (each row gets its own result), and all rows without doc_id
count as one document; extra columns are ignored; an empty table gives an empty result. Documents
that lose no line have no bitmap row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ints, keyed, real_id, shuffle_partitions, table, written

LINES = "dk long, th long, n_lines int, pos int, h1 long, h2 long"
ORDER = ("h1", "h2", "dk", "th", "pos")


def line_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each line of each text: its row, its position in the text, its key."""
    lines = pc.split_pattern(pc.ascii_lower(text), "\n")
    rows = ints(pc.list_parent_indices(lines))
    first = np.concatenate([[0], np.cumsum(ints(pc.list_value_length(lines)))])
    keys = pc.utf8_trim(lines.flatten(), characters=WHITE).to_pylist()
    return rows, np.arange(len(rows)) - first[rows], keys


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, pos, keys = line_keys(batch.column("text"))
        full = np.fromiter(map(len, keys), np.int64, len(keys)) > 0
        digest = b"".join(xxhash.xxh3_128_digest(k) for k in keys if k)
        halves = np.frombuffer(digest, ">i8").astype(np.int64).reshape(-1, 2)
        count = np.bincount(rows, minlength=batch.num_rows)
        rows, pos = rows[full], pos[full]
        dk, th = ints(batch.column("dk")), ints(batch.column("th"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(dk[rows]), pa.array(th[rows]), pa.array(count[rows].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            ["dk", "th", "n_lines", "pos", "h1", "h2"],
        )


def _stream(min_docs: int, keep_first: bool):
    """Decide runs of equal hashes; rows of a partition's edge runs come out undecided (pending)."""
    names = ["dk", "th", "n_lines", "pos", "h1", "h2"]

    def settle(cols: list[np.ndarray]) -> np.ndarray:
        """Which of the rows (whole runs, in order) are dropped."""
        dk, h1, h2 = cols[0], cols[4], cols[5]
        new = np.ones(len(dk), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= dk[1:] != dk[:-1]
        return (np.bincount(run, weights=fresh)[run] >= min_docs) & ~(new & keep_first)

    def out(cols: list[np.ndarray], pick: np.ndarray, pending: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c[pick]) for c in cols), pa.array(np.full(int(pick.sum()), pending))], [*names, "pending"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the run that is still open
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [ints(batch.column(n)) for n in names]
            same = (cols[4] == cols[4][-1]) & (cols[5] == cols[5][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            joins = bool(held) and cols[4][0] == held[0][4][0] and cols[5][0] == held[0][5][0]
            if cut == 0 and (joins or not held):
                held.append(cols)
                continue
            done = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])] if held else [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
            if first:  # its first run may have begun in an earlier partition
                edge = (done[4] == done[4][0]) & (done[5] == done[5][0])
                first = False
                yield out(done, edge, True)
                done = [c[~edge] for c in done]
            if len(done[0]):
                yield out(done, settle(done), False)
        for cols in held:
            yield out(cols, np.ones(len(cols[0]), bool), True)

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, counts = [], []
        for n, gone in zip(ints(batch.column("n_lines")), batch.column("gone").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            counts.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("dk"), batch.column("th"), batch.column("n_lines"), pa.array(counts, pa.int32()), pa.array(maps, pa.binary())],
            ["dk", "th", "n_lines", "n_dropped", "keep_bitmap"],
        )


def line_documents(docs: DataFrame, *columns: str) -> DataFrame:
    return keyed(docs, *columns).withColumn("th", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """Compressed keep bitmaps (dk, th, n_lines, n_dropped, keep_bitmap) of the documents that lose lines.

    A line is affected when at least min_docs documents hold its key. keep_first keeps its first
    occurrence in (doc_id, position) order; otherwise every occurrence goes.
    """
    spark = docs.sparkSession
    hashes = line_documents(docs).mapInArrow(_hashes, LINES)
    ordered = hashes.repartitionByRange(shuffle_partitions(spark), *ORDER).sortWithinPartitions(*ORDER)
    out = written(ordered.mapInArrow(_stream(min_docs, keep_first), f"{LINES}, pending boolean"))
    pending = out.where("pending")
    # At most two hashes a partition are pending, so the broadcast is bounded by twice their number.
    common = pending.select("h1", "h2", "dk").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_docs)
    leads = pending.groupBy("h1", "h2").agg(F.min(F.struct("dk", "th", "pos")).alias("lead"))
    edges = common.join(leads, ["h1", "h2"]).select("h1", "h2", "lead")
    late = pending.join(F.broadcast(edges), ["h1", "h2"])
    if keep_first:
        late = late.where(F.struct("dk", "th", "pos") != F.col("lead"))
    cols = ["dk", "th", "n_lines", "pos"]
    gone = out.where("not pending").select(cols).unionByName(late.select(cols))
    return (
        gone.groupBy("dk", "th")
        .agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("gone"))
        .mapInArrow(_bitmaps, "dk long, th long, n_lines int, n_dropped int, keep_bitmap binary")
    )


def kept_text(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines, its number of lines and of dropped lines."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).tolist()
    return "\n".join(x for x, k in zip(lines, keep) if k), len(lines), len(lines) - sum(keep)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [kept_text(t, m) for t, m in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist())]
        text, total, gone = map(list, zip(*done)) if done else ([], [], [])
        rest = [n for n in batch.schema.names if n not in ("text", "keep_bitmap")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in rest), pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            [*rest, "text", "n_lines", "n_dropped"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _apply(batches):
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(sha, pa.string())], ["dk", "n_lines", "n_dropped", "kept_sha256"])


def drop_lines(docs: DataFrame, bitmaps: DataFrame, *columns: str) -> DataFrame:
    """Documents (dk, the named columns, text, n_lines, n_dropped) with their bitmaps applied."""
    joined = line_documents(docs, *columns).join(bitmaps.select("dk", "th", "keep_bitmap"), ["dk", "th"], "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "keep_bitmap"))
    return joined.mapInArrow(_apply, f"{kinds}, text string, n_lines long, n_dropped long").drop("th")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    maps = keep_bitmaps(docs, min_docs=10, keep_first=False)
    joined = line_documents(docs).join(maps.select("dk", "th", "keep_bitmap"), ["dk", "th"], "left")
    return joined.mapInArrow(_digest, "dk long, n_lines long, n_dropped long, kept_sha256 string").select(real_id(), "n_lines", "n_dropped", "kept_sha256")


#: DuckDB's trim() takes the six characters one by one; translate() lower-cases A-Z only.
OP1_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos
  from documents),
keys as (
  select doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from lines),
common as (select k from keys where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint n_lines, count(c.k)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.k is null), '')) kept_sha256
from keys left join common c on keys.k = c.k
group by doc_id
"""
