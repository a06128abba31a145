"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (fit_rows rows, those with the least hash of
vec_id); every row is indexed. A row goes to the list of its nearest centroid, with the codes of its
residual's parts. There are about 4 sqrt(rows) lists, as far as the sample carries them (20 rows a list).

A query probes the lists with the largest inner products. How many is measured on the sample: as many as
hold the share `recall` of the true nearest rows there (more are found in the table, which is denser), among rows that the centroids were not fitted on
(every `HELD`th). Clustered vectors need a few lists, vectors without
structure need many, and a larger table needs a smaller share of them, since its nearest rows are nearer.

Lists lie side by side in shards of bounded size; a list that holds a third of all rows is many shards. A
query comes to a shard once, whatever number of its lists lie there. There the rows of these lists are scored
from asymmetric tables (the inner product with the centroid plus one table entry a part). The best by table are
reranked by the exact inner product, in double precision, of the original vectors, which the shard carries;
this gives a score that k rows reach, and then all rows that may exceed it, by the tables' error, are reranked.
The error is measured on the sample too (`MISSED`), so rows that share their codes, as in tight clusters, are
all reranked.

Defined cases: vectors that are null, zero or hold null or non-finite components, rows without id, and
vectors whose length is not the most frequent one take no part; ties go to the smaller vec_id; rows
that bear the query's vec_id are not its candidates; repeated rows are candidates each; of usable queries
that bear one vec_id the least vector is searched; with few rows there are few lists; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bit_sliced import dimension
from .common import ints, table, written
from .vectors import matrix

#: Rows to fit on, parts of a vector, codes of a part, rows of the sample that measure probes and error.
FIT_ROWS, PARTS, CODES, ASKED = 20_000, 16, 256, 400
#: Share of true neighbours whose exact score may exceed the tables' by more than the margin.
MISSED = 0.005
#: Every so manieth row of the sample measures and is not fitted on (in a sample of 1000 rows or more).
HELD = 4
#: Rows of a shard, queries of a pack, rows of the sample compared at a time.
SHARD, PACK, CHUNK = 16_384, 1024, 2048
#: So many times k rows of a shard tell which score k rows reach.
FIRST = 3


@dataclass
class Model:
    centre: np.ndarray  # (lists, dim)
    books: np.ndarray  # (parts, codes, width)
    probes: int
    margin: float


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid."""
    size = (centre**2).sum(1)[None]
    found = [(size - 2 * x[a : a + CHUNK] @ centre.T).argmin(1) for a in range(0, len(x), CHUNK)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids of x (float32); empty ones are put on the worst-placed rows."""
    k = max(1, min(k, len(x)))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        full = count > 0
        apart = ((x - centre[near]) ** 2).sum(1)
        centre[full] = np.add.reduceat(x[order], first[full], axis=0) / count[full, None]
        if not full.all():
            far = np.argsort(-apart)[: int((~full).sum())]
            centre[np.nonzero(~full)[0][: len(far)]] = x[far]
    return centre


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    """x as (rows, parts, width), with zeros where dim isn't a multiple of parts."""
    extra = -x.shape[1] % parts
    return np.pad(x, [(0, 0), (0, extra)]).reshape(len(x), parts, -1)


def encode(x: np.ndarray, centre: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float32)
    lists = nearest(x, centre)
    rest = padded(x - centre[lists], len(books))
    return lists, np.stack([nearest(rest[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(query, part * codes): what each code of each part adds to a query's score."""
    return np.einsum("qpw,pcw->qpc", padded(queries.astype(np.float32), len(books)), books).reshape(len(queries), -1)


def fit(x: np.ndarray, lists: int, k: int, recall: float, seed: int = 7) -> Model:
    """A model of x, whose probes find the share `recall` of the k nearest among these rows."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(x)) % HELD == HELD - 1 if len(x) >= 1000 else np.ones(len(x), bool)
    wide = x[~aside if len(x) >= 1000 else aside].astype(np.float32)
    centre = k_means(wide, lists, 10, rng)
    rest = padded(wide - centre[nearest(wide, centre)], PARTS)
    books = [k_means(rest[:, p], CODES, 8, rng) for p in range(PARTS)]
    most = max(map(len, books))
    books = np.stack([np.pad(b, [(0, most - len(b)), (0, 0)], mode="edge") for b in books])
    x = x[aside]
    near, codes = encode(x, centre, books)
    asked = np.arange(len(x))[:: max(1, len(x) // ASKED)][:ASKED]
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not top.size:
        return Model(centre, books, len(centre), 0.0)
    first = x[asked] @ centre.T.astype(np.float64)
    place = np.empty(first.shape, np.int64)
    np.put_along_axis(place, np.argsort(-first, axis=1, kind="stable"), np.arange(first.shape[1])[None], axis=1)
    need = np.sort(np.take_along_axis(place, near[top], axis=1), axis=None)
    probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1
    flat = codes.astype(np.int32) + most * np.arange(PARTS, dtype=np.int32)
    rough = np.take_along_axis(tables(x[asked], books)[:, None, :], flat[top], axis=2).sum(axis=2)
    rough = rough + np.take_along_axis(first, near[top], axis=1)
    error = np.take_along_axis(score, top, axis=1) - rough
    return Model(centre, books, probes, float(max(0.0, np.quantile(error, 1 - MISSED))) + 1e-6)


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows, values = matrix(batch.column("embedding"), dim)
    some = (values != 0).any(axis=1)
    return ints(batch.column("vec_id"))[rows[some]].astype(np.int64), values[some]


def _assign(dim: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, dim)
            if len(ids):
                lists, codes = encode(x, model.value.centre, model.value.books)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), pa.array(ids), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["list", "vec_id", "codes", "vector"],
                )

    return run


def _pack(columns: list[str], limit: int | None):
    """Rows sorted by shard become rows of at most limit members (None: a whole shard), their columns joined up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {c: [] for c in columns}

        def out() -> pa.RecordBatch:
            blobs = [b"".join(x) if isinstance(x[0], bytes) else np.array(x, np.int64).tobytes() for x in held.values()]
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["shard", *columns])

        for batch in batches:
            for shard, *row in zip(batch.column("shard").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                if held[columns[0]] and (shard != now or len(held[columns[0]]) == limit):
                    yield out()
                now = shard
                for c, v in zip(columns, row):
                    held[c].append(v)
        if held[columns[0]]:
            yield out()

    return run


def _probe(dim: int, model, places):
    """Queries dealt to the shards of the lists that they probe; places: (first, last) shard of each list, -1 without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, first, last = model.value.centre.T.astype(np.float64), *places.value
        for batch in batches:
            ids, x = usable(batch, dim)
            if not len(ids):
                continue
            lists = np.argsort(-(x @ centre), axis=1, kind="stable")[:, : model.value.probes]
            row, which = np.repeat(np.arange(len(ids)), lists.shape[1]), lists.ravel()
            row, which = row[first[which] >= 0], which[first[which] >= 0]
            times = last[which] - first[which] + 1
            shard = np.repeat(first[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, which = np.repeat(row, times), np.repeat(which, times)
            order = np.lexsort((which, shard, row))
            row, which, shard = row[order], which[order].astype(np.int32), shard[order]
            new = np.nonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))[0] if len(row) else np.empty(0, np.int64)
            size = np.diff(np.append(new, len(row)))
            probed = [which[a : a + n].tobytes() for a, n in zip(new.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[new]), pa.array(ids[row[new]]), pa.array([x[r].tobytes() for r in row[new]], pa.binary()), pa.array(size), pa.array(probed, pa.binary())],
                ["shard", "query_id", "query", "n_probed", "probed"],
            )

    return run


def search_shard(lists: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], model: Model, k: int):
    """(query row, shard row, score): the k best of a shard for each query; rows are sorted by list and vec_id."""
    here, start = np.unique(lists, return_index=True)
    size = np.diff(np.append(start, len(lists)))
    flat = codes.astype(np.int32) + model.books.shape[1] * np.arange(codes.shape[1], dtype=np.int32)
    each, middle = tables(queries, model.books), queries @ model.centre[here].T.astype(np.float64)
    for q, wanted in enumerate(probed):
        at = np.searchsorted(here, wanted)
        at = at[here[np.minimum(at, len(here) - 1)] == wanted] if len(here) else at[:0]
        if not len(at):
            continue
        rows = np.repeat(start[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(size[at].sum())
        rough = each[q].take(flat[rows]).sum(axis=1) + np.repeat(middle[q, at], size[at])
        live = ids[rows] != query_ids[q]
        rows, rough = rows[live], rough[live]
        if len(rows) > FIRST * k:
            best = np.argpartition(rough, len(rough) - FIRST * k)[-FIRST * k :]
            reached = np.partition((vectors[rows[best]] * queries[q]).sum(axis=1), -k)[-k]
            rows = rows[rough >= reached - model.margin]
        exact = (vectors[rows] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[rows], -exact))[:k]
        yield np.full(len(order), q), rows[order], exact[order]


def _search(dim: int, model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lists, ids, query_ids, n_probed = (np.frombuffer(row[c], np.int64) for c in ("list", "vec_id", "query_id", "n_probed"))
                codes, probed = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["probed"], np.int32)
                vectors, queries = np.frombuffer(row["vector"]).reshape(-1, dim), np.frombuffer(row["query"]).reshape(-1, dim)
                found = list(search_shard(lists, ids, codes, vectors, query_ids, queries, np.split(probed, np.cumsum(n_probed)[:-1]), model.value, k))
                if found:
                    q, r, score = map(np.concatenate, zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def model_of(rows: DataFrame, k: int, dim: int, fit_rows: int = FIT_ROWS, recall: float = 0.9) -> Model | None:
    """The model of a table's vectors; None if no vector is usable."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toArrow().combine_chunks()  # at most fit_rows vectors
    known = [usable(b, dim)[1] for b in sample.to_batches()] if dim else []
    x = np.concatenate(known) if known else np.empty((0, 1))
    return fit(x, max(1, int(min(4 * rows.count() ** 0.5, len(x) / 20))), k, recall) if len(x) else None


def search(rows: DataFrame, queries: DataFrame, k: int, fit_rows: int = FIT_ROWS, recall: float = 0.9) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, the k nearest found among all rows."""
    spark = rows.sparkSession
    pick = [F.col("vec_id").cast("long").alias("vec_id"), "embedding"]
    rows, queries = rows.select(pick).where("vec_id is not null"), queries.select(pick).where("vec_id is not null")
    dim = dimension(rows)
    fitted = model_of(rows, k, dim, fit_rows, recall)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(fitted)  # at most fit_rows / 20 centroids
    good = "size(embedding) = {} and forall(embedding, x -> x is not null and abs(double(x)) < double('infinity')) and exists(embedding, x -> x != 0)".format(dim)
    queries = queries.where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    coded = written(rows.mapInArrow(_assign(dim, model), "list int, vec_id long, codes binary, vector binary"))
    sizes = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # one row a list
    count = np.array([sizes.get(i, 0) for i in range(len(fitted.centre))], np.int64)
    before = np.cumsum(count) - count
    places = spark.sparkContext.broadcast((np.where(count > 0, before // SHARD, -1), (before + count - 1) // SHARD))
    spread = spark.createDataFrame([(i, int(b), int(c)) for i, (b, c) in enumerate(zip(before, count))], "list int, before long, n long")
    # A row's place among its list's is drawn from its id, so that a large list fills its shards evenly.
    draw = F.pmod(F.xxhash64("vec_id"), F.col("n"))
    placed = coded.join(F.broadcast(spread), "list").withColumn("shard", F.floor((F.col("before") + draw) / SHARD).cast("long")).withColumn("list", F.col("list").cast("long"))
    members = ["list", "vec_id", "codes", "vector"]
    inverted = placed.select("shard", *members).repartition("shard").sortWithinPartitions("shard", "list", "vec_id").mapInArrow(_pack(members, None), "shard long, list binary, vec_id binary, codes binary, vector binary")
    asked = queries.mapInArrow(_probe(dim, model, places), "shard long, query_id long, query binary, n_probed long, probed binary")
    told = ["query_id", "query", "n_probed", "probed"]
    packs = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(16))).repartition("shard", "salt").sortWithinPartitions("shard").mapInArrow(_pack(told, PACK), "shard long, " + ", ".join(f"{c} binary" for c in told))
    met = written(inverted).join(written(packs), "shard")
    found = met.select(*members, *told).mapInArrow(_search(dim, model, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"), 20)
