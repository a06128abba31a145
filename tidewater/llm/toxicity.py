"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the pair of its rows in two hashed tables. Filters of one, two and three words run
over the whole text, each is pooled to its maximum, and a logistic layer makes the score. Before the
training by Adam starts, the first coordinate of every row holds how much likelier a toxic document is to
have a word of that bucket (smoothed, from the training rows), and one filter of each width reads it; so
the maximum is informative from the first step. All weights are trained, with the gradient going to the
positions that the pooling chose.

The model is fitted on the driver on a bounded sample of labelled rows (`fit_rows` rows of `fit_bytes` bytes
in all, those with the least hash of doc_id) and broadcast; its size is fixed (BUCKETS). Thresholds are calibrated by language on the
rows that the training left out. Scoring is one pass over the documents without a shuffle. Labels,
lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has no words, so all filters give 0 and the score is that of the
bias; label rows with a null doc_id or label, or without a document, are no training rows; repeated
label rows, and repeated documents, count once; without rows of both labels the score is the share of label 1 (0 without any);
documents without doc_id are scored, held_out counts them as the empty string; each row has its own
result; extra columns are ignored; empty tables give an empty result. Long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table
from .word_features import numbers, plain, tokens

#: Bytes of text to fit on.
FIT_BYTES = 1 << 25
#: Rows to fit on, rows of an embedding table, its width, filters of each width of so many words.
FIT_ROWS, BUCKETS, WIDTH, FILTERS, SPANS = 6000, 1 << 17, 4, 6, (1, 2, 3)
#: Rows of each label that calibrate a threshold at least (else it is 0.5).
ENOUGH = 10
#: Words whose filters are computed at once.
RUN = 1 << 16


def key(word: str) -> tuple[int, int]:
    return numbers(plain(word), BUCKETS)


class Net:
    """The weights, as float32: two tables, filters (span offset, 2 WIDTH, filters), the logistic layer."""

    def __init__(self, base: float = 0.0):
        self.base, self.ready = base, False
        self.thresholds: dict[str, float] = {}

    def start(self, odds: np.ndarray, rng: np.random.Generator) -> None:
        self.tables = rng.normal(0, 0.05, (2, BUCKETS, WIDTH)).astype(np.float32)
        self.tables[:, :, 0] = odds
        self.filters = [rng.normal(0, 0.1, (s, 2 * WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
        for f in self.filters:
            f[:, :, 0] = 0
            f[0, 0, 0] = f[0, WIDTH, 0] = 0.5
        self.bias = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.out = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.out[::FILTERS] = 1 / len(SPANS)
        self.shift = np.float32(-1)
        self.ready = True

    def pooled(self, distinct: np.ndarray, of: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, filters): maxima over each row's words, and the word where each begins (-1: none).

        distinct: (words, 2) buckets; of: each word's distinct one; length: words of each row. A filter
        may reach beyond the row's end, where all is zero.
        """
        n, many = len(length), len(SPANS) * FILTERS
        best, place = np.zeros((n, many), np.float32), np.full((n, many), -1)
        if not len(of):
            return best, place
        x = np.concatenate([self.tables[0][distinct[:, 0]], self.tables[1][distinct[:, 1]]], axis=1)
        each = [[x @ f[k] for k in range(s)] for s, f in zip(SPANS, self.filters)]
        ends = np.cumsum(length)
        full = np.nonzero(length)[0]
        starts = (ends - length)[full]
        for a in range(0, len(of), RUN):
            b = min(len(of), a + RUN)
            last = np.searchsorted(ends, np.arange(a, b), "right")  # each word's row
            got = np.zeros((b - a, many), np.float32)
            for j, s in enumerate(SPANS):
                here = got[:, j * FILTERS : (j + 1) * FILTERS]
                here += each[j][0][of[a:b]]
                for k in range(1, s):
                    inside = np.nonzero(np.arange(a, b) + k < ends[last])[0]
                    here[inside] += each[j][k][of[a + inside + k]]
            got += self.bias
            first = np.maximum(starts[(starts < b) & (ends[full] > a)], a) - a
            some = full[(starts < b) & (ends[full] > a)]
            top = np.maximum.reduceat(got, first, axis=0)
            if self.training:
                size = np.diff(np.append(first, b - a))
                for i, (f0, m) in enumerate(zip(first, size)):
                    where = got[f0 : f0 + m].argmax(axis=0) + f0 + a
                    better = top[i] > best[some[i]]
                    place[some[i], better] = where[better]
            best[some] = np.maximum(best[some], top)
        return best, place

    training = False

    def score(self, distinct: np.ndarray, of: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(length), self.base)
        z = self.pooled(distinct, of, length)[0].astype(np.float64) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct bucket pairs, each word's, lengths) of rows of bucket pairs."""
    words = np.concatenate([*rows, np.empty((0, 2), np.int64)])
    pair, of = np.unique(words[:, 0] * BUCKETS + words[:, 1], return_inverse=True)
    return np.stack([pair // BUCKETS, pair % BUCKETS], axis=1), of, np.array([len(r) for r in rows])


def log_odds(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): the smoothed log of how much likelier toxic documents have a bucket."""
    out = np.zeros((2, BUCKETS), np.float32)
    share = label.mean()
    for h in (0, 1):
        seen = np.zeros((2, BUCKETS))
        for r, y in zip(rows, label):
            seen[y, np.unique(r[:, h])] += 1
        # Added counts, in the labels' shares, keep rare buckets near 0.
        odds = np.log((seen[1] + 4 * share) / (seen.sum(axis=0) + 4) / share)
        out[h] = odds - np.log(np.maximum((seen[0] + 4 * (1 - share)) / (seen.sum(axis=0) + 4) / (1 - share), 1e-9))
    return out


def train(rows: list[np.ndarray], label: np.ndarray, rounds: int = 4, batch: int = 32, rate: float = 0.02, seed: int = 11) -> Net:
    """A net fitted to rows of bucket pairs and their 0/1 labels."""
    net = Net(float(label.mean()) if len(label) else 0.0)
    if len(np.unique(label)) < 2:
        return net
    rng = np.random.default_rng(seed)
    net.start(log_odds(rows, label), rng)
    net.training = True
    weights = {"filters0": net.filters[0], "filters1": net.filters[1], "filters2": net.filters[2], "bias": net.bias, "out": net.out}
    mean = {k: np.zeros_like(w) for k, w in weights.items()}
    square = {k: np.zeros_like(w) for k, w in weights.items()}
    shift, step = np.zeros(2), 0
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            distinct, of, length = _flat([rows[i] for i in some])
            best, place = net.pooled(distinct, of, length)
            error = (1 / (1 + np.exp(-np.clip(best @ net.out + net.shift, -30, 30))) - label[some]).astype(np.float32) / len(some)
            step += 1
            grads = {k: np.zeros_like(w) for k, w in weights.items()}
            grads["out"] = error @ best + 1e-4 * net.out
            back = error[:, None] * net.out * (place >= 0)
            grads["bias"] = back.sum(axis=0)
            ends = np.cumsum(length)
            slow: dict[int, np.ndarray] = {}
            for j, s in enumerate(SPANS):
                for f in range(FILTERS):
                    c = j * FILTERS + f
                    for i in np.nonzero(back[:, c])[0]:
                        for k in range(s):
                            w = place[i, c] + k
                            if w < ends[i]:
                                a, b = distinct[of[w]]
                                x = np.concatenate([net.tables[0, a], net.tables[1, b]])
                                grads[f"filters{j}"][k, :, f] += back[i, c] * x
                                g = back[i, c] * net.filters[j][k, :, f]
                                slow[a] = slow.get(a, 0) + g[:WIDTH]
                                slow[BUCKETS + b] = slow.get(BUCKETS + b, 0) + g[WIDTH:]
            for k, w in weights.items():
                mean[k] = 0.9 * mean[k] + 0.1 * grads[k]
                square[k] = 0.999 * square[k] + 0.001 * grads[k] ** 2
                w -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
            shift = np.array([0.9 * shift[0] + 0.1 * error.sum(), 0.999 * shift[1] + 0.001 * error.sum() ** 2])
            net.shift -= np.float32(rate * (shift[0] / (1 - 0.9**step)) / (np.sqrt(shift[1] / (1 - 0.999**step)) + 1e-7))
            for row, g in slow.items():  # embeddings: plain steps, as most are never chosen
                net.tables[row // BUCKETS, row % BUCKETS] -= np.float32(5 * rate) * g
    net.training = False
    return net


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold of the highest F1 (ties: nearest to 0.5); 0.5 where a label has too few rows."""
    if min(label.sum(), (1 - label).sum()) < ENOUGH:
        return 0.5
    cuts = np.unique(np.concatenate([[0.5], (np.unique(score)[1:] + np.unique(score)[:-1]) / 2]))
    hit = np.array([((score >= c) & (label == 1)).sum() * 2 / max(1, (score >= c).sum() + label.sum()) for c in cuts])
    best = cuts[hit == hit.max()]
    return float(best[np.abs(best - 0.5).argmin()])


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, fit_rows: int = FIT_ROWS, held: int = 8, fit_bytes: int = FIT_BYTES) -> Net:
    """A net trained on fit_rows labelled rows at most, every held-th of which calibrates the thresholds."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    got = labelled_sample(docs, some.where(where) if where is not None else some, fit_rows, fit_bytes, lang.alias("lang"))
    rows: list[np.ndarray] = []
    for batch in got.to_batches():
        for _, length, distinct, of in tokens(batch, key):
            pairs = np.array(distinct, np.int64).reshape(-1, 2)[of] if len(of) else np.empty((0, 2), np.int64)
            rows += np.split(pairs, np.cumsum(length)[:-1])
    label = got.column("label").to_numpy().astype(np.int64)
    langs = np.array([x or "" for x in got.column("lang").to_pylist()])
    aside = np.arange(len(rows)) % held == held - 1
    net = train([r for r, a in zip(rows, aside) if not a], label[~aside])
    score = net.score(*_flat([r for r, a in zip(rows, aside) if a])) if aside.any() else np.empty(0)
    if net.ready:
        # 0.5 becomes the best threshold over all languages.
        cut = min(max(best_threshold(score, label[aside]), 1e-6), 1 - 1e-6)
        net.shift -= np.float32(np.log(cut / (1 - cut)))
        score = 1 / (1 + (1 / np.clip(score, 1e-12, 1) - 1) * cut / (1 - cut))
    for name in np.unique(langs[aside]):
        mine = langs[aside] == name
        net.thresholds[str(name)] = best_threshold(score[mine], label[aside][mine])
    return net


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, lang, score, flagged): flagged by the threshold of the row's language (0.5 without one)."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}

        def of_word(word: str) -> tuple[int, int]:
            if (found := known.get(word)) is None:
                found = key(word)
                if len(known) < 200_000:
                    known[word] = found
            return found

        for batch in batches:
            score = np.zeros(batch.num_rows)
            for row, length, distinct, of in tokens(batch, of_word):
                score[row : row + len(length)] = held.value.score(np.array(distinct, np.int64).reshape(-1, 2), of, length)
            cut = np.array([held.value.thresholds.get(x or "", 0.5) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(score), pa.array(score >= cut)], ["doc_id", "lang", "score", "flagged"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, flagged boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs, labels, where=~held_out())
    return scored(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
