"""Mixing to target weights by soft membership: rates for documents, not for sources.

A classifier fitted on a labelled table gives every document its posterior probability of each domain. Domains
are whatever the labelled table names; the registered query takes clean, low and toxic from `labels`, since the
sources of `documents` cannot be told apart by their text. Document d with w_d tokens and rate r_d adds
w_d r_d p_dk expected tokens to domain k. Nonnegative rates are sought whose totals match the targets t_k in
least squares and which change least, the minimum of

    1/2 sum_k ((sum_d w_d r_d p_dk - t_k) / T)^2  +  RIDGE/2 sum_d (w_d / T) (r_d - 1)^2

with a RIDGE so small that it decides only between rates of equal totals.

This is projected gradient descent. The gradient of a rate is sum_k p_dk e_k, e_k the residual of total k, so all
steps taken so far add up to one number x_k a domain, and the projected rates are r_d = max(0, 1 - sum_k p_dk x_k).
An iteration is one pass over the narrow table of posteriors, which sums the totals of the projected rates and
the Gram matrix of the domains, by which the step is scaled (small domains would else take very many steps), and
tries several lengths of the step at once. It ends when every total is within CLOSE (of all tokens) of its target;
where none gets there (no nonnegative rates may exist) there is a warning with what is left, and `reached` gives
targets and totals as a table. The driver holds a few numbers a domain, never documents.

Rates above 1 are whole copies and a draw for the rest (`copies`). Where they cannot be used (most = 1), the
size of the result is left free and only its shares are given: p_dk - (target share of k) takes the place of
p_dk, and 0 that of t_k.

The classifier works on words: how much likelier a domain's documents have a word (by hashed bucket) or a
word of that shape (case and marks), as mean and maximum over the text, weighed by a softmax layer. It is
fitted in numpy on at most `fit_rows` labelled rows of `fit_bytes` bytes in all, those with the least hash of doc_id.

Defined cases: a null or empty text has no tokens and rate 1; label rows without doc_id or domain, or
without a document, do not count; without labelled rows, or with one domain only, posteriors are the
domains' shares (equal ones without any rows) and rates are 1; rows without doc_id are weighed
too; repeated rows each get a result (and are fitted on once); extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, labelled_sample, real_id, table, written
from .word_features import numbers, plain, tokens

FIT_ROWS, BUCKETS, SHAPES, RIDGE, STEPS, CLOSE = 4000, 1 << 17, 1 << 12, 1e-6, 200, 1e-4
#: Bytes of text to fit on.
FIT_BYTES = 1 << 25
#: Lengths of a step that one pass tries.
LENGTHS = [1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001]

#: Domains of op4 and the pipeline, from the columns of labels, and their target weights.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 0 then 'low' when quality = 1 then 'clean' end"
WEIGHTS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


def shape(word: str) -> str:
    """A word's marks, with letters as a, A or Aa."""
    body = plain(word)
    case = "A" if len(word) > 1 and word.isupper() else "Aa" if word[:1].isupper() else "a"
    return case + re.sub(r"\w+", "_", word)[:8] + ("" if body else "-")


def key(word: str) -> tuple[int, int]:
    return numbers(plain(word), BUCKETS)[0], numbers(shape(word), SHAPES)[0]


class Classifier:
    def __init__(self, domains: list[str], share: np.ndarray):
        self.domains, self.share, self.weights = domains, share, None

    def features(self, distinct: np.ndarray, of: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(rows, 4 domains + 1): mean and maximum over each row's words, of both tables, and 1."""
        k = len(self.domains)
        out = np.zeros((len(length), 4 * k + 1), np.float32)
        out[:, -1] = 1
        if len(of):
            each = np.concatenate([self.words[distinct[:, 0]], self.shapes[distinct[:, 1]]], axis=1)[of]
            full = np.nonzero(length)[0]
            starts = (np.cumsum(length) - length)[full]
            out[full, : 2 * k] = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / length[full, None]
            out[full, 2 * k : 4 * k] = np.maximum.reduceat(each, starts, axis=0)
        return out

    def posteriors(self, distinct: np.ndarray, of: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.broadcast_to(self.share, (len(length), len(self.share)))
        z = (self.features(distinct, of, length) - self.centre) / self.scale @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _odds(rows: list[np.ndarray], label: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """(buckets, k): log of how much likelier a domain's documents have a bucket than documents at large."""
    seen, share = np.zeros((buckets, k)), np.bincount(label, minlength=k) / len(label)
    for r, y in zip(rows, label):
        seen[np.unique(r), y] += 1
    return np.log((seen + 4 * share) / ((seen.sum(axis=1, keepdims=True) + 4) * np.maximum(share, 1e-9)) + 1e-9).astype(np.float32)


def _softmax_fit(x: np.ndarray, label: np.ndarray, k: int, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    w, speed, hot = np.zeros((x.shape[1], k)), 0.0, np.eye(k)[label]
    for _ in range(steps):
        z = np.exp((z := x @ w) - z.max(axis=1, keepdims=True))
        speed = 0.9 * speed - rate * (x.T @ (z / z.sum(axis=1, keepdims=True) - hot) / len(x) + 1e-4 * w)
        w = w + 0.1 * speed
    return w


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Classifier:
    """A classifier of docs; labelled: doc_id, domain."""
    some = labelled.select("doc_id", F.col("domain").cast("string").alias("label")).where(F.col("label").isin(domains))
    got = labelled_sample(docs, some, fit_rows, fit_bytes)
    label = np.array([domains.index(d) for d in got.column("label").to_pylist()], np.int64)
    share = np.bincount(label, minlength=len(domains)) / len(label) if len(label) else np.full(len(domains), 1 / len(domains))
    model = Classifier(domains, share)
    if len(np.unique(label)) < 2:
        return model
    rows: list[np.ndarray] = []
    for batch in got.to_batches():
        for _, length, distinct, of in tokens(batch, key):
            pairs = np.array(distinct, np.int64).reshape(-1, 2)[of] if len(of) else np.empty((0, 2), np.int64)
            rows += np.split(pairs, np.cumsum(length)[:-1])
    # The tables come from one half, the layer from the other, which the tables have not seen.
    half = np.arange(len(rows)) % 2 == 0
    parts = [[r for r, h in zip(rows, half) if h == side] for side in (True, False)]
    k = len(domains)
    model.words = _odds([r[:, 0] for r in parts[0]], label[half], k, BUCKETS)
    model.shapes = _odds([r[:, 1] for r in parts[0]], label[half], k, SHAPES)
    words = np.concatenate([*parts[1], np.empty((0, 2), np.int64)])
    x = model.features(words, np.arange(len(words)), np.array([len(r) for r in parts[1]], np.int64))
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model.centre[-1], model.scale[-1] = 0, 1
    model.weights = _softmax_fit((x - model.centre) / model.scale, label[~half], k)
    return model


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(dk, th, n_tokens, p_<domain> ...) of each row; tokens are words between white space."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{d}" for d in model.domains]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}

        def of_word(word: str) -> tuple[int, int]:
            if (found := known.get(word)) is None:
                found = key(word)
                if len(known) < 200_000:
                    known[word] = found
            return found

        for batch in batches:
            p, n = np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows, np.int64)
            for row, length, distinct, of in tokens(batch, of_word):
                p[row : row + len(length)] = held.value.posteriors(np.array(distinct, np.int64).reshape(-1, 2), of, length)
                n[row : row + len(length)] = length
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("th"), pa.array(n), *(pa.array(c) for c in p.T)], ["dk", "th", "n_tokens", *names])

    rows = keyed(docs).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, "dk long, th long, n_tokens long, " + ", ".join(f"`{c}` double" for c in names))


def rates(found: DataFrame, weights: dict[str, float], anchor: str | None = None, ridge: float = RIDGE, most: float = np.inf) -> DataFrame:
    """found (from posteriors, written) with the column rate.

    weights: target shares of the domains. The targets add up to the tokens there are or, with anchor,
    to what leaves that domain's total as it is; with a finite `most` shares alone count.
    """
    names = [f"p_{d}" for d in weights]
    share = np.array(list(weights.values()), float)
    share = share / share.sum()
    free = bool(np.isfinite(most))
    sums = found.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(f"`{c}`")) for c in names)).first()
    total, now = float(sums[0] or 0), np.array([float(x or 0) for x in sums[1:]])
    k, x = len(names), np.zeros(len(names))

    def features(batch: pa.RecordBatch) -> np.ndarray:
        """What a token of each document adds to the totals."""
        p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
        return p - share if free else p

    if total:
        i = list(weights).index(anchor) if anchor else 0
        target = np.zeros(k) if free else share * (now[i] / share[i] / total if anchor else 1.0)

        def measures(points: list[np.ndarray]) -> list[tuple]:
            """At every point: the dual's value, its falling gradient (totals less targets), its second derivatives."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((len(points), 1 + k + k * k))
                for batch in batches:
                    p, w = features(batch), batch.column("n_tokens").to_numpy() / total
                    for row, at in zip(out, points):
                        raw = 1 - p @ at
                        r = np.clip(raw, 0, most)
                        wp = p * (w * ((raw > 0) & (raw <= most)))[:, None]
                        # r^2/2 up to most, then straight on
                        row[0] += w @ (r * r / 2 + r * (raw - r) * (raw > r))
                        row[1 : 1 + k] += (w * r) @ p
                        row[1 + k :] += (wp.T @ p).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["i", "s"])

            got = {r[0]: r[1] for r in found.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s")).collect()}
            rows = np.array([got[j] for j in range(len(got))]).reshape(len(points), -1)
            return [
                (r[0] + target @ at + ridge / 2 * at @ at, r[1 : 1 + k] - target - ridge * at, r[1 + k :].reshape(k, k) + ridge * np.eye(k), r[1 : 1 + k] - target)
                for r, at in zip(rows, points)
            ]

        value, down, second, apart = measures([x])[0]
        every = second  # with all documents off the bounds: steps by it always fall
        for _ in range(STEPS):
            if np.abs(apart).max() < CLOSE:
                break
            step = np.linalg.solve(second, down)
            tried = [*(x + length * step for length in LENGTHS), x + np.linalg.solve(every, down)]
            results = measures(tried)
            best = min(range(len(tried)), key=lambda j: results[j][0])
            if results[best][0] >= value:
                break  # rounding: no length of the step gains anything
            x, (value, down, second, apart) = tried[best], results[best]
        if np.abs(apart).max() >= CLOSE:
            warnings.warn(f"mixing: totals differ from their targets by {dict(zip(weights, apart.round(5).tolist()))} of all tokens", stacklevel=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = np.where(batch.column("n_tokens").to_numpy() > 0, np.clip(1 - features(batch) @ x, 0, most), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(run, f"{kinds}, rate double")


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None, most: float = np.inf) -> DataFrame:
    """(dk, th, n_tokens, p_<domain> ..., rate) of each row of docs; labelled: doc_id, domain."""
    model = fit(docs, labelled, list(weights))
    found = posteriors(docs, model)
    if model.weights is None:
        return found.withColumn("rate", F.lit(1.0))
    return rates(written(found), weights, anchor, most=most)


def reached(rated: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(domain, target, share): the target share of each domain and its share of the expected tokens at these rates."""
    share = {d: x / sum(weights.values()) for d, x in weights.items()}
    tokens_ = F.col("n_tokens") * F.col("rate")
    sums = rated.agg(F.sum(tokens_).alias("all"), *(F.sum(tokens_ * F.col(f"`p_{d}`")).alias(f"s_{d}") for d in weights))
    each = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(x).alias("target"), (F.col(f"`s_{d}`") / F.col("all")).alias("share")) for d, x in share.items()))
    return sums.select(F.inline(each))


def copies(rate: str = "rate"):
    """How often to take a document: its rate rounded up or down by a hash of (dk, th), so that rates hold on average."""
    draw = F.pmod(F.xxhash64("dk", "th"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col(rate) + draw).cast("int")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.expr(DOMAIN).alias("domain"))
    found = mixed(table(spark, sf_dir, "documents"), labelled, WEIGHTS, "clean")
    return found.select(real_id(), "n_tokens", *(f"p_{d}" for d in WEIGHTS), "rate")
