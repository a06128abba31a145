"""LM scoring: a hidden Markov model of words, trained by Baum-Welch counts that partitions add up.

Words. Texts are gathered into blocks. A block sends each of its distinct words once, with its count in
training texts; the words are counted by ordinary aggregation, and each block gets back its words' counts.
Every word is a symbol of a bounded alphabet: the TOP most frequent words and the end have symbols of
their own, the others share TAIL symbols by their last three code points. A state emits a symbol, the
symbol a word by add-one smoothed counts (with one place for words never seen), so the probabilities of all
texts are those of one model; all counts are over the whole corpus.

Training. Each round of Baum-Welch is one pass over all training texts: a task runs the scaled
forward-backward recursion over many texts side by side and returns the expected counts of states,
transitions and emissions, which the cluster adds up by symbol. Driver and broadcast hold the model alone
(STATES numbers a symbol). For training, texts are cut in pieces of PIECE words; a piece that does not begin its text has
initial probabilities of its own, learned as well. Round one starts from a model fitted to a bounded sample
(SAMPLE texts of up to SAMPLE_WORDS words), since labels of states must differ somehow; all that is estimated
afterwards covers all training texts.

Scoring. The scaled forward recursion gives the exact likelihood of the whole text. What goes beyond
LONG words is cut in pieces whose transfer matrices are computed side by side and then chained, which is the same
product of matrices.

Defined cases: null or empty texts consist of the end alone; a null doc_id counts as the empty string in
held_out; each row has its own result and, if it is not held out, is learned from, so repeated rows count
repeatedly; without training texts N and V are 0 and the model is uniform; extra columns are ignored; empty tables give
an empty result. Very long words never have a symbol of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, real_id, scratch, shuffle_partitions, table, utf8, written
from .words import Vocabulary, texts

STATES, TOP, TAIL, ROUNDS = 12, 8192, 4096, 5
#: The longest word, in code points, that may have a symbol of its own.
LONGEST = 64
#: Texts of the sample that the first model is fitted to, words of each at most, rounds there.
SAMPLE, SAMPLE_WORDS, SAMPLE_ROUNDS = 600, 800, 25
#: Weight of the unigram prior in each state's emissions.
PRIOR = 200.0
BLOCK_BYTES, PIECE, LONG = 16 << 20, 512, 4096
#: Words of a batch that is computed at once.
BATCH = 1 << 18
#: Documents whose crc32 leaves REMAINDER when divided by FOLDS are held out.
FOLDS, REMAINDER = 7, 2


def held_out(column: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS) == REMAINDER


# -- words and their symbols

BLOCKS = "block long, words array<string>, n array<long>, tokens binary, dk binary, held binary, size binary"


def _blocks(limit: int):
    def block(number, vocabulary, held, keys, apart) -> pa.RecordBatch:
        size = np.array([len(x) for x in held], np.int64)
        tokens = np.concatenate(held)
        learn = np.repeat(~np.array(apart, bool), size)
        n = np.bincount(tokens[learn], minlength=len(vocabulary))
        words = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
        cells = [tokens.tobytes(), np.array(keys, np.int64).tobytes(), np.array(apart, bool).tobytes(), size.tobytes()]
        name = TaskContext.get().partitionId() << 32 | number
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(n, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([name]), *lists, *(pa.array([c], pa.binary()) for c in cells)], [f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = 0, 0
        vocabulary, held, keys, apart = Vocabulary({b"": 0}), [], [], []
        for batch in batches:
            for (dk, text), out in zip(texts(batch), batch.column("held").to_pylist()):
                if held and total + len(text) > limit:
                    yield block(number, vocabulary, held, keys, apart)
                    number, total = number + 1, 0
                    vocabulary, held, keys, apart = Vocabulary({b"": 0}), [], [], []
                held.append(np.append(vocabulary.numbers(text.lower()), np.int32(0)))  # 0 is the end
                keys.append(dk)
                apart.append(out)
                total += len(text)
        if held:
            yield block(number, vocabulary, held, keys, apart)

    return run


CODED = "dk long, held boolean, n_tokens long, n_known long, base double, inner double, symbols binary"


def _code(block: pa.Table, told: pa.Table) -> pa.Table:
    """The documents of a block with their words as symbols; told: a row for each distinct word."""
    if not block.num_rows:
        raise ValueError("words of a block that is not there")
    row = block.to_pylist()[0]
    tokens, size, dk = (np.frombuffer(row[c], kind) for c, kind in (("tokens", np.int32), ("size", np.int64), ("dk", np.int64)))
    place = told.column("pos").to_numpy()
    columns = {}
    for name, kind in (("symbol", np.uint16), ("c", np.int64), ("base", np.float64), ("inner", np.float64)):
        columns[name] = np.zeros(len(place), kind)
        columns[name][place] = told.column(name).to_numpy()
    start = np.cumsum(size) - size
    sums = [np.add.reduceat(column[tokens], start) for column in ((columns["c"] > 0).astype(np.int64), columns["base"], columns["inner"])]
    symbols = columns["symbol"][tokens]
    bodies = [symbols[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]
    held = np.frombuffer(row["held"], bool)
    return pa.table([pa.array(dk), pa.array(held), pa.array(size), *map(pa.array, sums), pa.array(bodies, pa.binary())], names=[f.split()[0] for f in CODED.split(", ")])


def coded(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, np.ndarray, int]:
    """Each document's symbols and sums (as CODED), the symbols' shares of training words, and N."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    name = f"tidewater_words_{uuid.uuid4().hex}"
    rows = keyed(docs, held_out().alias("held")).mapInArrow(_blocks(block_bytes), BLOCKS)
    rows.write.bucketBy(parts, "block").option("path", f"{scratch(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalog's entry only: the files are read by those who hold the table
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "x")).select("block", "pos", "x.words", "x.n").withColumnRenamed("words", "word")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")))
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    # At most TOP short words: bounded, as are the TAIL classes below.
    top = [r["word"] for r in counts.where(f"c > 0 and word <> '' and length(word) <= {LONGEST}").orderBy(F.desc("c"), "word").limit(TOP).collect()]
    chosen = spark.createDataFrame([("", 0), *((w, i) for i, w in enumerate(top, 1))], "word string, own int")
    tail = F.pmod(F.xxhash64(F.right("word", F.lit(3))), F.lit(TAIL)).cast("int") + F.lit(TOP + 1)
    named = counts.join(F.broadcast(chosen), "word", "left").select("word", "c", F.coalesce("own", tail).alias("symbol"))
    classes = written(named.groupBy("symbol").agg(F.sum("c").alias("all"), F.count_if(F.col("c") > 0).alias("kinds")))
    inner = F.when(F.col("symbol") > TOP, F.log10((F.col("c") + 1) / (F.col("all") + F.col("kinds") + 1))).otherwise(0.0)
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    known = named.join(F.broadcast(classes), "symbol").select("word", "c", "symbol", base.alias("base"), inner.alias("inner"))
    told = words.select("block", "pos", "word").join(known, "word").select(F.col("block").alias("of"), "pos", "c", "symbol", "base", "inner")
    found = written(blocks.select("block", "tokens", "dk", "held", "size").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_code, CODED))
    share = np.ones(TOP + TAIL + 1)
    for r in classes.collect():
        share[r["symbol"]] += r["all"]
    return found, share / share.sum(), n


# -- the model


class Model:
    """start and inside: a text's or a later piece's first state; move: transitions; emit: (symbols, states)."""

    def __init__(self, start: np.ndarray, inside: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.inside, self.move, self.emit = start, inside, move, emit

    @classmethod
    def guess(cls, share: np.ndarray, states: int, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        even = np.full(states, 1 / states)
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        emit = share[:, None] * rng.gamma(1.0, 1.0, (len(share), states))
        return cls(even, even, move, emit / emit.sum(axis=0))


class Counts:
    """Expected counts, and the log10 likelihood of what they were taken from."""

    def __init__(self, symbols: int, states: int):
        self.emit = np.zeros((symbols, states))
        self.move = np.zeros((states, states))
        self.start, self.inside = np.zeros(states), np.zeros(states)

    def rows(self) -> np.ndarray:
        return np.vstack([self.emit, self.move, self.start, self.inside])

    @classmethod
    def of(cls, rows: np.ndarray, states: int) -> Counts:
        found = cls(0, states)
        found.emit, found.move, found.start, found.inside = rows[: -states - 2], rows[-states - 2 : -2], rows[-2], rows[-1]
        return found


def estimated(counts: Counts, share: np.ndarray) -> Model:
    """The model of the expected counts, with PRIOR words of the unigram distribution in each state."""
    states = len(counts.start)
    move = counts.move + 1.0 / states
    emit = counts.emit + PRIOR * share[:, None]
    first, later = counts.start + 1.0 / states, counts.inside + 1.0 / states
    return Model(first / first.sum(), later / later.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def cut(bodies: list[np.ndarray], piece: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pieces of at most so many symbols, each one's text, and whether it begins it."""
    out, of, first = [], [], []
    for i, body in enumerate(bodies):
        for a in range(0, len(body), piece):
            out.append(body[a : a + piece])
            of.append(i)
            first.append(a == 0)
    return out, np.array(of, np.int64), np.array(first, bool)


def by_time(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols, edge, size): pieces by falling length; symbols of time t are symbols[edge[t]:edge[t + 1]]."""
    size = np.array([len(p) for p in pieces], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([pieces[i] for i in order.tolist()])
    start = np.cumsum(size) - size
    time = np.arange(len(flat)) - np.repeat(start, size)
    by = np.argsort(time, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(time))])
    return order, flat[by], edge, size


def expect(model: Model, pieces: list[np.ndarray], first: np.ndarray, counts: Counts) -> None:
    """Add the expected counts of these pieces (not empty) by forward and backward recursion."""
    order, symbols, edge, _ = by_time(pieces)
    edge = edge.tolist()
    steps, states = len(edge) - 1, len(model.start)
    first = first[order]
    seen = model.emit[symbols]
    ahead = np.empty_like(seen)
    scale = np.empty((len(seen), 1))
    state = np.where(first[:, None], model.start, model.inside)
    for t in range(steps):
        a, b = edge[t], edge[t + 1]
        if t:
            state = state[: b - a] @ model.move
        state = state * seen[a:b]
        scale[a:b] = state.sum(axis=1, keepdims=True)
        state /= scale[a:b]
        ahead[a:b] = state
    seen /= scale
    back = np.ones((edge[steps] - edge[steps - 1], states))
    move = np.zeros((states, states))
    gamma = ahead  # filled from behind
    for t in range(steps - 2, -1, -1):
        a, b, c = edge[t], edge[t + 1], edge[t + 2]
        weighed = seen[b:c] * back
        move += ahead[a : a + c - b].T @ weighed
        gamma[b:c] *= back
        back = np.ones((b - a, states))
        back[: c - b] = weighed @ model.move.T
    gamma[: edge[1]] *= back
    counts.move += move * model.move
    for k in range(states):
        counts.emit[:, k] += np.bincount(symbols, weights=gamma[:, k], minlength=len(counts.emit))
    counts.start += gamma[: edge[1]][first].sum(axis=0)
    counts.inside += gamma[: edge[1]][~first].sum(axis=0)


def likelihood(model: Model, bodies: list[np.ndarray], long: int = LONG, piece: int = PIECE) -> np.ndarray:
    """log10 of each text's probability as symbols: scaled forward recursion, exact for whole texts."""
    states = len(model.start)
    order, symbols, edge, _ = by_time([b[:long] for b in bodies])
    edge = edge.tolist()
    total, last = np.zeros(len(bodies)), np.empty((len(bodies), states))
    state = np.tile(model.start, (len(bodies), 1))
    for t in range(len(edge) - 1):
        a, b = edge[t], edge[t + 1]
        if t:
            last[b - a : len(state)] = state[b - a :]
            state = state[: b - a] @ model.move
        state = state * model.emit[symbols[a:b]]
        scale = state.sum(axis=1)
        total[: b - a] += np.log10(scale)
        state /= scale[:, None]
    last[: len(state)] = state
    found, end = np.empty(len(bodies)), np.empty_like(last)
    found[order], end[order] = total, last
    # What lies beyond: the products of the pieces' matrices, one piece after the other.
    for i in [i for i, b in enumerate(bodies) if len(b) > long]:
        rest = bodies[i][long:]
        for a in range(0, len(rest), BATCH):
            pieces, _, _ = cut([rest[a : a + BATCH]], piece)
            for matrix, size in transfers(model, pieces):
                end[i] = end[i] @ matrix
                found[i] += size + np.log10(end[i].sum())
                end[i] /= end[i].sum()
    return found


def transfers(model: Model, pieces: list[np.ndarray]) -> Iterator[tuple[np.ndarray, float]]:
    """Each piece's matrix from the states before it to its last, scaled to a sum of 1, and log10 of the scale."""
    order, symbols, edge, _ = by_time(pieces)
    edge, states = edge.tolist(), len(model.start)
    every, size = np.tile(np.eye(states), (len(pieces), 1, 1)), np.zeros(len(pieces))
    for t in range(len(edge) - 1):
        a, b = edge[t], edge[t + 1]
        some = (every[: b - a] @ model.move) * model.emit[symbols[a:b]][:, None, :]
        scale = some.sum(axis=(1, 2))
        every[: b - a] = some / scale[:, None, None]
        size[: b - a] += np.log10(scale)
    where = np.empty(len(pieces), np.int64)
    where[order] = np.arange(len(pieces))
    for i in where.tolist():
        yield every[i], float(size[i])


def _bodies(batch: pa.RecordBatch) -> list[np.ndarray]:
    body, at = utf8(batch.column("symbols"))
    flat, at = np.frombuffer(body.tobytes(), np.uint16), at // 2
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _expect(held, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        counts = Counts(symbols, len(model.start))
        waiting, firsts, total = [], [], 0
        for batch in batches:
            pieces, _, first = cut(_bodies(batch), PIECE)
            for piece, begins in zip(pieces, first.tolist()):
                waiting.append(piece)
                firsts.append(begins)
                total += len(piece)
                if total >= BATCH:
                    expect(model, waiting, np.array(firsts), counts)
                    waiting, firsts, total = [], [], 0
        if waiting:
            expect(model, waiting, np.array(firsts), counts)
        rows = counts.rows()
        some = np.nonzero(rows.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(rows[some, k]) for k in range(rows.shape[1]))], ["row", *(f"s{k}" for k in range(rows.shape[1]))])

    return run


def fitted(texts_: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """A model of the training texts (rows of CODED) by Baum-Welch."""
    spark = texts_.sparkSession
    learn = texts_.where("not held").select("dk", "n_tokens", "symbols")
    names = [f"s{k}" for k in range(states)]
    model = Model.guess(share, states)
    few = learn.where(F.col("n_tokens") <= SAMPLE_WORDS).orderBy(F.xxhash64("dk"), "dk", "symbols").limit(SAMPLE).select("symbols").toArrow()
    sample = [b for x in few.combine_chunks().to_batches() for b in _bodies(x)]
    pieces, _, first = cut(sample, PIECE)
    for _ in range(SAMPLE_ROUNDS if pieces else 0):
        counts = Counts(len(share), states)
        expect(model, pieces, first, counts)
        model = estimated(counts, share)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((model.start, model.inside, model.move, model.emit))
        found = learn.select("symbols").mapInArrow(_expect(held, len(share)), "row long, " + ", ".join(f"{s} double" for s in names))
        added = found.groupBy("row").agg(*(F.sum(s).alias(s) for s in names)).toArrow()  # a row a symbol and state
        rows = np.zeros((len(share) + states + 2, states))
        if added.num_rows:
            rows[added.column("row").to_numpy()] = np.stack([added.column(s).to_numpy() for s in names], axis=1)
        model = estimated(Counts.of(rows, states), share)
        held.unpersist()
    return model


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            bodies = _bodies(batch)
            logs, a = np.zeros(len(bodies)), 0
            while a < len(bodies):  # so many texts that their symbols fill a batch
                b, total = a, 0
                while b < len(bodies) and (b == a or total + len(bodies[b]) <= 4 * BATCH):
                    total += len(bodies[b])
                    b += 1
                logs[a:b] = likelihood(model, bodies[a:b])
                a = b
            rest = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(logs)], [*rest, "logs"])

    return run


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(dk, held, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    found, share, n = coded(docs)
    model = fitted(found, share, states, rounds)
    held = docs.sparkSession.sparkContext.broadcast((model.start, model.inside, model.move, model.emit))
    done = found.mapInArrow(_score(held), CODED.replace("symbols binary", "logs double"))
    return done.select(
        "dk", "held", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("logs") + F.col("inner")).alias("score")
    )


def op11_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"))
    return found.select(real_id(), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
