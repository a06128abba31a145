"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprint segments.

The perfect binary Golay code [23, 12, 7] has a codeword within 3 bits of every 23-bit word. A
segment's keys are the indices of all codewords within 4 bits of it (one, or six). If two segments
differ in at most 2 bits, some codeword lies within 4 bits of both, so they share a key.

Exact radius 3 on 64 bits (simhash_classes): the fingerprint is two halves of 32 bits. By the
pigeonhole principle one half has at most one error. That half is a 23-bit segment and 9 more bits;
if the error is in the segment, the halves share a Golay key and the 9 bits, otherwise the segment
itself. Every pair within 3 bits therefore meets in some bucket, where it is verified.

Similarity 0.8 (similar_classes): documents with one set of shingles are one node. SimHashes of the sets
give `tables` pairs of segments, whose combined Golay keys are the buckets; members within `radius` of
each other on 128 further bits are candidates, and a candidate counts if the exact Jaccard similarity of
the two sets of hashed shingles is high enough. A pair of similarity 0.8 has about 15 % of differing
bits: a table finds it with a chance of about 0.37, twelve tables with 0.996, and radius 32 lets 0.999 pass.
A bucket first emits only the shortest forest of its candidates. Candidates which that leaves out can
matter only between classes that a refuted edge joined. What refuted edges connect is compared again, across
classes only and block by block: the members of the largest class lie in one block each, and those of the others,
which are few, come to all blocks. A first round has the sketches only, of which all bits (896 in place of 128) tell
which documents can have a link at all. These alone bring their sets to a second round, which verifies in place, so
that only links leave the task.

Buckets do not emit all their pairs: a bucket's links are reduced to a forest in place, at most one
edge a member. A bucket above `block` members is dealt to pairs of blocks of that size, each a group
of its own that compares across the two, so no task gets an unbounded group. Equal fingerprints are one node throughout.

Defined cases: a null text is empty; a text with fewer words than a shingle is one shingle, without
words its fingerprint is zero (and links like any other); repeated rows each get a result; rows
without doc_id take part but cannot name a component (all without: null); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, ints, shuffle_partitions, table, written
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Members of a bucket that one group compares; larger buckets are dealt to pairs of blocks.
BLOCK = 2048
#: Fingerprints that one task gives keys to: each makes up to some 200 rows, so the small table is dealt out first.
SPREAD_ROWS = 8192


# -- the Golay code


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern, and the index offsets of the codewords within 4 bits (-1: none).

    The code is cyclic with generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1; the upper 12 bits of a
    codeword are its index.
    """
    generator = 0b101011100011
    errors = np.zeros(2048, np.uint32)
    patterns = [0] + [1 << i for i in range(23)]
    patterns += [1 << i | 1 << j for i in range(23) for j in range(i)]
    patterns += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    light = []  # codewords of weight 7
    for index in range(4096):
        word = index << 11
        rest = int(_remainder(np.array([word], np.uint32), generator)[0])
        if bin(word | rest).count("1") == 7:
            light.append((word | rest, index))
    offsets = np.full((2048, 6), -1, np.int32)
    syndromes = _remainder(np.array(patterns, np.uint32), generator)
    for pattern, syndrome in zip(patterns, syndromes.tolist()):
        errors[syndrome] = pattern
        near = [0] + ([i for w, i in light if w & pattern == pattern] if bin(pattern).count("1") == 3 else [])
        offsets[syndrome, : len(near)] = near
    return errors, offsets


def _remainder(words: np.ndarray, generator: int = 0b101011100011) -> np.ndarray:
    words = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        words = np.where(words >> np.uint32(bit) & np.uint32(1), words ^ np.uint32(generator << (bit - 11)), words)
    return words


_tables: list[np.ndarray] = []


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for every codeword within 4 bits of each 23-bit word."""
    if not _tables:
        _tables.extend(_golay())
    errors, offsets = _tables
    words = words.astype(np.uint32)
    syndrome = _remainder(words)
    home = ((words ^ errors[syndrome]) >> np.uint32(11)).astype(np.int32)
    near = offsets[syndrome]
    rows, which = np.nonzero(near >= 0)
    return rows, home[rows] ^ near[rows, which]


# -- fingerprints


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of so many words (ASCII-lower-cased text), repeats included."""
    found = WORD.findall(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    joined = b" ".join(found)
    sizes = list(map(len, found))
    ends = list(accumulate(sizes[1:], lambda a, b: a + b + 1, initial=sizes[0]))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits of each hash: splitmix64's finaliser on an offset value."""
    if k == 0:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majorities(hashes: np.ndarray) -> np.ndarray:
    """majority of each column of (n, width) words: bit planes of the counts, added in pairs."""
    n, planes = len(hashes), [hashes]
    if not n:
        return np.zeros(hashes.shape[1], np.uint64)
    while (m := len(planes[0])) > 1:
        if m % 2:
            planes = [np.concatenate([p, np.zeros_like(p[:1])]) for p in planes]
        half, out, carry = (m + 1) // 2, [], np.uint64(0)
        for p in planes:
            a, b = p[:half], p[half:]
            x = a ^ b
            out.append(x ^ carry)
            carry = a & b | x & carry
        planes = [*out, carry]
    bits = np.unpackbits(np.concatenate(planes).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    over = (1 << np.arange(len(planes))) @ bits.astype(np.int64) * 2 > n
    return np.packbits(over, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int, seed: int, width: int = 1) -> DataFrame:
    """(doc_id, f0 .. f<width-1>): the SimHash of each row's whole text, 64 bits a column."""
    names = [f"f{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, width), np.uint64)
            lower = pc.ascii_lower(batch.column("text"))
            for i, text in enumerate(lower):
                hashes = shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", words, seed)
                out[i] = [majority(_mixed(hashes, k)) for k in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[:, k].view(np.int64)) for k in range(width))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def shingle_set(text: pa.Scalar, words: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.as_buffer().to_pybytes(), words, seed))


def sketches(docs: DataFrame, words: int, seed: int, width: int) -> DataFrame:
    """(doc_id, th, node, f0 .. f<width-1>) of each row: the text's xxhash64, a name for its set of shingles, the set's SimHash."""
    names = [f"f{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, node = np.zeros((batch.num_rows, width), np.uint64), np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(pc.ascii_lower(batch.column("text"))):
                hashes = shingle_set(text, words, seed)
                node[i] = xxhash.xxh64_intdigest(hashes.tobytes())
                out[i] = majorities(np.stack([_mixed(hashes, k) for k in range(width)], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(node.view(np.int64)), *(pa.array(out[:, k].view(np.int64)) for k in range(width))], ["doc_id", "th", "node", *names])

    return _texts(docs).mapInArrow(run, "doc_id long, th long, node long, " + ", ".join(f"{n} long" for n in names))


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, hashes) for every row of wanted (node, dk, th): its sorted distinct shingle hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words, seed).tobytes() for text in pc.ascii_lower(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    rows = _texts(docs).withColumn("dk", F.coalesce("doc_id", F.lit(NULL_ID))).join(wanted, ["dk", "th"])
    return rows.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, hashes binary")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, alike): whether the Jaccard similarity of the nodes' sets is so high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"))):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                found[i] = bool(len(a) and len(b)) and _jaccard(a, b) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found)], ["u", "v", "alike"])

    left, right = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("u", "a"), ("v", "b")))
    return edges.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, alike boolean")


# -- buckets


def radius_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) so that any two fingerprints within 3 bits share a bucket; prints is (n, 1)."""
    rows, keys = [], []
    for half in (0, 1):
        word = (prints[:, 0] >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        segment, rest = (word >> np.uint64(9)).astype(np.int64), (word & np.uint64(511)).astype(np.int64)
        row, index = golay_keys(segment)
        rows += [row, np.arange(len(segment))]
        keys += [(2 * half) << 32 | index.astype(np.int64) << 9 | rest[row], (2 * half + 1) << 32 | segment]
    return np.concatenate(rows), np.concatenate(keys)


def table_keys(tables: int, skip: int):
    """Buckets from pairs of 23-bit segments, one pair in each word after the first skip words."""

    def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, out = [], []
        for t in range(tables):
            word = prints[:, skip + t]
            low, high = (word & np.uint64(2**23 - 1)).astype(np.int64), (word >> np.uint64(23) & np.uint64(2**23 - 1)).astype(np.int64)
            (ra, ka), (rb, kb) = golay_keys(low), golay_keys(high)
            count = np.bincount(rb, minlength=len(word))
            first = np.concatenate([[0], np.cumsum(count)])[:-1]
            times = count[ra]
            left = np.repeat(np.arange(len(ra)), times)
            right = first[ra[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
            rows.append(ra[left])
            out.append(np.int64(t) << 24 | ka[left].astype(np.int64) << 12 | kb[right])
        rows, out = np.concatenate(rows), np.concatenate(out)
        order = np.argsort(rows, kind="stable")  # a node's rows side by side, where shuffle files compress them
        return rows[order], out[order]

    return keys


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n members' component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


def shortest_forest(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Indices of the links (a, b) that make a spanning forest of least distances (Boruvka)."""
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    label, alive, taken = np.arange(n), np.arange(len(a)), []
    while True:
        alive = alive[label[a[alive]] != label[b[alive]]]
        if not len(alive):
            return order[np.concatenate(taken)] if taken else order[:0]
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[alive]], alive)
        np.minimum.at(best, label[b[alive]], alive)
        won = np.unique(best[best < len(a)])
        taken.append(won)
        label = forest(n, label[a[won]], label[b[won]])[label]


def _linked(compare: list[str], radius: int, emit: str = "roots"):
    """Per bucket (rows arrive sorted by bucket): edges of its links.

    emit: "roots" for an edge from every linked member to its component's first, "forest" for the
    shortest links that connect as much.
    """
    ids = ["key", "s", "t"]

    def settle(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(cols["key"])
        new = np.ones(n, bool)
        for c in ids:
            new[1:] &= cols[c][1:] == cols[c][:-1]
        new[1:] = ~new[1:]
        run = np.cumsum(new) - 1
        at, step, links = np.arange(n), 1, []
        while True:
            at = at[at + step < n]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            # Within one block, or between the two of a pair: what lies inside a block is compared there.
            some = at[(cols["s"][at] == cols["t"][at]) | (cols["own"][at] != cols["own"][at + step])]
            apart = np.zeros(len(some), np.int64)
            for c in compare:
                apart += np.bitwise_count((cols[c][some] ^ cols[c][some + step]).view(np.uint64))
            near = apart <= radius
            if near.any():
                links.append((some[near].astype(np.int32), (some[near] + step).astype(np.int32), apart[near].astype(np.uint16)))
            step += 1
        node = cols["node"]
        if emit == "forest":
            a, b, d = (np.concatenate(x) for x in zip(*links)) if links else (np.empty(0, np.int32),) * 3
            some = shortest_forest(n, a, b, d)
            a, b = a[some], b[some]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["u", "v"])
        if links:
            root = forest(n, np.concatenate([x for x, _, _ in links]), np.concatenate([x for _, x, _ in links]))
        else:
            root = np.arange(n)
        inner = root != np.arange(n)
        return pa.RecordBatch.from_arrays([pa.array(node[inner]), pa.array(node[root[inner]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        names = [*ids, "own", *dict.fromkeys([*compare, "node"])]
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: ints(batch.column(c)) for c in names}
            if held:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            last = np.ones(len(cols["key"]), bool)
            for c in ids:
                last &= cols[c] == cols[c][-1]
            cut = int(np.argmax(last))  # rows are sorted: the last bucket is a suffix
            held = {c: x[cut:] for c, x in cols.items()}
            if cut:
                yield settle({c: x[:cut] for c, x in cols.items()})
        if held:
            yield settle(held)

    return run


def linked(prints: DataFrame, keys, key_columns: list[str], compare: list[str], radius: int, block: int = BLOCK, emit: str = "roots") -> DataFrame:
    """Edges (u, v) that connect all nodes which share a bucket and lie within radius (emit as for _linked).

    prints: node and fingerprint columns, one row a node.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                words = np.stack([ints(part.column(c)).view(np.uint64) for c in key_columns], axis=1)
                row, key = keys(words)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(ints(part.column(c))[row]) for c in carried)], ["key", *carried])

    carried = list(dict.fromkeys(["node", *compare]))
    parts = max(shuffle_partitions(prints.sparkSession), -(-prints.count() // SPREAD_ROWS))
    rows = prints.repartition(parts, "node").mapInArrow(spread, "key long, " + ", ".join(f"{c} long" for c in carried))
    large = rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(written(large), "key", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
        .select("key", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", *carried)
    )
    order = ["key", "s", "t"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_linked(compare, radius, emit), "u long, v long").distinct()


#: Members and bytes of shingle sets of a block that is compared across classes.
ACROSS, ACROSS_BYTES = 1024, 16 << 20


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values, neither empty."""
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _crossed(columns: list[str], radius: int, similarity: float | None):
    """Per group (key, kind, s, t; rows arrive sorted): links (u, v) between classes, as many as connect what is linked there.

    Without a similarity (and sets) the nodes that lie within radius of some other class, as (u, u).
    """
    ids, names = ["key", "kind", "s", "t"], ["node", "class", "own", *columns]

    def settle(cols: dict[str, np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.stack([cols[c] for c in columns], axis=1).view(np.uint64)
        klass, own, node = cols["class"], cols["own"], cols["node"]
        root: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        possible = np.zeros(len(node), bool)

        def of(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        inner = cols["kind"][0] == 1 and cols["s"][0] == cols["t"][0]
        right = np.arange(len(node)) if inner else np.nonzero(own == 1)[0]
        left = np.arange(len(node)) if inner else np.nonzero(own == 0)[0]
        for j in right.tolist():
            some = left[: j if inner else len(left)]
            some = some[klass[some] != klass[j]]
            some = some[np.bitwise_count(prints[some] ^ prints[j]).sum(axis=1, dtype=np.int64) <= radius]
            if similarity is None:
                possible[some] = True
                possible[j] |= len(some) > 0
                continue
            for i in some.tolist():
                p, q = of(int(klass[i])), of(int(klass[j]))
                if p != q and len(sets[i]) and len(sets[j]) and _jaccard(sets[i], sets[j]) >= similarity:
                    root[q] = p
                    found.append((max(node[i], node[j]), min(node[i], node[j])))
        if similarity is None:
            found = [(x, x) for x in node[possible].tolist()]
        u, v = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: ints(batch.column(c)) for c in [*ids, *names]}
            more = [] if similarity is None else [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ids], axis=0)
            if held is not None:
                new[0] = any(cols[c][0] != held[c][-1] for c in ids)
            starts = np.nonzero(new)[0].tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows]):
                if a == b:
                    continue
                if a in starts and held is not None:
                    yield settle(held, sets)
                    held, sets = None, []
                piece = {c: x[a:b] for c, x in cols.items()}
                held = piece if held is None else {c: np.concatenate([held[c], piece[c]]) for c in piece}
                sets += more[a:b]
        if held is not None:
            yield settle(held, sets)

    return run


def across(rows: DataFrame, columns: list[str], radius: int, similarity: float | None = None) -> DataFrame:
    """(u, v): links between classes of one key, of rows (key, node, class, sketch columns, hashes), verified on the sets; without
    a similarity, and hashes, the nodes that are near some other class.

    Every pair of different classes is compared. The largest class of a key is never compared with itself, so its members are
    dealt to blocks of their own; those of other classes come to every such block, and to pairs of blocks among themselves.
    """
    carried = ["node", "class", *([] if similarity is None else ["hashes"]), *columns]
    size = F.lit(0).cast("long") if similarity is None else F.length("hashes").cast("long")
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    top = F.max(F.struct("n", "bytes", "class")).alias("top")
    whole = sizes.groupBy("key").agg(top, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / ACROSS), F.ceil(size / ACROSS_BYTES)).cast("int")
    whole = written(whole.select("key", F.col("top.class").alias("largest"), blocks(F.col("top.n"), F.col("top.bytes")).alias("hosts"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("guests")))
    rows = rows.join(whole, "key").withColumn("host", F.col("class") == F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda kind, s, t, own: F.struct(F.lit(kind).alias("kind"), s.alias("s"), t.alias("t"), own.alias("own"))
    hosted = F.transform(upto("guests"), lambda g: group(0, place("hosts"), g, F.lit(0)))
    guest = F.concat(
        F.transform(upto("hosts"), lambda h: group(0, h, place("guests"), F.lit(1))),
        F.transform(upto("guests"), lambda g: group(1, F.least(place("guests"), g), F.greatest(place("guests"), g), (place("guests") > g).cast("int"))),
    )
    dealt = rows.select("key", *carried, F.explode(F.when(F.col("host"), hosted).otherwise(guest)).alias("g")).select("key", "g.*", *carried)
    order = ["key", "kind", "s", "t"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_crossed(columns, radius, similarity), "u long, v long").distinct()


def _classes(prints: DataFrame, columns: list[str], keys, key_columns: list[str], compare: list[str], radius: int) -> DataFrame:
    """(doc_id, the fingerprint columns, component_id): prints is a written table of doc_id and fingerprints."""
    node = F.xxhash64(*columns) if len(columns) > 1 else F.col(columns[0])
    prints = prints.withColumn("node", node)
    single = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in columns if c != "node")))
    found = components(linked(single, keys, key_columns, compare, radius))
    members = written(single.select("node", "least").join(found, "node"))
    ids = written(members.groupBy("root").agg(F.min("least").alias("component")))
    named = members.join(ids, "root").select("node", "component")
    every = written(single.select("node", "least").join(named, "node", "left").select("node", F.coalesce("component", "least").alias("component_id")))
    return prints.join(every, "node").drop("node")


def simhash_classes(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, f0, component_id): classes of 64-bit fingerprints linked at 3 or fewer differing bits."""
    prints = written(fingerprints(docs, words, seed))
    return _classes(prints, ["f0"], radius_keys, ["f0"], ["f0"], 3)


def similar_classes(docs: DataFrame, words: int = 5, seed: int = 42, similarity: float = 0.8, tables: int = 12) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by this Jaccard similarity of shingle sets or more."""
    skip = 2
    columns = [f"f{k}" for k in range(skip + tables)]
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius = int(64 * skip * share + 3.2 * (64 * skip * share * (1 - share)) ** 0.5)
    prints = written(sketches(docs, words, seed, skip + tables))
    place = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("dk"), "th")).alias("place")
    single = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), place, *(F.first(c).alias(c) for c in columns)))

    tree = written(linked(single, table_keys(tables, skip), columns, columns[:skip], radius, BLOCK // 2, "forest"))
    ends = tree.select(F.col("u").alias("node")).union(tree.select("v")).distinct()
    sets = written(shingle_sets(docs, written(single.join(ends, "node").select("node", "place.dk", "place.th")), words, seed))
    tested = written(verified(tree, sets, similarity))
    links = tested.where("alike").select("u", "v")
    classes = written(components(links))
    refuted = tested.where("not alike")
    for n in ("u", "v"):
        refuted = refuted.join(classes.select(F.col("node").alias(n), F.col("root").alias(f"of_{n}")), n, "left").withColumn(f"of_{n}", F.coalesce(f"of_{n}", n))
    refuted = written(refuted.where("of_u != of_v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))
    if not refuted.isEmpty():
        open_ = written(components(refuted)).select(F.col("node").alias("class"), F.col("root").alias("key"))
        rows = single.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).join(open_, "class")
        rows = written(rows.select("key", "node", "class", "place", *columns))
        bits = 64 * len(columns)
        near = int(bits * share + 3.2 * (bits * share * (1 - share)) ** 0.5)
        some = written(across(rows.drop("place"), columns, near).select(F.col("u").alias("node")).distinct())
        rows = written(rows.join(some, "node", "left_semi"))
        own = written(shingle_sets(docs, rows.select("node", "place.dk", "place.th"), words, seed))
        late = written(across(rows.drop("place").join(own, "node"), columns, near, similarity))
        if not late.isEmpty():
            classes = written(components(links.union(late)))
    members = written(single.select("node", "least").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = written(members.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(written(members.join(ids, "root").select("node", "component_id")), "node").select("doc_id", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
