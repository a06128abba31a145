"""Byte-level BPE in linear time: longest matches with backtracking.

A text is split by the vocabulary's pattern; each piece is encoded on its own. The piece's UTF-8
bytes become a Latin-1 string, so that the automaton of all tokens finds the longest one starting
at a byte. Tokens are then laid left to right, longest first; a token is accepted only where it is
compatible with the one before it, meaning that BPE itself, run on those two tokens' bytes, would
leave exactly these two. Failing that, the next shorter prefix is tried, then the previous token is
taken back. A position that turned out to be a dead end is never tried again, so the work is linear.
Compatibility of a pair depends on the pair alone and is memoised, as are frequent short pieces.

Defined cases: a null text is empty and has no tokens; lone surrogates cannot occur in Spark
strings; rows are independent, so repeated rows, ties and extra columns change nothing; an empty
table gives an empty result. Very long pieces are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, real_id, table

#: White space as Unicode defines it (regex's own \s also takes U+001C to U+001F).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A piece longer than this, in code points, is not memoised; nor is any once so many are held.
MEMO_PIECE, MEMO_SIZE = 40, 150_000


def own_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white-space classes written out."""
    inside = pattern.replace(r"[^\s", f"[^{SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Encoder(dict):
    """As a dict: piece -> its ids in decimal, joined by spaces (frequent pieces are kept)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.pattern = own_pattern(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.texts = {str(rank): token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.latin.items():
            self.automaton.add_word(token, rank)
        self.widest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(str, self.piece(piece.encode())))
        if len(piece) <= MEMO_PIECE and len(self) < MEMO_SIZE:
            self[piece] = ids
        return ids

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            body = self.tokens[token]
            self.shorter[token] = next((self.ranks[body[:n]] for n in range(len(body) - 1, 0, -1) if body[:n] in self.ranks), None)
        return self.shorter[token]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for those that no merge makes."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both would keep the border between them.

        Undo the later of the two outer merges again and again: at each moment the two tokens that
        touch the border must not have been free to merge before that moment's rank.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        a, b, limit = left, right, len(self.ranks) + 1
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                good = False
                break
            halves_a, halves_b = self.split(a), self.split(b)
            if halves_a and (a > b or not halves_b):
                limit, a = a, halves_a[1]
            elif halves_b:
                limit, b = b + 1, halves_b[0]
            else:
                good = True
                break
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def piece(self, body: bytes) -> list[int]:
        if (whole := self.ranks.get(body)) is not None:
            return [whole]
        latin, size = body.decode("latin-1"), len(body)
        longest, known, sizes = self.longest, self.pairs.get, self.sizes
        dead: set[int] = set()
        out: list[int] = []
        at, token = 0, longest(latin, 0)
        while at < size:
            end = at + sizes[token]
            if end in dead:
                good = False
            elif not out:
                good = True
            elif (good := known((out[-1], token))) is None:
                good = self.compatible(out[-1], token)
            if good:
                out.append(token)
                at = end
                if at < size:
                    token = longest(latin, at)
            elif (less := self.prefix(token)) is not None:
                token = less
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
        return out

    def longest(self, latin: str, at: int) -> int:
        """The longest token at a position: the automaton's deepest path, cut back to a token."""
        ahead = latin[at : at + self.widest]
        n = self.automaton.longest_prefix(ahead)
        while (token := self.latin.get(ahead[:n])) is None:
            n -= 1
        return token

    def encode(self, text: str) -> str:
        """All ids in decimal, joined by one space."""
        return " ".join(map(self.__getitem__, self.pattern.findall(text)))

    def forget(self) -> None:
        """Give up what is memoised: Python workers outlive their tasks, and later stages need the memory."""
        for memo in (self, self.pairs, self.shorter, self.halves):
            memo.clear()

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids.split(" "))) if ids else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = hashlib.sha256(content).hexdigest(), pattern
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(content), pattern)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (about 1 MB) as a broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, *columns: str) -> DataFrame:
    """docs as (dk, the named columns, text, ids array<int>)."""
    held = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern)
        for batch in batches:
            ids = [np.fromstring(encoder.encode(t), np.int32, sep=" ") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], [*batch.schema.names, "ids"])
        encoder.forget()

    rows = keyed(docs, *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The frame with a binary column decoded made of its ids (null ids: null)."""
    held = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(held.value).items()}
        for batch in batches:
            body = [None if ids is None else b"".join(map(tokens.__getitem__, ids)) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body, pa.binary())], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def encode_checked(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, *columns: str) -> DataFrame:
    """docs as (dk, the named columns, ids array<int>, round_trip): round_trip if the decoded ids are the text's bytes.

    Encodes and decodes in the same task: two Python operators in a row would take two workers for each core.
    """
    held = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern)
        for batch in batches:
            ids, same = [], []
            for text in batch.column("text").to_pylist():
                found = encoder.encode(text)
                same.append(encoder.decode(found) == text.encode())
                ids.append(np.fromstring(found, np.int32, sep=" "))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), _lists(ids), pa.array(same, pa.bool_())], [*rest, "ids", "round_trip"])
        encoder.forget()

    rows = keyed(docs, *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, ids array<int>, round_trip boolean")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate([*ids, np.empty(0, np.int32)]))


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, *columns: str) -> DataFrame:
    """Per document: dk, the named columns, n_tokens, and SHA-256 of its ids and of the decoded bytes.

    Encodes and decodes in the same task, so that no ids travel back to the JVM. What is memoised, which is bounded, serves a
    worker's next tasks as well, as no stage follows.
    """
    held = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern)
        for batch in batches:
            count, of_ids, of_bytes = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text)
                count.append(ids.count(" ") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                [*rest, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = keyed(docs, *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return done.select(real_id(), F.col("n_tokens"), "ids_sha256", "decoded_sha256")
