"""Words of UTF-8 texts, as bytes, in lists of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ints, utf8

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text that are split at once.
SLICE = 1 << 22


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(dk, text as bytes) of each row."""
    body, at = utf8(batch.column("text"))
    for i, dk in enumerate(ints(batch.column("dk")).tolist()):
        yield dk, body[at[i] : at[i + 1]].tobytes()


def words(text: bytes) -> Iterator[bytes]:
    """The runs between ASCII white space; a very long text is split slice by slice."""
    at = 0
    while at < len(text):
        found = SPACE.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = found.start() if found else len(text)
        yield from text[at:end].split()
        at = end


class Vocabulary(dict):
    """word -> its number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words(text)), np.int32)
