"""Words of texts as hashed numbers, by Arrow batch."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import chunks

#: Bytes of text that are handled at once (a longer single text is cut into runs of words by the caller).
SLICE = 1 << 20
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    """A word in lower case without what surrounds its letters."""
    return EDGES.sub("", word).lower()


def numbers(word: str, buckets: int) -> tuple[int, int]:
    """Two independent buckets of a word; 0 is kept for the empty word."""
    if not word:
        return 0, 0
    body = word.encode()
    return zlib.crc32(body) % (buckets - 1) + 1, zlib.adler32(body, zlib.crc32(body[::-1])) % (buckets - 1) + 1


def tokens(batch: pa.RecordBatch, key) -> Iterator[tuple[int, np.ndarray, list, np.ndarray]]:
    """Slices of a batch: (first row, words a row, key of each distinct word, number of each word's distinct one).

    Words are separated by Unicode white space; white space at the ends makes none, nor does an empty text.
    """
    row = 0
    for part in chunks(batch, "text", SLICE):
        text = pc.utf8_trim_whitespace(part.column("text"))
        words = pc.utf8_split_whitespace(text)
        flat = words.flatten()
        flat = pc.dictionary_encode(flat.filter(pc.not_equal(flat, "")))  # an empty text splits into one empty word
        distinct = [key(w) for w in flat.dictionary.to_pylist()]
        length = pc.if_else(pc.equal(text, ""), 0, pc.list_value_length(words))
        yield row, length.to_numpy(zero_copy_only=False), distinct, flat.indices.to_numpy(zero_copy_only=False)
        row += part.num_rows
