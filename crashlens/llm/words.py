"""Words of a text as bytes, for the operators that turn them into numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 22  # a longer text is split into words by slices of about this size
LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


def byte_map(blanks: Iterable[int], breaks: Iterable[int] = ()) -> bytes:
    """A translation that lowers A-Z and turns some bytes into a blank, others into a line feed."""
    table = bytearray(bytes.maketrans(*LOWER))
    for code in blanks:
        table[code] = 0x20
    for code in breaks:
        table[code] = 0x0A
    return bytes(table)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null becomes the empty text."""
    return [t if t is not None else b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(raw: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in slices that end at a blank or a line feed, so that no word is cut."""
    first = 0
    while len(raw) - first > size:
        last = max(raw.rfind(b" ", first, first + size), raw.rfind(b"\n", first, first + size))
        if last < 0:  # one word longer than a slice
            ends = [i for i in (raw.find(b" ", first + size), raw.find(b"\n", first + size)) if i >= 0]
            last = min(ends, default=len(raw) - 1)
        yield raw[first:last + 1]
        first = last + 1
    yield raw[first:]


class Numbers(dict):
    """Words numbered from 1 as they come; ``words[i]`` is the word of number i."""

    def __init__(self):
        super().__init__()
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def numbered(words: list[bytes], numbers: dict) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
