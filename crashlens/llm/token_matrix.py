"""Token-ID matrices (operator 4): best-fit-decreasing packing.

Documents are tokenised, split losslessly into pieces of at most ``max_tokens`` ids and packed
into rows of a matrix: pieces by falling length, each into the row with the least room that
still takes it. A segment tree over the possible rooms finds that row in O(log max_tokens).

Every partition packs its own documents, ``run_tokens`` ids at a time, so nothing is shuffled
and memory is bounded by a run plus one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from crashlens.llm.common import batch_of, python_tasks, texts
from crashlens.llm.tokens import encoder

MAX_TOKENS = 2048
END_ID = 50256
RUN_TOKENS = 2_000_000
EMIT = 256  # matrix rows per batch

SCHEMA = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, doc_starts array<long>")
ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                   ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                   ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])


class RoomTree:
    """Segment tree over rooms 0..size: which rooms have an open row, and the least room of at
    least ``n`` that has one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return (row, room) of the best fit for ``n``; None if no row has room."""
        i = self.leaves + n
        if not self.any[i]:
            # Up until a right neighbour has an open row, then down to its least room.
            while i > 1 and not (i & 1 == 0 and self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return row, room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers: pieces by falling length (ties in order), each into the fullest
    row that takes it. Lengths are 1 to ``capacity``."""
    tree, rows = RoomTree(capacity), []
    for p in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[p]
        found = tree.take(n)
        if found is None:
            rows.append([p])
            row, room = len(rows) - 1, capacity
        else:
            row, room = found
            rows[row].append(p)
        if room > n:
            tree.add(room - n, row)
    return rows


def unpack_row(ids: bytes, cu_seqlens: list[int]) -> list[np.ndarray]:
    """The segments of a matrix row."""
    row = np.frombuffer(ids, "<u4")
    return [row[a:b] for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:])]


def pack_matrix(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id",
                max_tokens: int = MAX_TOKENS, end_id: int = END_ID, pad_id: int = 0,
                run_tokens: int = RUN_TOKENS) -> DataFrame:
    """One row per matrix row: ``sequence_id, n_tokens, ids`` (``max_tokens`` little-endian
    unsigned 32-bit ids, padded with ``pad_id``), ``cu_seqlens`` (segment bounds, from 0 to
    ``n_tokens``), ``position_resets`` (where positions start at 0 again), and of each segment
    its document and its start there (``doc_ids``, ``doc_starts``).

    Each document's ids end with ``end_id``; null and empty texts are that id alone. Repeated
    rows are packed once each; null ids stay null; other columns are not read; an empty table
    gives an empty result.
    """
    python_tasks(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal sequence, pieces, held
            rows = best_fit([len(p[2]) for p in pieces], max_tokens)
            for at in range(0, len(rows), EMIT):
                columns: list[list] = [[] for _ in ARROW]
                for row in rows[at:at + EMIT]:
                    mine = [pieces[p] for p in row]
                    flat = np.concatenate([m[2] for m in mine])
                    bounds = np.cumsum([0] + [len(m[2]) for m in mine])
                    padded = np.full(max_tokens, pad_id, "<u4")
                    padded[:len(flat)] = flat
                    for c, v in zip(columns, (sequence, len(flat), padded.tobytes(), bounds, bounds[:-1],
                                              [m[0] for m in mine], [m[1] for m in mine])):
                        c.append(v)
                    sequence += 1
                yield batch_of(ARROW, columns)
            pieces, held = [], 0

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                ids = enc.encode(text, end_id)
                pieces.extend((doc_id, s, ids[s:s + max_tokens]) for s in range(0, len(ids), max_tokens))
                held += len(ids)
                if held >= run_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(pack, SCHEMA)
