"""Packing (operator 6): order-preserving dynamic programming over window cuts.

Documents are laid end to end in partition order. A window (sequence) is a run of at most
``max_tokens`` ids; the cut points offered are document ends (free), sentence ends and, where
neither comes for ``gap`` ids, any further id (both at a truncation penalty). The program
minimises padding plus penalties. With ``pos`` the cut positions,

    cost(i) = penalty(i) + max_tokens - pos(i) + min over j of (cost(j) + pos(j)),
    pos(i) - max_tokens <= pos(j) < pos(i),

so the minimum runs over a sliding window and a monotone queue gives each transition in
constant time. The last window of a run is cut at powers of two, which need no padding,
where that is cheaper than padding it.

Every partition is packed on its own, run after run of about ``run_tokens`` ids: nothing is
shuffled, memory is bounded by a run plus one document, and a lost task is simply run again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from crashlens.llm.common import batch_of, python_tasks, texts
from crashlens.llm.tokens import encoder

MAX_TOKENS = 2048
END_ID = 1
#: Costs in padding ids: a cut at a sentence end inside a document, a cut elsewhere.
SENTENCE_CUT = 4
FREE_CUT = 16
GAP = 32
RUN_TOKENS = 1_000_000

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, ids binary")
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens",
                                             "sequence_id", "offset", "sequence_length")]
                  + [("ids", pa.binary())])


def cut_points(ends: np.ndarray, sentences: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions and their penalties, from document ends and sentence ends."""
    total = int(ends[-1])
    known = np.unique(np.concatenate([[0], sentences, ends]))
    wide = np.nonzero(np.diff(known) > gap)[0]
    extra = [np.arange(known[i] + gap, known[i + 1], gap) for i in wide]
    pos = np.unique(np.concatenate([known, *extra]))
    penalty = np.full(len(pos), FREE_CUT, np.int64)
    penalty[np.searchsorted(pos, sentences)] = SENTENCE_CUT
    penalty[np.searchsorted(pos, ends)] = 0
    penalty[0] = 0
    assert pos[-1] == total
    return pos, penalty


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Positions at which windows end, the last position included, at the least cost of
    padding (each window padded to ``max_tokens``) plus penalties."""
    pos, penalty = pos.tolist(), penalty.tolist()
    back = [0] * len(pos)
    queue = deque([(pos[0], pos[0], 0)])  # (cost + pos, pos, node), keys rising
    for i in range(1, len(pos)):
        p = pos[i]
        low = p - max_tokens
        while queue[0][1] < low:
            queue.popleft()
        best = queue[0]
        back[i] = best[2]
        key = penalty[i] + max_tokens + best[0]  # = cost(i) + pos(i)
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, i))
    cuts = []
    i = len(pos) - 1
    while i > 0:
        cuts.append(pos[i])
        i = back[i]
    return cuts[::-1]


def trim_tail(cuts: list[int], max_tokens: int = MAX_TOKENS) -> list[int]:
    """Cut the last window at powers of two if the extra cuts cost less than its padding."""
    before = cuts[-2] if len(cuts) > 1 else 0
    left = cuts[-1] - before
    if (left.bit_count() - 1) * FREE_CUT >= max_tokens - left:
        return cuts
    at, tail = before, []
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            at += 1 << bit
            tail.append(at)
    return cuts[:-1] + tail


def _pack_run(docs: list[tuple[int, np.ndarray]], sentence_end: np.ndarray, max_tokens: int,
              first_sequence: int) -> tuple[list[list], int]:
    lengths = np.array([len(ids) for _, ids in docs], np.int64)
    ends = np.cumsum(lengths)
    flat = np.concatenate([ids for _, ids in docs])
    sentences = np.nonzero(sentence_end[flat])[0] + 1
    pos, penalty = cut_points(ends, sentences, min(GAP, max_tokens))
    cuts = np.array(trim_tail(choose_cuts(pos, penalty, max_tokens), max_tokens), np.int64)
    # Pieces lie between neighbouring marks of either kind: document ends and window cuts.
    marks = np.unique(np.concatenate([ends, cuts]))
    begin = np.concatenate([[0], marks[:-1]])
    doc = np.searchsorted(ends, begin, side="right")
    window = np.searchsorted(cuts, begin, side="right")
    starts = np.concatenate([[0], cuts[:-1]])
    raw = flat.tobytes()
    ids = np.array([d for d, _ in docs], object)
    return [ids[doc].tolist(), begin - (ends - lengths)[doc], marks - begin, lengths[doc],
            first_sequence + window, begin - starts[window], (cuts - starts)[window],
            [raw[4 * a:4 * b] for a, b in zip(begin.tolist(), marks.tolist())]], len(cuts)


def pack_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id",
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                   run_tokens: int = RUN_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_length, ids`` (little-endian unsigned 32-bit).

    ``vocabulary`` is the path of a byte-level BPE JSON, readable on every executor. Null and
    empty texts are documents of the end id alone. Repeated rows are packed once each; a null
    id stays null. An empty table gives an empty result. Only ``id_col`` and ``text_col`` are
    read, so further columns with any name do no harm. Within a sequence offsets run from 0
    without gaps; ``sequence_length`` is its number of ids before padding.
    """
    python_tasks(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        sentence_end = np.zeros(max(enc.size, end_id + 1), bool)
        sentence_end[:enc.size] = enc.sentence_end
        sequence = TaskContext.get().partitionId() << 33
        run: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal run, held, sequence
            columns, n = _pack_run(run, sentence_end, max_tokens, sequence)
            sequence += n
            run, held = [], 0
            yield batch_of(ARROW, columns)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                ids = enc.encode(text, end_id)
                run.append((doc_id, ids))
                held += len(ids)
                if held >= run_tokens:
                    yield from flush()
        if run:
            yield from flush()

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"),
                         docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(pack, SCHEMA)
