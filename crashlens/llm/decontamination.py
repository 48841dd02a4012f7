"""Benchmark decontamination by suffix arrays of the training texts (operator 12).

Each Arrow batch of documents is a shard. Its words become numbers of the benchmark's
vocabulary (0: no such word), runs too short to hold any window are left out, and a suffix
array of what remains is built by prefix doubling. Every benchmark suffix is then looked up by
binary search: the neighbours of its place give its longest verbatim match and where that is, and
the range of suffixes that share its first ``window`` words gives every occurrence.

The benchmark reaches the tasks in blocks of at most about ``BLOCK_WORDS`` words, cut from
segments that overlap by a window less one word, so that no window is lost. One block at a time
is broadcast; with several, the documents found so far are written between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import Staging, python_tasks
from crashlens.llm.words import byte_map, raw_texts, slices

WINDOW = 10                # consecutive words of an item
SEGMENT_WORDS = 512        # a longer item is cut
BLOCK_WORDS = 2_000_000    # benchmark words broadcast at a time

# Fixed values of the contract: bytes that are no part of a word (after lowering A-Z).
_BYTES = byte_map([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    for s in slices(raw.translate(_BYTES)):
        yield s.split()


@dataclass
class Block:
    """A part of the benchmark: its words as numbers, and for each suffix to look up (the start
    of a window) where it begins, how long its window and the rest of its segment are, and its
    item."""

    vocabulary: dict[bytes, int]
    text: np.ndarray
    start: np.ndarray
    need: np.ndarray
    rest: np.ndarray
    item: np.ndarray
    ids: list[str | None]

    @classmethod
    def of(cls, segments: list[tuple[str | None, bytes]], window: int) -> "Block":
        """``segments``: item id and words joined by blanks."""
        vocabulary: dict[bytes, int] = {}
        ids: dict[str | None, int] = {}
        text, start, need, rest, item = [0], [], [], [], []
        for name, joined in segments:
            words = joined.split(b" ")
            m = min(window, len(words))
            at = len(text)
            text.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
            text.append(0)
            n = len(words) - m + 1
            start.extend(range(at, at + n))
            need.extend([m] * n)
            rest.extend(range(len(words), m - 1, -1))
            item.extend([ids.setdefault(name, len(ids))] * n)
        return cls(vocabulary, np.array(text, np.int32), *(np.array(x, np.int64) for x in (start, need, rest, item)), list(ids))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The positions of the words (not 0) in the order of the suffixes, compared on ``depth``
    words at least or to their end. A 0 is below every word."""
    rank, done = text.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        new = np.empty(len(text), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if done >= depth or new[order[-1]] == len(text) - 1:
            return order[text[order] != 0]
        after = np.zeros(len(text), np.int64)
        after[:-done] = new[done:] + 1
        rank, done = new * (len(text) + 1) + after, 2 * done


def common_words(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of equal words of ``a`` from ``at`` and ``b`` from ``bt``, up to ``most``; 0 in
    ``a`` equals nothing. ``a`` ends with 0."""
    n = np.zeros(len(at), np.int64)
    open_ = np.nonzero(most > 0)[0]
    while len(open_):
        x = a[at[open_] + n[open_]]
        open_ = open_[(x != 0) & (x == b[bt[open_] + n[open_]])]
        n[open_] += 1
        open_ = open_[n[open_] < most[open_]]
    return n


def first_place(text: np.ndarray, sa: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """For each query (the first ``most`` words of ``b`` from ``bt``) the first place in the
    suffix array whose suffix is not below it, or (``after``) is above it and does not begin
    with it. One binary search for all queries."""
    low, high = np.zeros(len(bt), np.int64), np.full(len(bt), len(sa), np.int64)
    while True:
        open_ = np.nonzero(low < high)[0]
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        at = sa[mid]
        n = common_words(text, at, b, bt[open_], most[open_])
        whole = n == most[open_]
        above = text[at + n] > b[np.minimum(bt[open_] + n, len(b) - 1)]
        stop = np.where(whole, not after, above)
        high[open_[stop]] = mid[stop]
        low[open_[~stop]] = mid[~stop] + 1


class Shard:
    """The documents of a batch as one text of numbers, and its suffix array."""

    def __init__(self, raws: list[bytes], block: Block):
        get, parts, lengths = block.vocabulary.get, [], []
        for raw in raws:
            n = 0
            for words in words_of(raw):
                parts.append(np.fromiter([get(w, 0) for w in words], np.int32, len(words)))
                n += len(words)
            lengths.append(n)
            parts.append(np.zeros(1, np.int32))
        ids = np.concatenate([*parts, np.zeros(1, np.int32)])
        self.n_words = np.array(lengths, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])  # where each document begins
        self.size = len(ids)
        # Runs of known words long enough for the shortest window; the 0 behind each stays.
        least = int(block.need.min()) if len(block.need) else 1
        edge = np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]]))
        begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long_ = end - begin >= least
        begin, width = begin[long_], (end - begin)[long_] + 1
        self.place = np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())
        self.text = ids[self.place]
        self.sa = suffix_array(self.text, int(block.rest.max())) if len(self.text) else np.zeros(0, np.int64)

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each benchmark suffix: words of its longest match, where that is (in the shard),
        and the range of the suffix array that begins with its window."""
        n = len(block.start)
        best, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low = high = np.zeros(n, np.int64)
        if not len(self.sa) or not n:
            return best, where, low, high
        place = first_place(self.text, self.sa, block.text, block.start, block.rest, after=False)
        for side in (place - 1, place):
            at = self.sa[np.clip(side, 0, len(self.sa) - 1)]
            words = common_words(self.text, at, block.text, block.start, block.rest)
            words[(side < 0) | (side >= len(self.sa))] = 0
            where = np.where(words > best, self.place[at], where)
            best = np.maximum(best, words)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        hit = np.nonzero(best >= block.need)[0]
        args = (self.text, self.sa, block.text, block.start[hit], block.need[hit])
        low[hit], high[hit] = first_place(*args, after=False), first_place(*args, after=True)
        return best, where, low, high


def mark(raws: list[bytes], block: Block) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """For each text: its number of words, the hit words as ``[start, end, start, end ...]``,
    and the ids of the items with a window in it."""
    shard = Shard(raws, block)
    spans: list[list[int]] = [[] for _ in raws]
    items: list[list[str]] = [[] for _ in raws]
    _, _, low, high = shard.search(block)
    hit = np.nonzero(high > low)[0]
    if not len(hit):
        return shard.n_words, spans, items
    # Equal windows share one range: its occurrences are read once, whatever the number of items.
    ranges, which = np.unique(np.column_stack([low[hit], high[hit], block.need[hit]]), axis=0, return_inverse=True)
    which = which.reshape(-1)
    size = ranges[:, 1] - ranges[:, 0]
    owner = np.repeat(np.arange(len(ranges)), size)
    at = shard.place[shard.sa[np.repeat(ranges[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())]]
    change = np.bincount(at, minlength=shard.size + 1) - np.bincount(at + ranges[owner, 2], minlength=shard.size + 1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).view(np.int8)]))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    doc = np.searchsorted(shard.first, begin, "right") - 1
    for d, b, e in zip(doc.tolist(), (begin - shard.first[doc]).tolist(), (end - shard.first[doc]).tolist()):
        spans[d] += [b, e]
    pairs = np.unique((np.searchsorted(shard.first, at, "right") - 1) * len(ranges) + owner)
    by_range = np.argsort(which, kind="stable")
    item_of, bound = block.item[hit][by_range], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(ranges)))])
    doc, owner = pairs // len(ranges), pairs % len(ranges)
    for d, a, b in zip(*_runs(doc)):
        found = np.unique(np.concatenate([item_of[bound[r]:bound[r + 1]] for r in owner[a:b]]))
        items[d] = sorted(x for x in (block.ids[i] for i in found) if x is not None)
    return shard.n_words, spans, items


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    first = np.concatenate([[0], np.nonzero(values[1:] != values[:-1])[0] + 1])
    return values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)]


def join_spans(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of spans."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def benchmark_segments(benchmark: DataFrame, window: int, text_col: str, item_col: str, block_words: int,
                       staging: Staging) -> tuple[DataFrame, int]:
    """The items as segments ``(item, words, n)``, and the number of blocks."""
    schema = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64())])
    step = max(SEGMENT_WORDS, 2 * window) - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for item, raw in zip(b.column("item").to_pylist(), raw_texts(b)):
                words = [w for part in words_of(raw) for w in part]
                for first in range(0, max(1, len(words) - window + 1), step) if words else ():
                    segment = words[first:first + step + window - 1]
                    for column, value in zip(out, (item, b" ".join(segment), len(segment))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    narrow = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    segments = staging.write(narrow.mapInArrow(cut, "item string, words binary, n long"), "segments")
    total = segments.agg(F.sum("n")).first()[0] or 0
    return segments, max(1, -(-total // block_words))


def each_block(benchmark: DataFrame, window: int, text_col: str, item_col: str, block_words: int,
               staging: Staging) -> Iterator[Block]:
    segments, n_blocks = benchmark_segments(benchmark, window, text_col, item_col, block_words, staging)
    for i in range(n_blocks):
        rows = segments.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == i)
        yield Block.of([(r.item, bytes(r.words)) for r in rows.toLocalIterator()], window)


def mark_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                   item_text_col: str = "text", item_col: str = "item_id", n_words_col: str = "n_words",
                   spans_col: str = "spans", items_col: str = "items", block_words: int = BLOCK_WORDS,
                   staging: Staging | None = None) -> DataFrame:
    """``docs`` with three more columns: the number of words, the hit words as spans
    ``[start, end, start, end ...]`` and the ids (as sorted strings) of the items found.

    A word is hit inside any occurrence of ``window`` consecutive words of an item; an item with
    fewer words, but not none, is one window. Null and blank texts have no words. Items without
    an id hit words and are not listed; an id that recurs is listed once. Repeated rows are
    marked each. Long texts are read in slices and marked whole, long items are cut with overlap.
    An empty benchmark hits nothing; an empty table gives an empty one. The new names must be
    free in ``docs``.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    staging = staging or Staging(spark, "decontamination")
    for name in (n_words_col, spans_col, items_col):
        if name.lower() in {c.lower() for c in docs.columns}:
            raise ValueError(f"documents have a column {name} already")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema),
                        f"`{n_words_col}` long, `{spans_col}` array<int>, `{items_col}` array<string>"])
    n_columns = len(docs.columns)
    text_at = [c.lower() for c in docs.columns].index(text_col.lower())
    out = docs
    for i, block in enumerate(each_block(benchmark, window, item_text_col, item_col, block_words, staging)):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=i == 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, spans, items = mark(raw_texts(b, b.schema.names[text_at]), sent.value)
                if not first:
                    spans = [join_spans(x, y) for x, y in zip(b.column(n_columns + 1).to_pylist(), spans)]
                    items = [sorted({*x, *y}) for x, y in zip(b.column(n_columns + 2).to_pylist(), items)]
                columns = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n_columns], *columns],
                                                 names=[*b.schema.names[:n_columns], n_words_col, spans_col, items_col])

        if i:
            out = staging.write(out, f"block-{i}")
        out = out.mapInArrow(run, schema)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    marked = mark_documents(docs, benchmark, n_words_col="__words", spans_col="__spans", items_col="__items", **options)
    return marked.where(F.size("__spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                    id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id",
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each item with a window in some document, its longest verbatim match: ``item_id,
    words, doc_id, start`` (the word where it begins; of equal ones the smallest id, then the
    first). Matches reach no further than an item's segment of ``SEGMENT_WORDS`` words."""
    spark = docs.sparkSession
    python_tasks(spark)
    staging = Staging(spark, "longest")
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("item_id", pa.string()), ("words", pa.int64()), ("doc_id", pa.string()), ("start", pa.int64())])
    out = None
    for block in each_block(benchmark, window, item_text_col, item_col, block_words, staging):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = sent.value
                shard = Shard(raw_texts(b), block)
                best, where, low, high = shard.search(block)
                hit = np.nonzero(high > low)[0]
                order = hit[np.lexsort([where[hit], -best[hit], block.item[hit]])]
                _, first = np.unique(block.item[order], return_index=True)
                order = order[first]
                doc = np.searchsorted(shard.first, where[order], "right") - 1
                names = b.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
                    [block.ids[i] for i in block.item[order]], best[order], [names[d] for d in doc],
                    where[order] - shard.first[doc]), schema)], schema=schema)

        found = narrow.mapInArrow(run, "item_id string, words long, doc_id string, start long")
        out = found if out is None else out.union(found)
    top = F.min(F.struct((-F.col("words")).alias("w"), "doc_id", "start")).alias("m")
    return out.groupBy("item_id").agg(top).select("item_id", (-F.col("m.w")).alias("words"), "m.doc_id", "m.start")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                         text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each document (see
    :func:`mark_documents`); the digest is of the item ids sorted as strings and joined by
    commas."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = mark_documents(narrow, benchmark, window, **options)
    n_hit = F.expr("aggregate(sequence(0, greatest(size(spans) - 2, 0), 2), 0L, (s, i) -> "
                   "s + coalesce(get(spans, i + 1) - get(spans, i), 0))")
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                         (F.size("spans") > 0).alias("contaminated"))
