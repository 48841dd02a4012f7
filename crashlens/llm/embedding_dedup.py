"""Near-duplicate vectors by collision counting over projections (operator 9).

Two unit vectors at distance s differ by about N(0, s) along a random direction, so close
pairs fall into the same narrow window of a sorted projection far more often than others. A
single window still meets a fixed share of all pairs, hence two levels:

* routing: in each of some rounds, several projections are cut into shifted cells; vectors
  with equal cells meet. The number of projections grows with the logarithm of the number of
  vectors, so that a cell expects at most ``CELL`` unrelated ones, and the rounds follow from
  it (``routing_shape``): the share of unrelated pairs that meet falls as the table grows;
* counting: within a cell, each of ``PROJECTIONS`` further projections is sorted, the members
  in every query's window are found by binary search in that order, and collisions are
  counted per pair. The count asked for is the largest that a pair exactly at the threshold
  reaches with probability ``RECALL``.

Counting reads the projections alone, a byte each. Vectors are sent only to cells, and of
members, where a pair passed the count, and such pairs are verified by their cosine in double
precision. At the threshold itself routing finds a pair with probability ``ROUTED`` and
counting keeps it with at least ``RECALL``; closer pairs are found nearly always.

Equal vectors are one class with a multiplicity. A cell over ``BLOCK`` vectors is compared
in pairs of blocks, so no cell has to fit a task. A pair met in several rounds counts in the
first of them; tasks return sums and local roots, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import Staging, batch_of, python_tasks
from crashlens.llm.components import connected_components

PROJECTIONS = 48
RECALL = 0.97
ROUTED = 0.96
CELL = 256        # unrelated vectors expected in a cell, at most
CELL_WIDTH = 3.2  # in distances at the threshold
BLOCK = 1024
COUNTERS = 4_000_000  # pairs with a counter at a time
PAIRS = 100_000   # pairs verified at a time
STEPS = 31        # steps of a stored projection to a unit


def distance(threshold: float) -> float:
    return math.sqrt(2 - 2 * threshold)


def same_cell(width: float, s: float) -> float:
    """Probability that two values N(0, s) apart share a shifted cell of this width."""
    r = width / s
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def routing_shape(n: int, threshold: float) -> tuple[int, int]:
    """Projections a cell and rounds for ``n`` vectors: enough projections that ``n`` unrelated
    vectors put at most ``CELL`` into a cell, and enough rounds that a pair at the threshold
    meets with probability ``ROUTED``."""
    s = distance(threshold)
    near, far = same_cell(CELL_WIDTH * s, s), same_cell(CELL_WIDTH * s, math.sqrt(2))
    dims = max(4, math.ceil(math.log(max(n, 1) / CELL) / -math.log(far)))
    return dims, math.ceil(math.log(1 - ROUTED) / math.log1p(-near ** dims))


def windows(threshold: float) -> tuple[int, int]:
    """Window half-width in steps of a stored projection (a step more than the distance at the
    threshold, for rounding) and the recall-calibrated collision count."""
    hit = math.erf(1 / math.sqrt(2))
    tail, need = 0.0, 0
    for c in range(PROJECTIONS, -1, -1):
        tail += math.comb(PROJECTIONS, c) * hit ** c * (1 - hit) ** (PROJECTIONS - c)
        if tail >= RECALL:
            need = c
            break
    return math.ceil(distance(threshold) * STEPS) + 1, need


class Directions:
    """The random directions for one dimension and routing shape, the same in every task."""

    _made: dict[tuple[int, int, int], Directions] = {}

    def __init__(self, dim: int, dims: int, rounds: int):
        rng = np.random.default_rng([9, dim])
        self.dims, self.rounds = dims, rounds
        self.lines_at = rng.normal(size=(dim, PROJECTIONS))
        self.cells = rng.normal(size=(dim, rounds * dims))
        self.shift = rng.random(rounds * dims)
        self.mult = rng.integers(1, 1 << 62, (dims,), dtype=np.int64) | 1

    @classmethod
    def of(cls, dim: int, dims: int, rounds: int) -> Directions:
        if (dim, dims, rounds) not in cls._made:
            cls._made[dim, dims, rounds] = cls(dim, dims, rounds)
        return cls._made[dim, dims, rounds]

    def keys(self, unit: np.ndarray, width: float) -> np.ndarray:
        """One routing key per vector and round; a key belongs to one round and one dimension."""
        cell = np.floor(unit @ self.cells / width + self.shift).astype(np.int64)
        with np.errstate(over="ignore"):
            k = (cell.reshape(len(unit), self.rounds, self.dims) * self.mult).sum(axis=2)
            k = (k ^ (k >> 31)) * np.int64(0x2545F4914F6CDD1D)
            return k + np.arange(self.rounds) * np.int64(0x5851F42D4C957F2D) + unit.shape[1]

    def lines(self, unit: np.ndarray) -> np.ndarray:
        """The further projections in steps, as bytes; values beyond four units count as four."""
        return (np.rint(np.clip(unit @ self.lines_at, -4, 4) * STEPS) + 128).astype(np.uint8)


def as_units(raw: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(b, "<f8") for b in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(values) -> bytes | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, "<f8")
    if not np.isfinite(x).all():
        return None
    big = np.abs(x).max()
    return (x + 0.0).tobytes() if big > 0 else None  # + 0.0: -0.0 and 0.0 are one value


def usable_vectors(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def read(batches):
        for b in batches:
            yield batch_of(schema, [b.column("id"), [_valid(v) for v in b.column("v").to_pylist()]])

    return rows.mapInArrow(read, "id long, v binary").where("v is not null and id is not null")


def _scaled(raw: bytes) -> bytes:
    """The vector divided by its largest component, so that squares neither overflow nor vanish."""
    x = np.frombuffer(raw, "<f8")
    return (x / np.abs(x).max()).tobytes()


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def window_collisions(group: np.ndarray, lines: np.ndarray, half: int, need: int,
                      ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows ``(i, j)``, i < j, of equal group (ascending, side by side) that share the
    windows of at least ``need`` projections; some groups at a time.

    For every projection the rows are sorted by group and value; a query's window ends where a
    binary search for its value plus ``half`` does. Windows are symmetric, so the upper half
    of each counts every pair once.
    """
    starts = np.nonzero(np.diff(group, prepend=group[:1] - 1))[0]
    sizes = np.diff(starts, append=len(group))
    first = 0
    while first < len(sizes):
        last, room = first, 0
        while last < len(sizes) and (last == first or room + int(sizes[last]) ** 2 <= COUNTERS):
            room += int(sizes[last]) ** 2
            last += 1
        lo = starts[first]
        size = sizes[first:last]
        n = int(size.sum())
        which = np.repeat(np.arange(len(size)), size)
        local = np.arange(n) - np.repeat(starts[first:last] - lo, size)
        base = np.repeat(np.cumsum(size ** 2) - size ** 2, size)
        count = np.zeros(room, np.int16)
        for c in range(lines.shape[1]):
            value = which * 1024 + lines[lo:lo + n, c]  # windows do not reach the next group
            order = np.argsort(value, kind="stable")
            value = value[order]
            ends = np.searchsorted(value, value + half, "right")
            reach = ends - np.arange(n) - 1
            query = np.repeat(np.arange(n), reach)
            member = np.arange(len(query)) - np.repeat(np.cumsum(reach) - reach, reach) + query + 1
            x, y = order[query], order[member]
            low, high = np.minimum(x, y), np.maximum(x, y)
            count += np.bincount(base[low] + local[low] * size[which[low]] + local[high], minlength=room).astype(np.int16)
        hit = np.nonzero(count >= need)[0]
        g = np.searchsorted(np.cumsum(size ** 2), hit, "right")
        inside = hit - (np.cumsum(size ** 2) - size ** 2)[g]
        yield starts[first:last][g] + inside // size[g], starts[first:last][g] + inside % size[g]
        first = last


CELL_OF = ("key", "b1", "b2")


def _passing(table: pa.Table, half: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a sorted table that pass the count; in a pair of blocks only those of
    different blocks."""
    col = {n: table.column(n).to_numpy() for n in (*CELL_OF, "block")}
    change = np.zeros(table.num_rows, bool)
    for name in CELL_OF:
        change[1:] |= col[name][1:] != col[name][:-1]
    lines = np.frombuffer(b"".join(table.column("lines").to_pylist()), np.uint8).reshape(-1, PROJECTIONS)
    for i, j in window_collisions(np.cumsum(change), lines, half, need):
        keep = (col["b1"][i] == col["b2"][i]) | (col["block"][i] != col["block"][j])
        yield i[keep], j[keep]


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of some rows that end with a cell (or its pair of blocks)."""
    held: list[pa.RecordBatch] = []
    rows_held = 0
    for b in batches:
        held.append(b)
        rows_held += b.num_rows
        if rows_held < 4 * BLOCK:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(table.num_rows, bool)
        for name in CELL_OF:
            values = table.column(name).to_numpy()
            same &= values == values[-1]
        cut = int(np.argmax(same))  # the last cell may go on in the next batch
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows_held = table.num_rows - cut
    if rows_held:
        yield pa.Table.from_batches(held)


def passing_places(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows ``(key, b1, b2, block, id)`` in a pair that passes the count, from sorted rows
    with ``lines``; no pairs."""
    half, need = windows(threshold)
    schema = pa.schema([("key", pa.int64()), ("b1", pa.int32()), ("b2", pa.int32()), ("block", pa.int32()),
                        ("id", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            keep = np.zeros(table.num_rows, bool)
            for i, j in _passing(table, half, need):
                keep[i] = True
                keep[j] = True
            yield from table.select(schema.names).filter(pa.array(keep)).cast(schema).to_batches()

    return rows.mapInArrow(look, "key long, b1 int, b2 int, block int, id long")


def compare_meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """``(id, links, root)`` sums from sorted rows
    ``(key, b1, b2, block, id, mult, v, keys, lines)``."""
    half, need = windows(threshold)
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def one(table: pa.Table) -> pa.RecordBatch | None:
        ids, mult, key = (table.column(n).to_numpy() for n in ("id", "mult", "key"))
        n = table.num_rows
        raw = table.column("v").to_pylist()
        dim = np.array([len(r) // 8 for r in raw])  # a key holds vectors of one dimension
        unit, row_of = {}, np.zeros(n, np.int64)
        for size in np.unique(dim):
            at = np.nonzero(dim == size)[0]
            unit[size] = as_units([_scaled(raw[i]) for i in at])
            row_of[at] = np.arange(len(at))
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        links, a_all, b_all = np.zeros(n, np.int64), [], []
        for i, j in _passing(table, half, need):
            for start in range(0, len(i), PAIRS):
                p, q = i[start:start + PAIRS], j[start:start + PAIRS]
                good = np.zeros(len(p), bool)
                for size, vectors in unit.items():
                    at = np.nonzero((dim[p] == size) & (dim[q] == size))[0]
                    good[at] = np.einsum("ij,ij->i", vectors[row_of[p[at]]], vectors[row_of[q[at]]]) >= threshold
                p, q = p[good], q[good]
                if not len(p):
                    continue
                first = (keys[p] == keys[q]).argmax(axis=1)  # the first round in which they meet
                here = keys[p, first] == key[p]
                p, q = p[here], q[here]
                np.add.at(links, p, mult[q])
                np.add.at(links, q, mult[p])
                a_all.append(p)
                b_all.append(q)
        if not sum(map(len, a_all)):
            return None
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        hit = np.unique(np.concatenate([a, b]))
        order = hit[np.argsort(ids[hit], kind="stable")]  # the smallest id is the root
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(len(order))
        root = _roots(len(order), rank[a], rank[b])
        return batch_of(schema, [ids[order], links[order], ids[order][root]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            out = one(table)
            if out is not None:
                yield out

    return rows.mapInArrow(compare, "id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vector_col: str = "embedding",
                 id_col: str = "vec_id") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows linked directly (cosine >= ``threshold``),
    ``component_id`` is the smallest id reachable. Null, empty or zero vectors, and vectors
    with a null or non-finite component, are linked with nothing; vectors of different
    dimension are never linked. Repeated rows are rows of their own with equal vectors; rows
    without an id are linked with nothing, have no component and are kept. Other columns are
    not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    python_tasks(spark)
    staging = Staging(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    usable = staging.write(usable_vectors(rows), "usable")
    classes = staging.write(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "classes")

    dims_rounds = routing_shape(classes.count(), threshold)
    width = CELL_WIDTH * distance(threshold)
    key_schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64())), ("lines", pa.binary())])

    def route(batches):
        for b in batches:
            raw = b.column("v").to_pylist()
            keys: list = [None] * len(raw)
            lines: list = [None] * len(raw)
            dims = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                ways, unit = Directions.of(int(dim), *dims_rounds), as_units([_scaled(raw[i]) for i in at])
                for i, k, x in zip(at, ways.keys(unit, width), ways.lines(unit)):
                    keys[i], lines[i] = k, x.tobytes()
            yield batch_of(key_schema, [b.column("id"), keys, lines])

    keyed = staging.write(classes.select(F.col("rep").alias("id"), "v")
                          .mapInArrow(route, "id long, keys array<long>, lines binary"), "keyed")
    # Written first: the join then knows the size of what it may broadcast.
    large = staging.write(keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size"))
                          .where(F.col("size") > BLOCK)
                          .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "large")
    met = (keyed.select("id", "lines", F.explode("keys").alias("key")).join(large, "key", "left")
           .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
           .withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                   "block", "id", "lines"))
    places = staging.write(passing_places(
        met.repartition(*CELL_OF).sortWithinPartitions(*CELL_OF), threshold), "places")
    ready = (places.join(classes.select(F.col("rep").alias("id"), "mult", "v"), "id").join(keyed, "id")
             .select(*CELL_OF, "block", "id", "mult", "v", "keys", "lines")
             .repartition(*CELL_OF).sortWithinPartitions(*CELL_OF))
    found = staging.write(compare_meetings(ready, threshold), "found")
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), staging)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = (classes.withColumnRenamed("rep", "id").join(sums, "id", "left").join(comps, "id", "left")
                .select("v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                        F.coalesce("comp", "id").alias("component")))
    linked = usable.join(of_class, "v").select("id", "n_links", "component").where("n_links > 0").distinct()
    # Only linked rows are joined back, by id; a row that is not usable gets no link.
    marked = rows.select("id", F.col("id").alias("vec_id"))
    return (marked.join(linked, "id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
