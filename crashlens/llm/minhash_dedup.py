"""Near-duplicate documents by SuperMinHash (operator 3).

A document's set is its distinct word shingles. SuperMinHash gives each element a random
permutation of the signature positions; the element offers, at its j-th position, the value
j plus a uniform fraction, and a position keeps the least offer. Round j is over once no
position can be lowered by an offer of j or more, so long sets stop after a round or two.

1. Documents with equal sets form a class, stood for by its smallest id.
2. Class signatures are cut into bands; classes that share a band meet in a bucket. Buckets
   with the same members are one bucket.
3. Each bucket's members are compared with its leader (the smallest id)
   on full sets, and links are closed to components.
4. Where a bucket still holds several components, every member outside its largest component
   meets all the others, in blocks of bounded size. A pair is looked at in one bucket only (the
   least key the two share), and first by size and by a byte of each signature position; full
   sets are sent only to blocks, and of members, where a pair agrees in enough positions.
5. Components are closed again over all links.

Sets are compared as sorted 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import Staging, batch_of, python_tasks, texts
from crashlens.llm.components import connected_components

BANDS, ROWS = 25, 5   # a pair of similarity 0.8 shares no band with probability 5e-5
BLOCK = 256           # members or probes of a bucket compared in one task call
MISS = 2e-4           # share of pairs exactly at the similarity that the sketches may turn away
ELEMENTS = 200_000    # set elements signed at a time

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, k: int, words_of: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. Only A-Z are lowered; words end at ASCII blanks, which
    is what ``bytes.split`` and ``bytes.lower`` do. Fewer than ``k`` words: one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _GOLD + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures (sets, m) as integers: the round in the top 7 bits, the uniform
    fraction below. ``m`` is at most 127. An empty set keeps the largest value everywhere."""
    top = np.uint32(0xFFFFFFFF)
    sign = np.full((len(sets), m), top, np.uint32)
    flat = sign.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return sign
    e = np.concatenate(sets)
    perm = None
    for j in range(m):
        r = mix(e + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
        offer = (np.uint32(j) << np.uint32(25)) | (r >> np.uint64(39)).astype(np.uint32)
        if perm is None:
            at = k  # the first swap of an untouched permutation
        else:
            row = np.arange(len(e))
            at = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = at
        np.minimum.at(flat, owner * m + at, offer)
        # Done: every position holds an offer of this round or an earlier one.
        open_sets = (sign >> np.uint32(25)).max(axis=1) > j
        stay = open_sets[owner]
        if not stay.any():
            break
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
            k = k[stay]
            row = np.arange(len(k))
            perm[row, k] = perm[:, 0]
            perm[:, 0] = k
        elif not stay.all():
            perm = perm[stay]
        e, owner = e[stay], owner[stay]
    return sign


def band_keys(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.empty((len(sign), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sign), b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            h = mix(h * _GOLD + sign[:, i].astype(np.uint64))
        keys[:, b] = h
    return keys.view(np.int64)


def agreements_needed(percent: int, m: int = BANDS * ROWS, miss: float = MISS) -> int:
    """Signature positions in which a pair must agree: the largest count that a pair exactly at
    ``percent`` falls short of with a probability of at most ``miss`` (of independent positions;
    those of SuperMinHash vary less)."""
    j, tail = percent / 100, 0.0
    for c in range(m + 1):
        tail += math.comb(m, c) * j ** c * (1 - j) ** (m - c)
        if tail > miss:
            return c
    return m


def sign_documents(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch`` for each row of ``docs(doc_id, text)``; the
    sketch is the low byte of each signature position."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                        ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for b in batches:
            sets = [shingle_set(t, k, words_of) for t in texts(b)]
            keys: list = []
            sketches: list = []
            first = 0
            while first < len(sets):
                last, held = first, 0
                while last < len(sets) and (held == 0 or held + len(sets[last]) <= ELEMENTS):
                    held += len(sets[last])
                    last += 1
                sign = signatures(sets[first:last])
                keys.extend(band_keys(sign))
                sketches.extend(row.tobytes() for row in (sign & np.uint32(0xFF)).astype(np.uint8))
                first = last
            yield batch_of(schema, [
                b.column("doc_id"), [len(s) for s in sets],
                [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], keys, sketches])

    return docs.mapInArrow(sign_batches, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def build(batches):
        words_of = WordHashes()
        for b in batches:
            yield batch_of(schema, [b.column("doc_id"),
                                    [shingle_set(t, k, words_of).tobytes() for t in texts(b)]])

    return docs.mapInArrow(build, "id long, shingles binary")


def linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


def verify_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs(a, b, sa, sb)``, sets attached."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(bool(linked(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(check, "a long, b long")


def block_candidates(key: int, probe: np.ndarray, ids: np.ndarray, comp: np.ndarray, main: np.ndarray,
                     size: np.ndarray, bands: np.ndarray, sketch: np.ndarray, percent: int,
                     ) -> list[tuple[int, np.ndarray]]:
    """The pairs of one block that need their full sets, as ``(probe, members)`` places.

    A pair is left out if both are of one component, if their sizes alone forbid the
    similarity, if too few positions of their sketches agree, if a smaller key joins them too
    (they are looked at there), or, both being probes, in its second order.
    """
    need = agreements_needed(percent, sketch.shape[1])
    members = np.nonzero(~probe)[0]
    out = []
    for p in np.nonzero(probe)[0]:
        low, high = np.minimum(size[members], size[p]), np.maximum(size[members], size[p])
        q = members[(comp[members] != comp[p]) & (100 * low >= percent * high)
                    & ((comp[members] == main[members]) | (ids[members] > ids[p]))]
        if len(q):
            q = q[(sketch[q] == sketch[p]).sum(axis=1) >= need]
        if len(q):
            shared = np.where(bands[q] == bands[p], bands[q], np.iinfo(np.int64).max).min(axis=1)
            q = q[shared == key]
        if len(q):
            out.append((int(p), q))
    return out


def _block(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ids, components and candidates of the rows of one block."""
    col = {n: np.array(table.column(n).to_pylist()) for n in ("probe", "id", "comp", "main", "n")}
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(bands), -1)
    return col["id"], col["comp"], block_candidates(
        table.column("key")[0].as_py(), col["probe"], col["id"], col["comp"], col["main"], col["n"],
        bands, sketch, percent)


def open_places(rows: DataFrame, percent: int) -> DataFrame:
    """``(key, mblock, pblock, probe, id)`` of the rows with a candidate in their block; no pairs."""
    schema = pa.schema([("key", pa.int64()), ("mblock", pa.int32()), ("pblock", pa.int32()),
                        ("probe", pa.bool_()), ("id", pa.int64())])

    def look(table: pa.Table) -> pa.Table:
        _, _, found = _block(table, percent)
        keep = np.zeros(table.num_rows, bool)
        for p, q in found:
            keep[p] = True
            keep[q] = True
        return table.select(schema.names).filter(pa.array(keep)).cast(schema)

    return rows.groupBy("key", "mblock", "pblock").applyInArrow(
        look, "key long, mblock int, pblock int, probe boolean, id long")


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the probes and the members of each block of a bucket, on full sets; of
    several links of a probe to one component, one.

    ``rows(key, mblock, pblock, probe, id, comp, main, n, bands, sketch, shingles)`` hold a
    block's members (``probe`` false) and probes.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        ids, comp, found = _block(table, percent)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        found_a, found_b = [], []
        for p, members in found:
            joined = set()
            for q in members.tolist():
                if comp[q] in joined:
                    continue
                x, y = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                if linked(int((y[at] == x).sum()), len(x), len(y), percent):
                    joined.add(comp[q])
                    found_a.append(int(ids[p]))
                    found_b.append(int(ids[q]))
        return pa.table([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=schema)

    return rows.groupBy("key", "mblock", "pblock").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``k``-word shingles. ``component_id`` is the smallest id reachable over links. Documents
    without words (null, empty or blank texts) are linked with nothing. Ids are meant to be
    unique; if one recurs, each row follows its own text, and classes whose smallest id is the
    same are one. A row without an id is linked with nothing, has no component and is kept. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    staging = Staging(spark, "minhash")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    signed = staging.write(sign_documents(narrow, k), "signed")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    # Equal sets: one class. Partial aggregation keeps a hot digest to a row per task.
    classes = staging.write(usable.groupBy("digest")
                            .agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("m"))
                            .select("digest", F.col("m.doc_id").alias("rep"),
                                    F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands"),
                                    F.col("m.sketch").alias("sketch")), "classes")

    rows = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    buckets = (rows.groupBy("key")
               .agg(F.count("*").alias("size"), F.min("id").alias("leader"),
                    F.bit_xor(F.xxhash64("id")).alias("f1"), F.sum(F.hash("id").cast("long")).alias("f2"))
               .where("size > 1")
               # buckets of the same members: one of them
               .groupBy("size", "leader", "f1", "f2").agg(F.min("key").alias("key"))
               .select("key", "size", "leader"))
    met = staging.write(rows.join(buckets, "key"), "met")

    # The ids grow with the corpus: a merge join at every size, not a broadcast at small ones.
    wanted = met.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    sets = staging.write(full_sets(narrow.join(wanted, "doc_id", "left_semi"), k), "sets")
    near = ("100 * least(na, nb) >= {0} * greatest(na, nb)").format(percent)  # sizes alone allow it
    sizes = met.select("id", "n").distinct()
    pairs = (met.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"),
                                              F.col("n").alias("nb")).distinct()
             .join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").where(near))
    first = staging.write(verify_pairs(
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "sa", "sb"), percent), "first")
    comps = connected_components(first, staging)

    # Buckets that still hold several components: all outside the largest meet all others.
    inside = met.join(comps, "id", "left").select("key", "id", "size", F.coalesce("comp", "id").alias("comp"))
    parts = inside.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = (parts.groupBy("key").agg(F.count("*").alias("n_comps"), F.sum("c").alias("total"),
                                      F.max(F.struct("c", "comp")).alias("largest"))
             .where("n_comps > 1")
             .select("key", "total", F.col("largest.comp").alias("main"),
                     (F.col("total") - F.col("largest.c")).alias("outside")))
    # Written first: a join straight after the aggregation would take over its partitioning and
    # keep a large bucket in one task; between two tables a skewed key is split.
    mixed = staging.write(mixed, "mixed")
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    pblocks = F.ceil(F.col("outside") / BLOCK).cast("int")
    open_rows = inside.join(mixed, "key").withColumns({"mblocks": blocks, "pblocks": pblocks})
    members = open_rows.select(
        "key", F.pmod(F.hash("id"), F.col("mblocks")).alias("mblock"),
        F.explode(F.sequence(F.lit(0), F.col("pblocks") - 1)).alias("pblock"),
        F.lit(False).alias("probe"), "id", "comp", "main")
    probes = open_rows.where("comp <> main").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("mblocks") - 1)).alias("mblock"),
        F.pmod(F.hash("id"), F.col("pblocks")).alias("pblock"),
        F.lit(True).alias("probe"), "id", "comp", "main")
    meeting = members.union(probes).join(classes.select(F.col("rep").alias("id"), "n", "bands", "sketch"), "id")
    places = staging.write(open_places(meeting, percent), "places")
    again = (places.join(mixed.select("key", "main"), "key").join(comps, "id", "left")
             .withColumn("comp", F.coalesce("comp", "id"))
             .join(classes.select(F.col("rep").alias("id"), "n", "bands", "sketch"), "id").join(sets, "id"))
    rest = staging.write(compare_blocks(again, percent), "rest")
    if not rest.isEmpty():
        comps = connected_components(first.union(rest), staging)

    of_class = classes.select("digest", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("digest", F.coalesce("comp", "rep").alias("component"))
    return (signed.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"),
                                                         F.col("digest")).alias("digest"))
            .join(of_class, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
