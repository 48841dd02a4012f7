"""Prefix trie of conversations by the Euler-tour technique (operator 11).

1. Turns are put in order, and every conversation gets the running XOR of two 64-bit hashes of
   (place, role, text): prefixes with equal pairs of sums are one node.
2. A node is named by its smallest member and its depth. Children are ordered by that member.
   Each node gives an enter and an exit arc, each arc its successor in the tour.
3. The tour is list-ranked. Arcs are range-partitioned by conversation; a task contracts the
   stretches of the tour that lie within its partition, and pointer jumping over the stretches
   (one join a round, the distance doubles) ranks them, and so every arc.
4. Prefix sums over the ranked arcs give each node's leaves and savings: the sum at its exit less
   the sum before its enter.

No group is held by one task: running values are taken within range buckets, and what earlier
buckets of the same group sum up to is added afterwards, so a conversation, a node's children
or the members that end in a node may be any share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import Staging, batch_of, python_tasks

TOUR_BUCKET = 1 << 15  # places of the tour whose sums one task adds up
NODE = ("depth", "k1", "k2")


def ranged(df: DataFrame, staging: Staging, name: str, *order: str) -> DataFrame:
    """The table written in ranges of ``order``, each row with the number of its range."""
    return staging.write(df.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()), name)


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """``df(bucket, ...)`` with running values within ``group`` in ``order``.

    ``values`` has, by name, what is added up and how (``sum`` or ``bit_xor``). Buckets must be
    ranges of the order. A window covers a bucket's rows of a group only; the total of the
    group's earlier buckets comes from one row per group and bucket.
    """
    local = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    add = {"sum": F.sum, "bit_xor": F.bit_xor}
    totals = df.groupBy(*group, "bucket").agg(*(add[how](x).alias(f"{n}_t") for n, (x, how) in values.items()))
    totals = totals.select(*group, "bucket", *(add[how](f"{n}_t").over(earlier).alias(f"{n}_b") for n, (_, how) in values.items()))
    totals = totals.where(" or ".join(f"{n}_b is not null" for n in values))  # groups of one bucket have none
    out = df.withColumns({n: add[how](x).over(local) for n, (x, how) in values.items()})
    out = out.join(totals, [*group, "bucket"], "left")
    both = {n: F.col(n) + F.coalesce(f"{n}_b", F.lit(0)) if how == "sum" else F.col(n).bitwiseXOR(F.coalesce(f"{n}_b", F.lit(0).cast("long")))
            for n, (_, how) in values.items()}
    return out.withColumns(both).drop(*(f"{n}_b" for n in values))


def ordered_turns(conversations: DataFrame, staging: Staging, conv_col: str, turn_col: str, role_col: str,
                  text_col: str) -> DataFrame:
    """``conv_id, place, digest, chars`` of every turn; places count from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    turns = ranged(turns, staging, "turns", "conv_id", "turn", "digest")
    placed = running(turns, ["conv_id"], ["turn", "digest"], {"place": (F.lit(1), "sum")})
    return staging.write(placed.select("conv_id", (F.col("place") - 1).alias("place"), "digest", "chars"), "places")


def share_openings(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of conversation c - c % ``every``, then c's own
    after its first h; h = crc32(decimal c) % ``most``. Their turns ``conv_id, depth, digest,
    chars`` and the lengths ``conv_id, length`` of all."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    c = F.col("conv_id")
    plan = (sizes.select("conv_id", "own", (c - c % every).alias("base"),
                         (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
            .join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
            .withColumn("shared", F.least("h", F.coalesce("base_own", F.lit(0)))))
    lengths = plan.select("conv_id", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    own = (turns.join(plan.select("conv_id", "h", "shared"), "conv_id").where("place >= h")
           .select("conv_id", (F.col("place") - F.col("h") + F.col("shared") + 1).alias("depth"), "digest", "chars"))
    opening = (plan.where("shared > 0")
               .select("conv_id", F.col("base").alias("from_conv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shared") - 1)).alias("place"))
               .join(turns.where(F.col("place") < most).select(F.col("conv_id").alias("from_conv"), "place", "digest", "chars"), ["from_conv", "place"])
               .select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars"))
    return own.union(opening), lengths


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ``member`` ids, ascending and comma-joined: ``depth, k1, k2,
    ends_sha256``. Ids become texts in ranges of all ids; a node's texts, a row per thousand
    ids, meet in one task, which reads them one after the other (the digest itself is
    sequential)."""
    key = "depth long, k1 long, k2 long"
    part_schema = pa.schema([*((c, pa.int64()) for c in (*NODE, "first")), ("ids", pa.binary())])
    out_schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])

    def stretches(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        cols = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in NODE])
        change = np.nonzero((cols[1:] != cols[:-1]).any(axis=1))[0] + 1
        for first, last in zip([0, *change.tolist()], [*change.tolist(), len(cols)]):
            yield tuple(cols[first].tolist()), first, last

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("member").to_pylist()
                rows = [(*k, ids[first], ",".join(map(str, ids[first:last])).encode()) for k, first, last in stretches(b)]
                yield batch_of(part_schema, [list(c) for c in zip(*rows)])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            texts = b.column("ids").to_pylist()
            for k, first, last in stretches(b) if b.num_rows else ():
                if k != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                for i in range(first, last):
                    state.update(texts[i] if i == first else b"," + texts[i])
            if done:
                yield batch_of(out_schema, [list(c) for c in zip(*done)])
        if now is not None:
            yield batch_of(out_schema, [[x] for x in (*now, state.hexdigest())])

    parts = (ends.repartitionByRange(*NODE, "member").sortWithinPartitions(*NODE, "member")
             .mapInArrow(join, f"{key}, first long, ids binary"))
    return (parts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .select(*NODE, "ids").mapInArrow(digest, f"{key}, ends_sha256 string"))


def next_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes(depth, parent_conv_id, conv_id, bucket)``, in ranges of that order, with the next
    child of the same parent as ``sibling``."""
    group = ["depth", "parent_conv_id"]
    heads = nodes.groupBy(*group, "bucket").agg(F.min("conv_id").alias("head"))
    after = (heads.withColumn("after", F.lead("head").over(Window.partitionBy(*group).orderBy("bucket")))
             .where("after is not null").select(*group, "bucket", "after"))
    local = Window.partitionBy(*group, "bucket").orderBy("conv_id")
    return (nodes.withColumn("beside", F.lead("conv_id").over(local)).join(after, [*group, "bucket"], "left")
            .withColumn("sibling", F.coalesce("beside", "after")).drop("beside", "after", "bucket"))


ARC = ("conv_id", "depth", "side")             # side 0 enters a node, 1 leaves it
NEXT = ("next_conv", "next_depth", "next_side")
HEAD = ("head_conv", "head_depth", "head_side")


def contract(arcs: DataFrame) -> DataFrame:
    """The arcs with the head of their stretch within the partition and the distance from it;
    ``last`` marks the end of a stretch, whose successor lies in another partition (or nowhere)."""
    schema = pa.schema([*((c, pa.int64()) for c in (*ARC, *NEXT, *HEAD, "at")), ("last", pa.bool_()),
                        ("leaf", pa.int64()), ("saved", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        own = [table.column(c).to_numpy() for c in ARC]
        ends = table.column(NEXT[0]).is_null().to_numpy()
        nxt = [table.column(c).fill_null(0).to_numpy() for c in NEXT]
        convs, conv = np.unique(own[0], return_inverse=True)
        deep = int(max(own[1].max(), nxt[1].max())) + 1
        name = (conv * deep + own[1]) * 2 + own[2]
        at = np.searchsorted(convs, nxt[0])
        known = ~ends & (at < len(convs))
        known &= convs[np.where(known, at, 0)] == nxt[0]
        wanted = (at * deep + nxt[1]) * 2 + nxt[2]
        order = np.argsort(name)
        place = np.searchsorted(name[order], wanted)
        known &= place < len(name)
        place = order[np.where(known, place, 0)]
        known &= name[place] == wanted
        # Distance from the head of the stretch, by doubling.
        back = np.arange(len(name))
        back[place[known]] = np.nonzero(known)[0]
        distance = (back != np.arange(len(name))).astype(np.int64)
        while True:
            further = back[back]
            if (further == back).all():
                break
            distance, back = distance + distance[back], further
        n = len(name)
        columns = [*(table.column(c).combine_chunks() for c in (*ARC, *NEXT)), *(pa.array(x[back]) for x in own),
                   pa.array(distance), pa.array(~known), table.column("leaf").combine_chunks(), table.column("saved").combine_chunks()]
        out = pa.Table.from_arrays(columns, schema=schema)
        assert out.num_rows == n
        yield from out.to_batches(max_chunksize=10_000)

    types = ", ".join(f"{f.name} {'boolean' if f.name == 'last' else 'long'}" for f in schema)
    return arcs.select(*ARC, *NEXT, "leaf", "saved").mapInArrow(run, types)


def rank_stretches(stretches: DataFrame, staging: Staging) -> DataFrame:
    """``head_*, left``: the number of arcs from each stretch's head to the end of the tour.

    Pointer jumping: a stretch adds what its successor has and takes over its successor's
    successor, so after r rounds each has looked at 2 ** r stretches.
    """
    now = staging.write(stretches.select(*HEAD, *NEXT, "left"), "stretches")
    while not now.where("next_conv is not null").isEmpty():
        ahead = now.select(*(F.col(h).alias(n) for h, n in zip(HEAD, NEXT)), *(F.col(n).alias(f"{n}_2") for n in NEXT), F.col("left").alias("left_2"))
        after = staging.write(now.join(ahead, list(NEXT), "left").select(
            *HEAD, *(F.col(f"{n}_2").alias(n) for n in NEXT), (F.col("left") + F.coalesce("left_2", F.lit(0))).alias("left")), "stretches")
        staging.drop(now)
        now = after
    return now.select(*HEAD, "left")


def subtree_sums(arcs: DataFrame, staging: Staging) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` from the arcs of one tour (``leaf`` and
    ``saved`` are what its enter arc adds)."""
    ranged_arcs = staging.write(arcs, "arcs").repartitionByRange("conv_id", "depth")
    placed = staging.write(contract(ranged_arcs), "contracted")
    left = rank_stretches(placed.where("last").withColumn("left", F.col("at") + 1), staging)
    rank = placed.join(left, list(HEAD)).select("conv_id", "depth", "side", "leaf", "saved", (F.col("left") - F.col("at")).alias("left"))
    # Counted from the end, places are left - 1; sums from there do as well as from the start.
    tour = rank.withColumn("bucket", F.floor((F.col("left") - 1) / TOUR_BUCKET))
    summed = running(staging.write(tour, "tour"), [], ["left"], {"leaves": (F.col("leaf"), "sum"), "savings": (F.col("saved"), "sum")})
    # From the end the exit comes first: the sum at the enter arc less that at the exit arc.
    def between(name):
        return F.max(F.when(F.col("side") == 0, F.col(name))) - F.max(F.when(F.col("side") == 1, F.col(name)))
    return summed.groupBy("conv_id", "depth").agg(between("leaves").alias("n_leaves"), between("savings").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, shared_every: int | None = None, shared_most: int = 6, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the prefix trie: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of the first ``depth`` turns (role and text) of some
    conversation; the root, at depth 0, has no text. ``conv_id`` is the smallest conversation
    that begins with it, ``n_convs`` their number, ``n_leaves`` the childless nodes of its
    subtree, itself included; ``saved_tokens`` adds up, over that subtree, (members - 1) times the
    characters of a node's last text. ``ends_sha256`` is the digest of the conversations that end
    there. With ``shared_every`` the conversations are rebuilt first (:func:`share_openings`).

    Turns are ordered by ``turn``, nulls first, and of equal turns by the digest of role and text;
    repeated rows are turns each. Null roles and texts are empty. Rows without a conversation id
    belong to none. Texts of any length count by their digest and length. Other columns are not
    read. An empty table has no conversation and gives no node, not even a root.
    """
    spark = conversations.sparkSession
    python_tasks(spark)
    staging = Staging(spark, "trie")
    turns = ordered_turns(conversations, staging, conv_col, turn_col, role_col, text_col)
    if shared_every:
        turns, lengths = share_openings(turns, shared_every, shared_most)
    else:
        lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
        turns = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    lengths = staging.write(lengths, "lengths")
    turns = ranged(turns.withColumns({"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64(F.lit("second"), "digest", "depth")})
                   .drop("digest"), staging, "rebuilt", "conv_id", "depth")
    steps = staging.write(running(turns, ["conv_id"], ["depth"], {"k1": (F.col("x1"), "bit_xor"), "k2": (F.col("x2"), "bit_xor")})
                          .drop("bucket"), "steps")
    everyone = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = everyone.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"),
                           F.lit(None).cast("long").alias("parent_conv_id"))
    prefixes = staging.write(steps.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.min(F.col("k1").bitwiseXOR(F.col("x1"))).alias("p1"), F.min(F.col("k2").bitwiseXOR(F.col("x2"))).alias("p2")), "prefixes")
    parents = prefixes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    columns = [*NODE, "conv_id", "n_convs", "chars", "parent_conv_id"]
    top = prefixes.where("depth = 1").withColumn("parent_conv_id", everyone.select("conv_id").scalar()).select(*columns)
    nodes = (prefixes.where("depth > 1").join(parents, ["depth", "p1", "p2"]).select(*columns).union(top).union(root.select(*columns)))
    nodes = next_siblings(ranged(nodes, staging, "nodes", "depth", "parent_conv_id", "conv_id"))
    families = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
                .agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child")))
    nodes = staging.write(nodes.join(families, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "family")

    def arc(side, conv, depth, next_side):
        enter = side == 0
        return nodes.select("conv_id", "depth", F.lit(side).cast("long").alias("side"), conv.alias("next_conv"), depth.alias("next_depth"),
                            next_side.cast("long").alias("next_side"),
                            (F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long") if enter else zero).alias("leaf"),
                            ((F.col("n_convs") - 1) * F.col("chars") if enter else zero).alias("saved"))

    down, beside = F.col("n_children") > 0, F.col("sibling").isNotNull()
    enter = arc(0, F.coalesce("child", "conv_id"), F.when(down, F.col("depth") + 1).otherwise(F.col("depth")), F.when(down, 0).otherwise(1))
    leave = arc(1, F.coalesce("sibling", "parent_conv_id"), F.when(beside, F.col("depth")).when(F.col("depth") > 0, F.col("depth") - 1),
                F.when(beside, 0).when(F.col("depth") > 0, 1))
    sums = subtree_sums(enter.union(leave), staging)
    ends = (steps.join(lengths, "conv_id").where("depth = length").select(*NODE, F.col("conv_id").alias("member"))
            .union(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.col("conv_id").alias("member"))))
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, ["conv_id", "depth"]).join(end_digests(ends), list(NODE), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
