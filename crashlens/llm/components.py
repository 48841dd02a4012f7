"""Connected components of a link table, as joins over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import Staging


def connected_components(links: DataFrame, staging: Staging, rounds: list | None = None) -> DataFrame:
    """``(id, comp)`` for every id in ``links(a, b)``: the smallest id it can reach.

    Every id has a label, the smallest id known so far, and a grand label, the label of its
    label. A round takes the smallest grand label among an id's neighbours and offers it to the
    id and to the id's own label, so that whole trees are hooked at their tops and not only
    single ids; then the labels jump to the grand labels. Chains of falling, random and
    bit-reversed ids take about log2 of their length in rounds (tested), where passing labels
    between neighbours alone takes as many as a chain has links. Labels and grand labels only
    fall; their sums tell when none has changed. ``rounds``, if given, gets one entry a round.
    A hot label is aggregated before it is shuffled. Null ids and links of an id to itself are
    left out; an empty table has no components.
    """
    both = staging.write(links.select("a", "b").where("a <> b")
                         .union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
                         .distinct(), "links")
    labels = None
    offers = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("m"))
    total = None
    while True:
        lower = staging.write(offers.groupBy("id").agg(F.min("m").alias("comp")), "lower")
        tops = lower.select(F.col("id").alias("comp"), F.col("comp").alias("grand"))
        after = staging.write(lower.join(tops, "comp").select("id", "comp", "grand"), "labels")
        staging.drop(lower)
        if labels is not None:
            staging.drop(labels)
        labels = after
        if rounds is not None:
            rounds.append(len(rounds))
        now = labels.agg(*(F.sum(F.col(c).cast("decimal(38,0)")) for c in ("comp", "grand"))).first()
        if now[0] is None or now == total:
            return labels.select("id", "comp")
        total = now
        lowest = (both.join(labels.select(F.col("id").alias("b"), "grand"), "b")
                  .groupBy(F.col("a").alias("id")).agg(F.min("grand").alias("m")))
        known = labels.join(lowest, "id").select("id", "comp", F.least("grand", "m").alias("m"))
        offers = known.select("id", "m").union(known.select(F.col("comp").alias("id"), "m"))
