"""Connected components of a link table by alternating star contractions.

Every step is a join and an aggregation; nothing is collected.  A step's links are
written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from phasegrid.llm.common import F, materialize

MAX_STEPS = 64


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One contraction: neighbours of each node are linked with the least of them.

    Large star: neighbours above the node; small star: the node and those below it.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("m").alias("a"), "b")
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``a, b``; a component is named by its least node."""
    now = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(MAX_STEPS):
        now = materialize(_stars(_stars(now, small=False), small=True), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("links did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
