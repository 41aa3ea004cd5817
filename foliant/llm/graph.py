"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): root is the least node reachable.

    Alternates large-star and small-star steps, which end after about log(n) rounds also on
    long chains. Minima are pre-aggregated before the shuffle and joins can be split, so that a
    node with very many neighbours is no bottleneck; each round is checkpointed. Self links and
    null ends are ignored; an empty input gives an empty result.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = stash(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = _state(step)
        now = step
        if new == state:
            break
        state = new
    # at the end every node but the roots points at its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1_000_003).cast("long"))).first()
    return tuple(row)
