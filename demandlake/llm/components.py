"""Connected components by randomized contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.shared import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, a != b).

    Each round every node picks the neighbour (or itself) of lowest random rank
    and is merged into it; the expected number of nodes falls by a constant
    factor, so the number of rounds grows with the logarithm of the input. Each
    round's picks are a written table; the picks are then composed from the last
    round back. ``component`` is some node of the component. Minima are
    pre-aggregated before their shuffle and the joins are plain equi-joins whose
    large partitions adaptive execution can split, so a node of very high degree
    stays cheap. No rows for an empty input."""
    level = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    picks: list[DataFrame] = []
    while not level.isEmpty():
        seed = len(picks)
        both = level.select("a", "b").union(level.select(F.col("b"), F.col("a"))).toDF("node", "other")
        rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        low = F.min(F.struct(rank("other").alias("r"), F.col("other").alias("n"))).alias("low")
        own = F.struct(rank("node").alias("r"), F.col("node").alias("n"))
        pick = both.groupBy("node").agg(low).select("node", F.least(F.col("low"), own)["n"].alias("to"))
        pick = stage(pick, f"picks{seed}")
        picks.append(pick)
        a = pick.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        b = pick.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = level.join(a, "a").join(b, "b").filter("a2 <> b2")
        level = stage(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
                      f"edges{seed + 1}")
    if not picks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = picks[-1].select("node", F.col("to").alias("component"))
    for pick in reversed(picks[:-1]):
        later = out.select(F.col("node").alias("to"), "component")
        out = pick.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return out
