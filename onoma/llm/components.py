"""Connected components of an edge table by repeated contraction, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b), longs: equal roots are equal components.

    Each round sends a node to the least of its neighbours and itself, by a hash salted with
    the round, and contracts the edges. A hash order shrinks chains by a constant factor a round,
    so rounds grow with the logarithm of the longest path. Minima are partially aggregated, so
    a hub's neighbours never meet in one task.
    """
    live = stage(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    while live.limit(1).count():
        turn = len(steps)
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = live.select(F.col("a").alias("node"), rank("b").alias("x")).union(live.select(F.col("b").alias("node"), rank("a").alias("x")))
        to = both.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("x", rank("node"))["n"].alias("root"))
        to = stage(to, f"round{turn}")
        steps.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = stage(live.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{turn}")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    found = steps[-1]
    for to in reversed(steps[:-1]):
        up = found.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = to.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return found
