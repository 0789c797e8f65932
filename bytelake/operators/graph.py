"""Reachability and closures over edge tables with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.operators.store import discard, written


#: Paths that one task joins with each other rather than all tasks.
FEW = 50_000


def closure(edges: DataFrame, seed: DataFrame, owner: list[str], within: list[str] | None = None, steps: int = 3) -> DataFrame:
    """Rows (*owner, node) of seed and of all that their nodes reach along edges (*within, a, b).

    Semi-naive: a round goes `steps` steps from what the round before found last, and an anti-join drops what is known; so cycles end, and
    the rounds are the longest shortest path by `steps`. Each round is a table in the shared folder, so lineage does not grow.
    """
    within = within or []
    cols = [*owner, "node"]
    known = frontier = written(seed.select(cols).distinct(), "closure")
    ways = edges.select(*within, edges["a"].alias("node"), edges["b"].alias("__to"))
    rounds = 1
    while not frontier.isEmpty():
        at, found = frontier, None
        for k in range(steps):
            at = at.join(ways, [*within, "node"]).select(*owner, F.col("__to").alias("node")).distinct()
            level = at.withColumn("__step", F.lit(k))
            found = level if found is None else found.union(level)
        found = found.groupBy(*cols).agg(F.min("__step").alias("__step"))
        found = written(found.join(known, cols, "left_anti"), "closure")
        frontier = found.where(F.col("__step") == steps - 1).select(cols)
        known = known.union(found.select(cols))
        rounds += 1
        if rounds % 8 == 0:  # many small tables would make the anti-join's plan long
            known = written(known, "closure")
    return known


def transitive(edges: DataFrame) -> DataFrame:
    """Rows (a, b) for every path from a to b along edges (a, b), cycles included.

    Paths double in length twice a round, so the rounds are as many as the longest shortest path has digits to the base four; for graphs whose whole closure is wanted and is not much larger than they are, such
    as type hierarchies. Each round is a table in the shared folder, with the length of the shortest path: once none is as long as a round allows, there is no longer one. While a round starts from at most FEW
    paths, it is the work of one task, as moving them would cost more.
    """
    known, reach = written(edges.select("a", "b", F.lit(1).alias("n")).distinct(), "paths"), 1
    while True:
        old = known
        if known.count() <= FEW:
            known = known.coalesce(1)
        for _ in range(2):
            step = known.join(known.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m")), "b").select("a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n"))
            known = known.union(step).groupBy("a", "b").agg(F.min("n").alias("n"))
        known, reach = written(known, "paths"), 4 * reach
        discard(old)
        if (known.agg(F.max("n")).first()[0] or 0) < reach:
            return known.select("a", "b")
