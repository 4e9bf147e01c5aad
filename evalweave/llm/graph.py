"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u")
    return near.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(near.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a < b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the smallest node of its component.

    Every round is written to the shared folder, so no round depends on the executors of an earlier one; only two
    numbers a round reach the driver. Self-loops and NULL ends are ignored; an empty table gives no rows.
    """
    e = materialise(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        e = materialise(_small_star(_large_star(e)), "edges")
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1 << 31)), F.lit(0))).first())
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
