"""Connected components of a graph by alternating large-star and small-star steps, each a join and an
aggregation whose partial sums come before the shuffle. Each round is written to the shared folder, in as
many files as its edges need; the driver sees only a count and a checksum. Rounds grow as the logarithm of
the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import shared

#: Edges of a round to a task that writes.
EDGES_OF_A_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it is linked to), for each node of `edges` (columns a, b of one
    orderable type). Nulls link nothing; repeated edges and loops do no harm. No edge, no row."""
    spark = edges.sparkSession
    path = shared.new_path(spark, "edges")
    now = shared.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", path)
    seen = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if told["n"] == 0 or tuple(told) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = tuple(told)
        spent = [path, *(shared.new_path(spark, label) for label in ("least", "stars", "least"))]
        path = shared.new_path(spark, "edges")
        tasks = -(-told["n"] // EDGES_OF_A_TASK)
        stars = shared.written(_large_star(now, spent[1], tasks).coalesce(tasks), "stars", spent[2])
        now = shared.written(_small_star(stars, spent[3], tasks).coalesce(tasks), "edges", path)
        for old in spent:
            shared.removed(spark, old)


def _large_star(edges: DataFrame, path: str, tasks: int) -> DataFrame:
    """Each node's larger neighbours go to the least node around it. The least nodes become a table at `path`,
    so that Spark can split the join at a node of many edges."""
    both = edges.union(edges.select("b", "a"))
    least = shared.written(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")).coalesce(tasks), "least", path)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame, path: str, tasks: int) -> DataFrame:
    """Each node's smaller neighbours and itself go to the least of them. Edges (a written table) lead from a to a
    smaller b. The least nodes become a table at `path`, as above."""
    least = shared.written(edges.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks), "least", path)
    others = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.union(least.select("a", F.col("least").alias("b"))).distinct()
