"""Connected components of an undirected graph of any size, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: A key is heavy if it has more than this many rows and more than this share of all.
LIGHT, HEAVY_PART = 256, 1000


def join_groups(rows: DataFrame, key: str, groups: DataFrame, name: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` by ``key`` with ``groups``, one row for each ``name``, whose column ``n`` says how many rows it has.

    Groups of more than total / HEAVY_PART rows, of which there are HEAVY_PART
    at most, are broadcast, so their rows stay where they are; the others meet
    by a shuffle, in which no key has more rows than that. ``n`` is dropped.
    """
    most = max(LIGHT, total // HEAVY_PART)
    if total <= most:  # no key can be heavy
        return rows.join(groups.drop(n), F.col(key) == F.col(name))
    heavy = groups.where(F.col(n) > most).drop(n)
    tagged = rows.join(F.broadcast(heavy), F.col(key) == F.col(name), "left")
    light = tagged.where(F.col(name).isNull()).select(*rows.columns).join(groups.where(F.col(n) <= most).drop(n), F.col(key) == F.col(name))
    return tagged.where(F.col(name).isNotNull()).unionByName(light)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is named by its smallest node.

    Alternates large-star and small-star steps, each one grouping and one join,
    until the edges are stars: a number of rounds that grows with the logarithm
    of the graph's size. The edges of a hub meet its minimum by a broadcast of
    the heavy nodes' minima alone, so they are never one task. Loops and
    repeated edges do no harm; null ends are left out.
    """
    now = checkpointed(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        state = _state(now)
        if state == before:
            break
        before = state
        total = 2 * state[0]
        # Large star: each node hands its larger neighbours to the smallest of its neighbours and itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count("*").alias("d")).select("n", F.least("n", "m").alias("m"), "d")
        large = join_groups(both.where("b > a"), "a", least, "n", "d", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node hands its smaller neighbours and itself to the smallest of them.
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count("*").alias("d"))
        moved = join_groups(large, "a", lowest, "n", "d", total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = checkpointed(moved.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
