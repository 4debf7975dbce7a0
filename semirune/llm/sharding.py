"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, literal_rows

PARTITIONS, MOST_PARTITIONS, PARTITION_ROWS = 64, 4096, 1_000_000
BUCKETS = 4096
SEED = 6


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """An exact draw by inversion, outward from the mode: about as many steps as the standard deviation."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lchoose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(lchoose(good, mode) + lchoose(bad, draws - mode) - lchoose(good + bad, draws))
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts by partition and shard of a uniform permutation: row and column sums are exact."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        line, rest = [], sum(left)
        for j, room in enumerate(left):
            rest -= room
            k = hypergeometric(rng, room, rest, n)
            line.append(k)
            n -= k
            left[j] -= k
        out.append(line)
    return out


def shard(docs: DataFrame, keys: list[str], shards: int = 16, seed: int = SEED) -> DataFrame:
    """Adds shard (0 to shards-1) and slot (gapless from 0 in each shard) to ``docs``.

    The law is ``rows``: shard sizes differ by one row at most, and each
    assignment that has these sizes is equally likely. Rows are dealt into
    partitions by a hash of ``keys`` and of their place in the table; the
    matrix of exact partition-to-shard counts is drawn on the driver
    (partitions times shards numbers: 4096 partitions at most); each partition
    is permuted, its rows go to the shards in runs of the drawn lengths, and
    each shard is permuted again. Permuting is ordering by keyed hashes.

    Places are fixed by a checkpoint first, so rows that repeat, however many,
    are dealt apart like any others, and no key makes a task large; the same
    files read in the same splits give the same result. Equal texts need not
    meet: with a group above a shard's size they could not. Null keys are
    hashed as nulls, texts aren't looked at, and an empty table gives no rows.
    Columns may have any names; shard and slot are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = checkpointed(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")))
    own = [*[F.col("row")[k] for k in keys], F.col("place")]
    n = placed.count()
    partitions = min(MOST_PARTITIONS, max(PARTITIONS, -(-n // PARTITION_ROWS)))
    dealt = placed.withColumn("partition", F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(partitions)).cast("int")).withColumn("order", F.xxhash64(F.lit(seed + 1), *own))
    counts = {r["partition"]: r["n"] for r in dealt.groupBy("partition").agg(F.count("*").alias("n")).collect()}
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    ids = sorted(counts)
    matrix = communication_matrix([counts[i] for i in ids], sizes, seed)
    runs = [{"of": i, "ends": list(accumulate(line))} for i, line in zip(ids, matrix)]
    # A row for each partition, 4096 at most.
    ends = F.broadcast(literal_rows(spark, runs, "of int, ends array<long>"))
    rank = F.row_number().over(Window.partitionBy("partition").orderBy("order", "place")) - 1
    sent = dealt.withColumn("rank", rank).join(ends, F.col("partition") == F.col("of"))
    again = F.xxhash64(F.lit(seed + 2), *own)
    sent = sent.select("row", "place", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"), again.alias("again"))
    sent = checkpointed(sent.withColumn("bucket", F.shiftrightunsigned("again", 64 - int(math.log2(BUCKETS)))))
    held = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = held.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("again", "place")) - 1
    # A row for each shard and bucket: shards times BUCKETS, whatever the input.
    out = sent.withColumn("inside", inside).join(F.broadcast(before), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "shard", (F.col("before") + F.col("inside")).alias("slot"))
