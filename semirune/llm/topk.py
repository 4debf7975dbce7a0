"""Exact top-k inner-product search: a ball tree in each shard, shards cut from balls of near vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows of a shard, and queries that are searched in it at once.
SHARD_ROWS, QUERY_BLOCK = 8192, 16_384
#: Balls that the vectors are dealt into: this many at least, and as many as make a ball a shard up to the most.
FEWEST_BALLS, MOST_BALLS = 16, 256
#: Vectors that the balls' centres are found from, at most, and numbers that these hold, at most.
SAMPLE, SAMPLE_NUMBERS = 4096, 2_000_000
LEAF = 256
SEED = 7
LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Inner products up to here are exact as doubles; up to the other they fit 64 bits.
EXACT, LARGEST = 2.0**52, 2.0**62


class BallTree:
    """Points split at the median along the direction of two far points; each node has a centre, a radius and a smallest id.

    Points come in order of their ids. Of equal points only the ``k + 1`` of
    smallest ids stay: no others can be among a query's k best.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF):
        self.points, self.ids, self.k, self.leaf = points, ids, k, leaf
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        x = self.points[rows]
        centre = x.mean(axis=0)
        distance = ((x - centre) ** 2).sum(axis=1)
        me = len(self.nodes)
        self.nodes.append(())
        children = None
        radius = float(np.sqrt(distance.max()))
        if (x == x[0]).all():
            centre, radius, rows = x[0], 0.0, rows[: self.k + 1]
        elif len(rows) > self.leaf:
            far = x[distance.argmax()]
            other = x[((x - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(x @ (other - far), kind="stable")
            half = len(rows) // 2
            children = (self._build(np.sort(rows[order[:half]])), self._build(np.sort(rows[order[half:]])))
        self.nodes[me] = (centre, radius, children, rows, self.ids[rows[0]])
        return me


def reach(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """No point of the ball has a larger inner product; a little is added for rounding, and what results is whole."""
    most = queries @ centre + norms * radius
    most = most + 1e-9 * (1 + np.abs(most) + norms * (radius + math.sqrt(float(centre @ centre))))
    return np.floor(np.minimum(most, 2.0**62))


class Search:
    """The best k so far of a block of queries; what is below the kth, found here or known before, prunes every node."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, whole: bool = False, limit: np.ndarray | None = None, limit_id: np.ndarray | None = None):
        self.queries, self.ids, self.k, self.whole = queries, ids, k, whole
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.scores = np.full((len(queries), k), LOWEST)
        self.found = np.full((len(queries), k), NO_ID)
        self.limit = np.full(len(queries), LOWEST) if limit is None else limit
        self.limit_id = np.full(len(queries), NO_ID) if limit_id is None else limit_id
        self.scored = 0

    def visit(self, tree: BallTree, node: int, q: np.ndarray) -> None:
        centre, radius, children, rows, least = tree.nodes[node]
        most = reach(self.queries[q], self.norms[q], centre, radius)
        # An equal score may win by a smaller id.
        q = q[(most > self.limit[q]) | (most == self.limit[q]) & (least < self.limit_id[q])]
        if not len(q):
            return
        if children:
            bounds = [reach(self.queries[q], self.norms[q], *tree.nodes[c][:2]) for c in children]
            near = bounds[0] >= bounds[1]  # each query goes to the child with the larger bound first
            for first, second, part in ((0, 1, q[near]), (1, 0, q[~near])):
                if len(part):
                    self.visit(tree, children[first], part)
                    self.visit(tree, children[second], part)
            return
        self.scored += len(q) * len(rows)
        points = tree.points[rows]
        if self.whole:
            scores = self.queries[q].astype(np.int64) @ points.astype(np.int64).T
        else:
            scores = (self.queries[q] @ points.T).astype(np.int64)
        names = np.broadcast_to(tree.ids[rows], scores.shape)
        out = (names == self.ids[q][:, None]) | (scores < self.limit[q][:, None])
        some = ~out.all(axis=1)
        if not some.any():
            return
        q = q[some]
        scores, names = np.where(out, LOWEST, scores)[some], np.where(out, NO_ID, names)[some]
        scores, names = np.concatenate([self.scores[q], scores], axis=1), np.concatenate([self.found[q], names], axis=1)
        down = ~scores  # falls as scores rise, and never overflows
        if down.shape[1] > 4 * self.k:  # all that reach the kth score, ties included, then order these
            kth = np.partition(down, self.k - 1, axis=1)[:, self.k - 1]
            most = int((down <= kth[:, None]).sum(axis=1).max())
            if most < down.shape[1]:
                keep = np.argpartition(down, most - 1, axis=1)[:, :most]
                down, scores, names = (np.take_along_axis(x, keep, 1) for x in (down, scores, names))
        order = np.lexsort((names, down), axis=1)[:, : self.k]
        self.scores[q], self.found[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        kth, kth_id = self.scores[q, -1], self.found[q, -1]
        better = (kth_id < NO_ID) & ((kth > self.limit[q]) | (kth == self.limit[q]) & (kth_id < self.limit_id[q]))
        self.limit[q[better]], self.limit_id[q[better]] = kth[better], kth_id[better]

    def rows(self) -> pd.DataFrame:
        q, at = np.nonzero(self.found < NO_ID)
        return pd.DataFrame({"query_id": self.ids[q], "vec_id": self.found[q, at], "score": self.scores[q, at]})


def integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component; vectors that are null, or hold null, nan or infinity, are left out."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    return vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))


def matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype="float64").reshape(len(v), -1)


def centres_of(points: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Up to n centres of different points by Lloyd's rounds."""
    different = np.unique(points, axis=0)
    rng = np.random.default_rng(SEED)
    centres = different[rng.permutation(len(different))[:n]]
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (points @ centres.T), axis=1)


@dataclass
class Ball:
    size: int  #: length of its vectors
    number: int
    centre: np.ndarray
    radius: float
    shards: int


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k highest integer inner products over all rows but its own: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and v (array of long). Ties go to the smaller
    vec_id; a query with fewer candidates gets them all. A row is known by its
    vec_id: rows that repeat one are no candidates of each other, and a
    repeated query is answered once, by its smallest vector. Vectors meet only
    others of their length; an empty table gives no rows. Scores are exact: up
    to 2 ** 52 by doubles, beyond by 64-bit integers; where the largest norms
    allow products beyond 2 ** 62 an OverflowError is raised, not a wrapped
    score. Other columns are not looked at.

    Vectors go to the nearest of at most MOST_BALLS centres, which are found
    from a sample of at most SAMPLE rows and only say where rows are searched:
    every row is in a ball, whose radius is that of its farthest row. A ball is
    cut by hash into shards of about ``shard_rows``, so a ball of many equal
    vectors is many tasks, and a task has one shard and at most about
    ``query_block`` queries. Each query first searches the shards of the ball
    whose centre has the largest inner product with it. Its kth score then
    decides which other balls it is sent to at all, and prunes the trees there
    from the start, beside the kth scores found on the way.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "v", F.size("v").alias("size"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    n = rows.count()
    per_shard = min(shard_rows, max(256, -(-n // FEWEST_BALLS)))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "v").select("v", "size")
    widest = rows.agg(F.max("size")).first()[0] or 1
    sample = sample.limit(max(MOST_BALLS, min(SAMPLE, SAMPLE_NUMBERS // max(widest, 1)))).toPandas()
    balls_wanted = max(1, min(MOST_BALLS, max(FEWEST_BALLS, -(-n // shard_rows))))
    centres = {int(size): centres_of(matrix(part["v"]), balls_wanted) for size, part in sample.groupby("size") if size > 0}
    shared = spark.sparkContext.broadcast(centres)  # MOST_BALLS vectors of each length that the sample has

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                points = matrix(part["v"])
                own = shared.value.get(int(size), np.zeros((1, points.shape[1])))
                ball = nearest(points, own) if points.shape[1] else np.zeros(len(part), int)
                apart = np.sqrt(((points - own[ball]) ** 2).sum(axis=1)) if points.shape[1] else np.zeros(len(part))
                yield part.assign(ball=ball.astype("int32"), apart=apart, norm=(points**2).sum(axis=1))

    dealt = checkpointed(rows.mapInPandas(deal, "vec_id long, v array<long>, size int, asked boolean, ball int, apart double, norm double"))
    # A row for each ball of each length; lengths are no more than the longest vector's.
    found = dealt.groupBy("size", "ball").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.max("norm").alias("norm")).collect()
    largest = max((r["norm"] for r in found), default=0.0)
    if largest >= LARGEST:
        raise OverflowError("inner products of these vectors may not fit 64 bits")
    whole = largest >= EXACT
    balls = [Ball(r["size"], r["ball"], centres.get(r["size"], np.zeros((1, r["size"])))[r["ball"]], r["radius"] * (1 + 1e-9), -(-r["n"] // per_shard)) for r in found]
    known = spark.sparkContext.broadcast(balls)
    asked = dealt.where("asked").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("size", F.col("v").alias("q"))).alias("_q")).select("query_id", "_q.size", "_q.q")
    asked = checkpointed(asked)
    blocks = max(1, -(-asked.count() // query_block))

    def route(home: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for size, part in batch.groupby("size"):
                    own = [b for b in known.value if b.size == size]
                    q = matrix(part["q"])
                    norms = np.sqrt((q**2).sum(axis=1))
                    first = np.argmax(q @ np.array([b.centre for b in own]).T, axis=1) if size else np.zeros(len(part), int)
                    for i, b in enumerate(own):
                        here = first == i
                        if not home:
                            here = ~here & (reach(q, norms, b.centre, b.radius) >= part["kth"].to_numpy(np.int64))
                        chosen = part[here]
                        for shard in range(b.shards if len(chosen) else 0):
                            yield chosen.assign(ball=np.int32(b.number), shard=np.int32(shard))

        return run

    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        points = points.sort_values("vec_id", kind="stable")
        search = Search(matrix(queries["q"]), queries["query_id"].to_numpy(np.int64), k, whole, queries["kth"].to_numpy(np.int64).copy(), queries["kth_id"].to_numpy(np.int64).copy())
        tree = BallTree(matrix(points["v"]), points["vec_id"].to_numpy(np.int64), k)
        search.visit(tree, tree.root, np.arange(len(queries)))
        return search.rows()

    sent = "query_id long, size int, q array<long>, kth long, kth_id long, ball int, shard int"
    cut = [x for b in balls if b.shards > 1 for x in (F.lit(f"{b.size} {b.number}"), F.lit(b.shards))]
    shards = F.coalesce(F.try_element_at(F.create_map(*cut), F.concat_ws(" ", "size", "ball")), F.lit(1)) if cut else F.lit(1)
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), shards).cast("int")
    points = dealt.select("vec_id", "v", "size", "ball", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["size", "ball", "shard", "block"]
    block = F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    out = "query_id long, vec_id long, score long"

    def searched(queries: DataFrame, home: bool) -> DataFrame:
        routed = queries.mapInPandas(route(home), sent).select("*", block)
        return routed.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(search, out)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unknown = asked.select("*", F.lit(int(LOWEST)).alias("kth"), F.lit(int(NO_ID)).alias("kth_id"))
    started = searched(unknown, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    started = checkpointed(started)
    kth = started.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth_score"), F.col("vec_id").alias("at"))
    bounded = asked.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "size", "q", F.coalesce("kth_score", F.lit(int(LOWEST))).alias("kth"), F.coalesce("at", F.lit(int(NO_ID))).alias("kth_id"))
    ranked = started.drop("rank").unionByName(searched(bounded, False)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
