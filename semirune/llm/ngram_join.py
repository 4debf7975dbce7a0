"""Similarity join of documents by the Jaccard index of their word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_in_arrow
from .graph import components, join_groups

N_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Hashes of a signature, where the recall can be had with as many.
HASHES = 144
#: Documents of one side of a verification task.
BLOCK = 512
#: A candidate component of more blocks than this is compared band by band.
MOST_BLOCKS = 24
#: Words that a kernel's arrays hold at once, or one document.
WORDS_AT_ONCE = 250_000
SEED = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """The most rows a band may have so that few enough bands find a pair at ``threshold`` with probability ``recall``.

    Where not even bands of one row do with ``most`` hashes, there are as many bands of one as the recall takes.
    """
    need = lambda rows: math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
    best = (need(1), 1)
    for rows in range(2, most + 1):
        if need(rows) * rows <= most:
            best = (need(rows), rows)
    return best


def word_hashes(text: Column) -> Column:
    """Hash of each word; a word is a run of letters, digits and underscores, in lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(words: pa.ListArray, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, document after document, and how many each has; a shorter document is one run."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.asarray(words.value_lengths().fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    if not len(flat):
        return np.zeros(0, np.uint64), counts
    padded = np.concatenate([flat, np.zeros(n, np.uint64)])
    at = np.arange(len(flat))
    own_end = np.repeat(ends, lengths)
    h = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            inside = at + j < own_end
            h = h * _MULTIPLIER + np.where(inside, padded[j : len(flat) + j], np.uint64(j + 1))
        h = _mixed(h)
    starts = np.repeat(ends - lengths, lengths)
    return h[(at + n <= own_end) | (at == starts) & (own_end - starts < n)], counts


def slices(batch: pa.RecordBatch, most: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most ``most`` ``words``, or of one document."""
    ends = np.cumsum(np.asarray(batch.column("words").value_lengths().fill_null(0), dtype=np.int64))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def signatures(hashed: np.ndarray, counts: np.ndarray, bands: int, rows: int, seed: int = SEED) -> np.ndarray:
    """A hash for each band of each document with shingles: of ``rows`` minima under random maps."""
    rng = np.random.default_rng(seed)
    k = bands * rows
    multiply = (rng.integers(0, 2**32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)
    counts = counts[counts > 0]
    out = np.empty((len(counts), k), np.uint32)
    short = (hashed >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    low = 0
    with np.errstate(over="ignore"):
        while low < len(counts):  # as many documents as fit the processor's cache
            begin = ends[low] - counts[low]
            high = max(low + 1, int(np.searchsorted(ends, begin + 60_000, "right")))
            x = short[begin : ends[high - 1]]
            starts = ends[low:high] - counts[low:high] - begin
            for i in range(k):
                out[low:high, i] = np.minimum.reduceat(x * multiply[i] + add[i], starts)
            low = high
        folded = np.zeros((len(counts), bands), np.uint64)
        for j in range(rows):
            folded = folded * _MULTIPLIER + out[:, j::rows][:, :bands].astype(np.uint64)
        folded = _mixed(folded + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return folded.view(np.int64)


def banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, bands: the text's own hash, and the band hashes (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            hashed, counts = shingles(batch.column("words"))
            sig = signatures(hashed, counts, bands, rows)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), lists], names=["doc_id", "text_key", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), word_hashes(F.col("text")).alias("words"))
    return map_in_arrow(rows_in, run, "doc_id long, text_key string, bands array<long>")


def text_key() -> Column:
    return F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """Replaces ``words`` by ``shingles``, the sorted distinct n-gram hashes."""
    names = [c for c in rows.columns if c != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            hashed, counts = shingles(batch.column("words"))
            parts = np.split(hashed.view(np.int64), np.cumsum(counts)[:-1])
            sets = [np.unique(p) for p in parts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*names, "shingles"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "words")
    return map_in_arrow(rows.select(*names, "words"), run, f"{schema}, shingles array<long>")


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: which sets of ``a`` and ``b`` have a Jaccard index of ``threshold`` or more, counted exactly."""
    flat = np.concatenate([*a, *b])
    lengths = np.array([len(x) for x in (*a, *b)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one document is in no intersection
    keep = shared[term]
    number = np.cumsum(shared) - 1
    term, owner = number[term[keep]], owner[keep]
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    both = np.zeros((len(a), len(b)), np.float64)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        part = slice(*np.searchsorted(term, [low, low + width]))
        block = np.zeros((len(lengths), width), np.float32)
        block[owner[part], term[part] - low] = 1
        both += block[: len(a)] @ block[len(a) :].T
    sizes = lengths[: len(a), None] + lengths[None, len(a) :]
    return both >= threshold * (sizes - both) - 1e-9


def _verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the two blocks of a task, or within one: per text its links' copies and the smallest text it is joined to."""
    group = group.drop_duplicates("node").sort_values("node", kind="stable")
    within = bool((group["low"] == group["high"]).iloc[0])
    mine = group if within else group[group["block"] == group["low"]]
    theirs = group if within else group[group["block"] == group["high"]]
    if not len(mine) or not len(theirs):
        return pd.DataFrame({"node": [], "links": [], "joined": []}, dtype="int64")
    linked = similar(list(mine["shingles"]), list(theirs["shingles"]), threshold)
    if within:
        np.fill_diagonal(linked, False)
    # A pair that meets in several bands counts in the first of them.
    for j in range(int(group["band"].iloc[0])):
        linked &= np.array([x[j] for x in mine["bands"]])[:, None] != np.array([x[j] for x in theirs["bands"]])[None, :]
    nodes = group["node"].to_numpy()
    at, to = np.searchsorted(nodes, mine["node"]), np.searchsorted(nodes, theirs["node"])
    links = np.zeros(len(nodes), np.int64)
    links[at] += linked @ theirs["copies"].to_numpy()
    if not within:
        links[to] += linked.T @ mine["copies"].to_numpy()
    # The components of this task: labels are places in the order of nodes.
    label = np.arange(len(nodes))
    i, j = np.nonzero(linked)
    rows, cols = at[i], to[j]
    while len(rows):
        before = label.copy()
        low = np.minimum(label[rows], label[cols])
        np.minimum.at(label, rows, low)
        np.minimum.at(label, cols, low)
        label = label[label]
        if (label == before).all():
            break
    some = links > 0
    return pd.DataFrame({"node": nodes[some], "links": links[some], "joined": nodes[label][some]})


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each task that a text is in: each two blocks of what ``task`` names."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("other", other).select("node", "task", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "band", "bands", "copies", "shingles")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, text_key, class_id, copies, n_links, group_id, component for every row of ``docs`` (doc_id, text).

    Rows of equal text are a class (class_id: the smallest doc_id; copies: how
    many rows). Classes are linked where their sets of five-word runs have a
    Jaccard index of ``threshold`` or more. n_links counts the other rows a row
    is linked to, copies of its own text included; group_id is the smallest
    doc_id that can be reached over links. Groups may share it, or have none:
    what tells them apart is component, a number.

    Bands and rows are chosen for ``recall`` at the threshold. Band hashes are
    shuffled without the texts; texts that meet in a band hash, directly or
    over others, are a candidate component. Each text of one is then sent once,
    with its full n-gram set, to the task that compares the component; a large
    component is split into blocks and each two blocks are a task. So no task
    outgrows 2 * ``block`` texts, pairs are never written as rows, and no link
    within a component is missed. A component of over ``most_blocks`` blocks,
    as chance chains make in a large corpus, is compared band by band: only
    texts that share a band hash meet, in blocks again, and each pair counts in
    the first band that it shares. So the work is that of the buckets, not of
    the square of the component.

    Null and empty texts, and texts without words, are linked only to equal
    texts; a text of under five words has one run, a long one as many as it
    has words. Null doc_ids are kept and never name a class unless all are
    null. Repeated rows count as copies. Other columns are not looked at, and
    an empty table gives no rows. Groups with many rows are joined by
    broadcasts of theirs alone, so no text, bucket or component is one task.
    """
    bands, rows = bands_and_rows(threshold, recall)
    own = checkpointed(banded(docs, bands, rows))
    n = own.count()
    classes = own.groupBy("text_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # Numbers that are written once stand for the texts from here on: they are short, and no two texts share one.
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    buckets = classes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    hubs = buckets.groupBy(F.col("bucket").alias("of")).agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = components(join_groups(buckets, "bucket", hubs, "of", "n", n * bands).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    met = checkpointed(met)
    sizes = met.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = join_groups(met, "component", sizes, "of", "n", n).drop("of")
    members = members.join(classes, "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), "text")

    def with_sets(some: DataFrame) -> DataFrame:
        both = some.join(texts, (F.col("text_key") == F.col("key")) & F.col("class_id").eqNullSafe(F.col("id")))
        return shingle_sets(both.select("node", "component", "blocks", "copies", "bands", word_hashes(F.col("text")).alias("words")))

    own_block = lambda of: F.pmod(F.xxhash64("node", F.lit(SEED)), F.col(of)).cast("int")
    none = F.lit(None).cast("array<long>")
    narrow = with_sets(members.where(F.col("blocks") <= most_blocks).withColumn("bands", none))
    tasks = _blocks(narrow.withColumn("block", own_block("blocks")).withColumn("band", F.lit(0)).withColumn("task", F.col("component").cast("string")))
    if not members.where(F.col("blocks") > most_blocks).isEmpty():
        wide = checkpointed(with_sets(members.where(F.col("blocks") > most_blocks)))
        each = wide.select("node", F.posexplode("bands").alias("band", "bucket"))
        crowds = each.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        each = join_groups(each, "bucket", crowds, "of", "n", n * bands).select("node", "band", "bucket", "parts")
        met_in = wide.join(each, "node").drop("blocks").withColumnRenamed("parts", "blocks")
        tasks = tasks.unionByName(_blocks(met_in.withColumn("block", own_block("blocks")).withColumn("task", F.concat(F.lit("band "), F.col("bucket").cast("string")))))
    found = tasks.groupBy("task", "low", "high").applyInPandas(lambda g: _verify(g, threshold), "node long, links long, joined long")
    found = checkpointed(found)
    joined = components(found.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "text_key", "class_id", "copies").join(joined, "node", "left").join(links, "node", "left")
    named = checkpointed(named.select("text_key", "class_id", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    least = named.groupBy(F.col("component").alias("of")).agg(F.min("class_id").alias("group_id"), F.count("*").alias("n"))
    named = join_groups(named, "component", least, "of", "n", n)
    named = named.select(F.col("text_key").alias("key"), "class_id", "copies", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "group_id", "component", F.col("copies").alias("n"))
    return join_groups(own.select("doc_id", "text_key"), "text_key", named, "key", "n", n).drop("key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, a null one only if all are; among rows that repeat it, one.

    Texts that are like no other stay, null, empty and very long ones too, with
    all columns, whatever their names. An empty table is empty.
    """
    named = near_classes(docs, threshold, recall)
    best = named.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("group_id", "component").agg(F.min("text_key").alias("kept_key"), F.count("*").alias("repeats"))
    best = checkpointed(best.select(F.col("group_id").alias("kept_id"), "kept_key", "repeats"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    kept = rows.join(best, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    single = kept.where("repeats = 1").select("row.*")
    repeated = kept.where("repeats > 1").dropDuplicates(["kept_id", "kept_key"]).select("row.*")
    return single.unionByName(repeated)
