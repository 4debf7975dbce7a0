"""Mixing sources to target weights from fixed-length blocks of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, keyed_permutation

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and uses of a source's words at most.
SHARE, EPOCHS = 1.5, 2
BLOCK_WORDS = 256
SHARD_BLOCKS = 4096
BINS = 4096
BUCKETS = 2048
#: Slots that are written from one row, and by one task.
SPAN, TASK_SLOTS = 256, 262_144
SEED = 20


@dataclass
class Mix:
    documents: DataFrame  #: doc_id, source, size, source_size, target, taken, _source, _start, _text, and _copy of _copies rows that are equal in doc_id, source and text
    pieces: DataFrame  #: _source, _start, block, word_from, words, uses: what each document has in each block
    slots: DataFrame  #: shard, _source, epoch, block: what each output shard holds


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds _source (rank by code point, null last) and target to a table of (source, source_size).

    Words are dealt by weight; a source stops at ``epochs`` times its size and
    the excess is dealt again by weight until none is above. In order of
    limit / weight, the final level is the largest of the levels that result
    when the sources before each one are at their limits. The table has one
    row for each source, so its windows are over sources, not over documents.
    """
    everything = Window.partitionBy(F.lit(0))
    numbered = sizes.withColumn("_source", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_source") % len(weights) + 1).cast("int"))
    weighed = numbered.withColumn("_weight", weight).withColumn("_limit", F.lit(float(epochs)) * F.col("source_size"))
    upward = everything.orderBy(F.col("_limit") / F.col("_weight"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(share) * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("_limit").over(upward), F.lit(0.0))
    rest = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(upward), F.lit(0.0))
    levelled = weighed.withColumn("_level", (total - before) / rest)
    return levelled.withColumn("target", F.least("_limit", F.max("_level").over(everything) * F.col("_weight"))).select("source", "_source", "source_size", "target")


def unit(*key: Column) -> Column:
    """Pseudorandom double from 0 to under 1."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(2**53))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mix:
    """Mix the words of ``docs`` (doc_id, source, text) to target weights.

    Each source's documents, in a hashed order, are one stream of words cut
    into blocks of ``block_words``. A shard of the output has SHARD_BLOCKS
    slots; its counts by source are a multinomial draw. Draws beyond a source's
    quota are void, and a last shard settles what the draws left open, so each
    source's words come within a block or so of its target. The slots of a
    source are numbered over the shards, and a keyed permutation of the
    source's blocks for each epoch maps numbers to blocks: no block is used
    again before all have been used.

    A null or empty text has size 0 and is in no block. A null source is a
    source of its own, the last. Repeated rows are documents of their own.
    Everything is drawn by hashing, so reruns agree.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_text"))
    narrow = narrow.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_text", F.lit(seed)), F.lit(BUCKETS)))
    narrow = checkpointed(narrow)
    counts = checkpointed(narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")))
    sources = targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share)
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), blocks * EPOCHS)).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("_blocks", blocks).withColumn("_quota", quota)
    below = Window.partitionBy(F.lit(0)).orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)
    sources = checkpointed(sources.withColumn("_low", F.coalesce(F.sum("_quota").over(below), F.lit(0)).cast("long")))
    n = sources.agg(F.sum("_quota")).first()[0] or 0

    # Start of each document in its source's stream: sums of buckets, then of rows within a bucket.
    before = counts.withColumn("_before", F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_words"))
    before = before.join(sources, before["source"].eqNullSafe(sources["source"])).select("_source", "source_size", "target", "_before", before["source"].alias("_name"), F.col("_bucket").alias("_b"))
    within = Window.partitionBy("source", "_bucket").orderBy("doc_id", "_text", "size").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("source", "_bucket", "doc_id", "_text").orderBy("size")
    copies = F.count("*").over(Window.partitionBy("source", "_bucket", "doc_id", "_text"))
    placed = narrow.withColumn("_copy", F.row_number().over(alike)).withColumn("_copies", copies).withColumn("_within", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(before, placed["source"].eqNullSafe(before["_name"]) & (placed["_bucket"] == before["_b"]))
    placed = placed.select("doc_id", "source", "size", "_source", "source_size", "target", (F.col("_before") + F.col("_within")).alias("_start"), "_text", "_copy", "_copies")

    # Each slot draws a source by its quota; equal bins of the unit interval make the search an equi-join.
    drawn = spark.range(n).select(F.floor(F.col("id") / SHARD_BLOCKS).alias("shard"), F.floor(unit(F.lit(seed), F.lit(1), F.col("id")) * F.lit(float(n))).cast("long").alias("_at"))
    width = max(1, -(-n // BINS))
    spans = sources.where("_quota > 0").select("_source", "_blocks", "_quota", "_low", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_low") + F.col("_quota") - 1) / width))).alias("_bin"))
    drawn = drawn.withColumn("_bin", F.floor(F.col("_at") / width)).join(spans, "_bin").where((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_low") + F.col("_quota")))
    shares = drawn.groupBy("_source", "shard").agg(F.count("*").alias("_n"), F.first("_blocks").alias("_blocks"), F.first("_quota").alias("_quota"))
    shares = shares.withColumn("_first", F.sum("_n").over(Window.partitionBy("_source").orderBy("shard")) - F.col("_n"))
    shares = shares.select("_source", "shard", "_blocks", "_quota", "_first", F.least(F.col("_first") + F.col("_n"), F.col("_quota")).alias("_end"))
    shares = checkpointed(shares.where(F.col("_first") < F.col("_end")))
    met = shares.groupBy(F.col("_source").alias("_s")).agg(F.max("_end").alias("_met"))
    settled = sources.join(met, sources["_source"] == met["_s"], "left").select("_source", F.lit(-(-n // SHARD_BLOCKS)).cast("long").alias("shard"), "_blocks", "_quota", F.coalesce("_met", F.lit(0)).cast("long").alias("_first"), F.col("_quota").alias("_end"))
    every = shares.unionByName(settled.where(F.col("_first") < F.col("_end")))
    # Few rows stand for many slots: they are cut into spans, which are dealt out before the slots are written and permuted.
    span = F.lit(SPAN).cast("long")
    spans = every.select("shard", "_source", "_blocks", "_end", F.explode(F.sequence("_first", F.col("_end") - 1, span)).alias("_from"))
    spans = spans.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_SLOTS)), "_source", "_from")
    numbered = spans.select("shard", "_source", "_blocks", F.explode(F.sequence("_from", F.least(F.col("_from") + span, "_end") - 1)).alias("_number"))
    epoch = F.floor(F.col("_number") / F.col("_blocks"))
    block = keyed_permutation(F.pmod("_number", "_blocks"), F.col("_blocks"), F.lit(seed), F.lit(2), F.col("_source"), epoch)
    slots = numbered.select("shard", "_source", epoch.alias("epoch"), block.alias("block"))

    full = placed.where("size > 0")
    last = F.floor((F.col("_start") + F.col("size") - 1) / block_words)
    cut = full.select("doc_id", "_source", "_start", "size", F.explode(F.sequence(F.floor(F.col("_start") / block_words), last)).alias("block"))
    low = F.greatest(F.col("block") * block_words, F.col("_start"))
    high = F.least((F.col("block") + 1) * block_words, F.col("_start") + F.col("size"))
    cut = cut.select("_source", "_start", "block", (low - F.col("_start")).alias("word_from"), (high - low).alias("words"))
    uses = slots.groupBy("_source", "block").agg(F.count("*").alias("uses"))
    found = cut.join(uses, ["_source", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    # A document that has words starts at a place of its own in its source's stream.
    taken = found.groupBy("_source", "_start").agg(F.sum(F.col("uses") * F.col("words")).alias("taken"))
    documents = full.join(taken, ["_source", "_start"]).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return Mix(documents.select("doc_id", "source", "size", "source_size", "target", "taken", "_source", "_start", "_text", "_copy", "_copies"), found, slots)


def mixed_documents(docs: DataFrame, mixed: Mix) -> DataFrame:
    """``docs`` with the texts that the mix takes: a row for each document with words in it, its columns as they were.

    The text has the words of all blocks that are used, in order, and after a
    newline those of the blocks that are used twice. White space after a word
    stays with it. Texts are shuffled once; rows that are equal in doc_id,
    source and text are told apart by number, each with its own share. Null
    and empty texts have no words and go; an empty table gives no rows, and a
    text of any length is cut as a whole. Columns may have any names.
    """
    def key(doc_id: str, text: Column, source: str) -> Column:
        parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text.cast("string"), F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source)))]
        return F.concat_ws("|", *parts)

    each = mixed.pieces.where("uses > 0").groupBy("_source", "_start").agg(F.sort_array(F.collect_list(F.struct("word_from", "words", "uses"))).alias("pieces"))
    each = mixed.documents.where("taken > 0").join(each.hint("merge"), ["_source", "_start"], "left")
    each = each.select(key("doc_id", F.col("_text"), "source").alias("of"), F.col("_copy").alias("copy"), F.col("_copies").alias("copies"), "pieces")
    rows = docs.select(F.struct("*").alias("row"), key("doc_id", F.xxhash64("text"), "source").alias("key"))
    # Merged, not broadcast: what the mix takes grows with the documents, and would pass through the driver.
    single = rows.join(each.where("copies = 1").hint("merge"), F.col("key") == F.col("of")).select("row", "pieces")
    # Rows that repeat read the same shuffle of texts, and only they are numbered.
    repeated = each.where("copies > 1")
    again = rows.join(repeated.groupBy(F.col("of").alias("repeated")).agg(F.max("copies")).select("repeated"), F.col("key") == F.col("repeated"))
    again = again.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    again = again.join(repeated, (F.col("key") == F.col("of")) & (F.col("number") == F.col("copy"))).select("row", "pieces")
    joined = single.unionByName(again).withColumn("words", F.regexp_extract_all("row.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))

    def used(times: int) -> Column:
        parts = F.filter("pieces", lambda p: p["uses"] >= times)
        return F.array_join(F.transform(parts, lambda p: F.array_join(F.slice("words", (p["word_from"] + 1).cast("int"), p["words"].cast("int")), "")), "")

    again = F.when(F.exists("pieces", lambda p: p["uses"] > 1), F.concat(F.lit("\n"), used(2))).otherwise("")
    text = F.concat(used(1), again)
    return joined.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
