"""I-Match fingerprints with randomised lexicons."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: A term is in the lexicon if it is in this share of the documents. The sum
#: of all shares is the mean number of distinct terms of a document, so the
#: lexicon has at most that mean / LOW terms, however many documents there are.
LOW, HIGH = 0.01, 0.3
#: Lexicons drawn. Each is thinned by halves, the terms nearest to its seed staying longest.
LEXICONS = 32
SEEDS = [random.Random(f"lexicon {k}").getrandbits(64) - 2**63 for k in range(LEXICONS)]
DIGITS = 8
NONE = "-" * DIGITS


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text, sorted; a term is a run of letters and digits, in lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.sort_array(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms within the band of inverse document frequency, over all documents."""
    found = docs.select(terms(F.col("text")).alias("_terms"))
    n = docs.count()
    counts = found.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return sorted(r["term"] for r in counts.where(F.col("df").between(max(1, low * n), max(1, high * n))).select("term").collect())


def _digits(hashed: Column) -> Column:
    return F.substring(F.lower(F.lpad(F.hex(hashed), 16, "0")), 1, DIGITS)


def _thinned(found: Column, seed: int) -> Column:
    """Hash of the terms in the thinnest subset that has any: those that differ from the seed no sooner than the nearest does."""
    apart = lambda t: F.shiftrightunsigned(t.bitwiseXOR(F.lit(seed).cast("long")), 1)
    limit = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - F.length(F.bin(F.array_min(F.transform(found, apart)))))
    # An array of one keeps the limit from being made again for each term.
    return F.element_at(F.transform(F.array(limit), lambda most: _digits(F.xxhash64(F.filter(found, lambda t: apart(t) <= most)))), 1)


def with_fingerprint(df: DataFrame, text: str, lexicon_terms: list[int], out: str) -> DataFrame:
    """Adds ``out``: the hash of all lexicon terms of ``text``, then one hash for each randomised lexicon, DIGITS hex digits each.

    A randomised lexicon is thinned again and again: a term is in its b-th
    subset if the first b bits of its hash are those of the lexicon's seed. The
    hash is of the terms of the text in the thinnest subset that has any. Most
    often that is one term, so two texts agree in about as many lexicons as
    their shared lexicon terms are of all terms of both. A text without lexicon
    terms counts with all its terms, and one without terms has dashes after the
    first place. Equal texts have equal fingerprints; null counts as empty.
    """
    df = df.withColumn("_all", terms(F.col(text)))
    known = ", ".join(f"{t}L" if t != -(2**63) else f"({t + 1}L - 1L)" for t in lexicon_terms)
    df = df.withColumn("_known", F.expr(f"filter(_all, t -> t IN ({known}))") if lexicon_terms else F.slice("_all", 1, 0))
    df = df.withColumn("_in", F.when(F.size("_known") > 0, F.col("_known")).otherwise(F.col("_all")))
    parts = [_digits(F.xxhash64("_in")), *[F.when(F.size("_in") > 0, _thinned(F.col("_in"), seed)).otherwise(NONE) for seed in SEEDS]]
    return df.withColumn(out, F.concat(*parts)).drop("_all", "_known", "_in")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that either fingerprint has; 1.0 for equal fingerprints."""
    place = lambda c, i: F.substring(c, 1 + DIGITS * i, DIGITS)
    n = 1 + LEXICONS
    same = sum((F.when((place(a, i) == place(b, i)) & (place(a, i) != NONE), 1).otherwise(0) for i in range(n)), F.lit(0))
    either = sum((F.when((place(a, i) != NONE) | (place(b, i) != NONE), 1).otherwise(0) for i in range(n)), F.lit(0))
    return same.cast("double") / either


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order of distinct ids, nulls first; after the last comes the first.

    Ids are dealt into ranges and each range looks ahead on its own; only the
    first id of each range, as many as there are partitions, passes through one
    task.
    """
    ranged = ids.select("doc_id").distinct().repartitionByRange(F.col("doc_id").asc_nulls_first())
    ranged = checkpointed(ranged.withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("_first"))
    everything = Window.partitionBy(F.lit(0)).orderBy("_range")
    after = F.lead("_first").over(everything)
    firsts = firsts.select("_range", F.coalesce(after, F.first("_first").over(everything))["doc_id"].alias("_after"))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first())
    inside = ranged.withColumn("_rest", F.lead(F.struct("doc_id")).over(order))
    return inside.join(F.broadcast(firsts), "_range").select("doc_id", F.when(F.col("_rest").isNotNull(), F.col("_rest")["doc_id"]).otherwise(F.col("_after")).alias("next_id"))


def fingerprint_edits(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every document, of the document with its last quarter replaced, and their likeness.

    ``docs`` needs doc_id and text; null texts count as empty. The edited text
    is the text without its last quarter of code points, then as many from the
    start of the next document, by ascending doc_id, the first coming after the
    last. Rows that repeat a doc_id are all kept; as next document such an id
    stands for its row of the smallest text hash. An empty table gives no rows.

    Texts are shuffled once, by doc_id; a next document sends only as much of
    its start as the edit needs.
    """
    known = lexicon(docs, low, high)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    own = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), text)
    # These four columns are all that either join reads, so both read one shuffle.
    own = with_fingerprint(own, "text", known, "fingerprint")
    next_of = successors(docs)
    # The quarter of a document is what the longest row of its id needs.
    need = docs.groupBy("doc_id").agg(F.max(F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4)).cast("int").alias("_need"))
    wanted = next_of.join(need, next_of["doc_id"].eqNullSafe(need["doc_id"])).select(F.col("next_id"), next_of["doc_id"].alias("_for"), "_need")
    wanted = wanted.select(F.coalesce("next_id", F.lit(0)).alias("_id"), F.col("next_id").isNull().alias("_null"), F.coalesce("_for", F.lit(0)).alias("_for"), F.col("_for").isNull().alias("_for_null"), "_need")
    start = own.join(wanted, ["_id", "_null"]).select("_for", "_for_null", F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, _need)").alias("start"), F.col("fingerprint").alias("fp")).alias("_next"))
    start = start.groupBy(F.col("_for").alias("_id"), F.col("_for_null").alias("_null")).agg(F.min("_next").alias("_next"))
    both = own.join(start, ["_id", "_null"]).withColumn("doc_id", F.when(~F.col("_null"), F.col("_id"))).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("_quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars) - _quarter), substring(_next.start, 1, _quarter))"))
    both = with_fingerprint(both.withColumn("_next_fp", F.col("_next")["fp"]).drop("_next", "text"), "edited", known, "edited_fingerprint")
    return both.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_fp")).alias("near_next"))
