"""The thin queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, mixing, ngram_join, packing, pii, quality, secrets, sharding, topk
from .common import crc32_text, table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document's whole text and of its edited text, and how like they are. Null texts count as empty, repeated rows stay, an empty table gives no rows."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels that are not held out. Null and empty texts have the score of no n-grams; a null doc_id is not held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "text"), quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048, a row for each piece. Null and empty texts are one end token; repeated rows are packed each for itself."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. Null and empty texts have none; a null source is the last one; repeated rows are mixed each for itself."""
    mixed = mixing.mix(table(spark, sf_dir, "documents")).documents
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate of a secret: where it starts, how long it is, a digest of its value and what the forest says. Texts without candidates, null and empty ones too, give no rows."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = found.select("doc_id", F.explode("findings").alias("f"))
    hidden = F.sha2(F.encode("f.value", "UTF-8"), 256).alias("value_sha256")
    return each.select("doc_id", "f.start", F.length("f.found").alias("length"), F.substring("f.value", 1, 4).alias("first_chars"), hidden, F.round("f.probability", 6).alias("probability"), "f.is_secret")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document under the law of equal row counts. Null texts have size 1; repeated rows, null and equal ids are dealt each for itself."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), crc32_text(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = sharding.shard(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20. Null or unsound vectors take no part; an empty table gives no rows."""
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op8_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies, links and group of every document. Null and empty texts are equal to each other only; repeated rows are copies."""
    named = ngram_join.near_classes(table(spark, sf_dir, "documents"))
    return named.select("doc_id", "class_id", "copies", "n_links", "group_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from every formatted conversation, and from one that is made of control strings. Null texts and roles are empty, turns go by number, nulls first; an empty table leaves that one."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), said.alias("text"))
    return chat.digest(chat.format_chat(talks.unionByName(own)))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under keyed pseudonyms, and how many there were. The key is the session's, or a random one. Null texts stay null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return pii.pseudonymise(docs, pii.session_key(spark))


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprint": op1_fingerprint, "op10_pseudonyms": op10_pseudonyms, "op2_quality": op2_quality, "op3_pack": op3_pack, "op4_mix": op4_mix, "op5_secrets": op5_secrets, "op6_shard": op6_shard, "op7_search": op7_search, "op8_near_classes": op8_near_classes, "op9_chat": op9_chat}


def oracle_sql() -> dict[str, str]:
    return {"op7_search": OP7_SQL}
