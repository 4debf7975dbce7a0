"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, literal_rows, map_in_arrow

MAX_TOKENS = 2048
END_ID = 1
#: Words whose ids a Python worker keeps; beyond them ids are computed anew each time.
CACHED_WORDS = 400_000
BUCKETS = 1024

#: Text in which lower(), NFC and white space mean the same to Python and to the tokenizer.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xc0-\\u012f\\u0131-\\u017e]*")
WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


#: How the tokenizer normalises and splits that the word-by-word way below stands for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer's description is one that Encoder may read word by word."""
    normal, split, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = split.get("pretokenizers") or [{}, {}]
    return (
        normal.get("normalizers") == NORMALIZERS
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": SPLIT}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and (steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == (False, False)
        and (model.get("type"), model.get("dropout")) == ("BPE", None)
        and all(x["content"].startswith("<|") for x in spec.get("added_tokens") or [])
        and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
    )


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode``.

    A tokenizer of the form that ``by_words`` knows never joins across white
    space, so in plain Latin text each word's ids are looked up, or found once
    by the tokenizer's own model. Any other text, and every text of another
    tokenizer, goes through ``encode`` as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self.by_words or "<|" in text or not PLAIN.fullmatch(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join(x.to_bytes(4, "little") for x in ids)
        known = self.words
        words = text.lower().split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self._word(w) for w in words])

    def _word(self, word: str) -> bytes:
        found = b"".join([self.parts[p] if p in self.parts else self._part(p) for p in WORD_PARTS.findall(word)])
        if len(self.words) < CACHED_WORDS:
            self.words[word] = found
        return found

    def _part(self, part: str) -> bytes:
        letters = "".join([self.letters[b] for b in unicodedata.normalize("NFC", part).encode()])
        found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if len(self.parts) < CACHED_WORDS:
            self.parts[part] = found
        return found


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One per Python worker and file; ``tokenizer`` is a path, or a name that public_tokenizers knows."""
    if tokenizer not in _encoders:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _encoders[tokenizer] = Encoder(path)
    return _encoders[tokenizer]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with ``end_id`` after them, cut into pieces of at most ``max_tokens``."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                view = memoryview(ids)
                for start in range(0, n, max_tokens):
                    length = min(max_tokens, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_in_arrow(narrow, cut, PIECES)


def patterns(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (count, lengths) for every packing pattern.

    Lengths go longest first. All packs of one pattern are handled together:
    the open pattern with most space left takes as many of the length as it has
    packs. When none has room, as many packs open as the tokens still to be
    placed will fill beyond the space that is open, but enough for what remains
    and one for each at most. So a length stacks with itself where shorter ones
    can't fill packs of their own.
    """
    open_at: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    full: list[tuple[int, list[int]]] = []
    most = free = 0
    rest = sum(length * n for length, n in histogram.items())

    def put(count: int, pattern: list[int], space: int) -> None:
        nonlocal most, free
        free += count * space
        if space:
            open_at[space].append((count, pattern))
            most = max(most, space)
        else:
            full.append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not open_at[most]:
                most -= 1
            if most < length:
                pattern, space = [], max_tokens
                used = min(left, max(-(-left // (max_tokens // length)), -(-(rest - free) // max_tokens)))
            else:
                space = most
                count, pattern = open_at[space].pop()
                used = min(count, left)
                if used < count:
                    open_at[space].append((count - used, pattern))
                free -= used * space
            put(used, [*pattern, length], space - length)
            left -= used
            rest -= used * length
    return full + [x for space in sorted(open_at) for x in open_at[space]]


def slots(found: list[tuple[int, list[int]]]) -> list[dict]:
    """For each pattern and length: which ranks of the length it takes, from which of how many packs on, and where; the ranks go round the packs."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for count, pattern in found:
        offset = 0
        for length, same in groupby(pattern):
            stacked = len(list(same))
            rows.append({"length": length, "low": taken[length], "high": taken[length] + count * stacked, "first": first, "packs": count, "offset": offset})
            taken[length] += count * stacked
            offset += length * stacked
        first += count
    return rows


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pack documents into sequences of at most ``max_tokens`` ids.

    ``docs`` needs doc_id and text; other columns are not looked at. Returns a
    row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is a document of one id, the end
    id; a long one is cut into full sequences and a remainder. Repeated rows
    and repeated or null ids are packed as documents of their own, and an empty
    table gives no rows.

    Only the histogram of lengths, at most ``max_tokens`` numbers, reaches the
    driver. Pieces find their pattern by their rank within their length; ranks
    are counted within hashed buckets, so no length is one task.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, max_tokens, end_id).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)))
    cut = checkpointed(cut)
    counts = checkpointed(cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = slots(patterns(histogram, max_tokens))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # A length ends at most one pattern and splits at most one, so there are at most 2 * max_tokens patterns; the different
    # lengths of one add up to max_tokens, so they are under sqrt(2 * max_tokens): 262,144 rows of six numbers for 2048, whatever the input.
    if len(rows) > 2 * max_tokens * math.isqrt(2 * max_tokens):
        raise AssertionError("more intervals than patterns can have")
    where = F.broadcast(literal_rows(spark, rows, "length long, low long, high long, first long, packs long, offset long"))
    placed = ranked.join(where, (ranked["length"] == where["length"]) & (ranked["_rank"] >= where["low"]) & (ranked["_rank"] < where["high"]))
    at = F.col("_rank") - F.col("low")
    sequence = F.col("first") + at % F.col("packs")
    offset = F.col("offset") + ranked["length"] * F.floor(at / F.col("packs"))
    return placed.select("doc_id", "start", ranked["length"].alias("length"), "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))
