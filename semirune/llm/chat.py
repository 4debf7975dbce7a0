"""Chat formatting with typed content parts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks turns, placeholders and masks in the output, and what other common templates use.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>")
#: Tokens that an attachment expands to: a fixed number for an image tile, or by length.
IMAGE_TOKENS, AUDIO_TOKENS_PER_SECOND, DOCUMENT_TOKENS_PER_PAGE = 256, 25, 512

# A control string in a text gets a backslash after its first character, and a
# run of backslashes that follows an opening character grows by one; so no
# control string stays, and taking one backslash away brings the text back.
_tails = "|".join(re.escape(c[1:]) for c in sorted(set(CONTROL), key=len, reverse=True))
_escape = re.compile(rf"([<\[])(?=\\*(?:{_tails}))")
_unescape = re.compile(rf"([<\[])\\(?=\\*(?:{_tails}))")
_heads = ("<", "[")


def escape(text: str) -> str:
    return _escape.sub(r"\1\\", text) if any(h in text for h in _heads) else text


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text) if "\\" in text else text


@dataclass
class Formatted:
    """What the visitor has written so far: pieces of text, the loss mask, attachments and token counts."""

    out: list[str] = field(default_factory=list)
    chars: int = 0
    mask: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0

    def write(self, text: str, learned: bool = False) -> None:
        if learned and text:
            self.mask.append((self.chars, self.chars + len(text)))
        self.out.append(text)
        self.chars += len(text)


class Flatten:
    """Visits typed parts in order; each kind of part has a method of its own."""

    def __init__(self, to: Formatted):
        self.to = to

    def visit(self, part: dict, learned: bool) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part, learned)

    def visit_text(self, part: dict, learned: bool) -> None:
        self.to.write(escape(part.get("text") or ""), learned)

    def visit_image(self, part: dict, learned: bool) -> None:
        self.attach("image", part, IMAGE_TOKENS * max(1, int(part.get("amount") or 1)))

    def visit_audio(self, part: dict, learned: bool) -> None:
        self.attach("audio", part, round(AUDIO_TOKENS_PER_SECOND * float(part.get("amount") or 0)))

    def visit_document(self, part: dict, learned: bool) -> None:
        self.attach("document", part, DOCUMENT_TOKENS_PER_PAGE * max(1, int(part.get("amount") or 1)))

    def visit_unknown(self, part: dict, learned: bool) -> None:
        raise ValueError(f"no content part is of type {part['type']!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.to.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.to.chars, "tokens": tokens})
        self.to.expanded_tokens += tokens
        self.to.write(PLACEHOLDERS[kind])


def joined(parts: list[dict]) -> list[dict]:
    """Neighbouring texts as one part, so that no control string can form where they meet."""
    out: list[dict] = []
    for part in parts:
        if out and (part.get("type") or "text") == "text" == out[-1]["type"]:
            out[-1]["text"] += part.get("text") or ""
        else:
            out.append({**part, "type": part.get("type") or "text"} | ({"text": part.get("text") or ""} if (part.get("type") or "text") == "text" else {}))
    return out


def format_turns(turns: list[tuple[str | None, list[dict]]]) -> Formatted:
    """(role, parts) of each turn; assistant text is under the loss mask, its placeholders and marks are not."""
    done = Formatted()
    visitor = Flatten(done)
    for role, parts in turns:
        done.write(f"{TURN}{escape(role or '')}{BODY}")
        for part in joined(parts):
            visitor.visit(part, role == "assistant")
        done.write(END)
    return done


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; placeholders stay in the text."""
    turns = []
    for turn in formatted.split(TURN)[1:]:
        role, _, body = turn.partition(BODY)
        turns.append((unescape(role), unescape(body[: -len(END)])))
    return turns


def read_mask(formatted: str, mask: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in mask)


FORMATTED = "conv_id long, formatted string, mask array<struct<low:long,high:long>>, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, expanded_tokens long"
PART = "struct<type:string,text:string,ref:string,amount:double>"


def format_chat(conversations: DataFrame) -> DataFrame:
    """Format conversations (conv_id, turn, role, text or parts): a row for each conversation.

    ``parts``, if there, is an array of (type, text, ref, amount) with type
    text, image, audio or document; amount is tiles, seconds or pages. A plain
    text is one text part, and a null one an empty part. Turns go by turn, nulls
    first; equal turns go by role, then content. A null role is written as an
    empty one. Rows with a null conv_id are one conversation; repeated rows are
    turns of their own. A conversation is one row of the output, whose text no
    machine can split, so it is also gathered as one; texts of any length are
    whole. Returns conv_id, formatted, mask (character ranges of assistant
    text), attachments and expanded_tokens; other columns are not looked at,
    and an empty table gives no rows.
    """
    content = F.col("parts").cast(f"array<{PART}>") if "parts" in conversations.columns else F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), content.alias("parts")).alias("_turn"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [format_turns([(t["role"], [p if isinstance(p, dict) else p.asDict() for p in (t["parts"] if t["parts"] is not None else [])]) for t in turns]) for turns in batch["turns"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "formatted": ["".join(d.out) for d in done], "mask": [[{"low": a, "high": b} for a, b in d.mask] for d in done], "attachments": [d.attachments for d in done], "expanded_tokens": [d.expanded_tokens for d in done]})

    return grouped.mapInPandas(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the mask, as hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv_id, text, mask in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["mask"]):
                turns = read_back(text)
                learned = read_mask(text, [(m["low"], m["high"]) for m in mask])
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "mask").mapInPandas(run, DIGEST)
