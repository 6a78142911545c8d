"""Operator 9: chat formatting with typed content parts.

A turn's content is a list of parts of type text, image, audio or document. A visitor flattens them in order: text is
escaped, every attachment becomes a placeholder, its reference is recorded with the placeholder's number, and its
expanded token count is added. The template marks turns with control strings; inside roles and texts those strings are
escaped reversibly: backslashes are doubled, and a single backslash goes after the first character of a control string.

``format_turns`` works row by row, so a conversation of any size needs no grouping; ``read_back`` reads the formatted
segments in turn order as a stream with the state of one conversation at a time.

Edge cases: a null text is an empty text, a null role an empty role, a null list of parts no parts; an empty
conversation table gives an empty result; very long texts are escaped in linear time; ties of turn are ordered by the
formatted turn (role, then text, as escaped), null turns come first; repeated rows are repeated turns; rows with a null conversation id form one
conversation; only the columns named are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that have a meaning to this template or to common chat templates.
CONTROL = (TURN, TEXT, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_SEGMENT = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\?)")
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
SEGMENT = "segment string, loss_start long, loss_length long, attachments array<struct<number: int, type: string, ref: string, tokens: long>>, expanded_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one turn in order."""

    def __init__(self, patch: int = 14, audio_per_second: float = 25.0, per_page: int = 256):
        self.patch, self.audio_per_second, self.per_page = patch, audio_per_second, per_page
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, -(-(part.get("width") or 0) // self.patch) * -(-(part.get("height") or 0) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, -int(-(part.get("seconds") or 0.0) * self.audio_per_second // 1))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.per_page)

    def _attach(self, part: dict, tokens: int) -> None:
        self.out.append(PLACEHOLDERS[part["type"]])
        self.attachments.append({"number": len(self.attachments), "type": part["type"], "ref": part.get("ref"), "tokens": max(1, int(tokens))})


def format_turn(role: str | None, parts: list[dict], trained_roles: tuple[str, ...]) -> tuple[str, int, int, list[dict], int]:
    """(segment, start and length of the loss span in it, attachments, their tokens beyond the placeholders)."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    head, body = f"{TURN}{escape(role or '')}{TEXT}", "".join(visitor.out)
    loss = len(body) if role in trained_roles else 0
    return head + body + END, len(head), loss, visitor.attachments, sum(x["tokens"] - 1 for x in visitor.attachments)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, turn, segment, loss_start, loss_length, attachments, expanded_tokens) per turn. With ``parts_col`` (an array of
    ``PART``), its parts follow the text. A conversation's output is its segments joined in order."""
    conv, turn = (turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    parts = F.col(parts_col) if parts_col else F.lit(None).cast(f"array<{PART.replace(': ', ':')}>")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            roles, texts, more = (batch.column(k).to_pylist() for k in (2, 3, 4))
            rows = [format_turn(role, [{"type": "text", "text": text}, *(p for p in parts or () if p)], trained_roles) for role, text, parts in zip(roles, texts, more, strict=True)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv", "turn", "segment", "loss_start", "loss_length", "attachments", "expanded_tokens"])

    source = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), parts.alias("parts"))
    return source.mapInArrow(run, f"conv {conv}, turn {turn}, {SEGMENT}").withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation, read from the segments alone.

    Rows are sorted by conversation and turn within partitions; digests are fed turn by turn, so a task holds one
    conversation's digest and no group. A digest of one conversation is a chain over its turns and cannot be split."""
    conv = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done: list[tuple] = []
        state, key = None, None

        def close() -> None:
            if state is not None:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            kinds = [schema_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names)
            done.clear()
            return out

        schema_kind = pa.int64()
        for batch in slices(batches, "segment"):
            schema_kind = batch.column(0).type
            for conv_id, segment, start, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or conv_id != key:
                    close()
                    state, key = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv_id
                for role, body in _SEGMENT.findall(segment):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                learned = unescape(segment[start : start + length])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
            if len(done) > 5000:
                yield flush()
        close()
        if done:
            yield flush()

    rows = formatted.select(F.col(conv_col).alias("conv"), "segment", "loss_start", "loss_length", F.col(turn_col).alias("turn")).repartition("conv").sortWithinPartitions("conv", "turn", "segment")
    out = rows.select("conv", "segment", "loss_start", "loss_length").mapInArrow(run, f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)
