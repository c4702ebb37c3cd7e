"""Chat formatting: typed content parts rendered into one marked-up text, and read back.

A message's content is a list of typed parts.  `PartVisitor` flattens them in order: text is
escaped, and each image, audio or document part becomes a placeholder ``[ATT:kind:n]``, with an
attachment reference and the number of tokens that the placeholder expands to recorded beside it.

Rendering is a map over turns: every turn marks its own start and end, so a conversation's
formatted text is the plain concatenation of its turns' segments, and a conversation of any
length needs no task that holds it.  Reading back streams over the sorted segments with a few
hash states in memory; a SHA-256 over a conversation is sequential by nature, so its turns pass
through one task, never through a list.

Defined results: null role or text is empty; null parts are no parts; an unknown or null kind keeps only its
text; a size, length or page count that is null, negative, infinite or no number stands for no tokens;
null conv_id is a conversation of its own; equal turns are ordered by role, then segment;
a repeated row is a repeated turn; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, record_batches, spark_schema

USER_OPEN, USER_CLOSE = "<s>[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE = "<s>[ROLE]", "[/ROLE]"
END = "</s>"

#: A control string, with any backslashes that stand after its first character.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]|ATT:))"
_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\]|ATT:))")
_PLACEHOLDER = re.compile(r"\[ATT:([a-z]+):([0-9]+)\]")

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
SEGMENTS = arrow_schema(
    conv_id=pa.int64(),
    turn=pa.int64(),
    role=pa.string(),
    segment=pa.string(),
    loss=pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()})),
    attachments=pa.list_(pa.struct({"at": pa.int64(), "kind": pa.string(), "ref": pa.string(), "tokens": pa.int64()})),
)
DIGESTS = arrow_schema(
    conv_id=pa.int64(),
    n_turns=pa.int64(),
    turns_sha256=pa.string(),
    loss_chars=pa.int64(),
    loss_sha256=pa.string(),
    formatted_chars=pa.int64(),
    n_attachments=pa.int64(),
    attachment_tokens=pa.int64(),
)


def escape(text: str) -> str:
    """One more backslash inside each control string: no raw one is left, and `unescape` undoes it."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class TokenCosts:
    """How many tokens an attachment's placeholder stands for once it is expanded."""

    patch_pixels: int = 28
    audio_tokens_per_second: float = 12.5
    tokens_per_page: int = 512


def _amount(value: float | None) -> float:
    """A part's size as it counts: nothing unless it is a positive finite number."""
    return value if value is not None and math.isfinite(value) and value > 0 else 0


@dataclass
class PartVisitor:
    """Flattens typed parts into text with ordered placeholders; one visitor per message."""

    costs: TokenCosts = field(default_factory=TokenCosts)
    body: list[str] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict | None) -> None:
        if part:
            getattr(self, f"visit_{part['kind']}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        if text:
            self.texts.append((self.length, self.length + len(text)))
            self._add(text)

    def visit_image(self, part: dict) -> None:
        side = self.costs.patch_pixels
        self._attach(part, math.ceil(_amount(part["width"]) / side) * math.ceil(_amount(part["height"]) / side))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil(_amount(part["seconds"]) * self.costs.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, _amount(part["pages"]) * self.costs.tokens_per_page)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append((self.length, part["kind"], part["ref"] or "", tokens))
        self._add(f"[ATT:{part['kind']}:{len(self.attachments) - 1}]")

    def _add(self, text: str) -> None:
        self.body.append(text)
        self.length += len(text)


def render_turn(role: str, parts: list[dict], costs: TokenCosts) -> tuple[str, list, list]:
    """The segment, its loss spans and its attachments, both in code points of the segment."""
    visitor = PartVisitor(costs)
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.body)
    if role == "user":
        start, close = USER_OPEN, USER_CLOSE
    elif role == "assistant":
        start, close = "", END
    else:
        start, close = f"{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}", END
    shift = len(start)
    loss = [{"start": a + shift, "end": b + shift} for a, b in visitor.texts] if role == "assistant" else []
    kept = [{"at": at + shift, "kind": kind, "ref": ref, "tokens": n} for at, kind, ref, n in visitor.attachments]
    return start + body + close, loss, kept


def parse(formatted: str) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """Each turn's role, text and placeholders, read from a formatted conversation or a part of one."""
    at = 0
    while at < len(formatted):
        if formatted.startswith(USER_OPEN, at):
            role, begin, close = "user", at + len(USER_OPEN), USER_CLOSE
        elif formatted.startswith(ROLE_OPEN, at):
            end = formatted.index(ROLE_CLOSE, at)
            role, begin, close = unescape(formatted[at + len(ROLE_OPEN) : end]), end + len(ROLE_CLOSE), END
        else:
            role, begin, close = "assistant", at, END
        end = formatted.index(close, begin)
        body = formatted[begin:end]
        yield role, unescape(_PLACEHOLDER.sub("", body)), [(kind, int(n)) for kind, n in _PLACEHOLDER.findall(body)]
        at = end + len(close)


def text_messages(turns: DataFrame) -> DataFrame:
    """Plain (conv_id, turn, role, text) rows as messages of one text part."""
    part = F.struct(
        F.lit("text").alias("kind"), F.col("text"), *(F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages"))
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.array(part).cast(PARTS).alias("parts"))


def format_turns(messages: DataFrame, costs: TokenCosts | None = None) -> DataFrame:
    """(conv_id, turn, role, parts) to one formatted segment a turn; no shuffle."""
    costs = costs or TokenCosts()

    def render(batches):
        for batch in batches:
            ids, turns, roles, parts = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "parts"))
            rows = ((i, t, r or "", *render_turn(r or "", p or [], costs)) for i, t, r, p in zip(ids, turns, roles, parts, strict=True))
            yield from record_batches(rows, SEGMENTS)

    return messages.select("conv_id", "turn", "role", "parts").mapInArrow(render, spark_schema(SEGMENTS))


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted text holds, a row for each conversation; see the query contract for the digests."""
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.select("conv_id", "segment", "loss", "attachments").mapInArrow(_digest, spark_schema(DIGESTS))


def _digest(batches):
    yield from record_batches(_conversations(batches), DIGESTS)


def _conversations(batches) -> Iterator[tuple]:
    state = None
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss", "attachments"))
        for conv_id, segment, loss, attachments in zip(*columns, strict=True):
            if state is None or state.conv_id != conv_id:
                if state is not None:
                    yield state.row()
                state = _Digest(conv_id)
            state.add(segment, loss, attachments)
    if state is not None:
        yield state.row()


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_attachments = self.tokens = 0

    def add(self, segment: str, loss: list, attachments: list) -> None:
        for role, text, _ in parse(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            learned = unescape(segment[span["start"] : span["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(segment)
        self.n_attachments += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.chars, self.n_attachments, self.tokens,
        )
