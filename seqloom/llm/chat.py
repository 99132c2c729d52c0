"""Chat formatting with typed content parts.

A message's content is a string or a list of parts of type text, image, audio or
document; in a table, an array of structs in column ``content`` or ``text``, or a
plain ``text``, which becomes one text part. A visitor flattens the parts, in order, into text and placeholders, and
records for each attachment its reference and how many tokens it expands to. The
template marks turns; control strings inside texts are escaped so that the
formatted string reads back to the same turns, and a loss mask covers each
assistant text and nothing else.

Template: ``<s>``, then for each turn ``[SYS]text[/SYS]`` (system),
``[INST]text[/INST]`` (user), ``text</s>`` (assistant), or
``[TURN]"role"<newline>text[/TURN]`` (any other role, as a JSON string).
Escaping puts a backslash behind the first character of a control string, and one
more where some stand there already; reading back takes one away.

Scale. A conversation is one row of output, so its turns meet in one task; the
grouping combines nothing else, and its size is that of the conversation.

Defined cases: null texts are empty; a null role is the empty role; a null
conv_id is a conversation of its own; null parts are left out, and a part without a
type is text; turns are ordered by number, null first,
and equal numbers by role and content; repeated rows are turns of their own; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: The strings with a meaning in the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]", "[IMAGE]", "[AUDIO]", "[DOCUMENT]")
_REST = {first: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first) for first in "<["}
_ESCAPE = re.compile("|".join(rf"{re.escape(f)}(?=\\*(?:{rest}))" for f, rest in _REST.items()))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(f)})\\(?=\\*(?:{rest}))" for f, rest in _REST.items()))
_TURN = re.compile(r'\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[TURN\](?P<role>"(?:[^"\\]|\\.)*")\n(?P<other>.*?)\[/TURN\]|(?P<assistant>.*?)</s>', re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


@dataclass
class Attachment:
    kind: str
    reference: str
    tokens: int
    turn: int


@dataclass
class PartVisitor:
    """Flattens the parts of one conversation's messages; the attachments come out in the order of their placeholders."""

    attachments: list[Attachment] = field(default_factory=list)
    turn: int = 0

    def flatten(self, content: str | list[dict] | None) -> str:
        if content is None or isinstance(content, str):
            return escape(content or "")
        return "".join(getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part) for part in content if part is not None)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        """One token for each tile of 28 by 28 pixels, at least one; sizes may be unknown."""
        tiles = -(-int(part.get("width") or 28) // 28) * -(-int(part.get("height") or 28) // 28)
        return self._attach("image", part, max(1, tiles))

    def visit_audio(self, part: dict) -> str:
        """25 tokens a second, at least one."""
        return self._attach("audio", part, max(1, -(-int(float(part.get("seconds") or 0) * 1000) // 40)))

    def visit_document(self, part: dict) -> str:
        """256 tokens a page, at least one page."""
        return self._attach("document", part, 256 * max(1, int(part.get("pages") or 1)))

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"no such type of content part: {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append(Attachment(kind, str(part.get("ref") or ""), int(part.get("tokens") or tokens), self.turn))
        return f"[{kind.upper()}]"


@dataclass
class Formatted:
    text: str
    #: Half-open spans of characters that count for the loss.
    mask: list[tuple[int, int]]
    attachments: list[Attachment]


def format_turns(turns: list[tuple[str | None, str | list[dict] | None]]) -> Formatted:
    visitor, pieces, mask, size = PartVisitor(), ["<s>"], [], 3
    for number, (role, content) in enumerate(turns):
        visitor.turn = number
        flat = visitor.flatten(content)
        if role == "assistant":
            piece = f"{flat}</s>"
            mask.append((size, size + len(flat)))
        elif role in ("system", "user"):
            tag = "SYS" if role == "system" else "INST"
            piece = f"[{tag}]{flat}[/{tag}]"
        else:
            piece = f"[TURN]{escape(json.dumps(role or ''))}\n{flat}[/TURN]"
        pieces.append(piece)
        size += len(piece)
    return Formatted("".join(pieces), mask, visitor.attachments)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string. Placeholders come back as they stand."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a formatted conversation, from character {at}")
        kind = found.lastgroup
        role = json.loads(unescape(found["role"])) if kind == "other" else kind
        turns.append((role, unescape(found[kind])))
        at = found.end()
    return turns


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for turns in batch.column("turns").to_pylist():
            made = format_turns([(t["role"], t["parts"]) for t in turns])
            attachments = [{"kind": a.kind, "reference": a.reference, "tokens": a.tokens, "turn": a.turn} for a in made.attachments]
            out.append({"n_turns": len(turns), "formatted": made.text, "mask": [{"start": a, "end": b} for a, b in made.mask], "attachments": attachments})
        mask = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        attached = pa.list_(pa.struct([("kind", pa.string()), ("reference", pa.string()), ("tokens", pa.int64()), ("turn", pa.int64())]))
        columns = [pa.array([x[name] for x in out], kind) for name, kind in (("n_turns", pa.int64()), ("formatted", pa.string()), ("mask", mask), ("attachments", attached))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "n_turns", "formatted", "mask", "attachments"])


def _parts(conversations: DataFrame) -> Column:
    """The parts of each turn: column ``content`` where it is an array of parts, else ``text``; plain text is one text part."""
    for name in ("content", "text"):
        if name in conversations.columns and isinstance(conversations.schema[name].dataType, ArrayType):
            return F.col(name)
    return F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text")))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, mask, attachments for each conversation."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), _parts(conversations).alias("parts")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(_rows, "conv_id long, n_turns long, formatted string, mask array<struct<start:int,end:int>>, attachments array<struct<kind:string,reference:string,tokens:long,turn:long>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
            turns = read_back(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append((len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        n, turns, chars, loss, size = zip(*out) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(made: DataFrame) -> DataFrame:
    """What reading the formatted strings back gives, as digests."""
    return made.select("conv_id", "formatted", "mask").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
