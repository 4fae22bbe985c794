"""Chat formatting with typed content parts.

A turn has a role and a list of parts: text, image, audio or document.  A visitor flattens the parts, in
order: text is escaped and kept, every other part becomes a placeholder ``<|kind:n|>``, n counting the
attachments of the conversation; its reference and its expanded token count (what the placeholder stands
for once the model's encoder has run) are recorded.  The template is

    <|turn|>ROLE\\nTEXT<|end|>\\n

and control strings (those of the template, and those of common chat templates) are escaped inside roles
and texts: a backslash is doubled, and the first character of a control string becomes ``\\l`` (for <) or
``\\b`` (for [).  So no text can forge a turn, and ``parse`` gives every text back exactly.

Turns are sorted within a partition by conversation and turn and streamed: a conversation is put together
from its rows as they come, whatever batch they are in; memory holds one conversation's output only.

Defined results: a null role or text is empty; a null part is left out; a row with a null conversation id is a
conversation of its own, so that such rows meet in no task; turns with equal numbers are ordered by role, then
by parts (nulls first), and repeated turns all stay; an empty table gives an empty result.  A part of a kind
that is not known is kept as an attachment of its kind, with the placeholder ``<|other:n|>``.  Sizes, seconds
and pages that are null, negative or not a number count as none, so a placeholder costs ``Costs.least`` tokens;
token counts end at ``MOST_TOKENS``.  ``spans`` are the code-point ranges of the output under the loss mask: the
contents of the turns of ``learn_roles``.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Shielded, by_value

#: A count of tokens is no larger, nor is the sum of a conversation's, so that it is always a long.
MOST_TOKENS = 2**62
TURN, END, BREAK = "<|turn|>", "<|end|>", "\n"
#: What would be read as control by this or another chat template begins with one of these.
CONTROL = re.compile(r"\\|<(?=\||/?s>|/?unk>|/?pad>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|\[(?=/?INST\]|/?AVAILABLE_TOOLS\]|/?TOOL_RESULTS\]|TOOL_CALLS\])")
ESCAPED = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
PLAIN = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}  # n: in roles, which end at a line's end
PART = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType()),
    ]
)
OUT = (
    "formatted string, n_turns bigint, formatted_chars bigint, spans array<struct<start:bigint,stop:bigint>>, "
    "attachments array<struct<n:bigint,kind:string,ref:string,turn:bigint,tokens:bigint>>, expanded_tokens bigint"
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text, flags=re.S)


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder expands to."""

    patch: int = 28
    tokens_a_second: float = 25.0
    tokens_a_page: int = 512
    least: int = 1


@dataclass
class Visitor:
    """Visits the parts of one conversation's turns in order."""

    costs: Costs
    turn: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("kind") or "text"
        return {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(kind, self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        side = lambda n: -(-max(0, n or 0) // self.costs.patch)
        return self.attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> str:
        tokens = (part.get("seconds") or 0.0) * self.costs.tokens_a_second
        return self.attach("audio", part, math.ceil(min(tokens, MOST_TOKENS)) if tokens > 0 else 0)  # not a number: 0

    def visit_document(self, part: dict) -> str:
        return self.attach("document", part, (part.get("pages") or 0) * self.costs.tokens_a_page)

    def visit_other(self, part: dict) -> str:
        return self.attach(part["kind"], part, 0, "other")

    def attach(self, kind: str, part: dict, tokens: int, sign: str | None = None) -> str:
        n = len(self.attachments)
        tokens = min(max(self.costs.least, tokens), MOST_TOKENS)
        self.attachments.append({"n": n, "kind": kind, "ref": part.get("ref"), "turn": self.turn, "tokens": tokens})
        return f"<|{sign or kind}:{n}|>"


def merged(parts: list[dict | None]) -> Iterator[dict]:
    """Parts with neighbouring texts joined, so that no control string arises where two texts meet."""
    for is_text, run in groupby((p for p in parts if p is not None), key=lambda p: (p.get("kind") or "text") == "text"):
        if is_text:
            yield {"kind": "text", "text": "".join(p.get("text") or "" for p in run)}
        else:
            yield from run


class Conversation:
    """The output of one conversation, turn by turn."""

    def __init__(self, key, learn_roles: tuple[str, ...], costs: Costs):
        self.key, self.learn, self.visitor = key, learn_roles, Visitor(costs)
        self.pieces: list[str] = []
        self.length, self.spans = 0, []

    def add(self, role: str | None, parts: list[dict] | None) -> None:
        name = escape(role or "").replace("\n", "\\n")
        head = f"{TURN}{name}{BREAK}"
        body = "".join(self.visitor.visit(p) for p in merged(parts or []))
        start = self.length + len(head)
        if (role or "") in self.learn:
            self.spans.append({"start": start, "stop": start + len(body)})
        self.pieces += (head, body, END, BREAK)
        self.length = start + len(body) + len(END) + len(BREAK)
        self.visitor.turn += 1

    def row(self) -> tuple:
        found = self.visitor.attachments
        return self.key, "".join(self.pieces), self.visitor.turn, self.length, self.spans, found, min(sum(a["tokens"] for a in found), MOST_TOKENS)


def format_conversations(
    turns: DataFrame, parts: Column, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    learn_roles: tuple[str, ...] = ("assistant",), costs: Costs = Costs(),
) -> DataFrame:
    """One row for each conversation: its id, then ``OUT``.  ``parts`` is an array of structs with fields of ``PART``."""
    by_value()
    held = Shielded(turns)
    named = turns.select("*", parts).toDF(*held.rows.columns, "_parts")
    key, at, said_by = (F.col(held.of(c)) for c in (conversation, turn, role))
    # Rows without a conversation are dealt by what they say.
    alone = F.when(key.isNull(), F.xxhash64(at, said_by, F.to_json("_parts"))).otherwise(0)
    rows = named.select(key.alias("_key"), at.alias("_turn"), said_by.cast("string").alias("_role"), "_parts", alone.alias("_alone"))
    dealt = rows.repartition("_key", "_alone").sortWithinPartitions("_key", "_alone", "_turn", "_role", F.to_json("_parts")).drop("_alone")
    key_field = rows.schema["_key"]
    schema = T.StructType([T.StructField(conversation, key_field.dataType), *T.StructType.fromDDL(OUT).fields])
    arrow = to_arrow_schema(schema)

    def flush(done: list[Conversation]) -> pa.RecordBatch:
        columns = list(zip(*[c.row() for c in done], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, size = None, [], 0
        for batch in batches:
            keys, roles, all_parts = batch.column(0), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                key = keys[i].as_py()
                if now is None or key is None or key != now.key:
                    if now is not None:
                        done.append(now)
                        size += now.length
                        if size > 4 << 20 or len(done) >= 5000:
                            yield flush(done)
                            done, size = [], 0
                    now = Conversation(key, learn_roles, costs)
                now.add(roles[i].as_py(), all_parts[i].as_py())
        if now is not None:
            done.append(now)
        if done:
            yield flush(done)

    return dealt.mapInArrow(work, schema)


def text_parts(text: Column) -> Column:
    """A text as a list of one part."""
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")]
    fields += [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(*fields))


TURN_PATTERN = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, unescaped; placeholders stay as they are."""
    out, at = [], 0
    for m in TURN_PATTERN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside a turn")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside a turn")
    return out


def digests(formatted: DataFrame, conversation: str) -> DataFrame:
    """What can be read back from the output: turns from the template, learned text from the loss mask."""
    by_value()
    found = T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    schema = T.StructType([formatted.schema[conversation], *found.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                whole = text.as_py()
                turns, learned, loss, chars = parse(whole), hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    learned.update(f"{role}\n{said}\n".encode())
                for span in spans.as_py():
                    plain = unescape(whole[span["start"] : span["stop"]])
                    loss.update(plain.encode())
                    chars += len(plain)
                for column, value in zip(out, (len(turns), learned.hexdigest(), chars, loss.hexdigest(), len(whole)), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                names=schema.names,
            )

    return formatted.select(F.col(f"`{conversation}`"), "formatted", "spans").mapInArrow(work, schema)
