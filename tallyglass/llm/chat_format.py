"""Conversations as training text, checked by a grammar round trip.

A turn is rendered with its marks as it is and read again by a deterministic parser: an
opening mark, a text without any control string, and the closing mark of that opening.
Where the parser stops or finds another turn than the source, the turn's conflicting
strings are escaped (one more backslash behind their first character) and it is rendered
again, until both are identical. A turn's marks never depend on its neighbours, so a
conversation is read turn by turn, and what holds for each turn holds for their sequence.

Scale: rows are dealt by ranges of (conversation, turn), so a long conversation is
formatted by several tasks; a task sees its rows in order and holds one part (PART
characters or one turn). Reading a conversation back goes through its parts in order;
only conversations of several parts are exchanged for that. A digest over a whole
conversation is sequential by nature: it is one task's, which reads a part at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare, stored, trimmed

#: Characters from which a part of a conversation ends with the turn.
PART = 1 << 20
ESCAPE = "\\"


class GrammarError(ValueError):
    """A text that the template's grammar doesn't derive."""


@dataclass(frozen=True)
class ChatTemplate:
    """Opening and closing strings of each role. Other roles are written between other_role's strings, closed by other_close.

    controls are the strings that no text may hold as they are; each has two characters at
    least and begins with another than the escape's backslash.
    """

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<s><<SYS>> ", " <</SYS>></s>"), "user": ("<s>[INST] ", " [/INST]</s>"), "assistant": ("<s>[ANS] ", " [/ANS]</s>")})
    other_role: tuple[str, str] = ("<s>[ROLE] ", " [/ROLE] ")
    other_close: str = " </s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(len(c) < 2 or c[0] == ESCAPE for c in self.controls):
            raise ValueError("a control string has two characters or more and doesn't begin with a backslash")

    def __hash__(self):
        return hash((tuple(sorted(self.turns.items())), self.other_role, self.other_close, self.controls, self.trained))

    @cached_property
    def _escaped(self) -> re.Pattern:
        """Control strings with any number of backslashes behind the first character."""
        return re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in sorted(self.controls, key=len, reverse=True)))

    @cached_property
    def _bare(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))

    @cached_property
    def _openings(self) -> list[tuple[str, str | None]]:
        return sorted([(o, r) for r, (o, _) in self.turns.items()] + [(self.other_role[0], None)], key=lambda x: -len(x[0]))

    def escape(self, text: str) -> str:
        return self._escaped.sub(lambda m: ESCAPE + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][1:], text) if ESCAPE in text else text

    def _strings(self, role: str) -> tuple[str, str]:
        if role in self.turns:
            return self.turns[role]
        return self.other_role[0] + self._settled(role, lambda r: self._read_role(r + self.other_role[1], 0) == (role, len(r) + len(self.other_role[1]))) + self.other_role[1], self.other_close

    def _settled(self, text: str, same) -> str:
        """The text as it is if it is read back identical, else with its conflicts escaped."""
        for t in (text, self.escape(text)):
            try:
                if same(t):
                    return t
            except GrammarError:
                continue
        raise GrammarError(f"no escape makes this readable: {text[:80]!r}")

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn, and from where to where its text goes in it."""
        before, after = self._strings(role)
        t = self._settled(text, lambda t: self.parse_turn(before + t + after, 0)[0::3] == ((role, text), len(before) + len(t) + len(after)))
        return before + t + after, len(before), len(before) + len(t)

    def _until(self, data: str, at: int, close: str) -> tuple[str, int]:
        """The text up to a closing string, at the first control string or where the closing has none before it; and the place after."""
        lead = self._bare.search(close)
        m = self._bare.search(data, at)
        if m is None or lead is None:
            raise GrammarError(f"no {close!r} after character {at}")
        end = m.start() - lead.start()
        if end < at or not data.startswith(close, end):
            raise GrammarError(f"{m[0]!r} within a text, at character {m.start()}")
        return data[at:end], end + len(close)

    def _read_role(self, data: str, at: int) -> tuple[str, int]:
        text, at = self._until(data, at, self.other_role[1])
        return self.unescape(text), at

    def parse_turn(self, data: str, at: int) -> tuple[tuple[str, str], int, int, int]:
        """The turn that begins at a character: (role, text), the ends of its escaped text, and the place after."""
        for opening, role in self._openings:
            if data.startswith(opening, at):
                break
        else:
            raise GrammarError(f"no turn begins at character {at}")
        start, close = at + len(opening), self.other_close
        if role is None:
            role, start = self._read_role(data, start)
        else:
            close = self.turns[role][1]
        text, after = self._until(data, start, close)
        return (role, self.unescape(text)), start, start + len(text), after

    def parse(self, data: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, ends of its escaped text) of each turn."""
        at = 0
        while at < len(data):
            (role, text), start, end, at = self.parse_turn(data, at)
            yield role, text, start, end


TEMPLATE = ChatTemplate()
_PARTS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("n_turns", T.LongType()), T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("whole", T.BooleanType())])
_READ = T.StructType([T.StructField(c, T.StringType() if c.endswith("256") else T.LongType()) for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of 1,000, or fewer with PART characters of the column text."""
    held, size = [], 0
    pack = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += len(row[text]) if text is not None else 0
        if len(held) >= 1000 or size >= PART:
            yield pack()
            held, size = [], 0
    if held:
        yield pack()


def _formatted(rows: Iterator[tuple], template: ChatTemplate, part_chars: int, task: int) -> Iterator[tuple]:
    """Parts of rows (conv_id, role, text) in order. A conversation that begins or ends with the task's rows may go on in another task."""
    none = object()
    conv, begun, texts, loss, size, number = none, False, [], [], 0, 0

    def part(last: bool) -> tuple:
        return conv, task << 32 | number, "".join(texts), len(texts), loss, begun and last

    for c, role, text in rows:
        if conv is not none and (c != conv or size >= part_chars):
            yield part(c != conv)
            begun, texts, loss, size, number = c != conv, [], [], 0, number + 1
        conv = c
        turn, start, end = template.render(role or "", text or "")
        if role in template.trained:
            loss.append((size + start, size + end))
        texts.append(turn)
        size += len(turn)
    if conv is not none:
        yield part(False)


def format_chats(turns: DataFrame, template: ChatTemplate = TEMPLATE, part_chars: int = PART) -> DataFrame:
    """(conv_id, part, formatted, n_turns, loss, whole) of turns (conv_id, turn, role, text).

    The parts of a conversation, joined in the order of part, are its text; loss has where
    each trained turn's text (escaped, without marks) begins and ends in its part; whole
    says that a part surely is its whole conversation. Turns go by turn (nulls first), equal
    ones by a hash of role and text; repeated rows are turns of their own. A null role or
    text counts as empty; rows without a conv_id are one conversation. Texts of any length
    are taken whole. Other columns are dropped; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(turns.sparkSession)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [F.col("conv_id").cast("long"), F.col("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    x = turns.select(*(k.alias(c) for k, c in zip(keys, ("conv_id", "turn", "role", "text"), strict=True)))
    x = x.withColumn("h", F.xxhash64("role", "text"))  # splits equal turns between ranges without texts as bounds
    x = x.repartitionByRange(n, "conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "role", "text").select("conv_id", "role", "text")
    schema = to_arrow_schema(_PARTS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_formatted(_rows(batches), template, part_chars, TaskContext.get().partitionId()), schema, 2)

    return x.mapInArrow(trimmed(of), _PARTS)


def _read(parts: Iterator[tuple], template: ChatTemplate) -> Iterator[tuple]:
    """What the digest columns say, of parts (conv_id, formatted, loss) in order."""
    none = object()
    conv, n, chars, trained, turns, masked = none, 0, 0, 0, None, None
    for c, data, loss in parts:
        if c != conv:
            if conv is not none:
                yield conv, n, turns.hexdigest(), trained, masked.hexdigest(), chars
            conv, n, chars, trained, turns, masked = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for role, text, *_ in template.parse(data):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = template.unescape(data[span["start"] : span["end"]])
            trained += len(text)
            masked.update(text.encode())
        chars += len(data)
    if conv is not none:
        yield conv, n, turns.hexdigest(), trained, masked.hexdigest(), chars


def read_chats(parts: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from formatted text and loss alone.

    turns_sha256 is over role, line feed, text, line feed of each turn; loss_sha256 over the
    unescaped texts under the loss mask. Text outside of the grammar is an error. A null
    conv_id is one conversation; no parts give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_READ)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_read(_rows(batches), template), schema)

    wanted = ["conv_id", "formatted", "loss"]
    done = parts.where("whole").select(*wanted).mapInArrow(trimmed(of), _READ)
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rest = parts.where("not whole").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").select(*wanted)
    return done.unionByName(rest.mapInArrow(trimmed(of), _READ))


def chat_digests(turns: DataFrame, template: ChatTemplate = TEMPLATE, part_chars: int = PART) -> DataFrame:
    """Turns formatted, written to the shared folder, and read back from there; see format_chats and read_chats."""
    return read_chats(stored(format_chats(turns, template, part_chars), "chats"), template)
