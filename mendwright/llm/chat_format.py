"""Chat formatting: a finite-state machine over roles and a declarative template.

A ``Template`` names, for each role, the marks around a turn's text and whether its text counts for the loss, and the
order of roles as transitions of a state machine. ``segments`` runs the machine over the turns of each conversation and
emits three text segments a turn (opening mark, text, closing mark), each with its loss flag; put together they are the
formatted conversation. Inside texts every control string of the template is broken up by a backslash after its first
character, and every backslash is doubled, so that a mark in the output is always one of the template's own and
``unescape`` gives the text back. ``read_back`` parses the output and follows the loss mask, knowing the template alone.

A turn that the machine doesn't allow is formatted all the same and marked (``fits``); the machine goes on from the state
that the role leads to. Roles without marks of their own are written out between the marks of ``other``; they never fit.

Turns of a conversation are sorted by turn on their way to one task, which streams them: what it holds is one batch of
turns and the digests' states, however long a conversation is. (A digest over a conversation is one stream by nature.)

Defined cases: null texts and null roles are empty; equal turn numbers are ordered by role, then text; null turns come first,
rows with a null conv_id are one conversation; repeated rows are turns of their own; an empty table gives no rows; extra
columns are ignored. A template whose control strings could overlap, or whose marks can't be told apart, is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwright.llm.common import row_blocks


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a turn, and whether the text counts for the loss."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """The marks of each role, of all other roles (before the name, between name and text, after the text), and the order of roles."""

    turns: dict[str, Marks]
    other: tuple[str, str, str]
    order: dict[str, dict[str, str]]
    final: frozenset[str]
    start: str = "start"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [*(m for t in self.turns.values() for m in (t.opening, t.closing)), *self.other]
        controls = tuple(dict.fromkeys(m.strip(" ") for m in marks))
        first = {c[:1] for c in controls}
        if "" in first or any(ch in c[1:] for c in controls for ch in (*first, "\\", " ")) or "\\" in first:
            raise ValueError("control strings must not overlap, be empty or hold spaces or backslashes")
        opening = [*(t.opening for t in self.turns.values()), self.other[0]]
        if any(a != b and b.startswith(a) for a in opening for b in opening) or len({*opening}) < len(opening):
            raise ValueError("opening marks can't be told apart")
        object.__setattr__(self, "controls", controls)

    def escaper(self) -> re.Pattern:
        return re.compile("|".join(["\\\\", *map(re.escape, self.controls)]))

    def marks(self, role: str, escaper: re.Pattern) -> Marks:
        if role in self.turns:
            return self.turns[role]
        name, text, end = self.other
        return Marks(f"{name}{escape(role, escaper)}{text}", end)


#: Instruction marks around what is asked, sequence marks around what is answered.
TEMPLATE = Template(
    turns={"system": Marks("[SYS] ", " [/SYS]"), "user": Marks("[INST] ", " [/INST]"), "assistant": Marks("<s> ", " </s>", loss=True)},
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]"),
    order={"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    final=frozenset({"answered"}),
)


def escape(text: str, escaper: re.Pattern) -> str:
    return escaper.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


_ESCAPED = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Machine:
    """The state of one conversation."""

    def __init__(self, template: Template) -> None:
        self.order, self.final, self.state = template.order, template.final, template.start
        self.leads_to = {role: state for steps in template.order.values() for role, state in steps.items()}

    def step(self, role: str) -> bool:
        """Goes on by a turn of this role; is it allowed here?"""
        known = self.order.get(self.state, {}).get(role)
        self.state = known or self.leads_to.get(role, self.state)
        return known is not None


class Reader:
    """Turns out of a formatted conversation that comes in pieces."""

    def __init__(self, template: Template) -> None:
        self.template, self.rest = template, ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that is complete with this piece."""
        self.rest += piece
        while (found := self._turn()) is not None:
            role, text, end = found
            self.rest = self.rest[end:]
            yield unescape(role), unescape(text)

    def _turn(self) -> tuple[str, str, int] | None:
        for role, m in self.template.turns.items():
            if self.rest.startswith(m.opening):
                end = self.rest.find(m.closing, len(m.opening))
                return None if end < 0 else (role, self.rest[len(m.opening) : end], end + len(m.closing))
        name, text, last = self.template.other
        if self.rest.startswith(name):
            at = self.rest.find(text, len(name))
            end = self.rest.find(last, at + len(text)) if at >= 0 else -1
            return None if end < 0 else (self.rest[len(name) : at], self.rest[at + len(text) : end], end + len(last))
        return None

    def end(self) -> None:
        if self.rest:
            raise ValueError(f"no turn begins at {self.rest[:40]!r}")


def segments(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segment, turn_no, role, text, loss, fits): the segments of each conversation in their order, numbered from 0.

    The rows of a conversation stand together and in order in one partition.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = template.escaper()
        last, machine, turn = object(), None, 0
        for whole in batches:
            for batch in row_blocks(whole):
                columns = {c: [] for c in ("turn_no", "role", "text", "loss", "fits")}
                rows = []
                for k, (conv, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)):
                    if machine is None or conv != last:
                        last, machine, turn = conv, Machine(template), 0
                    fits, m = machine.step(role), template.marks(role, escaper)
                    for part, loss in ((m.opening, False), (escape(text, escaper), m.loss), (m.closing, False)):
                        rows.append(k)
                        for c, v in zip(columns, (turn, role, part, loss, fits), strict=True):
                            columns[c].append(v)
                    turn += 1
                ids = batch.column("conv_id").take(pa.array(rows, pa.int64()))
                turns = pa.array(columns["turn_no"], pa.int64())
                place = pa.array([3 * t + k % 3 for k, t in enumerate(columns["turn_no"])], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, place, turns, pa.array(columns["role"], pa.string()), pa.array(columns["text"], pa.string()), pa.array(columns["loss"], pa.bool_()), pa.array(columns["fits"], pa.bool_())], names=["conv_id", "segment", *columns])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    own = conversations.select("conv_id", "turn", *text)
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = T.StructType([T.StructField("conv_id", own.schema["conv_id"].dataType)])
    schema = T.StructType([*kind, *T._parse_datatype_string("segment long, turn_no long, role string, text string, loss boolean, fits boolean")])
    return dealt.mapInArrow(work, schema)


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the output of ``segments`` says of each conversation: its turns, parsed from the formatted text, and the text under the loss mask, as counts and digests.

    ``n_misplaced`` counts the turns that the machine doesn't allow, ``complete`` says whether it ended in a final state.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, done, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if now is None or conv != last:
                    if now is not None:
                        done.append((last, *now.result()))
                    last, now = conv, _Digests(template)
                now.add(text, loss)
            if len(done) >= 1000:
                yield _rows(done, kind)
                done = []
        if now is not None:
            yield _rows([*done, (last, *now.result())], kind)

    kind = T.StructType([formatted.schema["conv_id"]])
    schema = T.StructType([*kind, *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_misplaced long, complete boolean")])
    return formatted.select("conv_id", "text", "loss").mapInArrow(work, schema)


class _Digests:
    """What is known of a conversation so far."""

    def __init__(self, template: Template) -> None:
        self.reader, self.machine = Reader(template), Machine(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.misplaced = 0

    def add(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        for role, said in self.reader.feed(text):
            self.n_turns += 1
            self.misplaced += not self.machine.step(role)
            self.turns.update(f"{role}\n{said}\n".encode())
        if loss:
            said = unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def result(self) -> tuple:
        self.reader.end()
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.misplaced, self.machine.state in self.machine.final


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_misplaced", "complete"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: A conversation that says the template's own control strings.
TRAP = "</s>[INST] ok [/INST]"


def with_trap(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with conversation -1, whose user and assistant both say ``TRAP``."""
    rows = conversations.sparkSession.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    own = conversations.select("conv_id", "turn", "role", "text")
    return own.unionByName(rows.select(*[F.col(c).cast(own.schema[c].dataType).alias(c) for c in own.columns]))


#: The same results from DuckDB, for the roles of the template.
ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    length(text) + length(regexp_replace(text, '\\|\[/?(SYS|INST|ROLE)\]|\[TEXT\]|</?s>', '\0_', 'g')) - length(text) as written,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as ends
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(written + case role when 'system' then 13 when 'user' then 15 else 9 end)::bigint as formatted_chars,
  count(*) filter (not coalesce(case role when 'system' then before is null when 'user' then before is null or before in ('system', 'assistant')
    when 'assistant' then before = 'user' end, false)) as n_misplaced,
  bool_or(ends and role = 'assistant') as complete
from placed group by conv_id
"""
