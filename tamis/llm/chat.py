"""Chat formatting: schema fingerprints select mappings to canonical turns, a template writes them.

A record's fingerprint is the hash of its sorted nested field paths. The registry maps
fingerprints to declarative mappings, so no code looks at a record's fields to guess what it
is. Formatted conversations are ordered pieces, one per turn, so that a conversation of any
length is written and read as a stream.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``turns`` is either the path of a list whose elements have ``role`` and ``text`` fields,
    or empty; then ``fixed`` lists (role, path) pairs in order. ``number`` names the field
    that orders records which are single turns.
    """

    name: str
    conv: str
    turns: str = ""
    role: str = "role"
    text: str = "text"
    fixed: tuple[tuple[str, str], ...] = ()
    number: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.turns:
            own = {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        elif self.fixed:
            own = {path for _, path in self.fixed}
        else:
            own = {self.role, self.text, self.number}
        return own | {self.conv} | set(self.optional)

    def fingerprints(self) -> list[str]:
        """Of the layout with any of its optional fields left out."""
        every = self.paths()
        leave = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint_of(every - set(gone)) for gone in leave]


# The layouts that are known.
MAPPINGS = (
    Mapping("rows", conv="conv_id", number="turn", role="role", text="text", optional=("text", "role")),
    Mapping("messages", conv="conv_id", turns="messages", role="role", text="content"),
    Mapping("conversations", conv="id", turns="conversations", role="from", text="value"),
    Mapping("prompt", conv="conv_id", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", conv="conv_id", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(
        "instruction",
        conv="conv_id",
        fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
        optional=("system", "input"),
    ),
)
# Names of roles that mean a canonical one. Rows by turn keep their roles as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for mapping in mappings:
        for mark in mapping.fingerprints():
            if out.setdefault(mark, mapping) is not mapping:
                raise ValueError(f"layouts {out[mark].name} and {mapping.name} have the same fields")
    return out


def json_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed record; ``[]`` stands for the elements of a list."""
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(json_paths(v, f"{at}[]") for v in value), set()) or {f"{at}[]"}
    return {at}


def schema_paths(kind: DataType, at: str = "") -> set[str]:
    """Nested field paths of a Spark type."""
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields), set())
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


TURNS = "conv_id bigint, turn bigint, role string, text string"


def turns_of_columns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table whose own schema is the layout.

    Columns that no layout has are left out of the fingerprint, so that extra columns do no
    harm. An unknown layout is an error. Null texts and roles become empty.
    """
    known = set().union(*(m.paths() for m in mappings))
    mark = fingerprint_of(schema_paths(records.schema) & known)
    mapping = registry(mappings).get(mark)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {mark}: {sorted(schema_paths(records.schema))}")
    conv = F.col(mapping.conv).cast("bigint").alias("conv_id")
    names = set(records.columns)
    field = lambda path: F.col(path) if path in names else F.lit(None).cast("string")
    if mapping.turns:
        rows = records.select(conv, F.posexplode(mapping.turns).alias("turn", "m"))
        parts = rows.select("conv_id", F.col("turn").cast("bigint"), F.col(f"m.{mapping.role}").alias("role"), F.col(f"m.{mapping.text}").alias("text"))
    elif mapping.fixed:
        pairs = [F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("text")) for role, path in mapping.fixed if path in names]
        parts = records.select(conv, F.posexplode(F.array(*pairs)).alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint"), "m.role", "m.text")
    else:
        parts = records.select(conv, field(mapping.number).cast("bigint").alias("turn"), field(mapping.role).alias("role"), field(mapping.text).alias("text"))
    role = _canonical_role() if mapping.turns or mapping.fixed else F.col("role")
    return parts.select("conv_id", "turn", F.coalesce(role, F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _canonical_role() -> Column:
    role = F.col("role")
    for name, meant in ROLES.items():
        role = F.when(F.col("role") == name, meant).otherwise(role)
    return role


def _at(record: dict, path: str) -> object:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def record_turns(record: object, known: dict[str, Mapping]) -> tuple[str, str | None, list[tuple]]:
    """(fingerprint, layout or None, turns) of one parsed record."""
    mark = fingerprint_of(json_paths(record))
    mapping = known.get(mark)
    if mapping is None:
        return mark, None, []
    conv = _at(record, mapping.conv)
    if mapping.turns:
        listed = [(i, m.get(mapping.role), m.get(mapping.text)) for i, m in enumerate(_at(record, mapping.turns) or [])]
    elif mapping.fixed:
        listed = [(i, role, _at(record, path)) for i, (role, path) in enumerate((r, p) for r, p in mapping.fixed if _at(record, p) is not None)]
    else:
        listed = [(_at(record, mapping.number), _at(record, mapping.role), _at(record, mapping.text))]
    return mark, mapping.name, [(conv, i, role, None if text is None else str(text)) for i, role, text in listed]


def turns_of_json(records: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of records of mixed layouts, given as JSON in ``column``.

    Each record's own fingerprint selects its mapping. Rows have ``fingerprint`` and ``layout``
    too; a record with an unknown layout, or that is no JSON, gives one row with null layout
    and null turn fields, so that nothing is lost silently.
    """
    known = registry(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(0).to_pylist():
                try:
                    mark, layout, turns = record_turns(json.loads(value or ""), known)
                except ValueError:
                    mark, layout, turns = None, None, []
                rows += [(mark, layout, *t) for t in turns] or [(mark, layout, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["fingerprint", "layout", "conv_id", "turn", "role", "text"]
    made = records.select(column).mapInArrow(run, f"fingerprint string, layout string, {TURNS}")
    known_rows = F.col("layout").isNotNull()
    by_turn = [m.name for m in mappings if not (m.turns or m.fixed)]
    role = F.when(F.col("layout").isin(by_turn), F.col("role")).otherwise(_canonical_role())
    return made.withColumns(
        {"role": F.when(known_rows, F.coalesce(role, F.lit(""))), "text": F.when(known_rows, F.coalesce("text", F.lit("")))}
    )


@dataclass(frozen=True)
class Template:
    """Marks around a turn's role and text. In roles and texts, the escape character stands
    before itself and inside every ``lead`` that could begin a mark."""

    start: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"
    lead: str = "<|"
    escape: str = "\\"
    trained: str = "assistant"

    def guard(self, text: str) -> str:
        return text.replace(self.escape, self.escape * 2).replace(self.lead, self.lead[0] + self.escape + self.lead[1:])

    def unguard(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)


TEMPLATE = Template()
PIECES = "conv_id bigint, piece bigint, start bigint, formatted string, loss_start bigint, loss_end bigint"


def _ordered(turns: DataFrame) -> DataFrame:
    """Each conversation in one partition, its turns in order (null first, ties by content)."""
    return turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Formatted conversations as ordered pieces, one per turn.

    ``formatted`` starts at code point ``start`` of its conversation's text; the loss mask is
    [loss_start, loss_end) of that text (null without one). Partitions hold whole
    conversations with their pieces in order; a worker keeps one batch, whatever the length
    of a conversation. Without turns there are no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        piece = at = 0
        for batch in batches:
            out: list[tuple] = []
            for c, _, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                if c != conv:
                    conv, piece, at = c, 0, 0
                head = f"{template.start}{template.guard(role)}{template.middle}"
                body = template.guard(text)
                formatted = head + body + template.end
                trained = role == template.trained
                low = at + len(head)
                out.append((c, piece, at, formatted, low if trained else None, low + len(body) if trained else None))
                piece, at = piece + 1, at + len(formatted)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "piece", "start", "formatted", "loss_start", "loss_end"]
    return _ordered(turns).mapInArrow(run, PIECES)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What formatted conversations say: turns and masked text, read from the text alone.

    ``pieces`` must keep conversations together and in order, as ``format_turns`` returns
    them. Turns are found by the template's marks and unescaped; the masked text is cut out
    of the formatted text by the mask. Digests are made as a stream.
    """
    pattern = re.compile(f"{re.escape(template.start)}(.*?){re.escape(template.middle)}(.*?){re.escape(template.end)}", re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def result(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            out: list[tuple] = []
            for conv, _, start, formatted, low, high in zip(*(column.to_pylist() for column in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(result(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in pattern.findall(formatted):
                    state[1] += 1
                    state[2].update(f"{template.unguard(role)}\n{template.unguard(text)}\n".encode())
                if low is not None:
                    masked = template.unguard(formatted[low - start : high - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(formatted)
            if out:
                yield table(out)
        if state is not None:
            yield table([result(state)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pieces.mapInArrow(run, DIGEST)
