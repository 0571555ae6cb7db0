r"""Chat formatting by schema fingerprints.

Records are JSON texts of many layouts. The fingerprint of a record is a hash of its nested field paths (array elements as
``[]``), restricted to the paths that any mapping mentions, so that further fields do not matter. It selects a declarative
mapping, which turns the record into canonical turns (role, text). Turns are written in a template:

    ### user: text </turn>\n

Inside roles and texts, ``\`` becomes ``\\``, ``###`` becomes ``\###``, ``</turn>`` becomes ``\</turn>``, and in roles ``:`` becomes
``\:``; so the control strings only stand where the template put them, and reading back gives the same roles and texts.

Each turn is formatted for itself, in its own row; a conversation of any length is a number of rows. Reading back goes through
the sorted turns of a conversation with running digests, so memory does not grow with its length.

Defined cases: a null text or role reads as empty; turns with equal numbers follow role, then text; a null turn number is first,
a null conversation id is a conversation of its own; repeated rows are repeated turns; a record whose fingerprint no mapping
has, that is no JSON object, is nested too deeply for the parser, or has an element that is no object where turns should be, gives
one row with a null turn and its fingerprint, if it has one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = re.compile(r"\\|###|</turn>")
ROLE_ESCAPES = re.compile(r"\\|###|</turn>|:")
UNESCAPES = re.compile(r"\\(\\|###|</turn>|:)")
TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ((?:\\(?:\\|###|</turn>)|[^\\])*?) </turn>\n", re.S)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``each``: path of the array of turns, or empty if the record itself holds them.
    ``turns``: pairs of role and text, each a path below the element, or a constant if it begins with ``=``; empty texts of
    optional paths give no turn. ``roles``: names that stand for canonical ones. ``optional``: paths a record may lack."""

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        head = f"{self.each}[]." if self.each else ""
        return {head + x for pair in self.turns for x in pair if not x.startswith("=")}


#: layouts in common use
MAPPINGS = (
    Mapping("turn rows", (("role", "text"),), optional=("role", "text")),
    Mapping("messages", (("role", "content"),), each="messages"),
    Mapping("from and value", (("from", "value"),), each="conversations", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", (("=system", "system"), ("=user", "instruction"), ("=user", "input"), ("=assistant", "output")), optional=("system", "input")),
    Mapping("prompt and completion", (("=user", "prompt"), ("=assistant", "completion"))),
    Mapping("prompt and response", (("=system", "system"), ("=user", "prompt"), ("=assistant", "response")), optional=("system",)),
    Mapping("question and answer", (("=user", "question"), ("=assistant", "answer"))),
)


def beginnings(known: set[str]) -> set[str]:
    return {p[:i] for p in known for i in range(len(p) + 1)}


def known_paths(value: Any, known: set[str], begins: set[str]) -> set[str]:
    """Those of the leaves' paths that are in ``known`` (an empty array or object is a leaf). What no known path begins with
    is not walked into, and what is open waits in a list, so that depth is no matter."""
    out, waiting = set(), [("", value)]
    while waiting:
        at, value = waiting.pop()
        if isinstance(value, dict) and value:
            waiting += [(path, v) for k, v in value.items() if (path := f"{at}.{k}" if at else k) in begins]
        elif isinstance(value, list) and value:
            if f"{at}[]" in begins:
                waiting += [(f"{at}[]", v) for v in value]
        elif at in known:
            out.add(at)
    return out


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def by_fingerprint(mappings: tuple[Mapping, ...]) -> tuple[set[str], dict[str, Mapping]]:
    """The paths that count, and the mapping of each fingerprint; of two mappings with one fingerprint the earlier holds."""
    known = set().union(*(m.paths() for m in mappings))
    table: dict[str, Mapping] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for left_out in combinations(m.optional, n):
                if paths := m.paths() - set(left_out):
                    table.setdefault(fingerprint(paths), m)
    return known, table


LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def text_of(value: Any) -> str:
    """A text as it is, anything else as JSON; halves of surrogate pairs, which no text can hold, become U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return LONE_SURROGATE.sub("\ufffd", text)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical turns of a record; none if one of its elements is no object, as half a conversation teaches nothing."""
    elements = [record]
    if mapping.each:
        elements = record.get(mapping.each) or []
    if not isinstance(elements, list) or not all(isinstance(x, dict) for x in elements):
        return []
    out = []
    for element in elements:
        for role, text in mapping.turns:
            if text in mapping.optional and role.startswith("=") and not element.get(text):
                continue
            name = role[1:] if role.startswith("=") else text_of(element.get(role))
            out.append((mapping.roles.get(name, name), text_of(element.get(text))))
    return out


def canonical_turns(records: DataFrame, keys: list[str], json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """keys, fingerprint, layout, part (number of the turn in its record), role, text."""
    known, table = by_fingerprint(mappings)
    begins = beginnings(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                at, rows = [], []
                for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                    mark, found = None, []
                    try:
                        record = json.loads(raw) if raw else None
                        if isinstance(record, dict):
                            mark = fingerprint(known_paths(record, known, begins))
                            if mapping := table.get(mark):
                                found = [(mark, mapping.name, k, *turn) for k, turn in enumerate(turns_of(record, mapping))]
                    except (ValueError, RecursionError):  # no JSON, or nested too deeply for the parser
                        found = []
                    found = found or [(mark, None, None, None, None)]
                    rows += found
                    at += [i] * len(found)
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keys, "fingerprint", "layout", "part", "role", "text"])

    slim = records.select(*keys, F.col(json_col).cast("string").alias("_record"))
    head = "".join(f"`{k}` {slim.schema[k].dataType.simpleString()}, " for k in keys)
    return slim.mapInArrow(run, head + "fingerprint string, layout string, part int, role string, text string")


def formatted_turn(role: str, text: str) -> str:
    escape = lambda pattern, x: pattern.sub(lambda m: "\\" + m[0], x)
    return OPEN + escape(ROLE_ESCAPES, role) + ROLE_END + escape(ESCAPES, text) + CLOSE


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the (escaped) text stands, of every turn in a formatted text."""
    plain = lambda x: UNESCAPES.sub(lambda m: m[1], x)
    return [(plain(m[1]), plain(m[2]), m.start(2), m.end(2)) for m in TURN.finditer(formatted)]


def with_format(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and the loss mask of the turn: mask_from, mask_to (code points in ``formatted``; equal if none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out, low, high = [], [], []
            for role, text in zip(batch.column(names.index("role")).to_pylist(), batch.column(names.index("text")).to_pylist(), strict=True):
                whole = formatted_turn(role or "", text or "")
                out.append(whole)
                high.append(len(whole) - len(CLOSE))
                low.append(high[-1] if role != "assistant" else len(formatted_turn(role, "")) - len(CLOSE))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=[*names, "formatted", "mask_from", "mask_to"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields)
    return turns.mapInArrow(run, f"{fields}, formatted string, mask_from int, mask_to int")


def chat_report(formatted: DataFrame, id_col: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Reads formatted turns back: per conversation the number and digest of its turns, and of the text under the mask."""
    ordered = formatted.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], "formatted", "mask_from", "mask_to")
    ordered = ordered.repartition("id").sortWithinPartitions(F.col("id").isNull(), "id", *[f"_{i}" for i in range(len(order))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current, state = False, None, None
        done: list[tuple] = []

        def close() -> None:
            if started:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kinds = (batch.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            for conv, whole, low, high in zip(*(batch.column(c).to_pylist() for c in ("id", "formatted", "mask_from", "mask_to")), strict=True):
                if not started or conv != current:
                    close()
                    started, current, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, begin, end in read_turns(whole):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if low < high and begin == low and end == high:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(whole)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    kind = ordered.schema["id"].dataType.simpleString()
    report = ordered.mapInArrow(run, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return report.withColumnRenamed("id", id_col)


def conversation_report(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations given as rows of turns (id, turn, role, text): as records, canonical turns, formatted, and read back."""
    record = F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    turns = canonical_turns(rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), record.alias("record")), ["conv_id", "turn"])
    # a row whose role and text are both null is a turn with neither
    turns = turns.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    return chat_report(with_format(turns)).withColumnRenamed("conv_id", id_col)
