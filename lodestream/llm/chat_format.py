"""Chat formatting: conversations rendered by a compiled template, with control strings escaped reversibly.

Rows are shuffled by conversation and sorted by turn (null turns first; ties by role, then text). A task
then streams: it renders turn by turn and gives pieces of about PIECE characters, so its memory holds a turn
and a piece, whatever the length of a conversation. (The turns of one conversation are read in order by
one task, because their digest can only be taken in order.) Compiling happens once per task.

Escaping: where a text holds a control string, with any number of backslashes after its first character, one
more backslash is put there; reading takes one away. Control strings start with a character that none of them
holds elsewhere, so no text can join with its surroundings to a control string.

Defined results: null text and null role are empty; a null conv_id is a conversation of its own; repeated
rows are turns each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from .templates import Segment, compiled

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[GEN]")
TEMPLATE = """
{%- for turn in messages -%}
  {%- if loop.first -%} {{ '<s>' }} {%- endif -%}
  {%- if turn.role == 'assistant' -%}
    {{ '[GEN]' }} {%- generation -%} {{ turn.text | escape }} {%- endgeneration -%} {{ '</s>' }}
  {%- else -%}
    {{ '[INST]' }} {{- turn.role | escape }} {{- '[ROLE]' }} {{- turn.text | escape }} {{- '[/INST]' }}
  {%- endif -%}
{%- endfor -%}
"""
PIECE = 1 << 20


@lru_cache(maxsize=8)
def _escaping(controls: tuple[str, ...]) -> tuple[re.Pattern[str], re.Pattern[str]]:
    rest = {c[0]: "|".join(re.escape(d[1:]) for d in controls if d[0] == c[0]) for c in controls}
    one = "|".join(rf"(?<={re.escape(first)}){{0}}(?={others})" for first, others in rest.items())
    return re.compile("|".join(rf"{re.escape(first)}\\*(?={others})" for first, others in rest.items())), re.compile(one.replace("{0}", r"\\+"))


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _escaping(controls)[0].sub(lambda m: m[0] + "\\", text)


def unescape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _escaping(controls)[1].sub(lambda m: m[0][1:], text)


def renderer(template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> Callable[[dict[str, Any]], Iterator[Segment]]:
    return compiled(template, {"escape": lambda value: escape(value or "", controls)})


@dataclass
class Read:
    """One turn read back."""

    role: str
    text: str


def read_turns(pieces: Iterator[str], controls: tuple[str, ...] = CONTROLS) -> Iterator[Read]:
    """The turns of a text formatted by TEMPLATE, which arrives in pieces cut anywhere."""
    marks = re.compile("|".join(map(re.escape, controls)))
    longest = max(map(len, controls))
    role, parts, rest = "", [], ""
    for piece, is_end in chain(((p, False) for p in pieces), [("", True)]):
        buffer, at = rest + piece, 0
        for m in marks.finditer(buffer):
            parts.append(buffer[at : m.start()])
            at = m.end()
            body, parts = "".join(parts), []
            if m[0] == "[ROLE]":
                role = unescape(body, controls)
            elif m[0] == "[GEN]":
                role = "assistant"
            elif m[0] in ("</s>", "[/INST]"):
                yield Read(role, unescape(body, controls))
        keep = len(buffer) if is_end else max(at, len(buffer) - longest + 1)
        parts.append(buffer[at:keep])
        rest = buffer[keep:]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 4 * PIECE, at_most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, cut by the length of their third column (a text) and by number."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= chars or len(held) >= at_most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _id_type(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = df.schema["conv_id"].dataType.simpleString()
    return kind, {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())


def formatted(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """conv_id, piece (from 0), text, and marks: the marked [from, to) ranges of characters within the piece.

    A conversation's pieces stand in one partition, one after the other.
    """
    kind, id_type = _id_type(conversations)
    marks = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    schema = pa.schema([("conv_id", id_type), ("piece", pa.int32()), ("text", pa.string()), ("marks", marks)])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = renderer(template, controls)

        def pieces() -> Iterator[tuple]:
            for conv_id, turns in groupby(_rows(batches), itemgetter(0)):
                parts, spans, size, number = [], [], 0, 0
                for text, marked in run({"messages": ({"role": r or "", "text": t or ""} for _, _, r, t in turns)}):
                    if size and size + len(text) > PIECE:
                        yield conv_id, number, "".join(parts), spans
                        parts, spans, size, number = [], [], 0, number + 1
                    if marked and text:
                        spans.append({"from": size, "to": size + len(text)})
                    parts.append(text)
                    size += len(text)
                yield conv_id, number, "".join(parts), spans

        yield from _in_batches(pieces(), schema)

    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(render, f"conv_id {kind}, piece int, text string, marks array<struct<from:int,to:int>>")


def read_back(pieces: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """What a reader finds in the output of `formatted`, one row per conversation.

    pieces: that output, with each conversation's pieces in order within one partition.
    """
    kind, id_type = _id_type(pieces)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv_id, own in groupby(_rows(batches), itemgetter(0)):
                loss, counts = hashlib.sha256(), {"loss": 0, "all": 0}

                def texts(own=own, loss=loss, counts=counts) -> Iterator[str]:
                    for _, _, text, marks in own:
                        counts["all"] += len(text)
                        for span in marks:
                            plain = unescape(text[span["from"] : span["to"]], controls)
                            counts["loss"] += len(plain)
                            loss.update(plain.encode())
                        yield text

                turns, n = hashlib.sha256(), 0
                for turn in read_turns(texts(), controls):
                    turns.update(f"{turn.role}\n{turn.text}\n".encode())
                    n += 1
                yield conv_id, n, turns.hexdigest(), counts["loss"], loss.hexdigest(), counts["all"]

        yield from _in_batches(digests(), schema)

    return pieces.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are made of control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def format_report(conversations: DataFrame) -> DataFrame:
    return read_back(formatted(with_probe(conversations)))
