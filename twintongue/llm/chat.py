"""Chat formatting by columnar byte assembly, and the reader of what it writes.

Template of a turn: `<|im_start|>` role newline text `<|im_end|>` newline. A
control string begins with `<|`, so texts are made free of it: `<`, any
backslashes, `|` get one backslash more, which the reader takes away again. In a
role, a newline and a backslash are escaped as well, so that the first newline
ends it.

format_turns assembles a batch at a time: segment lengths, their cumulative
offsets and scatter indices come from numpy, and headers, roles, texts and ends
are copied into one preallocated Arrow buffer. It needs no shuffle. read_back
sorts the turns of each conversation and walks through them with the state of
one conversation at a time, so that a conversation of any length fits.

Defined results: a null role or text is empty; a null conv_id is a conversation
of its own; null turns come first; rows with the same turn are ordered by role
and text, so repeated rows are repeated turns; other columns, whatever their
names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col_of, ragged, sliced, small_batches, string_buffers

START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one string array, and where, in bytes of its turn, each text begins and ends."""
    parts = [string_buffers(escape_role(roles)), string_buffers(escape(texts))]
    n = len(texts)
    lens = np.empty((n, 5), np.int64)
    lens[:, 0], lens[:, 2], lens[:, 4] = len(START), 1, len(END)
    for k, (_, o) in zip((1, 3), parts):
        lens[:, k] = np.diff(o)
    at = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(lens.ravel(), out=at[1:])
    begin = at[:-1].reshape(n, 5)
    buf = pa.allocate_buffer(int(at[-1]))
    out = np.frombuffer(buf, np.uint8)
    for k, fixed in ((0, START), (2, b"\n"), (4, END)):
        out[begin[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, (data, o) in zip((1, 3), parts):
        out[ragged(begin[:, k], lens[:, k])] = data[: o[-1]]
    offs = np.append(begin[:, 0], at[-1])
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offs.tobytes()), buf])
    return made, begin[:, 3] - begin[:, 0], begin[:, 4] - begin[:, 0]


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv_id, turn, role, text, formatted, loss_from, loss_to (bytes of formatted under the loss mask; equal without loss)."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            role, text = col_of(b, "role"), col_of(b, "text")
            made, lo, hi = assemble(role, text)
            loss = np.array(pc.equal(role, LOSS_ROLE).to_pylist(), bool)
            yield batch_of(_TURNS, [col_of(b, "conv_id"), col_of(b, "turn"), role, text, made.cast(pa.string()), lo, np.where(loss, hi, lo)])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_from long, loss_to long")


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|).)*)<\|im_end\|>\n", re.S)
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Conversation:
    """What read_back knows of a conversation so far."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.formatted = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, lo: int, hi: int) -> None:
        found = _TURN.fullmatch(formatted)
        if not found:
            raise ValueError(f"conversation {self.conv}: no turn of the template")
        self.turns += 1
        self.formatted += len(formatted)
        self.all.update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
        if hi > lo:
            masked = unescape(formatted.encode()[lo:hi].decode())
            self.chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, parsed from `formatted` and its mask: n_turns, digests of all turns and of what bears loss."""
    rows = formatted.select("conv_id", "turn", "role", "text", "formatted", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_from", "loss_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for conv, text, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Conversation(conv)
                now.add(text, lo, hi)
            if len(done) > 1000:
                yield batch_of(_READ, [list(c) for c in zip(*done)])
                done = []
        if now:
            done.append(now.row())
        if done:
            yield batch_of(_READ, [list(c) for c in zip(*done)])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
