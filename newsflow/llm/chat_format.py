"""Chat formatting by columnar byte assembly.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
roles and texts a ``<``, any number of backslashes and a ``|`` get one
backslash more, so no control string can appear there and the escape is
undone by taking one away; a role's line breaks are written ``\\n`` with its
backslashes doubled, as the first line break ends the role.

Turns are dealt to partitions by conversation and sorted there; a task then
works on whole Arrow batches: it computes the byte length of every segment
(headers, roles, texts, ends), their cumulative offsets and the scatter
indices in numpy, and copies all of them into one preallocated buffer, which
becomes the data of the output column. The loss mask comes from the same
lengths, as pairs (start, end) in code points over assistant texts.

A conversation is written as one row, or, when it is longer than an Arrow
batch, as several consecutive parts (``part`` from 0), so memory is bounded
by a batch and not by a conversation.

Defined results: NULL role or text: empty; turns are ordered by (turn, role,
text), NULL first, and repeated rows are all kept; NULL conv_id: one
conversation of its own; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
ESCAPE = (r"<(\\*)\|", r"<\1\\|")       # one backslash more
UNESCAPE = (r"<(\\*)\\\|", r"<\1|")     # one backslash less
ASSISTANT = "assistant"
HELD_BYTES = 32 << 20  # a conversation's rows beyond this are written as a part


def _lengths(a: pa.Array) -> np.ndarray:
    return pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes_of(a: pa.Array) -> np.ndarray:
    """All bytes of a string array without nulls, in order."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(a) else np.empty(0, np.uint8)


def _scatter(out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy consecutive segments of ``data`` to ``starts`` of ``out``."""
    before = np.cumsum(lengths) - lengths
    out[np.repeat(starts - before, lengths) + np.arange(len(data))] = data


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return pc.replace_substring_regex(roles, *ESCAPE)


def unescape_role(role: str) -> str:
    out, i = [], 0
    role = _unescape(role)
    while i < len(role):
        if role[i] == "\\":
            i += 1
            out.append("\n" if role[i] == "n" else role[i])
        else:
            out.append(role[i])
        i += 1
    return "".join(out)


def _unescape(s: str) -> str:
    return pc.replace_substring_regex(pa.array([s]), *UNESCAPE)[0].as_py() if "|" in s else s


def _run_starts(conv: pa.Array) -> np.ndarray:
    """Row numbers at which another conversation begins; NULL equals NULL."""
    a, b = conv.slice(0, len(conv) - 1), conv.slice(1)
    changed = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(np.r_[True, changed.to_numpy(zero_copy_only=False)])


def assemble(first: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted strings of the runs of rows beginning at ``first``, with the
    starts and ends of their masks (lists per run)."""
    n = len(roles)
    rows = np.flatnonzero(pc.equal(roles, ASSISTANT).to_numpy(zero_copy_only=False))
    roles, texts = escape_role(roles), pc.replace_substring_regex(texts, *ESCAPE)
    # segments of a row: start mark, role, line break, text, end mark
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), 1, len(END)
    lengths[:, 1], lengths[:, 3] = _lengths(roles), _lengths(texts)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts, total = ends - lengths, int(ends[-1, -1])
    if total >= 1 << 31:
        raise ValueError("an Arrow batch of turns holds more than 2 GB")
    out = np.empty(total, np.uint8)
    for segment, mark in ((0, START), (4, END)):
        mark = np.frombuffer(mark, np.uint8)
        out[starts[:, segment, None] + np.arange(len(mark))] = mark
    out[starts[:, 2]] = ord("\n")
    _scatter(out, starts[:, 1], lengths[:, 1], _bytes_of(roles))
    _scatter(out, starts[:, 3], lengths[:, 3], _bytes_of(texts))

    bounds = np.r_[starts[first, 0], total]
    formatted = pa.Array.from_buffers(pa.utf8(), len(first), [
        None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])
    points = np.r_[0, np.cumsum((out & 0xC0) != 0x80, dtype=np.int64)]  # code points before a byte
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))[rows]
    base = points[bounds[run]]
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(run, minlength=len(first)))].astype(np.int32))
    return (formatted,
            pa.ListArray.from_arrays(offsets, pa.array(points[starts[rows, 3]] - base)),
            pa.ListArray.from_arrays(offsets, pa.array(points[ends[rows, 3]] - base)))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of the conversation the last batch ended with
    open_id, open_part = None, 0     # the conversation cut by the last write, if any

    def write(rows: pa.RecordBatch, cut: bool) -> pa.RecordBatch:
        nonlocal open_id, open_part
        conv = rows.column(0)
        first = _run_starts(conv)
        ids = conv.take(pa.array(first))
        parts = np.zeros(len(first), np.int32)
        if open_part and ids[0].as_py() == open_id:
            parts[0] = open_part
        open_id, open_part = ids[-1].as_py(), int(parts[-1]) + 1 if cut else 0
        return pa.RecordBatch.from_arrays([ids, pa.array(parts), *assemble(first, rows.column(1), rows.column(2))],
                                          names=["conv_id", "part", "formatted", "loss_start", "loss_end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _joined([*held, batch])
        last = int(_run_starts(rows.column(0))[-1])
        if last:
            yield write(rows.slice(0, last), cut=False)
        held = [rows.slice(last)]
        if held[0].nbytes >= HELD_BYTES:
            yield write(held[0], cut=True)
            held = []
    if held:
        yield write(held[0], cut=False)


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, formatted, loss_start, loss_end): conversations in the
    template, with the code-point spans of their loss mask."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(role_col, F.lit("")).alias("role"),
                        F.coalesce(text_col, F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(_format, f"conv_id {kind}, part int, formatted string, "
                                     "loss_start array<bigint>, loss_end array<bigint>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string, unescaped."""
    turns = []
    for piece in formatted.split(END.decode())[:-1]:
        role, _, text = piece[len(START):].partition("\n")
        turns.append((unescape_role(role), _unescape(text)))
    return turns


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def done(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols[2], cols[4] = ([h.hexdigest() for h in c] for c in (cols[2], cols[4]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    open_row, kind = None, None
    for batch in batches:
        kind, rows = batch.column(0).type, []
        for conv, part, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                if open_row is not None:
                    rows.append(open_row)
                open_row = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                open_row[1] += 1
                open_row[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends):
                said = _unescape(text[a:b])
                open_row[3] += len(said)
                open_row[4].update(said.encode())
            open_row[5] += len(text)
        if rows:
            yield done(rows, kind)
    if open_row is not None:
        yield done([open_row], kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars) per conversation, parsed from the formatted strings;
    parts of a conversation are read one after the other."""
    cols = ["conv_id", "part", "formatted", "loss_start", "loss_end"]
    rows = formatted.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                  "loss_sha256 string, formatted_chars bigint")
