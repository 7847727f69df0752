"""Chat formatting by columnar byte assembly.

The turns of a batch are laid out at once: lengths of headers, contents and footers give cumulative
offsets, the offsets give scatter indices, and every segment is copied into one preallocated buffer
that becomes the Arrow column. Conversations stream through a task in order, in parts of bounded size, so
that none has to fit in memory.

    <s>[INST] user [/INST] assistant </s><<SYS>> system <</SYS>>[ROLE] name\\nany other [/ROLE]

A control string within a text gets a backslash before it and before the backslashes that stand there
already; reading takes one away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import byte_slices, text_bytes

_CONTROL = r"<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]"
_ESCAPED = re.compile(rb"\\(\\*(?:" + _CONTROL.encode() + rb"))")

FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start: int, length: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    if not pc.any(pc.match_substring_regex(texts, _CONTROL)).as_py():
        return texts
    return pc.replace_substring_regex(texts, rf"(\\*)({_CONTROL})", r"\\\1\2")


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", text) if b"\\" in text else text


def frame(role: str) -> tuple[str, str]:
    """What stands before and after a content."""
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "assistant":
        return " ", " </s>"
    if role == "system":
        return "<<SYS>> ", " <</SYS>>"
    return f"[ROLE] {quote(role, safe=' ')}\n", " [/ROLE]"


def turns(formatted: bytes) -> Iterator[tuple[str, bytes]]:
    """Role and text of each turn of a formatted part."""
    at = 0
    while at < len(formatted):
        if formatted.startswith(b"<s>", at):
            at += 3
        if formatted.startswith(b"[INST] ", at):
            role, begin, end = "user", at + 7, b" [/INST]"
        elif formatted.startswith(b"<<SYS>> ", at):
            role, begin, end = "system", at + 8, b" <</SYS>>"
        elif formatted.startswith(b"[ROLE] ", at):
            line = formatted.index(b"\n", at)
            role, begin, end = unquote(formatted[at + 7 : line].decode()), line + 1, b" [/ROLE]"
        elif formatted.startswith(b" ", at):
            role, begin, end = "assistant", at + 1, b" </s>"
        else:
            raise ValueError("not a turn of this template")
        stop = formatted.index(end, begin)
        yield role, unescape(formatted[begin:stop])
        at = stop + len(end)


def _scatter(out: np.ndarray, starts: np.ndarray, column: pa.Array) -> None:
    data, offsets = text_bytes(column)
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], np.diff(offsets))] = data


def _assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some turns end to end, where each turn begins, and where its content begins and how long it is."""
    coded = pc.dictionary_encode(pc.fill_null(roles, ""))
    names = coded.dictionary.to_pylist()
    around = [frame(name) for name in names]
    code = coded.indices.to_numpy()
    headers = pa.array([start + frame[0] for frame in around for start in ("", "<s>")], pa.string()).take(pa.array(code * 2 + first))
    footers = pa.array([frame[1] for frame in around], pa.string()).take(pa.array(code))
    contents = escape(pc.fill_null(texts, ""))
    sizes = np.stack([np.diff(text_bytes(column)[1]) for column in (headers, contents, footers)], axis=1)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.uint8)
    for k, column in enumerate((headers, contents, footers)):
        _scatter(out, starts[k:-1:3], column)
    return out, starts[::3], starts[1::3], sizes[:, 1]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = None, 0
    for batch in batches:
        for at, texts in byte_slices(batch.column("text")):
            rows = batch.slice(at, len(texts))
            ids = rows.column("conv_id")
            key = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy()
            run = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            goes_on = last is not None and last == key[0]
            first = np.zeros(len(key), np.int64)
            first[run[int(goes_on) :]] = 1
            data, starts, begin, length = _assemble(rows.column("role"), texts, first)
            numbers = np.zeros(len(run), np.int64)
            if goes_on:
                numbers[0] = part + 1
            last, part = key[-1], int(numbers[-1])
            ends = np.append(run, len(key))
            spoken = pc.fill_null(pc.equal(rows.column("role"), "assistant"), False).to_numpy(zero_copy_only=False)
            owner = np.searchsorted(run, np.flatnonzero(spoken), side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array((begin[spoken] - starts[run][owner]).astype(np.int32)), pa.array(length[spoken].astype(np.int32))], ["start", "length"])
            loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(run)))]).astype(np.int32)), spans)
            formatted = pa.StringArray.from_buffers(len(run), pa.py_buffer(starts[ends].astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(run)), pa.array(numbers), pa.array(np.diff(ends)), formatted, loss], ["conv_id", "part", "n_turns", "formatted", "loss"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list | None = None
    done: list[tuple] = []

    def close() -> None:
        if held is not None:
            done.append((held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]))

    def flush() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])
        done.clear()
        return out

    for batch in batches:
        for conv, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True):
            if held is None or part == 0:
                close()
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = text.encode()
            for role, content in turns(raw):
                held[1] += 1
                held[2].update(role.encode() + b"\n" + content + b"\n")
            for span in loss:
                content = unescape(raw[span["start"] : span["start"] + span["length"]])
                held[3] += len(content.decode())
                held[4].update(content)
            held[5] += len(text)
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss) of rows (conv_id, turn, role, text); loss holds byte spans of assistant contents.

    Turns are taken in the order of turn, then role and text; repeated turns stay. Null text and role count as
    empty, rows with a null conv_id make up one conversation. A conversation is cut into parts, numbered from 0, where about
    1 MB of texts, or a batch, ends; a part's rows follow each other in order within a task. Other columns are not looked
    at. An empty table gives no rows.
    """
    columns = [F.col("conv_id").cast("long"), F.col("turn"), F.col("role"), F.col("text")]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatted, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted parts say when read back, a row for each conversation; parts must come in order, as they are made."""
    return formatted.mapInArrow(_digests, DIGESTS)
