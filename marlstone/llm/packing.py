"""Hierarchical multi-length packing of tokenised documents.

Tokens of a document go into windows of several context sizes. What is longer than the largest
window fills such windows by itself; the rest is routed to the smallest size that holds it. Each
size is packed first come, first placed; what is left of a window is filled with whole pieces of
shorter sizes, and at last with the head of the next piece, so that a window is full. Only the
last windows of a task hold less: they take the binary digits of what remains, and are full too.
Windows of one size are dealt in step groups of equal token counts.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import byte_slices

CONTEXTS = (256, 512, 1024, 2048)
#: Tokens of the windows that one training step takes.
STEP_TOKENS = 64 * 2048
#: Pieces of shorter sizes that are looked at to fill a gap.
LOOK = 64
#: Windows' worth of pieces that wait in each size, to have a choice.
WAIT = 4

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context long, step long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level BPE of a tokenizers file, as an encoder that gives the same ids several times faster.

    Its merges must be in the order of their ids, as in vocabularies of this kind.
    """
    import public_tokenizers
    import tiktoken

    held = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): n for word, n in held["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str, end: int = 1) -> np.ndarray:
    """uint32 ids of a text (null: empty), special strings as their ids, and the end id."""
    found = encoding(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(found.astype(np.uint32, copy=False), np.uint32(end))


class Packer:
    """Packs the pieces of one task; `rows` gathers (doc, start, ids, doc_tokens, sequence, offset, context, step)."""

    def __init__(self, contexts: tuple[int, ...], step_tokens: int, first: int) -> None:
        self.contexts, self.step_tokens, self.first = contexts, step_tokens, first
        self.waiting = {c: deque() for c in contexts}
        self.tokens, self.made = dict.fromkeys(contexts, 0), dict.fromkeys(contexts, 0)
        self.sequences, self.rows = 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        largest = self.contexts[-1]
        whole = len(ids) // largest * largest
        for at in range(0, whole, largest):
            self.emit([(doc, at, ids[at : at + largest], len(ids))], largest)
        if whole < len(ids):
            self.route((doc, whole, ids[whole:], len(ids)))

    def route(self, piece: tuple, front: bool = False) -> None:
        size = next(c for c in self.contexts if c >= len(piece[2]))
        (self.waiting[size].appendleft if front else self.waiting[size].append)(piece)
        self.tokens[size] += len(piece[2])
        while not front and self.tokens[size] >= (WAIT + 1) * size:
            self.fill(size)

    def fill(self, size: int) -> None:
        """One full window of this size, which has enough waiting."""
        gap, chosen, own = size, [], self.waiting[size]
        while own and len(own[0][2]) <= gap:
            gap -= self.take(own.popleft(), size, chosen)
        for shorter in [c for c in self.contexts[::-1] if c < size]:
            queue, passed = self.waiting[shorter], []
            for _ in range(min(LOOK, len(queue))):
                if not gap:
                    break
                piece = queue.popleft()
                if len(piece[2]) <= gap:
                    gap -= self.take(piece, shorter, chosen)
                else:
                    passed.append(piece)
            queue.extendleft(reversed(passed))
        if gap:
            doc, start, ids, total = own.popleft()
            self.tokens[size] -= len(ids)
            chosen.append((doc, start, ids[:gap], total))
            self.route((doc, start + gap, ids[gap:], total), front=True)
        self.emit(chosen, size)

    def take(self, piece: tuple, size: int, chosen: list) -> int:
        chosen.append(piece)
        self.tokens[size] -= len(piece[2])
        return len(piece[2])

    def emit(self, pieces: list, size: int) -> None:
        step = self.made[size] // max(1, self.step_tokens // size) if size in self.made else 0
        if size in self.made:
            self.made[size] += 1
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.first + self.sequences, offset, size, step))
            offset += len(ids)
        self.sequences += 1

    def finish(self) -> None:
        """The pieces that still wait, longest first, cut at the binary digits of their sum."""
        rest = deque(p for c in self.contexts[::-1] for p in self.waiting[c])
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.contexts[-1], 1 << (left.bit_length() - 1))
            gap, chosen = size, []
            while gap:
                doc, start, ids, total = rest.popleft()
                chosen.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.appendleft((doc, start + gap, ids[gap:], total))
                gap -= len(chosen[-1][2])
            self.emit(chosen, size)
            left -= size

    def batch(self) -> pa.RecordBatch:
        docs, starts, ids, totals, sequences, offsets, sizes, steps = zip(*self.rows, strict=True)
        self.rows = []
        ends = np.concatenate([[0], np.cumsum([x.nbytes for x in ids])]).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids))])
        longs = (docs, starts, [len(x) for x in ids], None, totals, sequences, offsets, sizes, steps)
        return pa.RecordBatch.from_arrays([binary if x is None else pa.array(x, pa.int64()) for x in longs], [c.split()[0] for c in SCHEMA.split(", ")])


def _packed(path: str | None, contexts: tuple[int, ...], step_tokens: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or default_tokenizer()
        packer = Packer(contexts, step_tokens, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for at, texts in byte_slices(batch.column(1)):
                for doc, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist(), strict=True):
                    packer.add(doc, token_ids(text, file))
                if packer.rows:
                    yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    return over


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, contexts: tuple[int, ...] = CONTEXTS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, context, step.

    Each id of each row's text (null: empty, so that only the end id 1 remains) lies in one piece.
    contexts are rising powers of two; sequences are full but for none: the last of a task have
    lengths of lower powers of two. Tasks pack apart from each other, so nothing is shuffled, and a
    lost task is packed again as before. A repeated row is packed again; a null id is kept as null.
    Other columns are not looked at. An empty table gives no rows. (sequence_id, offset) is unique;
    steps count from 0 within a task and context.
    """
    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(_packed(tokenizer, contexts, step_tokens), SCHEMA)
