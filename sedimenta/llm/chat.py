"""Chat formatting by columnar byte assembly.

A turn is written as ``<turn ROLE>\\nTEXT</turn>\\n``; in roles and texts each
``<``, ``>`` and ``\\`` gets a ``\\`` before it, so no text can hold a marker and
reading back is exact. Lengths, offsets and scatter indices of a whole batch
are computed with numpy, and headers and contents are copied into one buffer.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = b"<turn ", b">\n", b"</turn>\n"
TRAINED_ROLE = "assistant"
#: A block ends after about so many bytes; a longer turn is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of text assembled at once.
SLICE_BYTES = 4 << 20
#: Bytes of a text from which on it is copied whole, and bytes whose code points are counted together.
LARGE, PART = 1 << 16, 1 << 20
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[list(b"<>\\")] = True
_HEADER = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.DOTALL)
_MARK = re.compile(r"\\(.)", re.DOTALL)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _escape(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    marks = np.flatnonzero(_ESCAPED[data])
    if not len(marks):
        return offsets, data
    out = np.empty(len(data) + len(marks), dtype=np.uint8)
    plain = np.ones(len(out), dtype=bool)
    plain[marks + np.arange(len(marks))] = False
    out[plain] = data
    out[~plain] = ord("\\")
    return offsets + np.searchsorted(marks, offsets), out


def _scatter(out: np.ndarray, to: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy each segment of ``data`` to its place: small ones by one scatter, each large one whole, as its indices would take many times its bytes."""
    size = np.diff(offsets)
    for i in np.flatnonzero(size > LARGE):
        out[to[i] : to[i] + size[i]] = data[offsets[i] : offsets[i + 1]]
    small = size <= LARGE
    many = size[small]
    source = np.repeat(offsets[:-1][small] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    out[source + np.repeat((to - offsets[:-1])[small], many)] = data[source]


def _stamp(out: np.ndarray, to: np.ndarray, what: bytes) -> None:
    out[to[:, None] + np.arange(len(what))] = np.frombuffer(what, dtype=np.uint8)


def _points(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each place of ``at``; counted a part at a time."""
    found, before = np.zeros(len(at), dtype=np.int64), 0
    for first in range(0, len(out), PART):
        seen = np.concatenate([[0], np.cumsum((out[first : first + PART] & 0xC0) != 0x80)])
        here = (at >= first) & (at <= first + PART)
        found[here] = before + seen[at[here] - first]
        before += int(seen[-1])
    return found


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array, block_bytes: int = BLOCK_BYTES) -> list[pa.Array]:
    """Columns conv_id, n_turns, text, spans, n_chars of the blocks that consecutive turns make."""
    n = len(conv)
    role_at, role_data = _escape(*_bytes(role))
    text_at, text_data = _escape(*_bytes(text))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(role_n + text_n + len(OPEN) + len(AFTER_ROLE) + len(CLOSE))
    start = np.concatenate([[0], ends[:-1]])
    if ends[-1] >= 1 << 31:
        raise ValueError("a turn takes 2 GiB or more when it is formatted")
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    role_to = start + len(OPEN)
    text_to = role_to + role_n + len(AFTER_ROLE)
    _stamp(out, start, OPEN)
    _scatter(out, role_to, role_at, role_data)
    _stamp(out, role_to + role_n, AFTER_ROLE)
    _scatter(out, text_to, text_at, text_data)
    _stamp(out, ends - len(CLOSE), CLOSE)

    key = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    run = np.concatenate([[True], key[1:] != key[:-1]])
    part = (start - start[np.maximum.accumulate(np.where(run, np.arange(n), 0))]) // block_bytes
    first = np.flatnonzero(run | np.concatenate([[False], part[1:] != part[:-1]]))
    last = np.append(first[1:], n)
    block_of = np.repeat(np.arange(len(first)), last - first)
    trained = pc.fill_null(pc.equal(role, TRAINED_ROLE), False).to_numpy(zero_copy_only=False)
    blocks = np.append(start[first], ends[-1])
    edges = _points(out, blocks)
    base = edges[:-1][block_of[trained]]
    spans = pa.StructArray.from_arrays([pa.array(_points(out, text_to[trained]) - base), pa.array(_points(out, text_to[trained] + text_n[trained]) - base)], names=["start", "end"])
    span_at = np.concatenate([[0], np.cumsum(np.bincount(block_of[trained], minlength=len(first)))]).astype(np.int32)
    return [
        conv.take(pa.array(first)),
        pa.array(last - first),
        pa.StringArray.from_buffers(len(first), pa.py_buffer(blocks.astype(np.int32)), pa.py_buffer(out)),
        pa.ListArray.from_arrays(pa.array(span_at), spans),
        pa.array(np.diff(edges)),
    ]


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of formatted turns: conv_id, block, n_turns, text, spans (start and end of each trained text in code points of the block), n_chars.

    Turns are dealt by ranges of (conversation, turn), so a very long
    conversation is formatted by many tasks; its text is that of its blocks in
    the order of ``block``. Rows of equal turn number come in the order of role
    and text, and repeated rows are turns each; null turns come first; null
    roles and texts are empty; rows without a conversation make one of their own
    with a null id. An empty table gives no blocks. A very long turn takes a few
    times its bytes of memory; one that takes 2 GiB or more, escaped, is an error.
    """
    names = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*[F.col(c).alias(a) for c, a in zip((conv_col, turn_col, role_col, text_col), names, strict=True)])
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*names)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            cuts = np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                conv, count, text, spans, chars = assemble(part.column("conv_id"), part.column("role"), part.column("text"), block_bytes)
                yield pa.RecordBatch.from_arrays([conv, pa.array(np.arange(block, block + len(conv))), count, text, spans, chars], names=["conv_id", "block", "n_turns", "text", "spans", "n_chars"])
                block += len(conv)

    return dealt.mapInArrow(run, f"conv_id {kind}, block long, n_turns long, text string, spans array<struct<start: long, end: long>>, n_chars long")


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a block. An escaped ``>`` has a mark before it, so ``</turn>`` is only ever a marker."""
    turns = []
    for turn in text.split(CLOSE.decode())[:-1]:
        head = _HEADER.match(turn)
        turns.append((unescape(head[1]), unescape(turn[head.end() :])))
    return turns


def digests(blocks: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its blocks: counts and SHA-256 of its turns and of its trained texts.

    A digest of a whole conversation is one chain, so one task reads a
    conversation's blocks in order, holding one at a time.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    dealt = blocks.select("conv_id", "block", "text", "spans", "n_chars").repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches):
        now, state, kind_of = None, None, None

        def row():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            done, kind_of = [], batch.column("conv_id").type
            for conv, text, spans, chars in zip(*(batch.column(c) for c in ("conv_id", "text", "spans", "n_chars")), strict=True):
                conv, text = conv.as_py(), text.as_py()
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans.as_py():
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += chars.as_py()
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=out(kind_of))
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))], schema=out(kind_of))

    def out(conv_type):
        return pa.schema(list(zip(names, [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
