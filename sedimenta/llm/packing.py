"""Cost-balanced packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens gathered before they are packed together: 512 sequences of 2,048.
CHUNK_SEQUENCES = 512
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 1
#: UTF-8 lead bytes from here on begin characters from U+0280; below, both tokenizer libraries are tested to split alike.
_FAST_BELOW = 0xCA


@lru_cache(maxsize=2)
def exact_tokenizer(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added_strings(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer makes one id wherever they stand in a text."""
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file).get("added_tokens", []))


@lru_cache(maxsize=2)
def fast_tokenizer(path: str) -> tiktoken.Encoding:
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of one text as uint32: those of the tokenizer itself, called with ``add_special_tokens=False``.

    The rank file beside the tokenizer holds the same vocabulary and is four
    times as fast; texts with characters from U+0280 on, whose Unicode tables
    may differ, and texts that hold a string of an added token go to the
    tokenizer itself. Either is loaded when it is needed.
    """
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if (not len(raw) or raw.max() < _FAST_BELOW) and not any(x in text for x in added_strings(path)):
        return fast_tokenizer(path).encode_to_numpy(text, disallowed_special=())
    return np.array(exact_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths.

    Whole multiples of the capacity are cut off and fill sequences of their
    own. What remains goes, longest first (ties: earlier document first), to
    the sequence of lowest cost that has room for all of it; the number of
    sequences is the least possible, so at the end a piece may fit nowhere and
    is cut over the sequences with room, cheapest first. Only the last of the
    room stays empty: less than one sequence in all.
    """
    pieces, rest, sequence = [], [], 0
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity:
            pieces.append((doc, start, capacity, sequence, 0))
            sequence, start = sequence + 1, start + capacity
        if start < n:
            rest.append((n - start, doc, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    many = -(-sum(n for n, _, _ in rest) // capacity)
    used, cost = np.zeros(many, dtype=np.int64), np.zeros(many)

    def put(n: int, doc: int, start: int, s: int) -> None:
        pieces.append((doc, start, n, sequence + s, int(used[s])))
        used[s] += n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for n, doc, start in rest:
        s = int(np.where(used <= capacity - n, cost, np.inf).argmin())
        if used[s] + n <= capacity:
            put(n, doc, start, s)
            continue
        while n:
            s = int(np.where(used < capacity, cost, np.inf).argmin())
            part = min(n, capacity - int(used[s]))
            put(part, doc, start, s)
            n, start = n - part, start + part
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, chunk_sequences: int = CHUNK_SEQUENCES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Each document's ids are followed by one end id. Documents are packed in
    the order of the input, a partition at a time and within it in chunks of
    about ``chunk_sequences`` sequences, so a task holds one chunk and no row is
    shuffled; sequence ids are the partition's number in the high bits and a
    count in the low 40. A null text counts as empty (one end id); null ids are
    carried; repeated rows are packed each; an empty table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    limit = capacity * chunk_sequences

    def run(batches):
        ids, tokens, held, first = [], [], 0, TaskContext.get().partitionId() << 40
        id_type = None

        def flush():
            nonlocal ids, tokens, held, first
            pieces = assign(np.array([len(t) for t in tokens], dtype=np.int64), capacity)
            for at in range(0, len(pieces), 2048):
                doc, start, length, seq, offset = (list(x) for x in zip(*pieces[at : at + 2048], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d in doc], type=id_type),
                        pa.array(start, type=pa.int64()),
                        pa.array(length, type=pa.int64()),
                        pa.array([tokens[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)], type=pa.binary()),
                        pa.array([len(tokens[d]) for d in doc], type=pa.int64()),
                        pa.array([first + s for s in seq], type=pa.int64()),
                        pa.array(offset, type=pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            first += max((p[3] for p in pieces), default=-1) + 1
            ids, tokens, held = [], [], 0

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                tokens.append(np.append(encode(text.as_py(), path), np.uint32(END_ID)).astype("<u4"))
                held += len(tokens[-1])
                if held >= limit:
                    yield from flush()
        if tokens:
            yield from flush()

    return chosen.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
