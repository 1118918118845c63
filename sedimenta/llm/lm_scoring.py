"""Scoring documents by the code length of a model of partial matching, beside a word-frequency base.

Three passes. The first counts, by chunk of documents, byte contexts and words;
both leave a task already summed, as sorted, compressed blocks dealt to shards,
with a count of zero for what is asked only. The shards add up what was learnt;
then each reads its sums, words or a model of its own contexts, and answers the
blocks one by one, so neither the whole model nor all blocks of a shard are ever
in one task. The last pass reads a chunk's answers, then its documents. Texts
longer than ``SLICE_BYTES`` are counted and scored in parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import groupby, repeat
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import ppm
from sedimenta.llm.storage import located, materialize, scan_bytes

#: Documents of a file that ask for word counts together.
CHUNK_ROWS = 2048
#: Different grams that a task holds before it passes them on.
TASK_GRAMS = 1_000_000
#: Bytes of text taken at once.
SLICE_BYTES = 1 << 20
#: Shards at least, and bytes of input (as Spark estimates the scan) for each of more.
SHARDS, SHARD_BYTES = 64, 64 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SCHEMA = "kind string, shard int, chunk long, words binary, counts binary"
_NAMES = ["kind", "shard", "chunk", "words", "counts"]


def _slices(batch: pa.RecordBatch):
    """Parts of a batch whose texts are bounded together."""
    at, held = 0, 0
    for i, text in enumerate(batch.column("text")):
        held += len(text.as_buffer() or b"")
        if held >= SLICE_BYTES:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t.as_buffer().to_pybytes() if t.is_valid else b"").lower() for t in column]


def _packed(values: np.ndarray) -> bytes:
    """Numbers with their bytes apart, compressed: sorted keys and small counts shrink to a third."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Grams:
    """Contexts counted together."""

    def __init__(self):
        self.keys, self.counts, self.loose = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), []

    def add(self, texts: list[bytes], times: int = 1) -> None:
        for _, data, _ in ppm.windows(texts, SLICE_BYTES):
            keys, counts = ppm.summed(ppm.grams(data)[1])
            self.merge(keys, counts * times)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.loose.append((keys, counts))
        if sum(len(k) for k, _ in self.loose) > TASK_GRAMS:
            self.fold()

    def fold(self) -> None:
        parts = [(self.keys, self.counts), *self.loose]
        self.keys, self.counts = ppm.summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.loose = []

    def rows(self, chunk: int, shards: int):
        """Blocks by the context's last two bytes: grams whose shorter contexts add up lie together from order 2 on."""
        self.fold()
        shard = (((self.keys >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) >> np.uint64(8)) % np.uint64(shards)
        for s in np.unique(shard):
            own = shard == s
            yield ("gram", int(s), chunk, _packed(self.keys[own]), _packed(self.counts[own]))
        self.keys, self.counts = self.keys[:0], self.counts[:0]


def _words(text: bytes):
    """The words of a text, a bounded part of it at a time, cut at white space."""
    if len(text) <= SLICE_BYTES:
        yield text.split()
        return
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE_BYTES)
        end = space.end() if space else len(text)
        yield text[at:end].split()
        at = end


def _word_rows(chunk: int, seen: Counter, shards: int):
    """A chunk's words, sorted and dealt to shards: those it trains with their counts, those it only asks for with none."""
    dealt: dict[int, list[bytes]] = {}
    digest = xxhash.xxh32_intdigest
    for word in sorted(seen):
        dealt.setdefault(digest(word) % shards, []).append(word)
    for shard, words in dealt.items():
        counts = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        yield ("word", shard, chunk, zlib.compress(b" ".join(words), 1), _packed(counts))


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _collected(docs: DataFrame, shards: int) -> DataFrame:
    """Gram and word blocks of ``docs(chunk, held, text)``."""

    def run(batches):
        grams, now, seen = _Grams(), None, Counter()
        for batch in batches:
            for part in _slices(batch):
                rows = zip(part.column("chunk").to_pylist(), _texts(part.column("text")), part.column("held").to_pylist(), strict=True)
                for chunk, own in groupby(rows, key=lambda r: r[0]):
                    if chunk != now:
                        if seen:
                            yield _batch(_word_rows(now, seen, shards))
                        if out := list(grams.rows(now, shards)):
                            yield _batch(out)
                        now, seen = chunk, Counter()
                    learnt, asked = [], []
                    for _, text, out in own:
                        (asked if out else learnt).append(text)
                        for words in _words(text):
                            seen.update(dict.fromkeys(words, 0) if out else words)
                    if learnt:
                        grams.add(learnt)
                    if asked:
                        grams.add(asked, 0)
                    if len(grams.keys) > TASK_GRAMS:
                        yield _batch(grams.rows(now, shards))
        if seen:
            yield _batch(_word_rows(now, seen, shards))
        if out := list(grams.rows(now, shards)):
            yield _batch(out)

    return docs.select("chunk", "held", "text").mapInArrow(run, _SCHEMA)


def _by_shard(batches, names):
    """(shard, its rows one by one as tuples of ``names``) of batches sorted by shard."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("shard", *names)), strict=True))
    return groupby(rows, key=lambda r: r[0])


def _add_words(batches):
    """A shard's learnt words with their counts, and how many tokens and words these are; what is held is the different words."""
    schema = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("different", pa.int64())])
    for shard, rows in _by_shard(batches, ("words", "counts")):
        total: Counter = Counter()
        for _, words, counts in rows:
            for word, n in zip(zlib.decompress(words).split(b" "), _unpacked(counts, np.int64).tolist(), strict=True):
                if n:
                    total[word] += n
        if total:
            sums = np.fromiter(total.values(), dtype=np.int64, count=len(total))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "words": zlib.compress(b" ".join(total), 1), "counts": _packed(sums), "tokens": int(sums.sum()), "different": len(sums)}], schema=schema)


def _word_answers(blocks: DataFrame, learnt: DataFrame, shards: int) -> DataFrame:
    """(chunk, words, counts): the words of each block and how often each was learnt."""
    schema = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for _, rows in _by_shard(batches, ("chunk", "words", "counts")):
            total = {}
            for _, chunk, packed, counts in rows:
                words = zlib.decompress(packed).split(b" ")
                if chunk is None:
                    total = dict(zip(words, _unpacked(counts, np.int64).tolist(), strict=True))
                    continue
                counts = np.fromiter(map(total.get, words, repeat(0)), dtype=np.int64, count=len(words))
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "words": packed, "counts": _packed(counts)}], schema=schema)

    told = learnt.select("shard", F.lit(0).alias("ord"), F.lit(None).cast("long").alias("chunk"), "words", "counts")
    asked = blocks.where("kind = 'word'").select("shard", F.lit(1).alias("ord"), "chunk", "words", F.lit(None).cast("binary").alias("counts"))
    dealt = told.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "ord")
    return dealt.mapInArrow(run, "chunk long, words binary, counts binary")


def _add_grams(batches):
    """A shard's learnt grams of each order with their counts; what is held is the different grams, not the blocks.

    Orders 0 and 1 are parts that the driver adds up; they are few.
    """
    schema = pa.schema([("shard", pa.int32()), ("ord", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    for shard, rows in _by_shard(batches, ("words", "counts")):
        own = _Grams()
        for _, keys, counts in rows:
            keys, counts = _unpacked(keys, np.uint64), _unpacked(counts, np.int64)
            own.merge(keys[counts > 0], counts[counts > 0])
        own.fold()
        for j, (k, c, _) in enumerate(ppm.by_order(own.keys, own.counts)):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "ord": j, "keys": _packed(k), "counts": _packed(c)}], schema=schema)


def _gram_answers(blocks: DataFrame, shards: int) -> DataFrame:
    """(chunk, words, counts): the grams of each block and their log probabilities as floats, by the model of all that was learnt."""
    spark = blocks.sparkSession
    own = blocks.where("kind = 'gram'")
    learnt = materialize(own.select("shard", "words", "counts").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_add_grams, "shard int, ord int, keys binary, counts binary"), "lm-grams")
    few = ppm.summed(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for r in learnt.where("ord = 1").toLocalIterator():  # a gram of order 1 may be in several shards
        few = ppm.summed(np.concatenate([few[0], _unpacked(r["keys"], np.uint64)]), np.concatenate([few[1], _unpacked(r["counts"], np.int64)]))
    short = spark.sparkContext.broadcast([ppm.summed(ppm.shortened(few[0], 0)), few])

    def run(batches):
        now, tables, model = None, {}, None
        for batch in batches:
            for shard, order, chunk, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "ord", "chunk", "words", "counts")), strict=True):
                if shard != now:
                    now, tables, model = shard, {}, None
                if chunk is None:
                    tables[order] = _unpacked(keys, np.uint64), _unpacked(counts, np.int64)
                    continue
                if model is None:
                    nothing = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
                    model = ppm.Model([*short.value, *(tables.get(j, nothing) for j in range(2, ppm.ORDER + 1))])
                    tables = {}
                scores = model.score(_unpacked(keys, np.uint64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], type=pa.int64()), pa.array([keys], type=pa.binary()), pa.array([_packed(scores)], type=pa.binary())], names=["chunk", "words", "counts"])

    told = learnt.where("ord > 1").select("shard", "ord", F.lit(None).cast("long").alias("chunk"), F.col("keys").alias("words"), "counts")
    asked = own.select("shard", F.lit(ppm.ORDER + 1).alias("ord"), "chunk", "words", F.lit(None).cast("binary").alias("counts"))
    dealt = told.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "ord")
    return dealt.mapInArrow(run, "chunk long, words binary, counts binary")


def score(docs: DataFrame, held: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` is an SQL condition on ``docs``; rows where it holds are scored but
    not learnt from (null: learnt from). Texts are whole, A-Z lower-cased, null
    as empty. ``base_score`` adds up the logarithms of the tokens' smoothed
    shares, tokens being the words and one end; ``score`` is the log10
    probability of the text's bytes and its end under the byte model. Of
    training texts there may be none: every word is then unknown and all bytes
    alike. Repeated rows are learnt from and scored each; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    placed = located(docs.select(F.col(id_col).alias("id"), F.coalesce(F.expr(held) if held else F.lit(False), F.lit(False)).alias("held"), F.col(text_col).alias("text")))
    rows = placed.select("id", "held", "text", F.xxhash64("__file", F.floor(F.col("__row") / chunk_rows)).alias("chunk"))
    shards = max(SHARDS, scan_bytes(placed) // SHARD_BYTES)
    blocks = materialize(_collected(rows, shards), "lm-blocks")
    said = blocks.where("kind = 'word'").select("shard", "words", "counts").repartition(shards, "shard").sortWithinPartitions("shard")
    learnt = materialize(said.mapInArrow(_add_words, "shard int, words binary, counts binary, tokens long, different long"), "lm-words")
    sums = learnt.agg(F.sum("tokens"), F.sum("different")).first()
    trained = rows.where("not held").count()
    known, different = (sums[0] or 0) + trained, (sums[1] or 0) + (trained > 0)
    whole = log10(known + 0.5 * (different + 1))
    end = log10(trained + 0.5)

    kind = rows.schema["id"].dataType.simpleString()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("id", kind), ("held", "boolean"), ("text", "string"))]
    asked = _word_answers(blocks, learnt, shards).select("chunk", F.lit(0).alias("turn"), *nothing, "words", "counts")
    scored = _gram_answers(blocks, shards).select("chunk", F.lit(1).alias("turn"), *nothing, "words", "counts")
    told = rows.select("chunk", F.lit(2).alias("turn"), "id", "held", "text", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("counts"))
    dealt = asked.unionByName(scored).unionByName(told).repartition("chunk").sortWithinPartitions("chunk", "turn")

    def run(batches):
        now, count, logs, blocks, table = None, {}, np.log10, [], None

        def settle(texts):
            """Scores of a chunk's texts by the chunk's answers."""
            nonlocal blocks, table
            if blocks:
                keys, values = (np.concatenate(x) for x in zip(*blocks, strict=True))
                order = np.argsort(keys, kind="stable")
                blocks, table = [], (keys[order], values[order])
            out = np.zeros(len(texts))
            for first, data, starts in ppm.windows(texts, SLICE_BYTES):
                at, keys = ppm.grams(data)
                out[first : first + len(starts)] += np.add.reduceat(table[1][np.searchsorted(table[0], keys)].astype(np.float64), np.searchsorted(at, starts))
            return out.tolist()

        for batch in batches:
            for part in _slices(batch):
                kept, texts, scores = [], [], []
                n_tokens, n_known, base = [], [], []
                for i, (c, t) in enumerate(zip(part.column("chunk").to_pylist(), part.column("turn").to_pylist(), strict=True)):
                    if c != now:
                        if texts:
                            scores, texts = scores + settle(texts), []
                        now, count, blocks, table = c, {}, [], None
                    if t == 0:
                        words = zlib.decompress(part.column("words")[i].as_py()).split(b" ")
                        count.update(zip(words, _unpacked(part.column("counts")[i].as_py(), np.int64).tolist(), strict=True))
                        continue
                    if t == 1:
                        blocks.append((_unpacked(part.column("words")[i].as_py(), np.uint64), _unpacked(part.column("counts")[i].as_py(), np.float32)))
                        continue
                    text = part.column("text")[i]
                    text = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()
                    many, met, sum_of = 1, int(trained > 0), end
                    for words in _words(text):
                        seen = np.fromiter(map(count.get, words, repeat(0)), dtype=np.int64, count=len(words))
                        many, met, sum_of = many + len(words), met + int((seen > 0).sum()), sum_of + float(logs(seen + 0.5).sum())
                    kept.append(i)
                    texts.append(text)
                    n_tokens.append(many)
                    n_known.append(met)
                    base.append(sum_of - many * whole)
                if not kept:
                    continue
                if texts:
                    scores += settle(texts)
                where = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(where), part.column("held").take(where), pa.array(n_tokens, type=pa.int64()), pa.array(n_known, type=pa.int64()), pa.array([known] * len(kept), type=pa.int64()), pa.array(base, type=pa.float64()), pa.array(scores, type=pa.float64())],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return dealt.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
