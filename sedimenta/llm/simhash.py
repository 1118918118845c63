"""Near-duplicates by SimHash, found through a Golay code.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Two
fingerprints that differ in at most three bits differ in at most one bit in at
least two of the segments (two segments with two errors each would make four).
The perfect Golay code [23, 12, 7] puts each segment within three bits of
exactly one codeword; so if segments differ by one bit at most, the codeword of
the one lies within four bits of the other. Each fingerprint is stored under
the codeword indices of each pair of segments and looked up under all those
within four bits (one or six a segment); what meets is verified bit by bit.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.llm.components import components
from sedimenta.llm.storage import discard, located, materialize, plain, restored, small

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 3
_LANES = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles of a text, repeats counted; zero without words.

    Words are runs of anything but the bytes 9-13 and 32; A-Z are lower-cased.
    With fewer than ``width`` words the whole sequence is the only shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    tails = [words[i:] for i in range(min(width, len(words)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*tails, strict=False)), dtype="<u8")
    return _votes(hashes)


def _votes(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((votes * 2 > len(hashes)).astype(np.uint64) << _LANES).sum())


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 12-bit half's top part, error pattern of each syndrome), by dividing by the generator."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [syndrome(1 << i) for i in range(23)]
    errors = np.zeros(2048, dtype=np.int32)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    heads = np.array([syndrome(h << 11) for h in range(4096)], dtype=np.int32)
    return heads, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the only codeword within three bits of each 23-bit word."""
    heads, errors = golay_tables()
    words = words.astype(np.int32)
    return (words ^ errors[heads[words >> 11] ^ (words & 2047)]) >> 11


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index) of all codewords within four bits of each word, without repeats.

    A codeword at distance four is the nearest one of a word with one bit
    flipped towards it, so flipping each bit in turn finds them all.
    """
    heads, errors = golay_tables()
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int32)
    flipped = words.astype(np.int32)[:, None] ^ flips[None, :]
    index = np.sort(nearest(flipped.ravel()).reshape(flipped.shape), axis=1)
    fresh = np.ones(index.shape, dtype=bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    where, at = np.nonzero(fresh)
    return where, index[where, at]


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [((prints >> np.uint64(first)) & np.uint64((1 << wide) - 1)).astype(np.int32) for first, wide in SEGMENTS]


def stored_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): three keys a fingerprint, one for each pair of segments."""
    near = [nearest(s) for s in _segments(prints)]
    keys = np.stack([(t << 24) | (near[i] << 12) | near[j] for t, (i, j) in enumerate(PAIRS)], axis=1)
    return np.repeat(np.arange(len(prints)), 3), keys.ravel()


def lookup_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): for each pair of segments, all combinations of nearby codewords."""
    n, found = len(prints), [nearby(s) for s in _segments(prints)]
    starts = [np.searchsorted(where, np.arange(n + 1)) for where, _ in found]
    out = []
    for t, (i, j) in enumerate(PAIRS):
        where, left = found[i]
        many = np.diff(starts[j])[where]
        first = np.repeat(np.arange(len(where)), many)
        inner = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        right = found[j][1][starts[j][:-1][where[first]] + inner]
        out.append((where[first], (t << 24) | (left[first] << 12) | right))
    return np.concatenate([w for w, _ in out]), np.concatenate([k for _, k in out])


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fp``, the fingerprint as a signed long; texts go no further."""
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = chosen.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column("__text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(prints.view(np.int64))], names=[*keep, "fp"])

    return chosen.mapInArrow(run, schema)


def _keyed(prints: DataFrame, keys) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                where, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[where])], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key int, fp long")


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b), a > b: every pair of different fingerprints in ``prints(fp)`` that differ in at most three bits; ``prints`` holds each once."""
    stored = _keyed(prints, stored_keys).withColumnRenamed("fp", "b")
    looked = _keyed(prints, lookup_keys).withColumnRenamed("fp", "a")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = looked.join(stored.hint("shuffle_merge"), (looked["key"] == stored["key"]) & (differ >= 1) & (differ <= MAX_BITS))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, fp, root (a fingerprint that names the group), component_id and the columns of ``carry``.

    Rows link if their fingerprints differ in at most three bits, equal ones
    included; component_id is the least id reachable. Null and empty texts
    have fingerprint zero and link like any other; null ids are larger than
    all others (null only if no row reachable has an id); repeated rows stay
    repeated; an empty table gives an empty result.
    """
    prints = materialize(with_fingerprints(docs.withColumn("__id", F.col(id_col)), text_col, width, ("__id", *carry)), "simhash-prints")
    unique = materialize(prints.groupBy("fp").agg(F.min("__id").alias("least_id")), "simhash-unique")
    linked = components(near_links(unique))
    grouped = unique.join(linked.hint("shuffle_merge"), F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    roots = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(grouped.join(roots, "root").select("fp", "root", "component_id"), "simhash-named")
    return prints.join(named.hint("shuffle_merge"), "fp").select(F.col("__id").alias("id"), "fp", "root", "component_id", *carry)


#: Words of a shingle and least similarity of near-duplicate texts.
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: Buckets in which shingles are counted to order them, rare ones first; a bound on what tasks are sent, not on what is compared.
_SKETCH_BITS, _SKETCH_PARTS = 21, 32
#: Members of another component a text is compared with in each round; in the last with all.
_NEAREST = (4, 16, None)


def shingle_set(text: str | None, width: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles; words and short texts as in :func:`fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    tails = [words[i:] for i in range(min(width, len(words)))]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s)) for s in zip(*tails, strict=False)), dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones, one."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def set_name(shingles: np.ndarray) -> int:
    """The signed 64-bit hash that stands for a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that ascend as they do, eight to a doubling. Any common order of shingles will do for a prefix filter; a byte is all that tasks and the driver have to hold of a bucket."""
    return np.minimum(np.round(8 * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _sketch(texts: DataFrame) -> np.ndarray:
    """The :func:`frequency_class` of how many of ``texts(text)`` hold a shingle of each bucket."""
    width = (1 << _SKETCH_BITS) // _SKETCH_PARTS

    def count(batches):
        held = np.zeros(1 << _SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(held, (shingle_set(text.as_py()) >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64), 1)
        if held.any():
            for part in range(_SKETCH_PARTS):
                yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([held[part * width : (part + 1) * width].tobytes()])], names=["part", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(counts.as_py(), dtype=np.int64)
        for part, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([frequency_class(counts).tobytes()])], names=["part", "counts"])

    out = np.zeros(1 << _SKETCH_BITS, dtype=np.uint8)
    schema = "part int, counts binary"
    for r in texts.select("text").mapInArrow(count, schema).repartition(_SKETCH_PARTS, "part").mapInArrow(add, schema).collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out


def prefix(shingles: np.ndarray, sketch: np.ndarray, least: float) -> np.ndarray:
    """The shingles, in the common order (rare buckets first, then by hash), of which two sets at least ``least`` similar share one."""
    many = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1
    order = np.argsort(sketch[(shingles >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)], kind="stable")
    return shingles[order[:many]]


def _may_be(n, at, other_n, other_at, least: float):
    """Whether sets of ``n`` and ``other_n`` whose first common shingle stands at these places of their orders can be similar; of numbers, arrays or columns."""
    left, right = n - at, other_n - other_at
    together = least / (1 + least) * (n + other_n) - 1e-6
    return (n >= least * other_n - 1e-6) & (other_n >= least * n - 1e-6) & (left >= together) & (right >= together)


def _postings(texts: DataFrame, sketch: np.ndarray, least: float) -> DataFrame:
    """(key, node, n, at, bits, prev, prev_n, prev_at) for each prefix shingle ``key`` that several of ``texts(text)`` hold.

    ``n`` is the size of the set, ``at`` the shingle's place in its order,
    ``bits`` the set's fingerprint, ``prev`` the text before it under the key.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sketch.tobytes())

    def run(batches):
        sketch = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [x for x in (shingle_set(t.as_py()) for t in batch.column("text")[at : at + 256]) if len(x)]
                heads = [prefix(x, sketch, least) for x in sets]
                if not heads:
                    continue
                many = np.array([len(h) for h in heads])
                names = np.array([set_name(x) for x in sets], dtype=np.int64)
                places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                sizes = np.array([len(x) for x in sets])
                bits = np.array([_votes(x) for x in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(names, many)), pa.array(np.repeat(sizes, many).astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(np.repeat(bits, many))],
                    names=["key", "node", "n", "at", "bits"],
                )

    rows = texts.select("text").mapInArrow(run, "key long, node long, n int, at int, bits long")
    order = W.partitionBy("key").orderBy("n", "node")
    beside = rows.select("*", *[F.lag(c).over(order).alias(f"prev{end}") for c, end in (("node", ""), ("n", "_n"), ("at", "_at"))], F.lead("node").over(order).alias("next"))
    return beside.where("prev is not null or next is not null").drop("next")


def _across(postings: DataFrame, least: float, nearest: int | None) -> DataFrame:
    """(a, b), a > b: nodes of ``postings(key, node, n, at, bits, component)`` that share a key, may be similar and are not yet in one component.

    All such pairs or, if ``nearest`` is given, under each key for a node only so
    many of another component: those whose fingerprints are nearest to its own.
    """

    def pairs(node, n, at, bits, component):
        order = np.argsort(component, kind="stable")
        node, n, at, bits, component = node[order], n[order], at[order], bits[order], component[order]
        first = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
        if len(first) == 1:
            return
        # Small components first: work is done for pairs of different ones only.
        many = np.diff(np.append(first, len(node)))
        by_size = np.argsort(many, kind="stable")
        order = np.concatenate([np.arange(first[i], first[i] + many[i]) for i in by_size])
        node, n, at, bits, component, ends = node[order], n[order], at[order], bits[order], component[order], np.repeat(np.cumsum(many[by_size]), many[by_size])
        for i in range(len(node) - int(many[by_size[-1]])):
            rest = int(ends[i])
            good = np.flatnonzero(_may_be(n[i], at[i], n[rest:], at[rest:], least)) + rest
            if nearest and len(good) > 1:
                good = good[np.lexsort((np.bitwise_count(bits[good].view(np.uint64) ^ bits[i].view(np.uint64)), component[good]))]
                good = good[np.arange(len(good)) - np.searchsorted(component[good], component[good]) < nearest]
            if len(good):
                yield np.maximum(node[good], node[i]), np.minimum(node[good], node[i])

    def run(batches):
        now, held = None, []

        def done():
            out, size = [], 0
            for pair in pairs(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else ():
                out.append(pair)
                size += len(pair[0])
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

        for batch in batches:
            key, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "n", "at", "bits", "component"))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for x, y in zip(starts, [*starts[1:], len(key)], strict=True):
                if key[x] != now:
                    yield from done()
                    now, held = key[x], []
                held.append(tuple(c[x:y].astype(np.int64) for c in columns))
        yield from done()

    mixed = postings.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    # Dealt again, as a skewed join may split a key over tasks.
    listed = postings.join(mixed.hint("shuffle_merge"), "key").repartition("key").sortWithinPartitions("key")
    return listed.select("key", "node", "n", "at", "bits", "component").mapInArrow(run, "a long, b long").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(node, shingles)`` are at least that similar."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            good = [similarity(np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)) >= least for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("shuffle_merge"), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("shuffle_merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` once ``links(a, b)`` join their groups; only names of groups that are linked are compared."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("x")).hint("shuffle_merge")
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("y")).hint("shuffle_merge")
    between = links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    named = materialize(components(between), "simhash-joined")
    moved = small(named.select(F.col("node").alias("root"), "component"))
    return materialize(roots.join(moved, "root", "left").select("node", F.coalesce("component", "root").alias("root")), "simhash-roots")


def similar_groups(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """(root, component_id, __id, __file, __row) for each row of :func:`located` ``docs``, linked as in :func:`near_groups` or by similar texts.

    Texts are similar if their sets of five-word shingles are. Of two such sets
    the rarest fifth of either shares a shingle (prefix filter), so every pair
    is met. First each text is compared with the one before it under such a
    shingle, which gathers large groups by few comparisons; then, twice, with
    the few texts of each other component that look nearest, so that what strayed from a large group
    joins it without meeting all its members; then all that still are in
    different components are compared. Each is verified on the whole sets.
    """

    def prints(batches):
        for batch in batches:
            said = [t.as_py() for t in batch.column("__text")]
            fp = np.array([fingerprint(t, width) for t in said], dtype=np.uint64).view(np.int64)
            names = np.array([set_name(shingle_set(t)) for t in said], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("__id", "__file", "__row")] + [pa.array(fp), pa.array(names)], names=["__id", "__file", "__row", "fp", "node"])

    def shingled(batches):
        for batch in batches:
            blobs = [shingle_set(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, type=pa.binary())], names=["node", "shingles"])

    chosen = docs.select(F.col(id_col).alias("__id"), "__file", "__row", F.col(text_col).alias("__text"))
    kind = chosen.schema["__id"].dataType.simpleString()
    seen = materialize(chosen.mapInArrow(prints, f"__id {kind}, __file string, __row long, fp long, node long"), "simhash-prints")
    nodes = materialize(seen.groupBy("node").agg(F.min(F.struct("__file", "__row")).alias("p")).select("node", "p.__file", "p.__row"), "simhash-nodes")
    repeats = materialize(seen.select("__file", "__row").join(nodes.hint("shuffle_merge"), ["__file", "__row"], "left_anti"), "simhash-repeats")
    texts = docs.select("__file", "__row", F.col(text_col).alias("text")).join(small(repeats), ["__file", "__row"], "left_anti")

    known = seen.select("fp", "node").distinct()
    heads = materialize(known.groupBy("fp").agg(F.min("node").alias("head")), "simhash-heads")
    close = near_links(heads)
    named = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")).hint("shuffle_merge")
    other = heads.select(F.col("fp").alias("b"), F.col("head").alias("y")).hint("shuffle_merge")
    by_bits = close.join(named, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = known.join(heads.hint("shuffle_merge"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialize(nodes.join(asked, "node").select("node", "__file", "__row"), "simhash-wanted")
        sets = materialize(docs.select("__file", "__row", F.col(text_col).alias("text")).join(small(wanted), ["__file", "__row"]).select("node", "text").mapInArrow(shingled, "node long, shingles binary"), "simhash-sets")
        return _similar(pairs, sets, least)

    postings = materialize(_postings(texts, _sketch(texts), least), "simhash-postings")
    beside = postings.where(F.col("prev").isNotNull() & _may_be(F.col("n"), F.col("at"), F.col("prev_n"), F.col("prev_at"), least))
    pairs = materialize(beside.select(F.greatest("node", "prev").alias("a"), F.least("node", "prev").alias("b")).distinct(), "simhash-pairs")
    links = materialize(by_bits.unionByName(same).unionByName(verified(pairs)), "simhash-links")
    linked = components(links).hint("shuffle_merge")
    roots = materialize(nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("root")), "simhash-roots")
    for nearest in _NEAREST:
        grouped = postings.join(roots.hint("shuffle_merge"), "node").select("key", "node", "n", "at", "bits", F.col("root").alias("component"))
        grouped = materialize(grouped, "simhash-grouped")
        apart = materialize(_across(grouped, least, nearest).join(pairs.hint("shuffle_merge"), ["a", "b"], "left_anti"), "simhash-apart")
        discard(grouped)
        more = materialize(verified(apart), "simhash-more")
        pairs = pairs.unionByName(apart)
        if not more.isEmpty():
            roots = _joined(roots, more)

    rows = materialize(seen.join(roots.hint("shuffle_merge"), "node").select("__id", "__file", "__row", "root"), "simhash-rows")
    # Written first, so that both sides are plain shuffles, of which Spark splits a very large group.
    leads = materialize(rows.groupBy("root").agg(F.min("__id").alias("component_id")), "simhash-leads")
    return rows.join(leads.hint("shuffle_merge"), "root").select("root", "component_id", "__id", "__file", "__row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, least: float | None = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group the row with the least id (of equal ids the first by place).

    Groups are those of :func:`near_groups`, joined where texts are at least
    ``least`` similar by five-word shingles (None: not at all).
    """
    docs, names = plain(docs)
    docs = located(docs)
    if least is None:
        groups = near_groups(docs, names[id_col], names[text_col], width, ("__file", "__row")).withColumnRenamed("id", "__id")
    else:
        groups = similar_groups(docs, names[id_col], names[text_col], width, least)
    # The least id of a group is known; a repeated id leaves several rows, of which the first by place stays.
    lead = groups.where(F.col("__id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("__file", "__row")).alias("p"))
    stays = lead.select(F.col("p.__file").alias("__file"), F.col("p.__row").alias("__row"))
    gone = materialize(groups.select("__file", "__row").join(stays, ["__file", "__row"], "left_anti"), "simhash-gone")
    return restored(docs.join(small(gone), ["__file", "__row"], "left_anti"), names)
