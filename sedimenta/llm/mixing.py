"""Interleaving sources by Pfair scheduling.

A source's documents form a line, cut into blocks of equal size. With share c
of H in all, block j of a source may run from slot floor(j * H / c) and must run
before slot ceil((j + 1) * H / c). Taking at each slot the released block with
the earliest deadline meets every deadline, so at any slot each source is less
than one block away from its share. The schedule repeats after H slots: one
period is computed, and a document finds its slot from its source and block.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.llm.storage import materialize, plain, restored

#: Most sources that can be mixed: their totals and schedule are held by the driver.
MAX_SOURCES = 1000
#: Slots of a period times its sources at most: what the driver schedules and sends to all tasks.
MOST_SLOTS = 2_000_000
#: Rows of a source that one task orders at a time, on average.
BUCKET_ROWS = 2048
#: Buckets of a source that one task adds up at a time, as a power of two.
SUPER_BITS = 12
_NULL = "\0null"


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of sum(shares) slots, by earliest deadline first."""
    total = sum(shares.values())
    waiting = [(0, -(-total // c), name, 0) for name, c in sorted(shares.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {name: [] for name in shares}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, deadline, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, j))
        _, name, j = heapq.heappop(ready)
        slots[name].append(slot)
        c = shares[name]
        if j + 1 < c:
            heapq.heappush(waiting, ((j + 1) * total // c, -(-(j + 2) * total // c), name, j + 1))
    return slots


def phases(shares: dict[str, int], blocks: dict[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, period, slots of a period) until every block is placed.

    When a source has run out, the others go on by their shares alone: a new
    phase. Of a phase shorter than its period only the slots in use are returned.
    """
    done, left, out, start = dict.fromkeys(blocks, 0), {s for s, n in blocks.items() if n}, [], 0
    while left:
        now = {s: shares[s] for s in left}
        total, slots = sum(now.values()), period(now)
        ends = {}
        for s in left:
            last = blocks[s] - done[s] - 1
            ends[s] = last // now[s] * total + slots[s][last % now[s]] + 1
        long = min(ends.values())
        for s in left:
            ran = long // total * now[s] + sum(x < long % total for x in slots[s])
            out.append((s, done[s], done[s] + ran, start, total, slots[s][: max(ran, 1)] if long < total else slots[s]))
            done[s] += ran
        start += long
        left = {s for s in left if done[s] < blocks[s]}
    return out


def whole_shares(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Weights as the least whole shares in exactly their proportions; a float is the decimal it is written as."""
    parts = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if min(parts.values()) <= 0:
        raise ValueError("weights must be greater than zero")
    scale = lcm(*(p.denominator for p in parts.values()))
    whole = {s: int(p * scale) for s, p in parts.items()}
    shared = gcd(*whole.values())
    return {s: c // shared for s, c in whole.items()}


def mix(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, origin, size, start, block, slot and the columns of ``carry``.

    ``size`` is the text's bytes plus one, ``start`` the sum of the sizes before
    it in its source, ``block`` start / block_bytes, ``slot`` the block's place in
    the mixture. Within a source, rows come in the order of a hash of their id
    and text (ties: id, size, another hash of the text; rows that tie in all
    have equal texts). Sources without a weight get the least weight given, or
    1; none is dropped or repeated. A null source is a source of its own, a null
    text is empty, a null id hashes by its text alone; repeated rows keep a
    place each; an empty table gives no rows. At most ``MAX_SOURCES`` sources;
    weights are greater than zero and, as whole shares, add up to at most
    ``MOST_SLOTS`` divided by the number of sources, else it is an error.
    """
    spark = docs.sparkSession
    own = {c: f"__carry{i}" for i, c in enumerate(carry)}
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col), F.lit(_NULL)).alias("origin"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
        F.hash(F.col(text_col)).alias("mark"),
        *[F.col(c).alias(a) for c, a in own.items()],
    )
    many = rows.count()
    bits = max(1, (many // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    sums = materialize(rows.groupBy("origin", "bucket").agg(F.sum("size").alias("bytes")), "mix-sums")
    totals = {r["origin"]: r["b"] for r in sums.groupBy("origin").agg(F.sum("bytes").alias("b")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    given = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in (weights or {"": 1}).items()}
    shares = whole_shares({s: given.get(s, min(given.values())) for s in totals}) if totals else {}
    if sum(shares.values()) * len(shares) > MOST_SLOTS:
        raise ValueError(f"these weights need a period of {sum(shares.values())} slots; use weights with fewer digits")
    plan = phases(shares, {s: -(-b // block_bytes) for s, b in totals.items()})
    table = spark.createDataFrame(plan, "origin string, b0 long, b1 long, slot0 long, period long, slots array<long>")

    # Offsets of buckets by two levels of prefix sums, so no task has all buckets of a source.
    above = F.shiftright("bucket", SUPER_BITS)
    before = W.partitionBy("origin").orderBy("super").rowsBetween(W.unboundedPreceding, -1)
    supers = sums.groupBy("origin", above.alias("super")).agg(F.sum("bytes").alias("bytes"))
    supers = supers.select("origin", "super", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("far"))
    before = W.partitionBy("origin", "super").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    near = sums.withColumn("super", above).withColumn("near", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    offsets = near.join(supers, ["origin", "super"]).select("origin", "bucket", (F.col("near") + F.col("far")).alias("offset"))
    inside = W.partitionBy("origin", "bucket").orderBy("key", "id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets.hint("shuffle_merge"), ["origin", "bucket"]).withColumn("start", F.col("ahead") + F.col("offset"))
    placed = placed.withColumn("block", F.floor(F.col("start") / F.lit(block_bytes)).cast("long"))
    turn = F.col("block") - F.col("b0")
    per = F.size("slots")
    slot = F.col("slot0") + F.floor(turn / per).cast("long") * F.col("period") + F.element_at("slots", (turn % per + 1).cast("int"))
    timed = placed.join(F.broadcast(table), (placed["origin"] == table["origin"]) & (F.col("block") >= F.col("b0")) & (F.col("block") < F.col("b1")))
    return timed.select("id", placed["origin"], "size", "start", "block", slot.alias("slot"), *[F.col(a).alias(c) for c, a in own.items()])


def mixed(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` in the order of the mixture, for writing: partitions and rows within them ascend by slot."""
    docs, names = plain(docs)
    placed = mix(docs, weights, block_bytes, names[id_col], names[text_col], names[source_col], tuple(names.values()))
    return restored(placed.repartitionByRange("slot", "origin", "start").sortWithinPartitions("slot", "origin", "start"), names)
