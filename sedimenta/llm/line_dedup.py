"""Removing line runs that occur earlier in the corpus.

Lines that occur once break every run and go at once. Over the others a
suffix array is built by distributed prefix doubling. A line's identifier is
its rank among the repeated lines; round k ranks the pairs (rank of the first
2^k lines, rank of the 2^k after them) in a range sort, so ranks ascend as the
suffixes do, and suffixes with one rank are an interval of the array whose
longest common prefix is at least 2^(k+1) lines. A suffix that shares its rank
with no other leaves. An interval of exactly m lines has two, overlapping,
ranks of 2^floor(log2 m) lines: at its start and at its end.

A line weighs its words, at least one, and a run counts if it weighs
``min_weight`` or more. So the array is needed only down to the intervals that
first reach that weight: their runs, minimal in that they reach it only with
the last line, or only with the first, have at most ``min_weight`` lines. A
maximal repeated run of the weight is covered by such runs, and each of them
occurs earlier wherever the maximal one does; so deleting all of them that have
an earlier copy deletes exactly the later copies of the maximal runs.

Sides that grow with the input are joined by shuffles at every size, and a
table is dropped when what was made of it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.llm.storage import discard, located, materialize, plain, small

#: Bits of a position that number the line; the rest number the document.
LINE_BITS = 26


def _ordered(docs: DataFrame) -> DataFrame:
    """(file, row, d): documents numbered from 0 in the order of id and place."""
    dealt = docs.select("id", "file", "row").repartitionByRange("id", "file", "row").sortWithinPartitions("id", "file", "row")
    marked = materialize(dealt.select("file", "row", F.monotonically_increasing_id().alias("m")), "line-order")
    part = F.shiftright("m", 33)
    ahead = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition: as many as the session's shuffles have.
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    numbered = marked.withColumn("part", part).join(F.broadcast(ahead), "part").select("file", "row", (F.col("ahead") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("d"))
    out = materialize(numbered, "line-docs")
    discard(marked)
    return out


def _minimal_runs(lines: DataFrame, min_weight: int) -> DataFrame:
    """(start, m) of the runs of consecutive ``lines(pos, weight)`` that reach the weight only with their last or only with their first line."""
    doc = F.shiftright("pos", LINE_BITS)
    rows = lines.select("pos", "weight", doc.alias("d"))
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("d").orderBy("pos")))
    line = W.partitionBy("d", "island").orderBy("pos")
    sums = rows.withColumn("sum", F.sum(F.col("weight").cast("long")).over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    near = sums.withColumn("ahead", F.collect_list("sum").over(line.rowsBetween(W.currentRow, min_weight - 1)))
    near = near.withColumn("behind", F.collect_list(F.col("sum") - F.col("weight")).over(line.rowsBetween(-(min_weight - 1), W.currentRow)))
    forward = F.size(F.filter("ahead", lambda s: s - F.col("sum") + F.col("weight") < min_weight)) + 1
    backward = F.size(F.filter("behind", lambda s: F.col("sum") - s < min_weight)) + 1
    runs = near.select("pos", forward.alias("f"), (forward <= F.size("ahead")).alias("fok"), backward.alias("b"), (backward <= F.size("behind")).alias("bok"))
    first = runs.where("fok").select(F.col("pos").alias("start"), F.col("f").cast("long").alias("m"))
    last = runs.where("bok and b > 1").select((F.col("pos") - F.col("b") + 1).alias("start"), F.col("b").cast("long").alias("m"))
    return first.unionByName(last)


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, name) of ``rows(pos, *keys)`` whose keys occur more than once; ``name`` ascends as the keys do.

    The groups are written before they are joined back: then both sides of
    the join are plain shuffles, of which Spark splits a partition that a very
    common key swells.
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    ranks = materialize(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "line-ranks")
    named = materialize(rows.join(ranks.hint("shuffle_merge"), keys).select("pos", "name"), "line-names")
    discard(ranks)
    return named


def _doubled(named: DataFrame, span: int) -> DataFrame:
    """From (pos, name) over ``span`` lines those over twice as many, where the doubled run occurs more than once."""
    later = named.select((F.col("pos") - span).alias("pos"), F.col("name").alias("tail"))
    pairs = named.join(later.hint("shuffle_merge"), "pos").where((F.col("pos").bitwiseAND((1 << LINE_BITS) - 1) + span) < (1 << LINE_BITS))
    pairs = materialize(pairs.select("pos", "name", "tail"), "line-pairs")
    out = _ranked(pairs.withColumnRenamed("name", "head"), ["head", "tail"])
    discard(pairs)
    return out


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_weight: int = 50) -> DataFrame:
    """(file, row, spans): for each row of :func:`located` ``docs`` (columns file, row) that loses lines, the runs of line numbers (from, to), both included."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "file", "row")
    split = chosen.select("file", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    words = F.regexp_count("said", F.lit(r"[^\x20\x09-\x0D]+"))
    # 128 bits of a digest tell lines apart.
    digest = F.substring(F.unhex(F.sha2("said", 256)), 1, 16)
    lines = materialize(split.select("file", "row", F.col("line").cast("long").alias("line"), digest.alias("digest"), F.greatest(words, F.lit(1)).alias("weight")), "line-rows")

    # Which lines recur is counted by 64 bits of the digest: a chance meeting only keeps a line that the ranks then drop.
    brief = F.xxhash64("digest")
    again = materialize(lines.groupBy(brief.alias("brief")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("brief"), "line-again")
    order = _ordered(chosen)
    number = F.when(F.col("line") < (1 << LINE_BITS), F.shiftleft("d", LINE_BITS) + F.col("line")).otherwise(F.raise_error(F.lit("a text has too many lines")).cast("long"))
    repeated = lines.join(again.hint("shuffle_merge"), brief == F.col("brief"), "left_semi").join(order.hint("shuffle_merge"), ["file", "row"])
    repeated = materialize(repeated.select(number.alias("pos"), "digest", "weight"), "line-repeated")
    discard(lines, again)
    level = _ranked(repeated.select("pos", "digest"), ["digest"])

    runs = materialize(_minimal_runs(repeated, min_weight), "line-runs")
    discard(repeated)
    longest = runs.agg(F.max("m")).first()[0] or 0
    levels, k = [level], 0
    while 2 << k <= longest:
        levels.append(level := _doubled(level, 1 << k))
        k += 1
    names = levels[0].select(F.lit(0).alias("k"), "pos", "name")
    for k, level in enumerate(levels[1:], 1):
        names = names.unionByName(level.select(F.lit(k).alias("k"), "pos", "name"))

    depth = F.floor(F.log2(F.col("m").cast("double"))).cast("int")
    ends = runs.withColumn("k", depth).withColumn("last", F.col("start") + F.col("m") - F.expr("shiftleft(1L, k)"))
    head = names.select("k", F.col("pos").alias("start"), F.col("name").alias("head"))
    tail = names.select("k", F.col("pos").alias("last"), F.col("name").alias("tail"))
    whole = ends.join(head.hint("shuffle_merge"), ["k", "start"]).join(tail.hint("shuffle_merge"), ["k", "last"])
    whole = materialize(whole.select("start", "m", "head", "tail"), "line-whole")
    discard(runs, *levels)
    firsts = materialize(whole.groupBy("m", "head", "tail").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-firsts")
    copies = whole.join(firsts.hint("shuffle_merge"), ["m", "head", "tail"]).where("start > first").select("start", "m").distinct()
    gone = copies.select(F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("pos")).distinct()

    gone = gone.select(F.shiftright("pos", LINE_BITS).alias("d"), F.col("pos").bitwiseAND((1 << LINE_BITS) - 1).alias("line"))
    island = gone.withColumn("island", F.col("line") - F.row_number().over(W.partitionBy("d").orderBy("line")))
    spans = island.groupBy("d", "island").agg(F.struct(F.min("line").alias("from"), F.max("line").alias("to")).alias("span"))
    spans = spans.groupBy("d").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    out = materialize(order.join(spans.hint("shuffle_merge"), "d").select("file", "row", "spans"), "line-spans")
    discard(order, whole, firsts)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_weight: int = 50) -> DataFrame:
    """``docs`` with repeated line runs removed from the text, and n_lines, removed (lines) and spans beside its columns.

    The order that decides what is a later copy is that of the ids (a null id
    first, equal ids by place) and lines; copies within one text count too. A
    text that loses all lines becomes empty, a null text stays null and has one,
    empty, line; repeated rows lose what the first of them keeps; columns of the
    names added are replaced; an empty table gives no rows. A text of more than
    2^26 lines is an error.
    """
    docs, names = plain(docs)
    out = {c: n for c, n in names.items() if c not in ("n_lines", "removed", "spans")}
    text = names[text_col]
    placed = located(docs)
    spans = removed_spans(placed.withColumnsRenamed({"__file": "file", "__row": "row"}), names[id_col], text, min_weight)
    spans = spans.select(F.col("file").alias("__file"), F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    joined = placed.join(small(spans), ["__file", "__row"], "left")
    said = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    left = F.filter(said, lambda x, i: ~F.exists("__spans", lambda s: (i >= s["from"]) & (i <= s["to"])))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"] + 1)
    cleaned = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[(cleaned if n == text else F.col(n)).alias(c) for c, n in out.items()],
        F.size(said).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("removed"),
        F.col("__spans").alias("spans"),
    )
