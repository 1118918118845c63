"""Byte-identical files and the space that removing the extras would free."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.scalars import base_of, ext_of
from sedimenta.limits import LIMITS, Limits
from sedimenta.operators.ranking import capped, ranked


@dataclass(frozen=True)
class Match:
    """What must agree besides size and content."""

    name: bool = False
    modified: bool = False
    created: bool = False

    def keys(self) -> list[str]:
        return ["name"] * self.name + ["mod_unix"] * self.modified + ["created_unix"] * self.created


def candidates(entries: DataFrame, match: Match = Match()) -> DataFrame:
    """Files with content; with the created date as a criterion, those whose date is known: unknown dates equal nothing."""
    rows = entries.where("not is_dir and not unreadable and size > 0")
    return rows.where("created_unix is not null") if match.created else rows


def colliding(entries: DataFrame, match: Match = Match()) -> DataFrame:
    """Candidates that share size and criteria with another: the only ones whose content must be read.

    Keys are counted by partial aggregation and joined back, so a size that
    very many files share is neither gathered nor sorted in one task.
    """
    keys = ["size", *match.keys()]
    rows = candidates(entries, match)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(hot, keys, "left_semi")


def physical() -> Column:
    """What tells copies on disk apart: device and inode where they are known to be shared, else the path."""
    return F.when((F.col("nlink") > 1) & (F.col("ino") != 0), F.concat_ws(":", "dev", "ino")).otherwise(F.col("path"))


def groups(entries: DataFrame, match: Match = Match(), content: str = "hash") -> DataFrame:
    """size, criteria, hash, names, copies, reclaim, first_path of each set of at least two names on at least two copies.

    Two levels of partial aggregation: names of a copy, then copies of a
    content. What is freed is what all copies hold on disk without the largest.
    """
    keys = ["size", *match.keys(), content]
    copies = candidates(entries, match).groupBy(*keys, physical().alias("phys")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("size") - F.col("holes")).alias("held"), F.min("path").alias("p"))
    whole = copies.groupBy(*keys).agg(F.sum("n").alias("names"), F.count(F.lit(1)).alias("copies"), (F.sum("held") - F.max("held")).alias("reclaim"), F.min("p").alias("first_path"))
    return whole.where("names > 1 and copies > 1")


def ordered(found: DataFrame, limits: Limits | None = None, content: str = "hash") -> DataFrame:
    """Groups by space freed, hash, first path; numbered. With ``limits`` no more than half the cap in rows, as no more can be shown."""
    order = [F.desc("reclaim"), F.col(content), F.col("first_path"), F.col("size")]
    return ranked(found, order, limits and limits.duplicate_rows // 2 + 1).withColumn("ext", ext_of(base_of("first_path")))


def members(entries: DataFrame, numbered: DataFrame, match: Match = Match(), limits: Limits | None = None, content: str = "hash") -> DataFrame:
    """Rows of the groups with rank and pos (by path); with ``limits`` the first ``group_rows`` of each.

    That limit on the position is pushed below the shuffle, so each task
    passes on no more rows of a group than can be shown.
    """
    keys = ["size", *match.keys(), content]
    rows = candidates(entries, match).join(numbered.select(*keys, "rank"), keys)
    pos = F.row_number().over(W.partitionBy("rank").orderBy("path")).cast("long")
    placed = rows.withColumn("pos", pos)
    return placed.where(F.col("pos") <= limits.group_rows) if limits else placed


def totals(found: DataFrame) -> DataFrame:
    """One row: groups, files, bytes, reclaimable."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg(F.count(F.lit(1)).alias("groups"), total("names").alias("files"), total(F.col("size") * F.col("names")).alias("bytes"), total("reclaim").alias("reclaimable"))


def result(entries: DataFrame, match: Match = Match(), limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(groups, members) as stored: ranked, within the caps, ids ``g`` and the rank."""
    kept = capped(ordered(groups(entries, match), limits), limits.duplicate_rows)
    kept = kept.withColumn("id", F.concat(F.lit("g"), F.col("rank").cast("string")))
    return kept, members(entries, kept, match, limits)


def reclaim(rows: DataFrame, protected: Column, group: str = "rank") -> DataFrame:
    """group, reclaim: copies of which any name is protected stay; if any stays all others count, else all but the largest."""
    held = F.coalesce(F.col("size") - F.col("holes"), F.col("size"))
    copies = rows.groupBy(group, physical().alias("phys")).agg(F.max(protected.cast("int")).alias("stays"), F.max(held).alias("held"))
    free = F.sum(F.when(F.col("stays") == 1, 0).otherwise(F.col("held")))
    return copies.groupBy(group).agg(F.when(F.max("stays") == 1, free).otherwise(F.sum("held") - F.max("held")).cast("long").alias("reclaim"))


def created_unknown(entries: DataFrame) -> DataFrame:
    """One row: candidates that the created criterion leaves out."""
    return candidates(entries).agg(F.count_if(F.col("created_unix").isNull()).alias("blank"))
