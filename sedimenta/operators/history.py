"""Content history by generation: what a path held when it was last recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.limits import LIMITS, Limits

#: What names an entry; entries that can share a path need more.
KEY = ("path",)
COLUMNS = ["path", "size", "mod_unix", "pfx", "hash", "gen"]


def latest(history: DataFrame, before: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """The last entry of each path (or ``key``) of a generation before ``before``; earlier ones say nothing."""
    entry = F.struct("size", "mod_unix", "pfx", "hash", "gen")
    return history.where(F.col("gen") < before).groupBy(*key).agg(F.max_by(entry, "gen").alias("e")).select(*key, "e.*")


def changed(current: DataFrame, history: DataFrame, gen: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """path (or ``key``), prior_hash, hash where the last entry has today's size and time but other content.

    If that entry's size or time differs there is no evidence, whatever
    earlier generations hold. A past digest never stands in for reading today's
    content: ``current`` carries digests of this generation.
    """
    past = latest(history, gen, key).select(*key, "size", "mod_unix", F.col("hash").alias("prior_hash"), F.col("pfx").alias("prior_pfx"))
    same = current.join(past, [*key, "size", "mod_unix"])
    return same.where((F.col("prior_hash") != F.col("hash")) | (F.col("prior_pfx") != F.col("pfx"))).select(*key, "prior_hash", "hash")


def still_current(evidence: DataFrame, stat: DataFrame) -> DataFrame:
    """Evidence whose file has the same size and time in a second look (path, size, mod_unix)."""
    return evidence.join(stat.select("path", "size", "mod_unix"), ["path", "size", "mod_unix"], "left_semi")


def recorded(history: DataFrame, current: DataFrame, gen: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """The store after a run: one entry a path (or ``key``), this generation's where it has one."""
    columns = list(dict.fromkeys([*key, *COLUMNS]))
    return history.select(*columns).join(current.select(*key), list(key), "left_anti").unionByName(current.withColumn("gen", F.lit(gen)).select(*columns))


def trimmed(history: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The newest ``history_rows`` entries (ties by path)."""
    return history.orderBy(F.desc("gen"), "path").limit(limits.history_rows)


def sizes(history: DataFrame) -> DataFrame:
    """gen, entries, running (entries of it and newer ones): what a retention cap would keep."""
    by_gen = history.groupBy("gen").agg(F.count(F.lit(1)).alias("entries"))
    return by_gen.withColumn("running", F.sum("entries").over(W.orderBy(F.desc("gen"))))
