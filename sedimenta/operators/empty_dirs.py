"""The topmost folders that hold nothing but junk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.scalars import ancestors, any_of, is_junk, parent_of
from sedimenta.limits import LIMITS, Limits
from sedimenta.operators.ranking import ranked


def content_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders whose subtree holds content: a file that is not junk (a zero-byte one too), or a folder named like junk.

    ``files`` may have ``content`` set on rows that count whatever their name,
    as unreadable or passed-over entries do. Every entry marks its ancestors;
    the marks are made distinct before they are shuffled.
    """
    forced = F.col("content") if "content" in files.columns else F.lit(False)
    entries = files.where(forced | ~is_junk("name")).select("path")
    odd = folders.where(is_junk(F.substring_index("path", "/", -1))).select("path")
    return entries.unionByName(odd).select(F.explode(ancestors("path")).alias("path")).distinct()


def topmost(files: DataFrame, folders: DataFrame, roots: list[str]) -> DataFrame:
    """(path): empty folders below the roots whose parent has content or is a root; roots themselves are never among them."""
    below = folders.where(~F.col("path").isin(*roots))
    empty = below.join(content_folders(files, folders), "path", "left_anti")
    inner = empty.select(F.col("path").alias("up"))
    return empty.withColumn("up", parent_of("path")).join(inner, "up", "left_anti").select("path")


def with_junk(tops: DataFrame, files: DataFrame, examples: int = 3) -> DataFrame:
    """path, junk (files), junk_bytes, junk_examples: what lies below each, its first names by path."""
    junk = files.where(is_junk("name")).select("path", "name", "size", F.explode(ancestors("path")).alias("top"))
    own = junk.join(tops.select(F.col("path").alias("top")), "top")
    counted = own.groupBy("top").agg(F.count(F.lit(1)).alias("junk"), F.sum("size").alias("junk_bytes"))
    first = own.withColumn("n", F.row_number().over(W.partitionBy("top").orderBy("path"))).where(F.col("n") <= examples)
    named = first.groupBy("top").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "name"))), lambda x: x["name"]).alias("names"))
    joined = tops.join(counted, tops["path"] == counted["top"], "left").drop("top").join(named, F.col("path") == named["top"], "left")
    return joined.select("path", F.coalesce("junk", F.lit(0)).cast("long").alias("junk"), F.coalesce("junk_bytes", F.lit(0)).cast("long").alias("junk_bytes"), F.coalesce("names", F.array().cast("array<string>")).alias("junk_examples"))


def stored(tops: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The first folders by path, numbered ``pos``."""
    return ranked(tops, [F.col("path")], limits.empty_folder_rows, "pos")


def without_references(tops: DataFrame, refs: list[str]) -> DataFrame:
    """Leaves out folders that hold a reference folder."""
    return tops.where(~any_of([F.lit(r).startswith(F.concat("path", F.lit("/"))) for r in refs]))


def confirmed(tops: DataFrame, files_now: DataFrame, folders_now: DataFrame) -> DataFrame:
    """Candidates that a second look still finds empty: they still exist and no content lies below them by now."""
    there = folders_now.select("path")
    return tops.join(there, "path", "left_semi").join(content_folders(files_now, folders_now), "path", "left_anti")
