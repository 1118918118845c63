"""Flat tools: empty files and junk by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.scalars import is_junk, junk_rule
from sedimenta.limits import LIMITS, Limits
from sedimenta.operators.ranking import ranked


def empty_files(entries: DataFrame) -> DataFrame:
    return entries.where("not is_dir and size = 0")


def temp_files(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("is_dir") & is_junk("name"))


def by_rule(entries: DataFrame) -> DataFrame:
    """rule, files, bytes of junk by the kind of rule that makes it junk."""
    return temp_files(entries).groupBy(junk_rule("name").alias("rule")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def stored(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The first rows by path, numbered ``pos``."""
    return ranked(rows, [F.col("path")], limits.flat_rows, "pos")


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def truncation(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row: files beyond the cap, and the cap."""
    return rows.agg(F.greatest(F.count(F.lit(1)) - limits.flat_rows, F.lit(0)).cast("long").alias("files"), F.lit(limits.flat_rows).cast("long").alias("cap"))
