"""Stored results, move marks and CSV files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.scalars import mark_name_ok

SCHEMA_VERSION = 1
MARK_SCHEMA = "about string, at string, folder string, moved array<struct<name: string, size: long, mtime: long>>"
JOURNAL_SCHEMA = "batch string, seq long, tag string, path string, to_path string"

# Bounds of the move marks of one scan.
MARK_FILE_BYTES = 8 << 20
MARK_ENTRIES = 200_000


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written aside and renamed, so a reader sees the old text or the new."""
    fs, at = _fs(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(aside, at)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def save_results(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict) -> str:
    """Write a scan's tables and then point to them; readers of the state before are not disturbed."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    _write_text(spark, f"{root}/current.json", json.dumps({"schema": SCHEMA_VERSION, "version": version, "tables": sorted(tables)} | meta))
    return version


def load_results(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict]:
    """The current tables and their description; none if nothing is stored or it is of another schema."""
    text = _read_text(spark, f"{root}/current.json")
    meta = json.loads(text) if text else {}
    if meta.get("schema") != SCHEMA_VERSION:
        return {}, {}
    return {t: spark.read.parquet(f"{root}/{meta['version']}/{t}") for t in meta["tables"]}, meta


def request_key(tools: list[str], dirs: list[str], refs: list[str], recurse: bool, match: dict) -> str:
    """What a scan must share with an interrupted one to go on from it."""
    norm = lambda paths: sorted({p.rstrip("/") or "/" for p in paths})
    return json.dumps([sorted(tools), norm(dirs), norm(refs), recurse, match], sort_keys=True)


def write_marker(spark: SparkSession, root: str, key: str, gen: int) -> None:
    _write_text(spark, f"{root}/marker.json", json.dumps({"key": key, "gen": gen}))


def resume_generation(spark: SparkSession, root: str, key: str) -> int | None:
    """The generation of an interrupted scan of the same request, if there is one."""
    text = _read_text(spark, f"{root}/marker.json")
    found = json.loads(text) if text else {}
    return found.get("gen") if found.get("key") == key else None


def clear_marker(spark: SparkSession, root: str) -> None:
    fs, at = _fs(spark, f"{root}/marker.json")
    fs.delete(at, False)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """folder, path, name, size, mtime of what mark records say was moved, the first ``MARK_ENTRIES`` by path; ill-formed names and oversized files are passed over."""
    marks = spark.read.schema(MARK_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    fit = marks.where(F.col("_metadata.file_size") <= MARK_FILE_BYTES)
    rows = fit.select("folder", F.explode("moved").alias("m")).select("folder", "m.*").where(mark_name_ok("name"))
    return rows.withColumn("path", F.concat("folder", F.lit("/"), "name")).orderBy("path", *rows.columns).limit(MARK_ENTRIES)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines; a line that was cut short by a crash is passed over."""
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def capped_errors(entries: DataFrame, most: int) -> DataFrame:
    """Error lines, at most ``most``, and one line that says how many more there are."""
    errors = entries.where("unreadable").select(F.concat_ws(": ", "path", "error").alias("line"))
    first = errors.orderBy("line").limit(most)
    more = errors.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0")
    return first.unionByName(more.select(F.concat(F.lit("… and "), F.format_number("n", 0), F.lit(" more")).alias("line")))


def write_csv(df: DataFrame, path: str, order: list[str], drop: tuple[str, ...] = ()) -> None:
    """A CSV with header in the order given, in as many files as the range partitions have; an existing folder is an error."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop).write.mode("errorifexists").option("header", True).csv(path)
