"""Working tables of the training-data operators: dropped when used, and rows told apart by their place."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.working import fresh_dir, materialize, shared_root

__all__ = ["fresh_dir", "materialize", "shared_root"]

#: Rows that may be broadcast, and bytes of the files they stand in; larger sides are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of :func:`materialize` frames that nothing reads any more; others are left alone."""
    for df in frames:
        root = f"{shared_root(df.sparkSession)}/sedimenta/".split(":", 1)[-1]
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.lstrip("/") in path:
                drop_dir(df.sparkSession, path)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as the planner estimates them (from the files' sizes): for numbers of partitions, never for results."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _straight_from_files(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a file, at most projected and filtered: joins and generators would repeat its place."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return "Relation" in node.nodeName()


def located(docs: DataFrame, file_as: str = "__file", row_as: str = "__row") -> DataFrame:
    """``docs`` with the place of each row: file and row index in it.

    Places tell apart rows that are equal in every column. A frame that does
    not come straight from files is written to the shared folder first.
    """
    place = F.col("_metadata.file_path").alias(file_as), F.col("_metadata.row_index").alias(row_as)
    if _straight_from_files(docs):
        try:
            return docs.select("*", *place)
        except AnalysisException:  # a relation without such columns
            pass
    return materialize(docs, "located").select("*", *place)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by number, so none can clash with a helper column, and the new name of each."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) marked for broadcast if its files are small and it is counted to be within ``rows``, else left to a shuffled join."""
    fits = scan_bytes(df) <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if fits else df.hint("shuffle_merge")


def ascii_lower(text):
    """A-Z lower-cased and nothing else, null as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
