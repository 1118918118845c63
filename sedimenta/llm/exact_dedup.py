"""Exact deduplication as a stateful stream.

Arriving rows are reduced to (digest, id, place); a Structured Streaming
aggregation keyed by digest keeps, in RocksDB and without expiry, the stable
identifier and the place of the row that stays and the number of rows seen.
Where a digest is hit more than once the full bytes are compared, so a digest
collision never merges different texts.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.storage import ascii_lower, fresh_dir, located, materialize, plain, restored, small

#: The state's store. Without fallocate, as many small partitions would each reserve megabytes of disk;
#: all stores of an executor share one bounded cache, however many partitions it has, and a store is
#: closed when its task has committed, so it holds no memory beside the stages that follow.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def advance_state(spark: SparkSession, arrivals: str, state: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream what is new in folder ``arrivals`` into the state at ``state`` and return the state.

    A later call with the same two folders goes on from where the last one ended.
    """
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    keyed = stream.parquet(arrivals).groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("n"))
    with _rocksdb(spark):
        query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(state)
        value = kept.schema["value"].dataType.names
        return materialize(
            kept.select(
                F.col("key.digest").alias("digest"),
                F.col("value")[value[0]]["id"].alias("keep_id"),
                F.col("value")[value[0]]["file"].alias("keep_file"),
                F.col("value")[value[0]]["row"].alias("keep_row"),
                F.col("value")[value[1]].alias("n"),
            ).where("n > 1"),
            "dedup-hits",
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower, digest=sha256_digest, files_per_batch: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: file, row, id, digest, keep_id, group_size, kept.

    Rows are equal when their normalised texts are; a null text counts as
    empty. Of equal rows the one with the largest id stays (a null id is the
    smallest; among equal ids the row that comes last by file and place), so
    exactly one row of a group is kept even if whole rows repeat. An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    placed = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "file", "row")
    narrow = placed.select("id", "file", "row", digest(normalise(F.col("text"))).alias("digest"))
    path = fresh_dir(spark, "dedup-arrivals")
    narrow.write.parquet(path)
    arrivals = spark.read.schema(narrow.schema).parquet(path)
    hits = advance_state(spark, path, fresh_dir(spark, "dedup-state"), narrow.schema, files_per_batch)

    members = materialize(arrivals.join(small(hits), "digest").select("digest", "file", "row"), "dedup-members")
    full = placed.select("id", "file", "row", normalise(F.col("text")).alias("norm")).join(small(members), ["file", "row"])
    collided = materialize(full.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest"), "dedup-collided")

    key = ["digest"]
    if collided.limit(1).count():
        apart = full.join(collided, "digest").select("digest", "file", "row", "id", "norm")
        again = apart.groupBy("digest", "norm").agg(F.max(F.struct("id", "file", "row")).alias("s"), F.count(F.lit(1)).alias("n"))
        again = again.select("digest", "norm", F.col("s.id").alias("keep_id"), F.col("s.file").alias("keep_file"), F.col("s.row").alias("keep_row"), "n")
        apart = apart.join(again, ["digest", "norm"]).select("file", "row", "keep_id", "keep_file", "keep_row", "n")
        rest = arrivals.select("digest", "file", "row").join(hits.join(collided, "digest", "left_anti"), "digest").drop("digest")
        hits, key = materialize(rest.unionByName(apart), "dedup-apart"), ["file", "row"]
    return arrivals.join(small(hits), key, "left").select(
        "file",
        "row",
        "id",
        "digest",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in :func:`exact_groups`."""
    docs, names = plain(docs)
    groups = exact_groups(docs := located(docs), names[id_col], names[text_col])
    gone = materialize(groups.where(~F.col("kept")).select(F.col("file").alias("__file"), F.col("row").alias("__row")), "dedup-gone")
    return restored(docs.join(small(gone), ["__file", "__row"], "left_anti"), names)
