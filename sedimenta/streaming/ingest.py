"""Entries that keep arriving: history as state, and windows over events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sedimenta.operators.history import KEY

STATE = "size long, mod_unix long, pfx string, hash string, gen long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVIDENCE = "path string, prior_hash string, hash string, gen long"


class PathHistory(StatefulProcessor):
    """One state row a path (first column of the key): what it held when last seen. Emits a path whose content changed though size and time did not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues):
        found = []
        for batch in rows:
            for r in batch.sort_values("gen", kind="stable").itertuples(index=False):
                past = self.last.get() if self.last.exists() else None
                if past is not None and past[4] < r.gen and (past[0], past[1]) == (r.size, r.mod_unix) and (past[2], past[3]) != (r.pfx, r.hash):
                    found.append((key[0], past[3], r.hash, r.gen))
                self.last.update((int(r.size), int(r.mod_unix), r.pfx, r.hash, int(r.gen)))
        yield pd.DataFrame(found, columns=["path", "prior_hash", "hash", "gen"], dtype=object).astype({"gen": "int64"})

    def close(self) -> None:
        pass


def changed_stream(entries: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Evidence from a stream of (path, size, mod_unix, pfx, hash, gen) and what else is in ``key``; needs the RocksDB state store."""
    return entries.groupBy(*key).transformWithStateInPandas(statefulProcessor=PathHistory(), outputStructType=EVIDENCE, outputMode="append", timeMode="none")


def changed_in(generations: tuple[DataFrame, ...], columns: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """Evidence from generations that arrive one after the other, each as a batch of a stream that goes on."""
    spark = generations[0].sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sedimenta-")
    root = f"{root.rstrip('/')}/sedimenta/history-{uuid.uuid4().hex[:12]}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        for rows in generations:
            narrow = rows.select(*columns).withColumn("gen", F.col("gen").cast("long"))
            narrow.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(narrow.schema).parquet(f"{root}/in")
            out = changed_stream(stream, key).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(EVIDENCE).parquet(f"{root}/out")


def publish(entries: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that writes each tool's result of a batch as soon as it is there."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for name, tool in tools.items():
                tool(df).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            df.unpersist()

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their values by kind and window of event time; the same on a table and on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = marked.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events with less than ``gap`` between."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
