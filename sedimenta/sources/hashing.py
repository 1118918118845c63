"""Digests of real files, read where the entries are."""

from __future__ import annotations

import hashlib
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from sedimenta.functions.bytesafe import unescape
from sedimenta.limits import PREFIX_BYTES


def digests_of(path: str, retry_s: float = 0.2) -> tuple[str | None, str | None, str]:
    """(prefix digest, whole digest, error); a failed read is tried once more."""
    for attempt in (0, 1):
        try:
            with open(unescape(path), "rb") as f:
                head = f.read(PREFIX_BYTES)
                whole, prefix = hashlib.sha256(head), hashlib.sha256(head).hexdigest()[:32]
                while piece := f.read(1 << 20):
                    whole.update(piece)
            return prefix, whole.hexdigest(), ""
        except OSError as e:
            error = "EIO" if e.errno == 5 else e.strerror or "error"
            if attempt == 0 and e.errno == 5:
                time.sleep(retry_s)
            else:
                break
    return None, None, error


def with_digests(entries: DataFrame) -> DataFrame:
    """Entries with pfx, hash and read_error; files that cannot be read have null digests and their error."""
    names = entries.columns
    schema = StructType([*entries.schema.fields, *[StructField(n, StringType()) for n in ("pfx", "hash", "read_error")]])

    def run(batches):
        for batch in batches:
            rows = [digests_of(p) for p in batch.column("path").to_pylist()]
            arrays = [pa.array([r[i] for r in rows], type=pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + arrays, names=[*names, "pfx", "hash", "read_error"])

    return entries.mapInArrow(run, schema)
