"""Quality classification with hierarchical empirical Bayes.

A logistic classifier turns each text into evidence, the log likelihood ratio
of good against bad. It sees the text's shape and its words: hashed words and
word pairs with the log odds that labelled texts give them. Sites differ in how
often they are good: the rate of a host is shrunk towards the global rate and
the rate of a path on it towards its host's, each by a strength estimated from
how much the groups differ. A labelled document counts in these rates by its
label, any other by what its evidence alone says. A document's posterior joins
its evidence with its path's rate as the prior, and that rate is taken without
the document itself, so nothing is counted twice.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.storage import discard, located, materialize, plain, restored, small

#: Labelled rows the classifier is fitted on at most: those with the smallest hash of their id.
LABELLED_ROWS = 20_000
#: Evidence is kept within these log odds, so no text is beyond its site's influence.
MOST_EVIDENCE = 12.0
FEATURES = ("length", "lower", "upper", "digit", "space", "stop", "exclaim", "bar", "symbol", "high", "word_length", "distinct_words", "distinct_lines", "short_lines")
#: Buckets of hashed words, and as many of pairs of words; a power of two.
BUCKETS = 4096
#: Tasks that read the labelled rows; these are bounded.
_FIT_TASKS = 16
_CLASSES = 9
_CLASS = np.full(256, 7, dtype=np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b".,;:'\"()-?", b"!", b"|")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8


def features(text: str | None) -> np.ndarray:
    """``FEATURES`` of one whole text; a null text is empty and an empty one is all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES), dtype=np.float64)
    if not raw:
        return out
    out[0] = np.log1p(len(raw)) / 10
    out[1 : 1 + _CLASSES] = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=_CLASSES) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    if words:
        out[10] = min(len(raw) / len(words), 40.0) / 10
        out[11] = len(set(words)) / len(words)
    out[12] = len(set(lines)) / len(lines)
    out[13] = sum(len(x) < 30 for x in lines) / len(lines)
    return out


def word_counts(text: str | None) -> np.ndarray:
    """How often each bucket's words, then each bucket's pairs of neighbouring words, occur in a whole text; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.zeros(2 * BUCKETS, dtype=np.int64)
    for at in range(0, len(words), 1 << 20):
        part = words[at : at + (1 << 20) + 1]
        h = np.fromiter(map(zlib.crc32, part), dtype=np.uint32, count=len(part))
        out[:BUCKETS] += np.bincount(h[: 1 << 20] & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        pairs = (h[:-1] * np.uint32(0x9E3779B1) + h[1:]) * np.uint32(0xC2B2AE3D) >> np.uint32(16)
        out[BUCKETS:] += np.bincount(pairs & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def log_odds(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Each bucket's log odds, smoothed; words and pairs are shares of their own."""
    out = []
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        shares = [np.log(c[half] + 0.5) - np.log(c[half].sum() + 0.5 * BUCKETS) for c in (good, bad)]
        out.append(shares[0] - shares[1])
    return np.concatenate(out)


def inputs(text: str | None, odds: np.ndarray) -> np.ndarray:
    """What the classifier sees of a text: its features and the mean log odds of its words and of its pairs."""
    counts = word_counts(text)
    means = [counts[half] @ odds[half] / max(int(counts[half].sum()), 1) for half in (slice(0, BUCKETS), slice(BUCKETS, None))]
    return np.concatenate([features(text), means])


def _fitted(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, log odds, share of good) from ``labelled(fold, y, text)``; a row's words are judged for the fit by the other fold."""
    rows = labelled.repartition(_FIT_TASKS)

    def count(batches):
        sums = np.zeros((2, 2, 2 * BUCKETS), dtype=np.int64)
        for batch in batches:
            for fold, y, text in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), batch.column("text"), strict=True):
                sums[fold, int(y >= 0.5)] += word_counts(text.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["sums"])

    sums = np.zeros((2, 2, 2 * BUCKETS), dtype=np.int64)
    for r in rows.mapInArrow(count, "sums binary").collect():
        sums += np.frombuffer(r["sums"], dtype=np.int64).reshape(sums.shape)
    other = [log_odds(sums[1 - fold, 1], sums[1 - fold, 0]) for fold in (0, 1)]
    width = len(FEATURES) + 2

    def see(batches):
        for batch in batches:
            folds, n = batch.column("fold").to_pylist(), batch.num_rows
            x = np.array([inputs(t.as_py(), other[f]) for f, t in zip(folds, batch.column("text"), strict=True)], dtype=np.float64).reshape(n, width)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))], names=["y", "x"])

    seen = rows.mapInArrow(see, "y double, x array<double>").toPandas()
    x = np.array(seen["x"].tolist(), dtype=np.float64).reshape(len(seen), width)
    y = (seen["y"].to_numpy(dtype=np.float64) >= 0.5).astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums of floats shall not
    return fit(x[order], y[order]), log_odds(sums[:, 1].sum(axis=0), sums[:, 0].sum(axis=0)), float(y.mean()) if len(y) else 0.5


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression by Newton's method; zeros if all labels are alike.

    Inputs are widened by squares, so that a ratio may be wrong at both ends,
    and scaled to unit spread for the fit; the weights are those of the raw ones.
    """
    z = design(x)
    w = np.zeros(z.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    centre, scale = z.mean(axis=0), z.std(axis=0)
    centre[0], scale[scale < 1e-9] = 0.0, 1.0
    z = (z - centre) / scale
    penalty = np.full(len(w), ridge * len(y))
    penalty[0] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    w[0] -= (w * centre)[1:].sum()
    return w


def design(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x, x * x])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Rows that the prior ``mean`` of ``groups(n, s)`` counts for.

    It is the beta-binomial's by moments, from the spread of the groups' rates
    beyond what their sizes explain.
    """
    spread = (
        groups.withColumn("m", mean)
        .agg(
            F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("over"),
            F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
            F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("most"),
        )
        .first()
    )
    extra = max((spread["over"] or 0.0) - (spread["chance"] or 0.0), 0.0)
    inside = extra / spread["most"] if spread["most"] else 0.0
    return float(np.clip((1 - inside) / inside if inside > 0 else 1e6, 1.0, 1e6))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", carry: tuple[str, ...] = (), most_labels: int = LABELLED_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, host, path, evidence, host_rate, path_rate, posterior, kept and ``carry``.

    A document is kept if its posterior of being good is at least one half; the
    rates are those of its host and path without itself. Labels are rows (id,
    quality); null labels and labels of absent documents are passed over,
    several labels of a document are averaged. The classifier is fitted on the
    ``most_labels`` labels with the smallest hash of their id (of repeated rows
    of an id, on one); the rates count all labels. Without labels of both kinds
    there is no evidence and everything is kept. A null host or path is a group
    of its own, a null text is empty, repeated rows are judged alike, an empty
    table gives no rows.
    """
    keep = ("__id", "__host", "__path", *carry)
    named = docs.withColumns({"__id": F.col(id_col), "__host": F.coalesce(F.col(host_col).cast("string"), F.lit("\0null")), "__path": F.coalesce(F.col(path_col).cast("string"), F.lit("\0null"))})

    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg("quality").alias("y"))
    known = materialize(known, "quality-labels")
    sample = materialize(known.orderBy(F.xxhash64("__id"), "__id").limit(most_labels), "quality-sample")
    texts = named.select("__id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "__id")
    one = texts.groupBy("__id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    labelled = materialize(one.select(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).cast("int").alias("fold"), "y", "text"), "quality-labelled")
    w, odds, mu = _fitted(labelled)
    discard(labelled, sample)
    fits = bool(w.any())
    mu = float(np.clip(mu, 1e-3, 1 - 1e-3)) if fits else max(mu, 0.5)
    base = float(np.log(mu / (1 - mu))) if mu < 1 else MOST_EVIDENCE

    chosen = named.select(*keep, F.col(text_col).alias("__text"))
    schema = chosen.drop("__text").withColumn("evidence", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.array([inputs(t.as_py(), odds) for t in batch.column("__text")] if fits else np.zeros((n, len(FEATURES) + 2)), dtype=np.float64).reshape(n, len(FEATURES) + 2)
            evidence = np.clip(design(x) @ w - base, -MOST_EVIDENCE, MOST_EVIDENCE) if fits else np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(evidence)], names=[*keep, "evidence"])

    told = chosen.mapInArrow(run, schema)
    alone = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    if fits:
        told = materialize(told, "quality-evidence").join(known.withColumnRenamed("y", "__y"), "__id", "left").withColumn("__v", F.coalesce("__y", alone)).drop("__y")
    else:
        told = told.withColumn("__v", alone)
    told = materialize(told.select(*keep, "evidence", "__v"), "quality-values")

    paths = materialize(told.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__v").cast("decimal(20,12)")).cast("double").alias("s")), "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum(F.col("s").cast("decimal(30,12)")).cast("double").alias("hs"))
    host_strength = _strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s")), F.lit(mu))
    rates = materialize(paths.join(hosts, "__host").select("__host", "__path", "n", "s", "hn", "hs"), "quality-rates")

    def shrunk(s: Column, n: Column, strength: float, mean: Column) -> Column:
        return (s + strength * mean) / (n + strength)

    path_strength = _strength(rates.withColumn("m", shrunk(F.col("hs"), F.col("hn"), host_strength, F.lit(mu))), F.col("m"))
    joined = told.join(small(rates), ["__host", "__path"])
    joined = joined.withColumn("host_rate", shrunk(F.col("hs") - F.col("__v"), F.col("hn") - 1, host_strength, F.lit(mu)))
    joined = joined.withColumn("path_rate", shrunk(F.col("s") - F.col("__v"), F.col("n") - 1, path_strength, F.col("host_rate")))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.greatest(F.least("path_rate", F.lit(1 - 1e-6)), F.lit(1e-6))))))
    out = joined.withColumn("posterior", posterior)
    return out.select(F.col("__id").alias("id"), F.col("__host").alias("host"), F.col("__path").alias("path"), "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= 0.5).alias("kept"), *carry)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns; cases as in :func:`judge`. The labels' id has the name ``id_col``."""
    docs, names = plain(docs)
    docs = located(docs)
    labels = labels.select(F.col(id_col).alias(names[id_col]), "quality")
    judged = judge(docs, labels, names[id_col], names[text_col], names[host_col], names[path_col], ("__file", "__row"))
    gone = materialize(judged.where(~F.col("kept")).select("__file", "__row"), "quality-gone")
    return restored(docs.join(small(gone), ["__file", "__row"], "left_anti"), names)
