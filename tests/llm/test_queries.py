"""All registered queries against their SQL or a brute-force version, and the pipeline stage by stage."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from sedimenta.llm import registry
from tests.llm.test_dedup import ascii_lower, brute_fingerprint, components

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda cur: Counter(tuple(r) for r in cur)
    assert rows(got.select(*names).collect()) == rows(want.select(*names).fetchall())


def test_names_cover_all_ten():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.mode("overwrite").parquet(path)
        rows, before = {r["doc_id"]: r for r in spark.read.parquet(path).collect()}, {r["doc_id"]: r for r in docs.collect()}
        assert after.columns == columns and all(before[i] == r for i, r in rows.items())
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            wrong = sum((i in rows) != bool(labels[i]) for i in before if i in labels)
            assert wrong <= 0.05 * len(labels)
        if name == "exact":
            by = defaultdict(list)
            for i, r in before.items():
                by[ascii_lower(r["text"])].append(i)
            assert set(rows) == {max(ids) for ids in by.values()}
        if name == "near":
            ids = sorted(before)
            texts = [before[i]["text"] for i in ids]
            assert set(rows) == set(components([brute_fingerprint(t) for t in texts], ids, texts))
        if name == "mixture":
            assert set(rows) == set(before)
        docs = spark.read.parquet(path)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_packing_follows_the_mixture_however_files_are_dealt(spark, tmp_path):
    from sedimenta.llm import mixing

    text = lambda i: " ".join(f"word{i}x{k}" for k in range(3000))
    rows = [(i, text(i), "en", "hot" if i % 4 else "cold", 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    slot = {r["id"]: r["slot"] for r in mixing.mix(frame).collect()}
    frame.repartition(5, "doc_id").write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "d")), SF).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spans = defaultdict(list)
    for r in pieces:
        spans[r["sequence_id"] >> 40].append(slot[r["doc_id"]])
    order = [spans[p] for p in sorted(spans)]
    assert len(order) > 1 and len(set(slot.values())) > 3 and {r["doc_id"] for r in pieces} == set(slot)
    assert all(max(a) <= min(b) for a, b in zip(order, order[1:]))
