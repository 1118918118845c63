"""Queries of the file tools beyond the caps of stored results, against DuckDB."""

from collections import Counter

import duckdb
import pytest

from sedimenta.operators import ranking
from sedimenta.queries import ORACLES, QUERIES


def differences(spark, folder, name):
    """Rows that only Spark, and rows that only SQL has."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    names = sorted(got.columns)
    have = Counter(map(tuple, got.select(*names).collect()))
    want = Counter(con.sql(ORACLES[name]).select(*[f'"{n}"' for n in names]).fetchall())
    assert want
    return list((have - want).items())[:3], list((want - have).items())[:3]


@pytest.fixture(scope="module")
def many_sets(spark, tmp_path_factory):
    """Over 10,001 pairs of one size and time that differ: more than a stored result of conflicts holds."""
    folder = tmp_path_factory.mktemp("sets")
    docs = spark.range(21_500).selectExpr(
        "id as doc_id", "repeat(if(id div 7 % 2 = 0, 'a', 'b'), cast(id div 14 + 1 as int)) as text", "if(id div 50 % 2 = 0, 'en', 'fr') as lang", "concat('src', id % 7) as source"
    )
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["conflict_flagged", "conflict_members", "conflict_ranked", "conflict_representatives", "conflict_search", "conflict_skew_sample", "export_conflicts"])
def test_conflicts_are_not_cut(spark, many_sets, name):
    assert differences(spark, many_sets, name) == ([], [])


def test_all_rows_are_numbered(spark):
    rows = spark.range(1000).selectExpr("id % 10 as a", "id as b").repartition(7)
    order = [rows["a"].desc(), rows["b"]]
    got = {(r["a"], r["b"]): r["rank"] for r in ranking.ranked(rows, order, None).collect()}
    assert got == {k: n for n, k in enumerate(sorted(got, key=lambda k: (-k[0], k[1])), 1)} and len(got) == 1000
    assert ranking.ranked(rows.limit(0), order, None).count() == 0


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Copies of texts beyond 64 KiB, pairs of documents with one path (50 ids apart), long texts with one start."""
    folder = tmp_path_factory.mktemp("long")
    text = "repeat(concat('word', {}), 9000)"
    rows = spark.range(900).selectExpr(
        "id as doc_id",
        f"case when id % 3 = 0 then {text.format('id % 12')} when id % 7 < 2 then concat(repeat('x', 70000), id % 14) else concat('short ', id % 80) end as text",
        "'en' as lang",
        "'src0' as source",
    )
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["dup_prefix_split", "history_changed", "history_stream", "plan_identity_strength", "history_latest", "history_recorded"])
def test_long_texts_and_shared_paths(spark, long_texts, name):
    assert differences(spark, long_texts, name) == ([], [])
