"""Golden cases over small frames."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import scalars as S
from sedimenta.limits import LIMITS
from sedimenta.operators import conflicts, duplicates, empty_dirs, flat, history, ranking, results
from sedimenta.operators.duplicates import Match
from sedimenta.plans import moves
from sedimenta.scan import Request, scan

ENTRY = "path string, name string, dir string, size long, holes long, mod_unix long, created_unix long, dev long, ino long, nlink int, hash string, pfx string, is_dir boolean, unreadable boolean"


def entries(spark, rows):
    """Rows (path, size, content) and what differs from the usual."""
    out = []
    for path, size, content, *more in rows:
        extra = more[0] if more else {}
        row = {"holes": 0, "mod_unix": 100, "created_unix": None, "dev": 1, "ino": 0, "nlink": 1, "is_dir": False, "unreadable": False} | extra
        folder, name = path.rsplit("/", 1)
        out.append((path, name, folder, size, row["holes"], row["mod_unix"], row["created_unix"], row["dev"], row["ino"], row["nlink"], content, content, row["is_dir"], row["unreadable"]))
    return spark.createDataFrame(out, ENTRY)


def test_hard_links_are_one_copy(spark):
    linked = {"ino": 7, "nlink": 2}
    ent = entries(spark, [("/v/a", 10, "h", linked), ("/v/b", 10, "h", linked), ("/v/c", 10, "h")])
    assert tuple(duplicates.groups(ent).select("names", "copies", "reclaim").first()) == (3, 2, 10)
    assert duplicates.groups(ent.where("path <> '/v/c'")).count() == 0


def test_sparse_copy_keeps_the_largest(spark):
    ent = entries(spark, [("/v/a", 100, "h"), ("/v/b", 100, "h", {"holes": 90})])
    assert duplicates.groups(ent).first()["reclaim"] == 10


def test_unknown_created_never_groups(spark):
    ent = entries(spark, [("/v/a", 5, "h"), ("/v/b", 5, "h"), ("/v/c", 5, "h", {"created_unix": 9}), ("/v/d", 5, "h", {"created_unix": 9})])
    assert duplicates.groups(ent, Match(created=True)).first()["names"] == 2
    assert duplicates.created_unknown(ent).first()["blank"] == 2


def test_totals_with_protection(spark):
    ent = entries(spark, [(f"/v/{i}", 10, "x") for i in range(3)] + [("/v/ref/a", 7, "y"), ("/v/b", 7, "y")])
    rows = duplicates.members(ent, duplicates.ordered(duplicates.groups(ent)))
    total = lambda p: duplicates.reclaim(rows, p).agg(F.sum("reclaim")).first()[0]
    assert total(S.under_any("path", ["/v/ref"])) == 27 and total(F.lit(True)) == 0


def test_cap_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 50), (2, 30), (3, 40), (4, 5)], "rank long, names long")
    assert [r["rank"] for r in ranking.capped(df, 100).orderBy("rank").collect()] == [1, 2]
    assert [r["rank"] for r in ranking.capped(df, 10).collect()] == [1]
    assert tuple(ranking.truncation(df, ranking.capped(df, 100), 100).first()) == (2, 45, 100)


def test_page_trim_is_sequential(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([600, 3, 700, 900, 10], 1)], "rank long, names long")
    assert [r["shown"] for r in ranking.trimmed(df, 2000, 500, 2).orderBy("rank").collect()] == [500, 3, 500, 500, 10]
    tight = ranking.trimmed(df, 501, 500, 2).orderBy("rank").collect()
    assert [r["shown"] for r in tight] == [500, 2, 2, 2, 2]


@pytest.mark.parametrize(
    ("q", "hit"),
    [
        ({}, True), ({"q": "shore"}, True), ({"q": "SHORE-18"}, False), ({"q": " archive "}, True), ({"loc": "/volume1/Archive"}, True), ({"loc": "/volume1/Archive/"}, True),
        ({"loc": "/volume1/Arch"}, False), ({"ftype": "pic"}, True), ({"ftype": "video"}, False), ({"ftype": "nothing"}, False), ({"ftype": "ext", "ext": ".jpg"}, True),
        ({"ftype": "ext"}, True), ({"ftype": "dir"}, False), ({"size_op": "eq", "size_mb": 5}, True), ({"size_op": "gt", "size_mb": 5}, False), ({"size_op": "lt", "size_mb": 6}, True),
        ({"date_by": "modified", "date_from": "2024-01-01", "date_to": "2024-01-01"}, True), ({"date_by": "created", "date_from": "2000-01-01"}, False), ({"date_by": "created"}, True),
    ],
)
def test_search(spark, q, hit):
    ent = entries(spark, [("/volume1/Archive/trips/shore-17.JPG", 5 << 20, "h", {"mod_unix": 1704150000})])
    assert results.search_rows(ent, results.Query(**q)).count() == hit


def test_conflict_core(spark):
    ent = entries(
        spark,
        [("/v/1/report.txt", 4096, "A"), ("/v/2/report.txt", 4096, "B"), ("/v/t1", 9, "same"), ("/v/t2", 9, "same"), ("/v/e1", 8, "C"), ("/v/e2", 8, "D", {"mod_unix": 3700}), ("/v/alone", 77, "E")],
    )
    found = conflicts.sets(ent).collect()
    assert len(found) == 1 and found[0]["variants"] == 2 and found[0]["same_name"] and not found[0]["flagged"]
    bad = entries(spark, [("/v/a", 5, "A"), ("/v/b", 5, None, {"unreadable": True})])
    assert conflicts.sets(bad).first()["flagged"]
    assert conflicts.totals(conflicts.sets(ent)).first()["reclaimable"] == 0


def verdict_of(spark, rows):
    import hashlib

    data = [(1, p, hashlib.sha256(c or b"").hexdigest(), bytearray(c) if c is not None else None, err, past) for p, c, err, past in rows]
    return {r["path"]: (r["verdict"], r["evidence"]) for r in conflicts.verdicts(spark.createDataFrame(data, "rank long, path string, hash string, content binary, read_error string, prior_hash string")).collect()}


def test_verdicts(spark):
    import hashlib

    from tests.test_media import PNG

    body = bytes(range(1, 256)) * 16
    tail = body[:2000] + bytes(len(body) - 2000)
    got = verdict_of(spark, [("/a", body, None, None), ("/b", tail, None, None), ("/c", tail, None, None)])
    assert [got[p][0] for p in ("/a", "/b", "/c")] == ["unknown", "corrupt", "corrupt"] and got["/b"] == got["/c"]
    flip = bytes([body[0] ^ 1]) + body[1:]
    assert {v for v, _ in verdict_of(spark, [("/a", body, None, None), ("/b", flip, None, None)]).values()} == {"unknown"}
    broken = PNG[:50] + bytes([PNG[50] ^ 9]) + PNG[51:]
    got = verdict_of(spark, [("/a.png", PNG, None, None), ("/b.png", broken, None, None)])
    assert got["/a.png"][0] == "intact" and got["/b.png"][0] == "corrupt"
    got = verdict_of(spark, [("/a", body, None, None), ("/b", None, "EIO", None)])
    assert got["/b"][0] == "corrupt" and got["/a"][0] == "unknown"
    got = verdict_of(spark, [("/a", body, None, None), ("/b", flip, None, hashlib.sha256(body).hexdigest())])
    assert got["/b"][0] == "corrupt" and "changed" in got["/b"][1]


def test_skew_sample(spark):
    rows = [(f"/v/{i:03}", 5, f"h{i % 40}") for i in range(200)] + [("/v/zz", 5, "odd", {"mod_unix": 100})]
    small = dataclasses.replace(LIMITS, skewed_family=100, skew_sample=10, skew_each=2)
    got = [r["path"] for r in conflicts.skew_sample(entries(spark, rows), small, F.col("path") == "/v/zz").collect()]
    assert len(got) == 11 and "/v/zz" in got


def dirs(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def files(spark, paths):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[1], 3) for p in paths], "path string, name string, size long")


@pytest.mark.parametrize(
    ("folders", "held", "want"),
    [
        (["/r/foo", "/r/foo/in", "/r/foo2"], ["/r/foo2/x.txt"], ["/r/foo"]),
        (["/r/a", "/r/a/b", "/r/a/b/c"], [], ["/r/a"]),
        (["/r/a", "/r/a/b", "/r/a/c"], ["/r/a/c/keep"], ["/r/a/b"]),
        (["/r/junk"], ["/r/junk/Thumbs.db", "/r/junk/.DS_Store", "/r/junk/._side"], ["/r/junk"]),
        (["/r/k"], ["/r/k/.gitkeep"], []),
        (["/r/bak"], ["/r/bak/notes.bak"], []),
        (["/r/p", "/r/p/old.tmp"], [], ["/r/p/old.tmp"]),
        ([], [], []),
    ],
)
def test_topmost(spark, folders, held, want):
    got = empty_dirs.topmost(files(spark, held) if held else files(spark, ["/x/y"]).limit(0), dirs(spark, ["/r", *folders]), ["/r"])
    assert sorted(r["path"] for r in got.collect()) == want


def test_junk_below(spark):
    f = files(spark, [f"/r/j/{i}.tmp" for i in range(5)])
    row = empty_dirs.with_junk(dirs(spark, ["/r/j"]), f).first()
    assert (row["junk"], row["junk_bytes"], row["junk_examples"]) == (5, 15, ["0.tmp", "1.tmp", "2.tmp"])


def test_history_looks_no_deeper_than_the_last_entry(spark):
    old = spark.createDataFrame([("/a", 5, 1, "p", "x", 1), ("/a", 6, 1, "p", "y", 2), ("/b", 5, 1, "p", "x", 2)], "path string, size long, mod_unix long, pfx string, hash string, gen int")
    now = spark.createDataFrame([("/a", 5, 1, "p", "z"), ("/b", 5, 1, "p", "z")], "path string, size long, mod_unix long, pfx string, hash string")
    assert [r["path"] for r in history.changed(now, old, 3).collect()] == ["/b"]
    assert history.changed(now, old, 2).count() == 1  # then /a's last entry is that of generation 1 and /b has none


KEEP = "rank long, path string, requested boolean, prot boolean, exists boolean, out boolean"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("/v/a/f", True, False, True, False), ("/v/b/f", True, False, True, False)], "/v/b/f"),
        ([("/v/a/f", True, False, True, False), ("/v/b/f", False, False, True, False)], None),
        ([("/v/a/f", True, False, True, False), ("/v/b/f", True, True, True, False)], None),
        ([("/v/a/f", True, False, True, False), ("/v/b/f", True, False, False, False)], "/v/a/f"),
        ([("/v/a/f", True, False, False, False), ("/v/b/f", True, False, False, False)], "/v/b/f"),
        ([("/v/a/f", True, False, True, False), ("/v/out/f", False, False, True, True)], "/v/a/f"),
        ([("/v/a/f", False, False, True, False), ("/v/out/f", True, False, True, True)], None),
        ([("/v/out/f", True, False, True, True)], "/v/out/f"),
    ],
)
def test_keep_one(spark, rows, want):
    got = [r["hold"] for r in moves.keep_one(spark.createDataFrame([(1, *r) for r in rows], KEEP)).collect()]
    assert got == ([want] if want else [])


def test_replay(spark):
    lines = [("b", 1, "begin", "/a", ""), ("b", 2, "placed", "/a", "/o/a"), ("b", 3, "begin", "/b", ""), ("b", 4, "begin", "/c", ""), ("b", 5, "gone", "/c", ""), ("b", 6, "begin", "/d", ""), ("b", 7, "failed", "/d", "")]
    got = {r["path"]: r["outcome"] for r in moves.replay(spark.createDataFrame(lines, "batch string, seq long, tag string, path string, to_path string")).collect()}
    assert got == {"/a": "moved", "/b": "unsettled", "/c": "gone"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(S.ext_of(lit(n))) for n in ("a.txt", "a", ".bashrc", "a.", "x.tar.gz")] == ["TXT", "FILE", "BASHRC", "FILE", "GZ"]
    assert [one(S.fmt_bytes(lit(n))) for n in (0, 999, 1024, 20_000, 200_000, 3 << 30)] == ["0 B", "999 B", "1.00 KB", "19.5 KB", "195 KB", "3.00 GB"]
    assert [one(S.csv_cell(lit(t))) for t in ("=1", "  +x", "a=1", "", "\t@x")] == ["'=1", "'  +x", "a=1", "", "'\t@x"]
    assert [one(S.in_batch_layout(lit(p))) for p in ("/volume1/s/Duplicates/volume1/x", "/volume1/s/Duplicates (2)/volumeUSB1/x", "/volume1/s/Duplicates/volume1", "/volume1/s/Duplicates/x", "/v/Duplicates (x)/volume1/y", "/volume1/s/Empty Folders/volume1/a")] == [True, True, False, False, False, True]
    assert [one(S.free_name(lit(n), lit(2))) for n in ("a.txt", "a", ".x")] == ["a (2).txt", "a (2)", ".x (2)"]
    assert [one(S.mark_name_ok(lit(n))) for n in ("a/b", "../a", "a//b", "x" * 256)] == [True, False, False, False]
    assert [one(S.allowed_path(lit(p), ["/volume1"])) for p in ("/volume1/a", "/volume1/../etc", "/volume10/a", "volume1/a", "/volume1/..a")] == [True, False, False, False, True]
    assert one(S.ancestors(lit("/a/b/c"))) == ["/a", "/a/b"] and one(S.ancestors(lit("/a"))) == []
    assert one(S.split_share(lit("/photo/x/y"))) == ("photo", "/x/y") and one(S.human_count(lit(1234567))) == "1,234,567"
    assert [one(S.may_be_renamed(lit(n))) for n in ("ok", "a:b", "dot.", "tab\t")] == [False, True, True, True]


def test_read_only_tools_move_nothing_and_scans_leave_moved_copies_out(spark):
    ent = entries(spark, [("/volume1/a/x.tmp", 0, "h"), ("/volume1/a/y.tmp", 0, "h"), ("/volume1/a/z.txt", 3, "z")])
    assert {(r["action"], r["reason"]) for r in moves.refusals(ent, ["/volume1"], [], tool="corrupted_files").collect()} == {("refuse", "read-only tool")}
    moved = spark.createDataFrame([("path", "/volume1/a/x.tmp"), ("path", "/volume1/b")], "kind string, key string")
    folders = dirs(spark, ["/volume1", "/volume1/a", "/volume1/b", "/volume1/c", "/volume1/d"])
    out = scan(ent, folders, Request(limits=dataclasses.replace(LIMITS, empty_folder_rows=1)), moved)
    found = lambda tool: [r["path"] for r in out[tool].collect()]
    assert found("empty_files") == found("temp_files") == ["/volume1/a/y.tmp"] and found("empty_folders") == ["/volume1/c"]


def test_scan_runs_every_tool(spark):
    ent = entries(spark, [("/volume1/a/x", 5, "h"), ("/volume1/a/y", 5, "h"), ("/volume1/b/z.tmp", 0, "e"), ("/volume1/c/q", 5, "other")])
    out = scan(ent, dirs(spark, ["/volume1", "/volume1/a", "/volume1/b", "/volume1/c"]), Request())
    assert list(out) == ["empty_folders", "empty_files", "temp_files", "duplicates", "corrupted_files"]
    assert {t: df.count() for t, df in out.items()} == {"empty_folders": 1, "empty_files": 1, "temp_files": 1, "duplicates": 2, "corrupted_files": 3}
    with pytest.raises(ValueError, match="unknown"):
        scan(ent, None, Request(tools=("nothing",)))


def test_flat_order_is_total(spark):
    ent = entries(spark, [(f"/v/{n}.tmp", 1, "h") for n in "cab"])
    assert [r["path"] for r in flat.stored(flat.temp_files(ent), dataclasses.replace(LIMITS, flat_rows=2)).orderBy("pos").collect()] == ["/v/a.tmp", "/v/b.tmp"]


def test_grouped_answer(spark):
    rows = [(f"/v/big/{i:02}", 10, "x", {"created_unix": 5 + i % 2}) for i in range(8)] + [("/v/ref/a", 7, "y"), ("/v/b", 7, "y"), ("/v/c/1", 3, "z"), ("/v/c/2", 3, "z")]
    ent = entries(spark, rows)
    stored = duplicates.members(ent, duplicates.ordered(duplicates.groups(ent)))
    small = dataclasses.replace(LIMITS, page_groups=2, trim_page=6, trim_group=5, trim_least=2)
    got = results.grouped_answer(stored, results.Query(q="/v/"), None, results.PageRequest(limits=small), ("/v/ref",))
    page = [(r["place"], r["names"], r["shown"], r["reclaim"]) for r in got["page"].orderBy("place").collect()]
    assert page == [(1, 8, 5, 70), (2, 2, 2, 7)] and got["rows"].count() == 7
    assert tuple(got["grand"].first()) == (3, 12, 100) == tuple(got["total"].first())
    got = results.grouped_answer(stored, results.Query(loc="/v/c"), Match(name=False, modified=True), results.PageRequest(), ())
    assert got["total"].first()["groups"] == 1 and got["grand"].first()["groups"] == 3 and got["rows"].count() == 2
    got = results.grouped_answer(stored, results.Query(), Match(created=True), results.PageRequest(), ())
    assert [r["names"] for r in got["page"].collect()] == [4, 4]


def test_flat_answer(spark):
    ent = entries(spark, [(f"/v/{n}.tmp", i, "h") for i, n in enumerate("abcd")])
    got = results.flat_answer(flat.stored(flat.temp_files(ent)), results.Query(q="tmp"), "size", True, results.PageRequest(offset=1, limit=2), ("/v/b.tmp",))
    assert [(r["name"], r["prot"]) for r in got["page"].collect()] == [("c.tmp", False), ("b.tmp", True)]
    assert tuple(got["total"].first()) == (4, 6)
