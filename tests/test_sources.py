import json
import os
import time

from pyspark.sql import functions as F

from sedimenta.functions.bytesafe import unescape
from sedimenta.operators import duplicates, empty_dirs
from sedimenta.sources import filesystem, hashing, state
from sedimenta.streaming import ingest


def tree(root):
    for path, data in {"a/x.bin": b"1" * 70_000, "a/y.bin": b"1" * 69_999 + b"2", "b/x copy.bin": b"1" * 70_000, ".hidden": b"h", "_under": b"u", "empty/none": b"", "@eaDir/thumb": b"t"}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (root / "void/inner").mkdir(parents=True)
    os.link(root / "a/x.bin", root / "a/hard.bin")
    os.symlink(root / "a", root / "alias")
    with open(os.fsencode(root) + b"/bad\xff.bin", "wb") as f:
        f.write(b"1" * 70_000)


def test_walk(spark, tmp_path):
    tree(tmp_path)
    rows = {r["rel"]: r for r in filesystem.walk(spark, [str(tmp_path)]).collect()}
    names = {unescape(n) for n in rows}
    assert names >= {b".hidden", b"_under", b"empty/none", b"a/x.bin", b"void", b"void/inner", b"bad\xff.bin", b"@eaDir"}
    assert b"@eaDir/thumb" not in names and b"alias" not in names
    assert rows["a/x.bin"]["nlink"] == 2 and rows["a/x.bin"]["ino"] == rows["a/hard.bin"]["ino"]
    flat = {r["rel"] for r in filesystem.walk(spark, [str(tmp_path)], recurse=False).collect()}
    assert "a" in flat and "a/x.bin" not in flat and "@eaDir" not in flat


def test_scan_of_real_files(spark, tmp_path):
    tree(tmp_path)
    ent = hashing.with_digests(filesystem.walk(spark, [str(tmp_path)]).where("not is_dir")).withColumn("created_unix", F.lit(None).cast("long"))
    row = duplicates.groups(ent).first()
    assert (row["names"], row["copies"], row["reclaim"] > 0) == (4, 3, True)
    all_ = filesystem.walk(spark, [str(tmp_path)])
    tops = empty_dirs.topmost(all_.where("not is_dir"), all_.where("is_dir"), [str(tmp_path)])
    assert str(tmp_path / "void") in {r["path"] for r in tops.collect()}
    assert hashing.digests_of(str(tmp_path / "missing"))[2]


def test_roots_and_mounts(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    roots = [str(tmp_path / "a/b"), str(tmp_path / "a"), str(tmp_path / "a")]
    assert filesystem.distinct_roots(roots, True) == [str(tmp_path / "a")] and len(filesystem.distinct_roots(roots, False)) == 2
    mounts = "10.0.0.5:/volume1/x /mnt/self\\040dir nfs rw 0 0\nother:/y /mnt/o nfs rw 0 0\n//me/share /mnt/s cifs rw 0 0\n/dev/sda /v ext4 rw 0 0"
    assert filesystem.self_mounts(mounts, {"10.0.0.5", "me"}) == ["/mnt/s", "/mnt/self dir"]


def test_unreadable_is_an_error_row(spark, tmp_path):
    missing = filesystem.walk(spark, [str(tmp_path / "gone")])
    assert missing.where("unreadable").count() == 1
    lines = [r["line"] for r in state.capped_errors(missing.unionByName(missing).unionByName(missing), 1).collect()]
    assert len(lines) == 2 and "2 more" in lines[1]


def test_state(spark, tmp_path):
    root = str(tmp_path / "state")
    assert state.load_results(spark, root) == ({}, {})
    for n in (1, 2):
        state.save_results(spark, root, {"rows": spark.range(n)}, {"scanned_at": f"t{n}"})
    tables, meta = state.load_results(spark, root)
    assert tables["rows"].count() == 2 and meta["scanned_at"] == "t2"
    key = state.request_key(["b", "a"], ["/x/"], [], True, {})
    assert key == state.request_key(["a", "b"], ["/x"], [], True, {})
    state.write_marker(spark, root, key, 7)
    assert state.resume_generation(spark, root, key) == 7 and state.resume_generation(spark, root, "other") is None
    state.clear_marker(spark, root)
    assert state.resume_generation(spark, root, key) is None


def test_marks_journal_csv(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.json").write_text(json.dumps({"about": "x", "at": "t", "folder": "/v/o", "moved": [{"name": "a", "size": 1, "mtime": 2}, {"name": "../b", "size": 1, "mtime": 2}]}))
    assert [r["path"] for r in state.read_marks(spark, str(tmp_path / "m")).collect()] == ["/v/o/a"]
    (tmp_path / "j.jsonl").write_text('{"batch":"b","seq":1,"tag":"begin","path":"/a"}\n{"batch":"b","se')
    assert state.read_journal(spark, str(tmp_path / "j.jsonl")).count() == 1
    out = str(tmp_path / "csv")
    state.write_csv(spark.createDataFrame([(2, "b"), (1, "=a")], "Group long, Name string"), out, ["Group"])
    assert spark.read.option("header", True).csv(out).count() == 2


def wait(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_history_stream(spark, tmp_path):
    schema = "path string, size long, mod_unix long, pfx string, hash string, gen long"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for gen, content in ((1, "x"), (2, "y"), (3, "y")):
            spark.createDataFrame([("/a", 5, 1, "p", content, gen), ("/b", 5, gen, "p", content, gen)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(0.01)
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            wait(ingest.changed_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("/a", "x", "y", 2)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_publish_and_windows(spark, tmp_path):
    schema = "name string, size long, ts timestamp, event_type string, user_id long, value double"
    rows = [("a.tmp", 0, "2024-01-01 00:10:00", "k", 1, 1.0), ("b", 3, "2024-01-01 00:20:00", "k", 1, 2.0), ("c", 0, "2024-01-01 02:00:00", "k", 1, 4.0)]
    df = spark.createDataFrame(rows, "name string, size long, ts string, event_type string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    wait(ingest.publish(stream, {"empty": lambda d: d.where("size = 0")}, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out/empty")).count() == 2
    assert {(r["events"], r["total"]) for r in ingest.event_windows(df).collect()} == {(2, 3.0), (1, 4.0)}
    assert sorted(r["events"] for r in ingest.event_sessions(df).collect()) == [1, 2]
    wait(ingest.event_windows(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "w")).option("checkpointLocation", str(tmp_path / "wcp")).trigger(availableNow=True).start())
    assert spark.read.parquet(str(tmp_path / "w")).count() >= 1
