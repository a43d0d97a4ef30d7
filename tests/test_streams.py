"""The log and the memos as streams: restarts, replays, readers, keyed state."""

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from skyloom.operators import history
from skyloom.streaming import history as log
from skyloom.streaming import memos

T0 = dt.datetime(2024, 1, 1)


def entry(k, user=0):
    return (k, "six", f"r{k}", T0 + dt.timedelta(minutes=k), None if k % 3 else f'{{"k": {k}}}', user)


def put(spark, folder, entries, name):
    spark.createDataFrame(entries, history.SCHEMA + ", user long").coalesce(1).write.mode("append").json(f"{folder}/{name}")


def stream(spark, folder, schema=history.SCHEMA + ", user long"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(folder)


def seqs(spark, path):
    return [r["seq"] for r in log.current(spark, path).collect()]


def test_versions_restart_and_replay(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    put(spark, source, [entry(k) for k in range(5)], "a")
    assert seqs(spark, path) == []
    entries = stream(spark, source).drop("user")
    log.keep_latest(entries, path, checkpoint, 8).awaitTermination()
    assert seqs(spark, path) == [4, 3, 2, 1, 0]
    held = log.current(spark, path)  # a reader of this version, while the next is written
    put(spark, source, [entry(k) for k in range(5, 12)], "b")
    log.keep_latest(entries, path, checkpoint, 8).awaitTermination()
    assert seqs(spark, path) == list(range(11, 3, -1)) and [r["seq"] for r in held.collect()] == [4, 3, 2, 1, 0]
    # The last batch comes again: its commit is lost, its version is whole.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    log.keep_latest(entries, path, checkpoint, 8).awaitTermination()
    assert seqs(spark, path) == list(range(11, 3, -1))
    # It comes again with its version half written: that one doesn't count, and is made anew.
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    newest = log.versions(spark, path)[-1]
    (tmp_path / "log" / f"v{newest:012d}" / "_SUCCESS").unlink()
    assert seqs(spark, path) == [4, 3, 2, 1, 0]
    log.keep_latest(entries, path, checkpoint, 8).awaitTermination()
    assert seqs(spark, path) == list(range(11, 3, -1)) and len(log.versions(spark, path)) == 2


def test_log_by_key(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    run = lambda: log.latest_by_key(stream(spark, source), "user", 3).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{out}/{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    put(spark, source, [entry(k, k % 2) for k in range(6)] + [entry(9, 5)], "a")
    run()
    put(spark, source, [entry(20, 1), entry(20, 1), entry(2, 1), entry(21, 7)], "b")  # one entry twice, one late
    run()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out).collect()
    got = {}
    for r in rows:
        got.setdefault(r["user"], []).append([e[1] for e in json.loads(r["entries"])])
    assert {u: max(x, key=lambda v: (max(v), len(v))) for u, x in got.items()} == {0: [4, 2, 0], 1: [20, 5, 3], 5: [9], 7: [21]}
    assert all(r["n"] <= 3 for r in rows)


def test_memos(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "memos", "cp"))
    day = lambda k: dt.date(2024, 1, k)
    write = lambda rows, name: spark.createDataFrame(rows, "user long, day date, sign int, seq long").coalesce(1).write.json(f"{source}/{name}")
    run = lambda: memos.keep(stream(spark, source, "user long, day date, sign int, seq long"), path, checkpoint).awaitTermination()
    write([(1, day(1), 5, 1), (2, day(1), 7, 2), (1, day(2), 9, 3)], "a")
    run()
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "memos" / "day=2024-01-01").glob("*.parquet")}
    write([(1, day(2), 3, 4), (3, day(2), 8, 5), (1, day(3), 1, 6), (1, day(3), 2, 6)], "b")
    run()
    want = {(1, day(1), 5), (2, day(1), 7), (1, day(2), 3), (3, day(2), 8), (1, day(3), 2)}
    state = lambda: {(r["user"], r["day"], r["sign"]) for r in memos.read(spark, path).collect()}
    assert state() == want and len(memos.read(spark, path).collect()) == 5
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "memos" / "day=2024-01-01").glob("*.parquet")} == untouched
    assert [r["sign"] for r in memos.drawn_on(memos.read(spark, path), 1, day(2)).collect()] == [3] and memos.drawn_on(memos.read(spark, path), 9, day(2)).collect() == []
    plan = memos.drawn_on(memos.read(spark, path), 1, day(2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    memos.upsert(spark, spark.createDataFrame([(1, day(2), 3, 4), (1, day(2), 9, 3)], "user long, day date, sign int, seq long"), path, str(tmp_path / "again"))
    assert state() == want
    shutil.rmtree(checkpoint)  # all batches come again, in order
    run()
    assert state() == want
    assert memos.read(spark, str(tmp_path / "none")).collect() == []
