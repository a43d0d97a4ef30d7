"""The log as a stream: one bounded table in versions with a reader, and a bounded log a key as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import history


# -- one log, in versions --------------------------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions under path, ascending: those whose writer has committed."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1]))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The log as its newest whole version has it, newest entries first; an empty log before the first.  A version is never changed once it is whole, and the one before it stays, so a reader isn't disturbed by the batch that is being written."""
    known = versions(spark, path)
    return history.latest(history.load(spark, f"{path}/v{known[-1]:012d}") if known else spark.createDataFrame([], history.SCHEMA), 1 << 30)


def keep_latest(entries: DataFrame, path: str, checkpoint: str, capacity: int = history.CAPACITY):
    """Starts a query that keeps the newest entries of a stream under path.

    Each micro-batch makes the next version from the last; a batch that comes again after a restart finds its version
    whole and does nothing, or makes it anew from the same predecessor.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = versions(spark, path)
        if known and known[-1] >= number:
            return
        before = history.load(spark, f"{path}/v{known[-1]:012d}") if known else spark.createDataFrame([], history.SCHEMA)
        history.save(history.append(before, batch, capacity), f"{path}/v{number:012d}")
        for old in known[:-1]:
            fs, where = _fs(spark, f"{path}/v{old:012d}")
            fs.delete(where, True)

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- a log a key -----------------------------------------------------------------------------------------------------
def latest_by_key(entries: DataFrame, key: str, capacity: int = history.CAPACITY) -> DataFrame:
    """A stream of (key, n, entries) of every key that a batch touches: its newest entries by date and seq as JSON, newest first, from keyed state that holds no more than `capacity` of them.

    entries: a stream of history's columns and the key (a long).  A key's new entries come in slices and are cut to the
    capacity after each, so a hot key needs no more memory than others.
    """

    def step(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for part in parts:
            fresh = [[str(r.date), int(r.seq), r.type, r.result, r.details] for r in part.itertuples()]
            known = {(e[0], e[1]): e for e in held + fresh}  # an entry that comes again counts once
            held = [known[k] for k in sorted(known, reverse=True)[:capacity]]
        state.update((json.dumps(held, ensure_ascii=False),))
        yield pd.DataFrame({key: [names[0]], "n": [len(held)], "entries": [json.dumps(held, ensure_ascii=False)]})

    columns = entries.select(key, "seq", "type", "result", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), "details")
    return columns.groupBy(key).applyInPandasWithState(step, f"{key} long, n int, entries string", "entries string", "update", GroupStateTimeout.NoTimeout)
