"""Session folders, written intermediate tables and small column helpers of the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local one where it names none and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skyloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a few numbers that a file holds at least, where their number is known.
FILE_ROWS = 1 << 16


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors.  rows: about so many come, of a few numbers each and from inputs no larger; partitions then go together into files of FILE_ROWS, a file for each core at least."""
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(df.sparkSession)}/skyloom-{uuid.uuid4().hex}/{label}"
    _WRITTEN.append(path.rsplit("/", 1)[0])
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")  # the shuffles behind a written table aren't needed again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of the tables that this process has written.
_WRITTEN: list[str] = []


def discard(spark: SparkSession, tables: list[str] | None = None, unless_read_by: DataFrame | None = None) -> int:
    """Deletes the intermediate tables written so far (or those of them in tables), but for the ones that a frame reads, and with them other results that still read them; returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    needed = "".join(unless_read_by.inputFiles()) if unless_read_by is not None and tables != [] else ""
    gone = [x for x in _WRITTEN if (tables is None or x in tables) and x.rsplit("/", 1)[1] not in needed]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x not in gone]
    return len(gone)


def tables_written() -> list[str]:
    """The folders of the intermediate tables that there are."""
    return list(_WRITTEN)


def blocks_for(df: DataFrame, each: int = 8 << 20) -> int:
    """A number of hash blocks for df's text (binary): two for each shuffle partition, and more where a block would have over `each` bytes; the bytes are counted, not taken from the planner."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min((1 << 31) - 1, max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each)))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for clusters whose workers cannot import it."""
    sc = spark.sparkContext
    if getattr(sc, "_skyloom_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="skyloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = shutil.make_archive(f"{folder}/skyloom", "zip", root, "skyloom")
    sc.addPyFile(name)
    sc._skyloom_sent = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, kind: str = "int") -> Column:
    """The folds of an array's beginnings: op of the first one, two, three ... values.  op is associative; values and folds are of that kind.  In blocks of the size's root, so n values cost n to the power 1.5 and not the square, as an array can only be built by copies."""
    none = F.array().cast(f"array<{kind}>")
    last = lambda a: F.get(a, F.size(a) - 1)
    folded = lambda a: F.aggregate(a, none, lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(op(last(done), x)).cast(kind))))

    def joined(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: folded(F.slice(v, b * width + 1, width)))
        carried = lambda inside: let(folded(F.transform(inside, last)), lambda ends: F.flatten(F.transform(inside, lambda a, b: F.when(b == 0, a).otherwise(F.transform(a, lambda x: op(F.get(ends, b - 1), x).cast(kind))))))
        return F.when(F.size(v) > 0, let(blocks, carried)).otherwise(none)

    return let(values, joined)


def words(text: Column) -> Column:
    """The maximal runs of other characters than white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Rows are dropped by a broadcast of their keys up to so many bytes, and by a shuffle beyond; the rows are the same.
BROADCAST_BYTES = 64 << 20


def without(df: DataFrame, dropped: DataFrame, left: Column, right: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df's rows whose key is not in dropped, a written table; null is a key like others."""
    size = dropped.agg(F.sum(F.coalesce(F.octet_length(right.cast("string")), F.lit(0)) + 32)).first()[0] or 0
    return df.join(F.broadcast(dropped) if size <= broadcast_bytes else dropped, left.eqNullSafe(right), "left_anti")
