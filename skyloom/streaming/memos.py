"""The day's sign of each user as a keyed sink: upserts by day partition, read back by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "user long, sign int, seq long, day date"


def newest(memos: DataFrame) -> DataFrame:
    """Of each user and day the row of the greatest seq (of equal ones, the greatest sign)."""
    last = Window.partitionBy("user", "day").orderBy(F.col("seq").desc(), F.col("sign").desc())
    return memos.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All memos; empty before the first.  day is the partition, so a filter on it reads that day alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def drawn_on(memos: DataFrame, user: int, day) -> DataFrame:
    """What a user drew on a day: no row if nothing yet."""
    return memos.where((F.col("day") == F.lit(day)) & (F.col("user") == user)).select("user", "sign")


def upsert(spark: SparkSession, new: DataFrame, path: str, staging: str) -> None:
    """Merges new (user, day, sign, seq) into path: only the days that occur in it are rewritten, from a staged table, since they are read, too.  Doing it again changes nothing."""
    days = new.select("day").distinct()
    before = read(spark, path).join(F.broadcast(days), "day", "left_semi")
    newest(before.unionByName(new.select("user", "sign", "seq", "day"))).write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(SCHEMA).parquet(staging)
    staged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def keep(memos: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes a stream of (user, day, sign, seq) to the memos under path; a batch that comes again is the same upsert."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, batch, path, f"{checkpoint}/staged/{number % 2}")

    return memos.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
