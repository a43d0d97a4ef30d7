"""The bounded log of results: append, the latest ones, clear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "seq long, type string, result string, date timestamp_ntz, details string"
CAPACITY = 100
#: How dates are written, to the microsecond, and read, with any fraction or none.
WRITTEN, READ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]"


def latest(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest entries: by date, then by seq."""
    return log.orderBy(F.col("date").desc(), F.col("seq").desc()).limit(capacity)


def append(log: DataFrame, entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return latest(log.unionByName(entries), capacity)


def save(log: DataFrame, path: str) -> None:
    """One JSON object a row."""
    log.write.mode("overwrite").option("timestampNTZFormat", WRITTEN).json(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("timestampNTZFormat", READ).json(path)


def clear(spark, path: str) -> None:
    save(spark.createDataFrame([], SCHEMA), path)


def encoded(log: DataFrame) -> DataFrame:
    """seq and the entry as JSON text."""
    return log.select("seq", F.to_json(F.struct("type", "result", "details")).alias("entry"))


def decoded(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.from_json("entry", "type string, result string, details string").alias("e")).select("seq", "e.*")
