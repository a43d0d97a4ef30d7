"""Details of mixed shape: JSON text as VARIANT, typed extraction by path, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(log: DataFrame, column: str = "details") -> DataFrame:
    """log with column as VARIANT, and `<column>_bad` for text that isn't JSON (null then); null stays null."""
    value = F.try_parse_json(F.col(column))
    return log.withColumns({f"{column}_bad": F.col(column).isNotNull() & value.isNull(), column: value})


def field(column: str, path: str, kind: str) -> Column:
    """The value at a path, as a type; null where the path isn't there or the value isn't of that type."""
    return F.try_variant_get(F.col(column), path, kind)


def kinds(log: DataFrame, column: str = "details") -> DataFrame:
    """shape, n: how many rows have which schema, whole records of which shape occur in a log of mixed details."""
    return log.groupBy(F.schema_of_variant(column).alias("shape")).agg(F.count("*").alias("n"))


def fields(log: DataFrame, key: str, column: str = "details") -> DataFrame:
    """key, name, kind, value: one row a top-level field of an object, whatever fields each row has."""
    # Each entry by variant_explode, a table function joined laterally: no schema is needed.
    return log.sparkSession.sql(f"SELECT r.{key}, e.key AS name, schema_of_variant(e.value) AS kind, to_json(e.value) AS value FROM {{rows}} r, LATERAL variant_explode(r.{column}) e", rows=log)


def encoded(log: DataFrame, column: str = "details") -> DataFrame:
    """VARIANT back to JSON text: keys in the order of the VARIANT (sorted), numbers as they are written shortest."""
    return log.withColumn(column, F.to_json(column))
