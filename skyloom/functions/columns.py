"""Small column helpers: look-ups in fixed lists, keyed picks, the sexagenary formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cycles
from .dialect import SPARK


def at(values, index: Column) -> Column:
    """values[index], counted from 0; null outside."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def pick(salt: str, key: Column, n: int) -> Column:
    """A number in [0, n) that depends on salt and key alone."""
    return F.pmod(hashed(salt, key), F.lit(n)).cast("int")


def hashed(salt: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), key)), 1, 8), 16, 10).cast("long")


def day_stem(ts: str, convention: str) -> Column:
    return F.expr(cycles.day_stem(SPARK, ts, convention))


def day_branch(ts: str, convention: str) -> Column:
    return F.expr(cycles.day_branch(SPARK, ts, convention))


def hour_branch(ts: str) -> Column:
    return F.expr(cycles.hour_branch(SPARK, ts))


def joined(items: Column, sep: str) -> Column:
    return F.array_join(items, sep)


def kept(*items: Column) -> Column:
    """An array of those of the items that aren't null."""
    return F.array_compact(F.array(*items))
