"""Searches of a nested table (a row a category, an array of lessons in it) that keep categories and entries in order without flattening first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(rows: DataFrame, key: str, order: str, name: str = "lessons", page: int | None = None) -> DataFrame:
    """One row a key with its rows as an array of structs, by `order`; rows of equal order by their other columns.

    A key's rows become one value, which suits groups of bounded size, as a catalog's categories are.  With `page` a key
    has a row for each stretch of so many of a numeric `order` (column page, from 0), so that a key of very many rows is
    many values; what is asked of all of a key is then summed over its pages.
    """
    others = [c for c in rows.columns if c not in (key, order)]
    keys = [F.col(key)] if page is None else [F.col(key), F.floor(F.col(order) / page).alias("page")]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias(name))


def _has(entry: Column, word: str, texts: list[str], lists: list[str]) -> Column:
    low = F.lit(word.lower())
    found = [F.coalesce(F.lower(entry[c]).contains(low), F.lit(False)) for c in texts]
    found += [F.coalesce(F.exists(entry[c], lambda x: F.lower(x).contains(low)), F.lit(False)) for c in lists]
    return reduce(lambda a, b: a | b, found)


def search(table: DataFrame, word: str, texts: list[str], lists: list[str] = (), name: str = "lessons") -> DataFrame:
    """table with only the entries that have the word in a text or in an entry of a list, literally, whatever its case; rows without any go, and a blank word finds nothing."""
    if not word.strip():
        return table.where("false")
    kept = table.withColumn(name, F.filter(name, lambda x: _has(x, word, texts, list(lists))))
    return kept.where(F.size(name) > 0)


def flattened(table: DataFrame, key: str, name: str = "lessons") -> DataFrame:
    """key, place and the entry's fields, one row an entry."""
    each = table.select(key, F.posexplode(name).alias("place", "entry"))
    return each.select(key, "place", "entry.*")


def counts(table: DataFrame, key: str, inner: str | None = None, name: str = "lessons") -> DataFrame:
    """key, n and, for a list inside the entries, the sum of its sizes; null lists count as empty."""
    n = {"n": F.coalesce(F.size(name), F.lit(0))}
    if inner:
        n["n_inner"] = F.aggregate(F.coalesce(name, F.array()), F.lit(0), lambda a, x: a + F.coalesce(F.size(x[inner]), F.lit(0)))
    return table.select(key, *(v.alias(k) for k, v in n.items()))


def first_with(name: str, condition, otherwise: str) -> Column:
    """The first entry of an array for which condition(entry) holds; an error that names `otherwise` where there is none."""
    found = F.filter(name, condition)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit(f"no entry: {otherwise}")))


def by_id(table: DataFrame, key: str, wanted, order: str | None = None) -> DataFrame:
    """The row of that key, the first by `order` (by key, if none is named); an error if there is none."""
    one = table.where(F.col(key) == F.lit(wanted)).agg(F.min_by(F.struct(*table.columns), F.col(order or key)).alias("__one"))
    return one.select(F.coalesce("__one", F.raise_error(F.lit(f"no {key} {wanted}"))).alias("__one")).select("__one.*")
