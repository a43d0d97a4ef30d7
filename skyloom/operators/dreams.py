"""The dream dictionary over texts: matches by one automaton, readings in the row, without a join or shuffle."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at, kept, pick
from ..sources import fixed as V
from .texts import BLANKS, dream_terms
from .words import found_words, may_have, ship


def matched(rows: DataFrame) -> DataFrame:
    """rows (txt, ...) with entries: the places of the dictionary's entries that the text, in lower case, has a word of, ascending."""
    ship(rows.sparkSession)
    low = F.lower("txt")
    return rows.withColumn("entries", found_words(F.when(may_have(low, dream_terms()), low), dream_terms()))


def entries(rows: DataFrame) -> DataFrame:
    """id, ord, keyword, kind, good: one row an entry of a text.  A row gives its own entries, whatever its id."""
    each = matched(rows).select("id", F.explode("entries").alias("ord"))
    return each.select("id", "ord", *(at([d[k] for d in V.DREAMS], F.col("ord")).alias(c) for k, c in enumerate(("keyword", "kind", "good"))))


def statistics(rows: DataFrame) -> DataFrame:
    """kind, n, n_good over all texts' entries."""
    return entries(rows).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))


def _tier(score: Column, values) -> Column:
    return F.when(score >= 80, values[3]).when(score >= 60, values[2]).when(score >= 40, values[1]).otherwise(values[0])


def readings(rows: DataFrame) -> DataFrame:
    """One row a text with a character that isn't blank: id, n, base_score, score (with its keyed jitter), meaning, time_frame, colours, numbers, suggestion; a text without entries gets a generic reading.

    Null and blank texts have no row; rows that share an id, or have none, are read each for itself (their draws by the
    id are the same).
    """
    asked = rows.where(F.col("txt").rlike(f"[^{BLANKS}]")).select("id", "txt")
    found, key = matched(asked), F.col("id").cast("string")
    of = lambda k, o: at([d[k] for d in V.DREAMS], o)
    has = lambda word: F.array_contains("entries", next(k for k, d in enumerate(V.DREAMS) if d[0] == word))
    some = F.col("n") > 0
    points = F.aggregate("entries", F.lit(0), lambda a, o: a + F.when(of(2, o), 70).otherwise(30))
    found = found.withColumns({"n": F.size("entries"), "any_good": F.exists("entries", lambda o: of(2, o))})
    found = found.withColumn("base_score", F.when(some, F.floor(points / F.greatest(F.col("n"), F.lit(1)))).otherwise(50).cast("int"))
    jittered = F.least(F.greatest(F.col("base_score") + pick("jitter", key, 21) - 10, F.lit(0)), F.lit(100))
    found = found.withColumn("score", F.when(some, jittered).otherwise(pick("generic", key, 31) + 40))
    score = F.col("score")
    told = F.create_map(*(F.lit(x) for pair in V.DREAM_TYPE_TEXTS.items() for x in pair))
    kinds = F.array_distinct(F.transform("entries", lambda o: of(1, o)))
    meaning = F.concat(F.array_join(F.transform(kinds, lambda k: F.coalesce(F.try_element_at(told, k), F.lit(V.DREAM_OTHER_TEXT))), "；"), F.lit("。"), _tier(score, V.DREAM_SUMMARIES))
    # The matched colours come first, then three that follow from the omens, then the common ones; five are kept.
    first = [F.when(has(c), c) for c in ("红色", "金色", "白色")]
    omens = F.when(F.col("any_good"), F.array(*map(F.lit, V.DREAM_COLOURS["good"]))).otherwise(F.array(*map(F.lit, V.DREAM_COLOURS["bad"])))
    colours = F.slice(F.array_distinct(F.concat(kept(*first), omens, F.array(*map(F.lit, V.DREAM_COLOURS["common"])))), 1, 5)
    drawn = [pick(salt, key, 49) + 1 for salt in ("number1", "number2")]
    numbers = F.slice(F.array_distinct(F.array(F.col("n"), *map(F.lit, V.DREAM_NUMBERS), *drawn)), 1, 6)
    tiers = F.when(score >= 70, 2).when(score >= 50, 1).otherwise(0)
    own = F.transform(F.slice("entries", 1, 3), lambda o: at(V.DREAM_SUGGESTIONS, o))
    suggestion = F.concat(F.array_join(F.slice(F.concat(own, *(F.array(at([t[k] for t in V.DREAM_TIER_SUGGESTIONS], tiers)) for k in (0, 1))), 1, 3), "；"), F.lit("。"))
    text = lambda own_text, generic: F.when(some, own_text).otherwise(generic)
    return found.select(
        "id", "n", "base_score", "score", text(meaning, at(V.DREAM_GENERIC_TEXTS, pick("meaning", key, 5))).alias("meaning"), text(_tier(score, V.DREAM_TIMES), V.DREAM_TIMES[2]).alias("time_frame"),
        text(F.array_join(colours, " "), " ".join(V.DREAM_COLOURS["generic"])).alias("colours"), text(F.array_join(numbers.cast("array<string>"), " "), " ".join(map(str, V.DREAM_GENERIC_NUMBERS))).alias("numbers"), text(suggestion, V.DREAM_GENERIC_SUGGESTION).alias("suggestion"),
    )
