"""Quality rules of documents, and the verdict on hosts that the documents' failures give.

Every document is measured alone, without a shuffle.  Failures are then summed by host (a partial sum in each
task, so a host with a third of all rows is one row a task), each rule's rate is shrunk towards the mean of all
hosts by a beta prior fitted to the hosts' rates, and the verdict is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, without, words, written

SYMBOLS = "#*$%&|<>"
#: A host whose shrunk failure rate of any rule is above this is rejected with all its documents.
HOST_LIMIT = 0.8
RULES = ("short", "repeats", "symbols", "lines", "lengths")


def repeated_words(tokens: Column) -> Column:
    """Words in those 3-word windows that are found twice or more in tokens; tokens must be a column, not an expression.

    The windows' hashes are sorted with their positions; equal neighbours are repeats, and the union of
    the repeats' three-word intervals is counted in one pass over their sorted starts.
    """
    n = F.size(tokens)
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")),
    )

    def starts(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return F.when(n >= 4, let(F.sort_array(hashed), lambda s: let(starts(s), covered))).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """One row for each row of docs: the columns of docs in keep (whose names differ from the following), id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.  A null text has no words and no lines with words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(*keep, F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("__text"), words(F.col(text_col)).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return split.select(
        *keep,
        "id",
        "host",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    ).select(*keep, "id", "host", "n_words", "word_chars", "n_symbols", F.col("__lines.n").alias("n_lines"), F.col("__lines.dup").alias("n_dup_lines"), "n_repeat_words")


def failures(m: DataFrame) -> DataFrame:
    """A boolean column fail_<rule> for each rule."""
    n = F.col("n_words")
    return m.withColumns(
        {
            "fail_short": n < 50,
            "fail_repeats": 100 * F.col("n_repeat_words") > 50 * n,
            "fail_symbols": 2 * F.col("n_symbols") > n,
            "fail_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
            "fail_lengths": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        }
    )


def host_verdicts(failed: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each host (null is a host): host, n_docs, host_rejected.

    A rule's prior is Beta(m s, (1 - m) s): m is the mean of the hosts' rates, each weighted by its documents, and s follows
    from their variance, weighted alike, by the method of moments, held within 1 and 1000.  The shrunk rate is
    (failures + m s) / (documents + s): a host of few documents stays near the mean, a host of many keeps its own rate.
    """
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(r) for r in RULES])
    moments = hosts.agg(
        *[(F.sum(r) / F.sum("n_docs")).alias(f"m_{r}") for r in RULES],
        *[(F.sum(F.col(r) * F.col(r) / F.col("n_docs")) / F.sum("n_docs")).alias(f"q_{r}") for r in RULES],
    )
    joined = hosts.join(F.broadcast(moments))  # moments has one row
    rejected = F.lit(False)
    for r in RULES:
        m = F.col(f"m_{r}")
        v = F.col(f"q_{r}") - m * m
        s = F.when(v > 1e-12, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(F.lit(1000.0))
        rejected = rejected | ((F.col(r) + m * s) / (F.col("n_docs") + s) > limit)
    return joined.select("host", "n_docs", rejected.alias("host_rejected"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs, with its columns, that quality() keeps.

    Null, empty and short texts go; a null host is a host of its own.  Repeated rows and ids are judged each for itself,
    columns of any names are kept as they are (they travel as one struct), and an empty table gives none.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    checked = written(failures(measures(packed, "id", "text", "host", ["__row"])), "measures")
    rejected = written(host_verdicts(checked, limit).where("host_rejected").select("host"), "hosts")
    passed = checked.where(~F.col("fail_short") & ~F.col("fail_repeats"))
    return without(passed, rejected, passed["host"], rejected["host"]).select("__row.*")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every row, base_failed, host_rejected and kept.

    Rows are judged one by one: repeated rows and ids give repeated results.  Null or empty texts have no words and
    fail; a null host is a host of its own; other columns of docs, whatever their names, are not read.  An empty
    table gives an empty result.
    """
    failed = failures(written(measures(docs, id_col, text_col, host_col), "measures"))
    verdict = host_verdicts(failed, limit).select(F.col("host").alias("of_host"), "host_rejected")
    base = F.col("fail_short") | F.col("fail_repeats")
    # Hosts may be many: the planner broadcasts the verdicts below its size threshold, and splits a hot host beyond it.
    return failed.join(verdict, F.col("host").eqNullSafe(F.col("of_host")), "left").select(
        "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "host_rejected", (~base & ~F.col("host_rejected")).alias("kept")
    )
