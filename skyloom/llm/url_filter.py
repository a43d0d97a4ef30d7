"""URL filters: host rules first, then the ratio of two character language models, trained on URLs that rules allow and block.

Both models are smoothed variable-order Markov models over bytes: each symbol is predicted by the longest context of
up to ORDER bytes that the model has seen, mixed with all shorter ones by Witten-Bell weights.  They are counted over all URLs
under a rule outside the threshold's fold, by a shuffle.  Orders that fit in a checked number of bytes are broadcast; what
higher orders say of a symbol comes by a join with their contexts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import SMALL_BYTES
from .common import LOWER, UPPER, ship, written

#: Fixed values: (verdict, host and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
ORDER = 6
#: Orders are broadcast, lowest first, while both models take so many bytes; a continuation takes GRAM_BYTES with its share of a context.
MODEL_BYTES, GRAM_BYTES = 64 << 20, 40
#: One in so many URLs under a rule is never fitted on; all of these set the threshold.
FOLDS = 4
#: Scores are counted in steps of this share of a nat to find the threshold.
STEPS = 1000
BEGIN, END = 2, 3


# -- rules -----------------------------------------------------------------------------------------------------------
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(authority, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"^([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, null fields without one: a rule fits its host and all subdomains where the path starts with the rule's path.  Of rules of one length the first wins."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    kind = "struct<rule:string,verdict:string>"
    return F.coalesce(chosen.cast(kind) if chosen is not None else F.lit(None).cast(kind), F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))


# -- models ----------------------------------------------------------------------------------------------------------
@dataclass
class Symbols:
    """URLs as one run of symbols: each begins with BEGIN, which isn't predicted, and ends with END, which is."""

    data: np.ndarray  # symbols, all URLs
    room: np.ndarray  # of each symbol, how many precede it in its URL
    owner: np.ndarray  # of each symbol, its URL
    n: int

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Symbols:
        n, sizes = len(offsets) - 1, np.diff(offsets) + 2
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if n else 0, np.uint64)
        owner = np.repeat(np.arange(n), sizes)
        room = np.arange(len(out)) - np.repeat(ends - sizes, sizes)
        last = room == np.repeat(sizes, sizes) - 1
        out[(room > 0) & ~last] = data
        out[room == 0], out[last] = BEGIN, END
        return cls(out, room, owner, n)

    def grams(self):
        """By order k from 0 to ORDER: the places with a context of k symbols, and context and symbol there as one number (k + 1 bytes, the context's nearest symbol lowest but one)."""
        code = self.data.copy()
        for k in range(ORDER + 1):
            if k:
                code[k:] |= self.data[:-k] << np.uint64(8 * k) if k < len(code) else 0
            at = np.flatnonzero(self.room >= max(k, 1))
            yield at, code[at]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether they hold what is wanted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Markov:
    """By order: sorted (context, symbol) codes with counts, and sorted contexts with total counts and numbers of different symbols."""

    grams: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    contexts: list = field(default_factory=list)
    totals: list = field(default_factory=list)
    kinds: list = field(default_factory=list)

    @classmethod
    def fit(cls, symbols: Symbols) -> Markov:
        return cls.of([np.unique(code, return_counts=True) for _, code in symbols.grams()])

    @classmethod
    def of(cls, by_order: list[tuple[np.ndarray, np.ndarray]]) -> Markov:
        """From sorted codes and their counts, by order from 0 on."""
        model = cls()
        for grams, counts in by_order:
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            model.grams.append(grams)
            model.counts.append(counts.astype(np.float64))
            model.contexts.append(contexts)
            model.totals.append(np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0))
            model.kinds.append(np.diff(np.append(first, len(grams))).astype(np.float64))
        return model

    def log_likelihood(self, symbols: Symbols) -> np.ndarray:
        """Each URL's natural log-likelihood."""
        told = symbols.room > 0
        return np.bincount(symbols.owner[told], np.log(self.chances(symbols)[told]), symbols.n)

    def chances(self, symbols: Symbols) -> np.ndarray:
        """Each symbol's probability, by the orders that there are.  A context that wasn't seen has no longer one that was, and a symbol not seen behind it isn't seen behind a longer one, so later orders look up less."""
        p = np.full(len(symbols.data), 1 / 256)
        alive, known = np.ones(len(p), bool), np.ones(len(p), bool)
        for k, (at, code) in zip(range(len(self.grams)), symbols.grams(), strict=False):
            live = alive[at]
            alive[:] = False
            at, code = at[live], code[live]
            c, seen = find(self.contexts[k], code >> np.uint64(8))
            at, code, c = at[seen], code[seen], c[seen]
            alive[at] = True
            count = np.zeros(len(at))
            looked = known[at]
            g, there = find(self.grams[k], code[looked])
            count[looked] = np.where(there, self.counts[k][g] if len(g) else 0, 0)
            known[at[looked]] = there
            p[at] = (count + self.kinds[k][c] * p[at]) / (self.totals[k][c] + self.kinds[k][c])
        return p


def scores(accepted: Markov, rejected: Markov, symbols: Symbols) -> np.ndarray:
    """Each URL's log-likelihood under the rejected model less that under the accepted one, by its symbols (the end is one)."""
    length = np.bincount(symbols.owner[symbols.room > 0], minlength=symbols.n)
    return (rejected.log_likelihood(symbols) - accepted.log_likelihood(symbols)) / np.maximum(length, 1)


def threshold_of(histogram: dict[int, tuple[int, int]]) -> float:
    """The least loss of balanced accuracy over counts (allowed, blocked) by score step: URLs at or above the threshold are blocked.  Of equally good steps, also between those that occur, the one nearest to 0; 0 where a verdict has no URL."""
    allowed, blocked = (sum(h[k] for h in histogram.values()) for k in (0, 1))
    if not allowed or not blocked:
        return 0.0
    edges = sorted(histogram)
    lost, found = allowed * blocked, []  # below the first step all are blocked, so the allowed ones are lost
    for before, step in zip([min(0, edges[0]) - 1, *edges], [*edges, max(0, edges[-1] + 1)], strict=True):
        nearest = min(max(0, before + 1), step)
        found.append((lost, abs(nearest), nearest))
        a, b = histogram.get(step, (0, 0))
        lost += b * allowed - a * blocked
    return min(found)[2] / STEPS


# -- the operator ----------------------------------------------------------------------------------------------------
def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str, url_col: str) -> DataFrame:
    """id, url (never null, bytes that aren't UTF-8 as U+FFFD), host, path, rule, verdict of the rule."""
    url = F.make_valid_utf8(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url, F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    return rows.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "r.rule", "r.verdict")


def fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS))


def fit_rows(rows: DataFrame, verdict: str, fit_urls: int, fit_bytes: int) -> list[bytes]:
    """For trying models out on little; the operator reads all URLs.  At most fit_urls distinct URLs, and fit_bytes of them, of a verdict outside the threshold's fold: those of least hash.  A count first leaves some twice as many rows to be sorted, however many there are."""
    mine = rows.where((F.col("verdict") == verdict) & (fold() != 0)).select("url", F.xxhash64(F.lit("fit"), "url").alias("h"))
    n = mine.agg(F.approx_count_distinct("url")).first()[0]
    if n > 2 * fit_urls:
        mine = mine.where(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * 2 * fit_urls / n))
    mine = mine.distinct().withColumn("k", F.pmod("h", F.lit(1 << 40)))
    few = mine.orderBy("k", "url").limit(fit_urls).withColumn("bytes", F.sum(F.octet_length("url")).over(Window.orderBy("k", "url")))
    return [bytes(r[0]) for r in few.where(F.col("bytes") <= fit_bytes).orderBy("k", "url").select(F.encode("url", "UTF-8")).collect()]


@dataclass
class Models:
    """The models of allowed and of blocked URLs: their orders up to `order`, and a table of the contexts of higher ones, None if there are none (columns k, context, in_allow, kinds_allow, in_block, kinds_block, and by symbol the counts)."""

    accepted: Markov
    rejected: Markov
    order: int = ORDER
    higher: DataFrame | None = None


def gram_counts(urls: DataFrame) -> DataFrame:
    """k, code, allow, block: how often each continuation of k symbols occurs in the URLs (columns verdict, url) of each verdict."""
    ship(urls.sparkSession)

    def run(batches):
        from .arrow import slices

        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), SMALL_BYTES):
                blocked = np.array(batch.column(0).slice(first, end - first).to_pylist()) == "block"
                symbols = Symbols.of(data, offsets)
                for k, (at, code) in enumerate(symbols.grams()):
                    found, where = np.unique(code, return_inverse=True)
                    counts = np.bincount(2 * where + blocked[symbols.owner[at]], minlength=2 * len(found)).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found.view(np.int64)), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["k", "code", "allow", "block"])

    parts = urls.select("verdict", F.col("url").cast("binary")).mapInArrow(run, "k int, code long, allow long, block long")
    return parts.groupBy("k", "code").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def fitted(rows: DataFrame, model_bytes: int = MODEL_BYTES) -> Models | None:
    """The models of all distinct URLs under a rule outside the threshold's fold; None if there are no URLs of either verdict."""
    grams = written(gram_counts(rows.where(F.col("verdict").isNotNull() & (fold() != 0)).select("verdict", "url").distinct()), "grams")
    sizes = {r["k"]: (r["allow"], r["block"]) for r in grams.groupBy("k").agg(*(F.count_if(F.col(v) > 0).alias(v) for v in ("allow", "block"))).collect()}  # a row an order
    if not all(sizes.get(0, (0, 0))):
        return None
    held = GRAM_BYTES * np.cumsum([sum(sizes.get(k, (0, 0))) for k in range(ORDER + 1)])
    order = max(0, int(np.searchsorted(held, model_bytes, side="right")) - 1)  # the lowest has 256 symbols at most
    table = grams.where(F.col("k") <= order).toArrow()
    k, code = table["k"].to_numpy(), table["code"].to_numpy().view(np.uint64)
    sort, models = np.lexsort((code, k)), []
    for verdict in ("allow", "block"):
        n = table[verdict].to_numpy()
        mine = sort[n[sort] > 0]
        ends = np.searchsorted(k[mine], np.arange(order + 2))
        models.append(Markov.of([(code[mine[x:y]], n[mine[x:y]]) for x, y in zip(ends[:-1], ends[1:], strict=True)]))
    if order == ORDER:
        return Models(*models)
    context, symbol = F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(0xFF).alias("symbol")
    both = [f(v).alias(f"{name}_{v}") for v in ("allow", "block") for name, f in (("in", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))]
    by_symbol = F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("allow", "block")))).alias("symbols")  # 256 at most
    higher = grams.where(F.col("k") > order).select("k", context, symbol, "allow", "block").groupBy("k", "context").agg(*both, by_symbol)
    return Models(*models, order, written(higher, "contexts"))


def scored(rows: DataFrame, models: Models) -> DataFrame:
    """rows with score; url is rows' second column, null is empty."""
    return scored_in_slices(rows, models) if models.higher is None else scored_by_joins(rows, models)


def scored_by_joins(rows: DataFrame, models: Models) -> DataFrame:
    """scored where not all orders are broadcast: each symbol of the distinct URLs (by two hashes of 64 bits) meets its higher contexts in a join; a null URL has no score."""
    spark, order, url = rows.sparkSession, models.order, F.col(rows.columns[1])
    names = lambda x: (F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit("again")).alias("h2"))
    ship(spark)
    shared = spark.sparkContext.broadcast((models.accepted, models.rejected))

    def run(batches):
        from .arrow import slices

        accepted, rejected = shared.value
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(2), SMALL_BYTES // 8):
                symbols = Symbols.of(data, offsets)
                told = np.flatnonzero(symbols.room > 0)
                code = np.zeros(len(symbols.data), np.uint64)
                for at, grown in symbols.grams():
                    code[at] = grown  # of the longest context there is
                owner = pa.array(symbols.owner[told] + first)
                found = [batch.column(k).take(owner) for k in (0, 1)] + [pa.array(x[told]) for x in (symbols.room, code.view(np.int64), accepted.chances(symbols), rejected.chances(symbols))]
                yield pa.RecordBatch.from_arrays(found, ["h1", "h2", "at", "code", "p_allow", "p_block"])

    urls = rows.where(url.isNotNull()).select(url.alias("url")).distinct().select(*names("url"), F.col("url").cast("binary"))
    places = written(urls.mapInArrow(run, "h1 long, h2 long, at long, code long, p_allow double, p_block double"), "places")
    row = ["h1", "h2", "at"]
    longer = places.where(F.col("at") > order).select(*row, "code", F.explode(F.sequence(F.lit(order + 1), F.least(F.lit(ORDER), F.col("at").cast("int")))).alias("k"))
    own = F.expr("code & (shiftleft(1L, 8 * k + 8) - 1)")
    wanted = longer.select(*row, "k", F.shiftright(own, 8).alias("context"), F.col("code").bitwiseAND(0xFF).alias("symbol"))
    met = wanted.join(models.higher, ["k", "context"]).withColumn("n", F.try_element_at("symbols", F.col("symbol")))
    told = met.select(*row, F.struct("k", *(F.struct(F.coalesce(F.col("n")[v], F.lit(0)).alias("n"), F.col(f"in_{v}").alias("all"), F.col(f"kinds_{v}").alias("kinds")).alias(v) for v in ("allow", "block"))).alias("x"), F.lit(None).cast("double").alias("p_allow"), F.lit(None).cast("double").alias("p_block"))
    either = told.unionByName(places.select(*row, "p_allow", "p_block"), allowMissingColumns=True)
    symbol = either.groupBy(row).agg(F.max("p_allow").alias("p_allow"), F.max("p_block").alias("p_block"), F.sort_array(F.collect_list("x")).alias("xs"))  # ORDER at most

    def mixed(v: str) -> Column:
        """A context that the model hasn't seen changes nothing."""
        one = lambda p, x: F.when(x[v]["all"] > 0, (x[v]["n"] + x[v]["kinds"] * p) / (x[v]["all"] + x[v]["kinds"])).otherwise(p)
        return F.ln(F.aggregate("xs", F.col(f"p_{v}"), one)).alias(v)

    summed = lambda v: F.aggregate("all", F.lit(0.0), lambda done, x: done + x[v])
    by_url = symbol.select(*row, mixed("allow"), mixed("block")).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("at", "allow", "block"))).alias("all"))
    found = by_url.select("h1", "h2", ((summed("block") - summed("allow")) / F.size("all")).alias("score"))
    h1, h2 = (F.when(url.isNotNull(), x) for x in (F.xxhash64(url), F.xxhash64(url, F.lit("again"))))
    return rows.withColumns({"h1": h1, "h2": h2}).join(found, ["h1", "h2"], "left").drop("h1", "h2")


def scored_in_slices(rows: DataFrame, models: Models) -> DataFrame:
    """scored where all orders are broadcast: one narrow pass."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((models.accepted, models.rejected))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        from .arrow import slices
        from .url_filter import Symbols, scores

        accepted, rejected = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), 1 << 20):
                found = scores(accepted, rejected, Symbols.of(data, offsets))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array(found)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, schema)


def filtered(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", *, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """id, host, path, rule, verdict and score of every row of pages: the longest fitting rule's verdict, else block where the score reaches the threshold.

    score is the length-normalised log-likelihood ratio of whole URLs (rejected over accepted model; null where a rule
    decides).  The models are fitted on all distinct ruled URLs but those of one fold; the threshold has
    the least balanced error over all ruled URLs of the fold that no model has seen, counted by score.  Orders
    beyond model_bytes are joined instead of broadcast, with the same scores.  Without allowed
    or without blocked URLs there is no model: every other URL is allowed, with a null score.  Null URLs and those
    without `://` have an empty host and path and no rule; a null one is scored as empty.  Repeated rows and ids are
    judged each for itself, an empty table gives none, and other columns aren't read.  Three passes over the URL
    column (counts, threshold, result); ruled URLs and the models' counts are shuffled, and rows only where orders are joined.
    """
    rows = judged(pages, rules, id_col, url_col)
    models = fitted(rows, model_bytes)
    columns = ["id", "host", "path", "rule"]
    if models is None:
        return rows.select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    tried = scored(rows.where(F.col("verdict").isNotNull() & (fold() == 0)).select("verdict", "url"), models)
    step = F.floor(F.col("score") * STEPS)
    counts = tried.groupBy(step.alias("step")).agg(*(F.count_if(F.col("verdict") == v) for v in ("allow", "block"))).collect()
    limit = threshold_of({r[0]: (r[1], r[2]) for r in counts})
    # A URL under a rule goes through the worker as null, so no time is spent on its score.
    asked = rows.select("id", F.when(F.col("verdict").isNull(), F.col("url")).alias("asked"), "host", "path", "rule", "verdict")
    free = F.col("verdict").isNull()
    return scored(asked, models).select(*columns, F.coalesce("verdict", F.when(F.col("score") >= limit, "block").otherwise("allow")).alias("verdict"), F.when(free, F.col("score")).alias("score"))
