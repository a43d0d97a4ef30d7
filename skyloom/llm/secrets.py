"""Secret scans: strong patterns alone, and weak credential parts where complementary parts co-occur.

One scan finds the spans of every pattern inside each row: matches are fenced by two marker characters, the text is split
at the fences, and running lengths give code point offsets.  Weak parts (identifiers, secrets, endpoints) are
then met within scopes of `scope` code points by an interval join: each part looks up the nearest part of the
other kinds on either side of it by ordered windows, so a document gives rows in proportion to its parts, never pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, running, written

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
# The contract's strong patterns.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Weak parts: each alone is common in clean text.
IDENT = "(?<![A-Za-z0-9_])(?i:user|username|user_?id|login|account|client_?id|access_?key(?:_?id)?)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]{3,})"
WEAK = "(?<![A-Za-z0-9_])(?i:pwd|pass|passphrase|key|auth|credentials?|signature)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=!@#%^&*-]{6,})"
ENDPOINT = "(?<![A-Za-z0-9])(?:https?|ftp|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Parts of one credential lie within so many code points of each other.
SCOPE = 300


def matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """struct(start, kind, end) of the leftmost non-overlapping matches, those that keep(match) holds for.  text has no fence characters."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")  # odd parts are matches

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, F.length), lambda x, y: x + y)
        found = let(ends, lambda e: F.transform(p, lambda x, i: F.struct(F.when(i % 2 == 1, F.get(e, i) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), (keep(x) if keep else F.lit(True)).alias("ok"))))
        return F.transform(F.filter(found, lambda x: x["start"].isNotNull() & x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array().cast(SPAN))


def parts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __base (strong spans) and __loose (weak spans, also those that overlap strong ones), both sorted, and __row, a number of the row.  Bytes that aren't UTF-8 count as U+FFFD."""
    text = F.translate(F.coalesce(F.make_valid_utf8(F.col(text_col)), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    found = docs.withColumn("__text", text).select(
        *docs.columns,
        F.sort_array(F.concat(matches(F.col("__text"), ASSIGN, 0, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 8), matches(F.col("__text"), ACCESS, 1), matches(F.col("__text"), HEX, 2))).alias("__base"),
        F.sort_array(F.concat(matches(F.col("__text"), IDENT, 3), matches(F.col("__text"), WEAK, 4), matches(F.col("__text"), ENDPOINT, 5))).alias("__loose"),
    )
    return found.withColumn("__row", F.monotonically_increasing_id())


def may_link() -> Column:
    """Has a row an endpoint and a weak part whose complement it has too, at whatever distance?"""
    has = lambda name, *kinds: F.exists(name, lambda x: x["kind"].isin(*kinds))
    secret_by_id = has("__loose", 4) & (has("__loose", 3) | has("__base", 1))
    return has("__loose", 5) & (secret_by_id | has("__loose", 3) & has("__base", 0, 2))


def with_links(parts: DataFrame, scope: int) -> DataFrame:
    """parts, a written table, with __linked; only rows that may have links are joined, the others aren't moved."""
    linkable = parts.where(may_link()).join(linked(parts, scope), "__row", "left")
    return linkable.unionByName(parts.where(~may_link()).withColumn("__linked", F.lit(None).cast(SPAN)))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """__row, spans: the weak identifiers and secrets of each row whose complements co-occur.

    A weak part that overlaps a strong one is no part.  A weak secret counts if within its scope lies an identifier
    (weak, or a strong access id) and an endpoint; a weak identifier counts if within its scope lies a secret (weak or
    strong) and an endpoint.  Both are asked of ordered windows over a row's parts: n log n of them, never pairs.
    """
    rows = parts.where(may_link()).select("__row", F.explode(F.concat("__base", "__loose")).alias("s")).select("__row", "s.*")
    after, before = (Window.partitionBy("__row").orderBy(F.col("start").asc() if up else F.col("start").desc(), F.col("kind").asc() if up else F.col("kind").desc(), F.col("end")) for up in (True, False))
    past = lambda is_it, order: (F.max(F.when(is_it, F.col("end"))) if order is after else F.min(F.when(is_it, F.col("start")))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    strong = F.col("kind") <= 2
    rows = rows.withColumns({"strong_before": past(strong, after), "strong_after": past(strong, before)})
    covered = F.coalesce(F.col("strong_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_after") < F.col("end"), F.lit(False))
    rows = rows.where(strong | ~covered).drop("strong_before", "strong_after")
    roles = {"id": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4), "endpoint": F.col("kind") == 5}
    near = {r: F.coalesce(F.col("start") - past(is_role, after) <= scope, F.lit(False)) | F.coalesce(past(is_role, before) - F.col("end") <= scope, F.lit(False)) for r, is_role in roles.items()}
    met = rows.withColumns({f"near_{r}": c for r, c in near.items()})
    wanted = F.col("near_endpoint") & ((F.col("kind") == 4) & F.col("near_id") | (F.col("kind") == 3) & F.col("near_secret"))
    return met.where(wanted).groupBy("__row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__linked"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, base (strong spans) and spans (all reported spans) of every row of docs: arrays of struct(start, kind, end), sorted.

    Offsets are code points, end exclusive; kind is an index of KINDS.  A null or empty text has no spans; bytes that
    aren't UTF-8 count as U+FFFD.  Rows are judged one by one, so repeated rows and ids give repeated results; other
    columns are not read.  Weak spans that overlap strong ones are left out.  Spans of one start go by kind.  An empty
    table gives an empty result.  A very long text costs its length and its matches to the power 1.5.
    """
    found = parts_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    parts = written(found.drop("text"), "parts")
    none = F.array().cast(SPAN)
    return with_links(parts, scope).select(
        F.col("doc_id").alias("id"), F.col("__base").alias("base"), F.sort_array(F.concat("__base", F.coalesce("__linked", none))).alias("spans")
    )


#: Code points of a piece of a text that is masked.
PIECE = 1024


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each span (sorted by start) replaced by mask, overlapping ones by one.  The text is cut into pieces once; what is between spans is taken from those, so nothing is read from the text's front again."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """The code points from a to b."""
        first, last = (F.floor(x / PIECE).cast("int") for x in (a, b))
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        whole = F.concat(F.substring(piece(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(piece(last), F.lit(1), b % PIECE))
        return F.when(first == last, F.substring(piece(first), a % PIECE + 1, F.greatest(b - a, F.lit(0)))).otherwise(whole)

    def rebuilt(p: Column, e: Column) -> Column:
        before = lambda k: F.coalesce(F.get(e, k - 1), F.lit(0))
        heads = F.filter(F.transform(spans, lambda x, k: F.struct(x["start"].alias("start"), before(k).alias("at"))), lambda x: x["start"] >= x["at"])
        kept = F.array_join(F.transform(heads, lambda x: F.concat(between(p, x["at"], x["start"]), F.lit(mask))), "")
        return F.concat(kept, between(p, before(F.size(e)), F.length(text)))

    reach = running(F.transform(spans, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda p: let(reach, lambda e: rebuilt(p, e)))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with every reported span of its text replaced by mask (overlapping spans by one); other columns are kept.

    Null texts stay null and texts without spans stay as they are; in others bytes that aren't UTF-8 become U+FFFD.
    Repeated rows and ids are masked each for itself, and an empty table gives none.  Columns whose names begin with
    two underscores and row, base, loose, linked or spans would clash.
    """
    parts = written(parts_of(docs, id_col, text_col), "parts")
    all_spans = F.sort_array(F.concat("__base", F.coalesce("__linked", F.array().cast(SPAN))))
    joined = with_links(parts, scope).withColumn("__spans", all_spans)
    done = masked(F.make_valid_utf8(F.col(text_col)), F.col("__spans"), mask)
    return joined.withColumn(text_col, F.when(F.size("__spans") > 0, done).otherwise(F.col(text_col))).select(*docs.columns)


def span_string(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

