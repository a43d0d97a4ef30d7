"""Queries that run the streams over the driver's tables to their end and read what they leave, with DuckDB SQL by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..sources import fixed as V
from ..streaming import history as log
from ..streaming import memos
from ..streaming.places import fresh


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, a file a batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern the path may be one file as well as a folder of files.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")


def _entries(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("value").cast("decimal(18,4)").cast("string").alias("result"), F.col("ts").alias("date"), F.col("props").alias("details"))


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as the stream's last version has it."""
    place = fresh(spark, "log")
    log.keep_latest(_entries(_events(spark, sf_dir)).drop("user_id"), place, f"{place}-checkpoint").awaitTermination()
    return log.current(spark, place).select("seq", "type", "date", "details")


def history_by_user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten entries of each user from keyed state: how many, and the newest and oldest kept."""
    place = fresh(spark, "by-user")
    kept = log.latest_by_key(_entries(_events(spark, sf_dir)), "user_id", 10)
    kept.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{place}/batch={n}")).option("checkpointLocation", f"{place}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.schema("user_id long, n int, entries string, batch int").parquet(f"{place}/*").groupBy("user_id").agg(F.max_by(F.struct("n", "entries"), "batch").alias("x"))
    seqs = F.transform(F.from_json("x.entries", "array<array<string>>"), lambda e: e[1].cast("long"))
    return newest.select("user_id", "x.n", F.array_join(seqs.cast("array<string>"), " ").alias("seqs"))


def _signs(events: DataFrame) -> DataFrame:
    """A draw of the day's sign by each event's user."""
    day = F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")
    return events.select(F.col("user_id").alias("user"), F.col("ts").cast("date").alias("day"), (F.pmod(day + F.col("event_id"), F.lit(len(V.SIGN_TYPES))) + 1).cast("int").alias("sign"), F.col("event_id").alias("seq"))


def daily_memo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user drew last on each day, as the sink's day partitions have it."""
    place = fresh(spark, "memos")
    memos.keep(_signs(_events(spark, sf_dir)), place, f"{place}-checkpoint").awaitTermination()
    return memos.read(spark, place).select("user", F.date_format("day", "yyyy-MM-dd").alias("day"), "sign", "seq")


def daily_memo_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user has drawn on the tables' last day, and what: the day's partition alone is read."""
    place = fresh(spark, "memos")
    memos.keep(_signs(_events(spark, sf_dir)), place, f"{place}-checkpoint").awaitTermination()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    today = events.agg(F.max("ts").cast("date").alias("day")).first()[0]
    drawn = memos.read(spark, place).where(F.col("day") == F.lit(today)).select(F.col("user").alias("of_user"), "sign")
    users = events.select(F.col("user_id").alias("user")).distinct()
    return users.join(drawn, F.col("user") == F.col("of_user"), "left").select("user", F.col("sign").isNotNull().alias("drawn"), F.coalesce("sign", F.lit(0)).alias("sign"), F.coalesce(F.get(F.array(*map(F.lit, V.SIGN_TYPES)), F.col("sign") - 1), F.lit("")).alias("kind"))


def history_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries saved, loaded, cleared where they were saved, and decoded from JSON text: what comes back."""
    place = fresh(spark, "saved")
    history.save(history.latest(_entries(spark.read.parquet(f"{sf_dir}/events.parquet")).drop("user_id")), place)
    back = history.load(spark, place)
    entry = history.decoded(history.encoded(back)).select("seq", "type", "result", "details")
    return back.select("seq", "date").join(entry, "seq")


_SIGN = f"(strftime(ts, '%Y%m%d')::BIGINT + event_id) % {len(V.SIGN_TYPES)} + 1"
_MEMO = f"SELECT user_id AS user, strftime(ts, '%Y-%m-%d') AS day, max_by({_SIGN}, event_id)::INT AS sign, max(event_id) AS seq FROM events GROUP BY 1, 2"
_KINDS = "[" + ", ".join(f"'{k}'" for k in V.SIGN_TYPES) + "]"
QUERIES = {f.__name__: f for f in (history_stream, history_by_user_stream, daily_memo_stream, daily_memo_today, history_round_trip)}
ORACLES = {
    "history_stream": "SELECT event_id AS seq, event_type AS type, ts AS date, props AS details FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "history_by_user_stream": "SELECT user_id, count(*)::INT AS n, string_agg(event_id, ' ' ORDER BY ts DESC, event_id DESC) AS seqs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY user_id",
    "daily_memo_stream": _MEMO,
    "daily_memo_today": f"WITH m AS ({_MEMO}) SELECT u.user, sign IS NOT NULL AS drawn, coalesce(sign, 0)::INT AS sign, coalesce({_KINDS}[sign], '') AS kind FROM (SELECT DISTINCT user_id AS user FROM events) u LEFT JOIN m ON m.user = u.user AND m.day = (SELECT strftime(max(ts), '%Y-%m-%d') FROM events)",
    "history_round_trip": "SELECT event_id AS seq, ts AS date, event_type AS type, CAST(value AS DECIMAL(18, 4))::VARCHAR AS result, props AS details FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
}
