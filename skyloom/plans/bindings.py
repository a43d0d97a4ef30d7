"""Queries of the formulas over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cycles as C
from ..functions import elements as E
from ..functions.dialect import SPARK, Dialect
from ..operators import charts as H
from ..operators import history
from ..operators import texts as X
from . import records, streams, twins

AS_OF = 2024
#: Sources: (table, query over it); t stands for the table.
ORDERS = ("orders", "SELECT o_orderkey AS id, o_orderdate AS ts FROM {t}")
EVENTS = ("events", "SELECT event_id AS id, ts FROM {t}")
BIRTHS = ("events", "SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN '男' ELSE '女' END AS gender FROM {t}")
BIRTH_DATES = ("orders", "SELECT o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender FROM {t}")
DATES = ("orders", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {t}")
PAIRS = ("part", "SELECT p_partkey AS id, p_partkey % 5 AS a, p_size % 5 AS b FROM {t}")
TRIGRAMS = ("part", "SELECT p_partkey AS id, p_partkey % 8 AS u, p_size % 8 AS l, p_partkey % 6 + 1 AS p FROM {t}")
NAMES = ("part", "SELECT p_partkey AS id, p_name AS txt FROM {t}")
NUMBERS = (
    "lineitem",
    "SELECT l_orderkey AS id, max(l_shipdate) AS ts, count(*) AS k, max(CASE WHEN l_linenumber = 1 THEN l_partkey ELSE 0 END) AS n1, max(CASE WHEN l_linenumber = 2 THEN l_partkey ELSE 0 END) AS n2, max(CASE WHEN l_linenumber = 3 THEN l_partkey ELSE 0 END) AS n3, sum(l_partkey) AS total FROM {t} GROUP BY l_orderkey",
)
SOUNDS = ("events", "SELECT user_id AS id, max(ts) AS ts, count(*) AS n FROM {t} GROUP BY user_id")
AGES = ("events", "SELECT event_id AS id, ts, max(ts) OVER (PARTITION BY user_id) AS now_ts FROM {t}")
KINDS = ("region", "SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN '动物' WHEN 1 THEN '水' WHEN 2 THEN '数字' WHEN 3 THEN '' ELSE '颜色' END AS word FROM {t}")
CATEGORIES = ("region", "SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN 'liuyao' WHEN 1 THEN 'ziwei' WHEN 2 THEN 'none' WHEN 3 THEN 'bazi' ELSE 'other' END AS word FROM {t}")
SIGNS = ("region", "SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN '上签' WHEN 1 THEN '中下签' WHEN 2 THEN '7' WHEN 3 THEN '21' ELSE '20' END AS word FROM {t}")
STARS = ("part", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '文昌' WHEN 1 THEN '火星' WHEN 2 THEN '化禄' WHEN 3 THEN '天马' WHEN 4 THEN '右弼' ELSE '地劫' END AS star FROM {t}")
LIKENESSES = ("part", "SELECT p_partkey AS id, p_partkey % 8 AS u, p_size % 11 + 1 AS p FROM {t}")
CYCLES = ("part", "SELECT p_partkey AS id, p_partkey % 10 AS s, p_size % 12 AS b FROM {t}")
WORDS = ("region", "SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN '六爻' WHEN 1 THEN '邵雍' WHEN 2 THEN '%' WHEN 3 THEN ' ' ELSE '太' END AS word FROM {t}")


def questions(q: Dialect, src: str) -> str:
    """A reading's question by its number, one for each group of words and one without any."""
    asked = q.at(["今年事业如何", "收入好吗", "考试能过吗", "孩子怎样", "朋友来吗", "婚姻顺利吗", "天气"], q.mod("id", 7))
    return f"SELECT id, asked, {H.significator(q, 'asked')} AS kin FROM (SELECT id, {asked} AS asked FROM {src} __s)"


def answered(q: Dialect, src: str) -> str:
    kin = H.significator(q, q.at(["今年事业如何", "收入好吗", "考试能过吗", "孩子怎样", "朋友来吗", "婚姻顺利吗", "天气"], q.mod("id", 7)))
    return H.six_line_answer(q, H.six_line_time(q, src), kin)


def concluded(q: Dialect, src: str) -> str:
    kin = H.significator(q, q.at(["今年事业如何", "收入好吗", "考试能过吗", "孩子怎样", "朋友来吗", "婚姻顺利吗", "天气"], q.mod("id", 7)))
    return H.six_line_conclusion(q, H.six_line_time(q, src), kin)


def suggested(q: Dialect, src: str) -> str:
    return H.six_line_suggestions(q, H.six_line_time(q, src), H.significator(q, "'今年事业如何'"))


def flagship(q: Dialect, src: str) -> str:
    """Orders by the pillar of their day and its melodic element."""
    return f"SELECT day_pillar, melodic, count(*) AS n FROM ({C.calendar(q, src)}) GROUP BY day_pillar, melodic"


#: name: (source, formula)
FORMULAS: dict[str, tuple[tuple[str, str], Callable[[Dialect, str], str]]] = {
    "orders_by_day_pillar": (ORDERS, flagship),
    "calendar_of_orders": (ORDERS, C.calendar),
    "calendar_of_events": (EVENTS, C.calendar),
    "solar_terms": (ORDERS, lambda q, s: f"SELECT term, starts, count(*) AS n, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_passed FROM ({C.solar_terms(q, s)}) GROUP BY term, starts"),
    "age_labels": (AGES, C.age_label),
    "element_relations": (PAIRS, E.relations),
    "hexagrams": (TRIGRAMS, E.hexagrams),
    "six_line_time_lines": (EVENTS, lambda q, s: H.six_line_chart(q, H.six_line_time(q, s))),
    "six_line_time_reading": (ORDERS, lambda q, s: H.six_line_reading(q, H.six_line_time(q, s))),
    "six_line_number_lines": (NUMBERS, lambda q, s: H.six_line_chart(q, H.six_line_numbers(q, s))),
    "six_line_number_reading": (NUMBERS, lambda q, s: H.six_line_reading(q, H.six_line_numbers(q, s))),
    "six_line_coins": (EVENTS, H.six_line_coins),
    "six_line_questions": (ORDERS, questions),
    "six_line_answers": (EVENTS, answered),
    "six_line_conclusions": (EVENTS, concluded),
    "six_line_suggestions": (EVENTS, suggested),
    "trigram_likeness": (LIKENESSES, E.likeness),
    "stems_and_branches": (CYCLES, E.stems_and_branches),
    "plum_time": (EVENTS, H.plum_time),
    "plum_numbers": (NUMBERS, H.plum_numbers),
    "plum_sound": (SOUNDS, H.plum_sound),
    "plum_text": (NAMES, H.plum_text),
    "four_pillars": (BIRTHS, H.four_pillars),
    "four_pillars_corrected": (BIRTH_DATES, lambda q, s: H.four_pillars(q, s, "corrected")),
    "four_pillar_elements": (BIRTHS, H.element_reading),
    "luck_cycles": (BIRTH_DATES, lambda q, s: H.luck_cycles(q, s, AS_OF)),
    "nine_palace_cells": (EVENTS, H.nine_cells),
    "nine_palace_reading": (EVENTS, H.nine_reading),
    "twelve_branch_lessons": (EVENTS, H.twelve_lessons),
    "twelve_branch_plates": (EVENTS, H.twelve_plates),
    "nine_palace_drawn_cells": (EVENTS, lambda q, s: H.nine_cells(q, s, drawn=True)),
    "nine_palace_drawn_reading": (EVENTS, lambda q, s: H.nine_reading(q, s, drawn=True)),
    "twelve_branch_drawn_lessons": (EVENTS, lambda q, s: H.twelve_lessons(q, s, drawn=True)),
    "twelve_branch_drawn_plates": (EVENTS, lambda q, s: H.twelve_plates(q, s, drawn=True)),
    "purple_star_houses": (EVENTS, H.purple_houses),
    "purple_star_stars": (ORDERS, H.purple_stars),
    "purple_star_reading": (ORDERS, H.purple_reading),
    "purple_star_texts": (BIRTH_DATES, H.purple_texts),
    "almanac_lists": (DATES, H.drawn_lists),
    "almanac_day": (DATES, H.almanac_day),
    "activity_advice": (DATES, H.activity_advice),
    "purple_star_classes": (STARS, H.star_classes),
    "purple_star_house": (EVENTS, lambda q, s: f"SELECT * FROM ({H.purple_houses(q, s)}) __h WHERE house = '财帛'"),
    "dreams_by_kind": (KINDS, X.dreams_by_kind),
    "books_by_category": (CATEGORIES, X.books_of),
    "signs_by_kind": (SIGNS, X.signs_by_kind),
    "classic_drawn": (ORDERS, X.classic_drawn),
    "book_search": (WORDS, X.search_books),
    "daily_signs": (EVENTS, X.daily_sign),
}


def run(spark: SparkSession, frame: DataFrame, formula: Callable[[Dialect, str], str]) -> DataFrame:
    """A formula over a frame with the columns that it asks for."""
    return spark.sql(formula(SPARK, "{__src}"), __src=frame)


def _query(name: str):
    (table, source), formula = FORMULAS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return run(spark, spark.sql(source.replace("{t}", "{rows}"), rows=rows), formula)

    return query


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("value").cast("decimal(18,4)").cast("string").alias("result"), F.col("ts").alias("date"), F.col("props").alias("details"))
    return history.latest(log).select("seq", "type", "date", "details")


def queries() -> dict:
    return {n: _query(n) for n in FORMULAS} | {"history_latest": history_latest} | records.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by hand, none of it printed by the formulas."""
    return twins.ORACLES | records.ORACLES | streams.ORACLES | {"history_latest": "SELECT event_id AS seq, event_type AS type, ts AS date, props AS details FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"}
