"""Vectors worked out by hand from the formulas, and small-domain properties."""

import datetime as dt

import duckdb
import pytest

from skyloom.functions import cycles as C
from skyloom.functions import elements as E
from skyloom.functions.dialect import DUCKDB, SPARK
from skyloom.operators import charts as H
from skyloom.operators import texts as X
from skyloom.operators import dreams
from skyloom.plans import bindings
from skyloom.sources import fixed as V

A, B = dt.datetime(2024, 1, 1, 10), dt.datetime(1999, 12, 31, 23)


@pytest.fixture(scope="module")
def moments(spark):
    return spark.createDataFrame([(1, A, "男"), (2, B, "男"), (3, A, "女")], "id long, ts timestamp_ntz, gender string")


def rows(spark, frame, formula, *columns):
    return [tuple(r[c] for c in columns) for r in sorted(bindings.run(spark, frame, formula).collect(), key=lambda r: tuple(map(str, r)))]


def test_calendar(spark, moments):
    got = rows(spark, moments, C.calendar, "id", "day_almanac", "day_pillar", "day_six_line", "day_lesson", "animal", "mansion", "month_branch")
    assert got[0] == (1, "壬戌", "甲子", "癸卯", "甲寅", "龙", "角", "子")
    assert got[1][1::4] == ("乙卯", "兔") and got[1][6:] == ("翼", "亥")


def test_four_pillars(spark, moments):
    got = rows(spark, moments, H.four_pillars, "id", "year_pillar", "month_pillar", "day_pillar", "hour_pillar")
    assert got[:2] == [(1, "癸卯", "乙丑", "甲子", "己巳"), (2, "己卯", "丁丑", "丁巳", "庚子")]
    counts = rows(spark, moments, H.element_reading, "n_wood", "n_fire", "n_earth", "n_metal", "n_water", "scarcest", "favourable", "unfavourable")
    assert counts[0] == (4, 2, 4, 2, 4, "火", "木", "水")


def test_luck_cycles(spark, moments):
    got = rows(spark, moments, lambda q, s: H.luck_cycles(q, s, 2024), "id", "i", "name", "from_age", "to_age", "from_year", "to_year")
    assert (1, 0, "甲子", 8, 17, 2032, 2041) in got and (3, 0, "丙寅", 7, 16, 2031, 2040) in got


def test_six_lines(spark, moments):
    got = rows(spark, moments, lambda q, s: H.six_line_reading(q, H.six_line_time(q, s)), "id", "name")
    assert got[:2] == [(1, "火水未济"), (2, "离为火")]
    numbers = spark.createDataFrame([(1, A, 1, 17, 0, 0, 17), (2, A, 2, 5, 3, 0, 8), (3, A, 3, 3, 8, 12, 23)], "id long, ts timestamp_ntz, k long, n1 long, n2 long, n3 long, total long")
    got = rows(spark, numbers, H.six_line_numbers, "id", "m1", "m2", "m3")
    assert got == [(1, 5, 0, 0), (2, 2, 0, 0), (3, 3, 2, 6)]
    assert rows(spark, numbers, lambda q, s: H.six_line_reading(q, H.six_line_numbers(q, s)), "name") == [("坤为地",), ("山水蒙",), ("水风井",)]
    assert rows(spark, numbers, H.plum_numbers, "name", "moving", "changed") == [("地天泰", 5, "水天需"), ("风火家人", 2, "风天小畜"), ("火地晋", 6, "雷地豫")]


def test_plum(spark, moments):
    got = rows(spark, moments, H.plum_time, "id", "name", "moving", "body", "use_part", "changed")
    assert got[:2] == [(1, "泽雷随", 2, "兑", "震", "兑为泽"), (2, "泽天夬", 2, "兑", "乾", "泽火革")] or got[1][1:2] == ("泽天夬",)


def test_nine_palaces(spark, moments):
    got = rows(spark, moments, H.nine_parameters, "id", "pu", "pm", "pl", "pj")
    assert got[:2] == [(1, 1, 3, 3, 1004), (2, 5, 8, 1, 502)]
    assert rows(spark, moments, H.nine_reading, "id", "pattern")[1] == (2, "开门得地")


def test_twelve_branches(spark, moments):
    got = rows(spark, moments, H.twelve_lessons, "id", "day_name", "hour_name", "above", "lesson_type")
    assert got[0][:4] == (1, "甲寅", "己巳", "寅 卯 辰") and got[1] == (2, "丁未", "庚子", "戌 亥 子", "遥克")


def test_flip_twice_and_relations():
    assert all(E.FLIPPED[E.FLIPPED[t][p]][p] == t for t in range(8) for p in range(3))
    con = duckdb.connect()
    for a in range(5):
        for b in range(5):
            one, two = con.execute(f"SELECT {E.rel(DUCKDB, str(a), str(b))}, {E.rel(DUCKDB, str(b), str(a))}").fetchone()
            assert (one + two) % 5 == 0
    assert len(set(E.NAMES)) == 64 and sorted(E.PALACE_OF) == sorted(list(range(8)) * 8)


def test_cycle_of_sixty(spark):
    got = spark.sql("SELECT " + ", ".join(f"{C.sixty(SPARK, str(n % 10), str(n % 12))} AS c{n}" for n in range(60))).first()
    assert list(got) == list(range(60))


def test_dreams(spark):
    docs = spark.createDataFrame([(1, "梦见一条大蛇和龙"), (2, "  "), (3, "abc"), (4, None), (5, "我的猫")], "id long, txt string")
    assert sorted((r["id"], r["keyword"]) for r in dreams.entries(docs).collect()) == [(1, "蛇"), (1, "龙"), (5, "猫")]
    got = {r["id"]: r for r in dreams.readings(docs).collect()}
    assert sorted(got) == [1, 3, 5] and got[1]["base_score"] == 50 and got[5]["base_score"] == 30 and got[3]["n"] == 0
    assert got[5]["colours"].startswith("蓝色")


def test_dreams_are_read_row_by_row(spark):
    """Null and repeated ids: each row by its own text."""
    docs = spark.createDataFrame([(None, "梦见龙"), (1, "梦见蛇"), (1, "abc"), (1, "梦见蛇"), (1, "梦见猫和龙"), (None, None), (None, "x")], "id long, txt string")
    got = dreams.readings(docs)
    assert sorted((r["id"] or 0, r["n"]) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (1, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_drawn_parts_of_dreams(spark):
    docs = spark.createDataFrame([(k, "梦见龙" if k % 2 else "abc") for k in range(200)], "id long, txt string")
    got = dreams.readings(docs).collect()
    numbers = [[int(x) for x in r["numbers"].split()] for r in got if r["n"]]
    assert all(x[:4] == [1, 3, 6, 8] and len(x) <= 6 and len(set(x)) == len(x) and all(1 <= y <= 49 for y in x) for x in numbers)
    assert sum(len(x) == 6 for x in numbers) > 50 and len({tuple(x[4:]) for x in numbers}) > 50
    assert {r["meaning"] for r in got if not r["n"]} == set(V.DREAM_GENERIC_TEXTS)


def test_drawn_charts(spark):
    frame = spark.createDataFrame([(k, dt.datetime(2024, 5, 6, 7)) for k in range(400)], "id long, ts timestamp_ntz")
    drawn = bindings.run(spark, frame, lambda q, s: H.nine_parameters(q, s, drawn=True)).collect()
    assert all({r[p] for r in drawn} == set(range(1, 10)) for p in ("pu", "pm", "pl"))
    assert len({r["pj"] for r in drawn}) > 200 and all(0 <= r["pj"] < 1080 for r in drawn)
    lessons = bindings.run(spark, frame, lambda q, s: H.twelve_lessons(q, s, drawn=True)).collect()
    assert len({r["day_name"] for r in lessons}) > 90 and len({r["hour_name"] for r in lessons}) > 90


def test_day_31_and_edges(spark):
    frame = spark.createDataFrame([(1, dt.datetime(2001, 1, 31)), (2, dt.datetime(2001, 2, 3)), (3, dt.datetime(2001, 2, 4)), (4, dt.datetime(1899, 12, 30, 5)), (5, None)], "id long, ts timestamp_ntz")
    got = {r["id"]: r for r in bindings.run(spark, frame, C.calendar).collect()}
    assert got[1]["lunar_date"].endswith("三十") and got[5]["day_pillar"] is None
    frame = frame.selectExpr("*", "'男' AS gender")
    got = {r["id"]: r["year_pillar"] for r in bindings.run(spark, frame, H.four_pillars).collect()}
    assert got[2] != got[3]


def test_history(spark, tmp_path):
    from skyloom.operators import history
    from skyloom.streaming.history import current, keep_latest

    log = spark.createDataFrame([(k, "t", str(k), dt.datetime(2024, 1, 1), None) for k in range(150)], history.SCHEMA)
    got = history.latest(log)
    assert got.count() == 100 and got.first()["seq"] == 149
    history.save(got, str(tmp_path / "log"))
    assert history.load(spark, str(tmp_path / "log")).count() == 100
    assert history.decoded(history.encoded(got)).first()["result"] == "149"
    history.clear(spark, str(tmp_path / "log"))
    assert history.load(spark, str(tmp_path / "log")).count() == 0
    for part in range(2):
        log.where(f"seq % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert current(spark, str(tmp_path / "out")).agg({"seq": "min"}).first()[0] == 50


def test_fixed_tables():
    assert len(V.MELODIC) == 30 and len(V.MANSIONS) == 28 and len(V.DREAMS) == 39 and len(V.BOOKS) == 19 and len(V.SIGN_TYPES) == 20
    assert sum(not d[2] for d in V.DREAMS) == 4 and sum(b[4] for b in V.BOOKS) == 14
