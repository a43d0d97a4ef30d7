"""Records, automaton, and the operators that came with them, against plain Python and the relational queries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions import elements as E
from skyloom.operators import dreams, records, six_lines, words
from skyloom.plans import bindings
from skyloom.sources import fixed as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def moments(spark):
    rng = random.Random(3)
    rows = [(k, dt.datetime(1890 + rng.randrange(180), 1 + rng.randrange(12), 1 + rng.randrange(28), rng.randrange(24), rng.randrange(60)), rng.choice("男女")) for k in range(300)]
    return spark.createDataFrame([*rows, (None, dt.datetime(2024, 2, 29, 23), "女"), (1, dt.datetime(2024, 2, 4), "男")], "id long, ts timestamp_ntz, gender string")


# -- six lines -------------------------------------------------------------------------------------------------------
def test_every_cast_of_lines(spark):
    """All 64 hexagrams with all 64 sets of moving lines: names, changed lines and generations by plain rules."""
    rows = [(s * 64 + m, [(bool(s >> k & 1), bool(m >> k & 1)) for k in range(6)]) for s in range(64) for m in range(64)]
    cast = spark.createDataFrame(rows, "id long, throws array<struct<solid:boolean,moving:boolean>>").select("id", F.lit(dt.datetime(2024, 5, 6, 7)).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("question"), F.lit("").alias("method"), "throws")
    trigram = {"".join(x): t for x, t in zip(V.TRIGRAM_LINES, V.TRIGRAMS, strict=True)}
    name = lambda b: E.NAMES[V.TRIGRAMS.index(trigram[b[3:]]) * 8 + V.TRIGRAMS.index(trigram[b[:3]])]
    text = lambda n: "".join(str(n >> k & 1) for k in range(6))
    palaces = {}
    for t in V.TRIGRAM_LINES:
        b = t + t
        for turned, self_line in (((), 6), ((1,), 1), ((1, 2), 2), ((1, 2, 3), 3), ((1, 2, 3, 4), 4), ((1, 2, 3, 4, 5), 5), ((1, 2, 3, 5), 4), ((5,), 3)):
            palaces["".join(str(1 - int(c)) if k + 1 in turned else c for k, c in enumerate(b))] = (trigram[t], self_line, (self_line + 2) % 6 + 1)
    assert len(palaces) == 64
    for r in six_lines.chart(cast, corrected=True).collect():
        now, moving = text(r["id"] // 64), r["id"] % 64
        assert r["chart"]["name"] == name(now) and (r["chart"]["palace"], r["chart"]["self_line"], r["chart"]["answer_line"]) == palaces[now]
        assert r["chart"]["mutual"] == name(now[1:4] + now[2:5]) and r["n_moving"] == bin(moving).count("1")
        if not moving:
            assert r["changed"] is None
            continue
        then = text(r["id"] // 64 ^ moving)
        assert r["changed"]["name"] == name(then) and "".join(str(int(x["solid"])) for x in r["changed"]["lines"]) == then and not any(x["moving"] for x in r["changed"]["lines"])
        assert [x["branch"] for x in r["changed"]["lines"]] == [x["branch"] for x in r["chart"]["lines"]]


def test_up_to_six_lines_move(spark, moments):
    read = six_lines.reading(six_lines.chart(six_lines.coin_cast(moments.crossJoin(spark.range(8)).select(F.monotonically_increasing_id().alias("id"), "ts", F.lit("收入").alias("question")))))
    got = read.select("n_moving", "analysis.on_moving", "analysis.conclusion").collect()
    assert {r["n_moving"] for r in got} >= {0, 1, 2, 3, 4}
    assert all((r["n_moving"] == 0) == ("变卦为" not in r["conclusion"]) and (r["n_moving"] < 4 or r["on_moving"] == V.MOVING_TEXTS[4]) for r in got)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Join [" not in plan.split("Range")[0] and "Python" not in plan


def test_no_numbers_no_chart(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None, []), (2, dt.datetime(2024, 1, 1), None, None), (3, dt.datetime(2024, 1, 1), None, [17]), (4, dt.datetime(2024, 1, 1), None, [5, 3]), (5, dt.datetime(2024, 1, 1), None, [3, 8, 12]), (6, dt.datetime(2024, 1, 1), None, [0])], "id long, ts timestamp_ntz, question string, numbers array<long>")
    got = {r["id"]: (r["chart"]["name"], {x["position"] for x in r["chart"]["lines"] if x["moving"]}) for r in six_lines.chart(six_lines.number_cast(rows)).collect()}
    assert got == {3: ("坤为地", {5}), 4: ("山水蒙", {2}), 5: ("水风井", {2, 3, 6}), 6: ("乾为天", {6})}


# -- nested records --------------------------------------------------------------------------------------------------
def relational(spark, rows, formula):
    return sorted(map(str, bindings.run(spark, rows, formula).collect()))


def test_records_agree_with_relational_queries(spark, moments):
    from skyloom.operators import charts as H

    nine = records.nine_palace_record(moments)
    assert sorted(map(str, records.exploded(nine, "cells").collect())) == relational(spark, moments, H.nine_cells)
    twelve = records.twelve_branch_record(moments)
    assert sorted(map(str, records.exploded(twelve, "plate").collect())) == relational(spark, moments, H.twelve_plates)
    star = records.purple_star_record(moments)
    houses = star.select("id", F.explode("houses").alias("h")).select("id", F.explode("h.stars").alias("s"), "h.house").select("id", "s.star", "house", "s.change")
    assert sorted(map(str, houses.collect())) == relational(spark, moments, H.purple_stars)
    pillars = records.four_pillar_record(moments, 2024)
    flat = pillars.select("id", *(F.concat(F.get("pillars", F.lit(k))["stem"], F.get("pillars", F.lit(k))["branch"]).alias(f"{n}_pillar") for k, n in enumerate(("year", "month", "day", "hour"))))
    want = bindings.run(spark, moments, H.four_pillars).select(*flat.columns)
    assert sorted(map(str, flat.collect())) == sorted(map(str, want.collect()))
    for frame in (nine, twelve, star, pillars):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_almanac_draws(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(1500)]
    got = records.almanac_record(spark.createDataFrame([(d,) for d in days], "d date"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    side_by_side = doubled = 0
    for r in got.collect():
        assert 4 <= len(r["suitable"]) <= 7 and 3 <= len(r["taboo"]) <= 5 and 2 <= len(r["good"]) <= 4 and 2 <= len(r["bad"]) <= 4
        assert len(set(r["suitable"])) == len(r["suitable"]) and len(set(r["taboo"])) == len(r["taboo"])
        forced = (["嫁娶", "出行"] if r["d"].isoweekday() >= 6 else []) + (["开市", "入宅"] if r["d"].day <= 8 else [])
        assert r["suitable"][: len(forced)] == forced
        again = [k for k, x in enumerate(r["good"]) if r["good"].count(x) > 1]
        doubled += bool(again)
        side_by_side += len(again) == 2 and again[1] - again[0] == 1
    assert side_by_side < max(5, doubled * 0.95) or doubled < 10


# -- the automaton ---------------------------------------------------------------------------------------------------
def test_automaton_against_search():
    rng = random.Random(1)
    for _ in range(200):
        terms = [(rng.randrange(9), "".join(rng.choice("ab龙🙂") for _ in range(rng.randint(0, 5)))) for _ in range(rng.randint(1, 8))]
        texts = ["".join(rng.choice("abc龙🙂") for _ in range(rng.choice([0, 1, 3, 20, 255, 256, 257, 261, 700]))) for _ in range(5)]
        assert words.Automaton(terms).hits(texts) == [sorted({k for k, w in terms if w and w in t}) for t in texts]


def test_found_words_on_rows(spark):
    terms = [(0, "one"), (1, "ne t"), (2, "龙"), (3, ""), (4, "]")]
    frame = spark.createDataFrame([("one two",), (None,), ("",), ("x龙]y" * 50_000,), ("ONE",)], "t string")
    got = [r[0] for r in frame.select(words.found_words(F.col("t"), terms)).collect()]
    assert got == [[0, 1], [], [], [2, 4], []]
    assert [r[0] for r in frame.select(words.may_have(F.col("t"), terms)).collect()] == [True, None, False, True, False]


def test_cost_does_not_follow_the_dictionary():
    """Ten times the words, the same look-ups."""
    few, many = ([(k, f"龙{k:05d}") for k in range(n)] for n in (100, 1000))
    text = ["abc龙00001 " * 2000] * 20
    assert words.Automaton(few).hits(text) == words.Automaton(many).hits(text) == [[1]] * 20
