import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skyloom.operators import catalogs as K


def test_study(spark, tmp_path):
    lesson = lambda i, t, points: {"id": i, "title": t, "description": "d", "content": "100% sure", "difficulty": 1, "key_points": points, "examples": []}
    rows = [
        {"ord": 0, "id": "a", "name": "A", "lessons": [lesson("a1", "First", ["x", "Bee"]), lesson("a2", "Second", [])]},
        {"ord": 1, "id": "b", "name": "B", "lessons": [lesson("b1", "Third", ["y"])]},
    ]
    (tmp_path / "study.json").write_text("\n".join(map(json.dumps, rows)))
    study = K.load(spark, str(tmp_path / "study.json"), K.STUDY)
    assert [r["id"] for r in K.lessons(study).collect()] == ["a1", "a2", "b1"]
    assert [r["id"] for r in K.search_lessons(study, "bEE").collect()] == ["a1"]
    assert K.search_lessons(study, "0%").count() == 3 and K.search_lessons(study, "_").count() == 0 and K.search_lessons(study, " ").count() == 0
    assert K.category(study, "b").first()["name"] == "B"
    with pytest.raises(Exception, match="no id z"):
        K.category(study, "z").collect()
    assert [tuple(r) for r in K.lesson_counts(study).collect()] == [("a", 2, 2), ("b", 1, 1)]


def test_flat_catalogs(spark):
    books = spark.createDataFrame([(k, f"b{k}", t, "Au", None, "c", None, "about", k == 0, w) for k, (t, w) in enumerate([("Alpha", ["one", "two", "three", "four"]), ("Beta", None)])], K.BOOK)
    assert [r["id"] for r in K.search_books(books, "FOUR").collect()] == ["b0"] and K.search_books(books, "").count() == 0
    assert K.preview(books, "keywords").orderBy("ord").first()["keywords"] == ["one", "two", "three"]
    texts = spark.createDataFrame([("Alpha", "known")], "title string, meaning string")
    assert {r["title"]: r["meaning"] for r in K.with_default(books, texts, "title", {"meaning": "unknown"}).collect()} == {"Alpha": "known", "Beta": "unknown"}


def test_memos(spark):
    schema = "user long, day date, sign int"
    memos = K.upsert_memo(spark.createDataFrame([(1, dt.date(2024, 1, 1), 3), (2, dt.date(2024, 1, 2), 4)], schema), spark.createDataFrame([(1, dt.date(2024, 1, 2), 5)], schema))
    assert sorted(tuple(r)[::2] for r in K.memo_of(memos, F.to_date(F.lit("2024-01-02"))).collect()) == [(1, 5), (2, 4)]


def test_signs_by_number_and_day(spark, tmp_path):
    rows = [{"id": k, "content": f"c{k}", "interpretation": "i", "source": "s", "type": "上签", "keywords": ["a"]} for k in range(1, 21)]
    (tmp_path / "signs.json").write_text("\n".join(map(json.dumps, rows)))
    signs = K.load(spark, str(tmp_path / "signs.json"), K.SIGN)
    assert K.sign(signs, 7).first()["content"] == "c7"
    with pytest.raises(Exception, match="no id 21"):
        K.sign(signs, 21).collect()
    days = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(1999, 12, 31)), (3, None)], "id long, ts timestamp_ntz")
    assert {r["id"]: (r["sign"], r["sign_content"]) for r in K.sign_of_day(days, signs).collect()} == {1: (2, "c2"), 2: (12, "c12"), 3: (None, None)}


def test_nested_searches(spark):
    from skyloom.operators import nested

    rows = [("b", 2, "Two", ["x"]), ("b", 1, "one", None), ("a", 1, None, ["TWO", "y"]), ("c", 1, "100%", [])]
    table = nested.nest(spark.createDataFrame(rows, "k string, n int, title string, points array<string>"), "k", "n")
    hits = lambda word, texts, lists: sorted((r["k"], [x["n"] for x in r["lessons"]]) for r in nested.search(table, word, texts, lists).collect())
    assert hits("tWo", ["title"], ["points"]) == [("a", [1]), ("b", [2])] and hits("two", ["title"], []) == [("b", [2])]
    assert hits("%", ["title"], []) == [("c", [1])] and hits(" ", ["title"], []) == [] and hits("o", ["title"], []) == [("b", [1, 2])]
    assert sorted(map(tuple, nested.counts(table, "k", "points").collect())) == [("a", 1, 2), ("b", 2, 1), ("c", 1, 0)]
    long = nested.nest(spark.createDataFrame([("k", n, "t") for n in range(95)], "k string, n int, title string"), "k", "n", page=10)
    assert sorted((r["page"], [x["n"] for x in r["lessons"]]) for r in long.collect()) == [(p, list(range(10 * p, min(95, 10 * p + 10)))) for p in range(10)]
    first = lambda frame: frame.select("k", nested.first_with("lessons", lambda x: x["title"].isNotNull(), "with a title")["n"]).collect()
    assert sorted(map(tuple, first(table.where("k <> 'a'")))) == [("b", 1), ("c", 1)]
    with pytest.raises(Exception, match="no entry: with a title"):
        first(table)


def test_as_of_and_intervals(spark):
    import bisect
    import random

    from skyloom.operators import intervals

    rng = random.Random(2)
    t0 = dt.datetime(1969, 12, 30)
    moment = lambda: t0 + dt.timedelta(seconds=rng.randrange(400_000), microseconds=rng.randrange(3))
    left = [(k, rng.choice([1, 1, 1, 2, None]), moment() if k % 17 else None) for k in range(400)] + [(0, 1, t0)] * 2
    right = sorted(((rng.choice([1, 1, 2, None, 3]), moment(), n) for n in range(60)), key=lambda r: r[1:])
    frames = spark.createDataFrame(left, "id int, k int, ts timestamp_ntz"), spark.createDataFrame(right + [(1, None, 99)], "k int, at timestamp_ntz, v int")
    for strict in (False, True):
        for seconds in (7000, 86_400, 10**7):
            want = []
            for i, k, ts in left:
                known = [(a, v) for kk, a, v in right if kk == k]
                at = (bisect.bisect_left if strict else bisect.bisect_right)([a for a, _ in known], ts) if ts else 0
                want.append((i, k, ts, *(known[at - 1] if at else (None, None))))
            got = intervals.as_of(*frames, ["k"], "ts", "at", ["v"], seconds=seconds, strict=strict)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    points = [(k, rng.choice([1, 1, 2, None]), rng.randrange(-50, 50)) for k in range(200)] + [(7, 1, 3)] * 2 + [(8, 1, None)]
    spans = [(n, rng.choice([1, 1, 2, None]), a, a + rng.randrange(0, 40)) for n in range(40) for a in [rng.randrange(-60, 50)]]
    want = sorted((p, n) for p, k, x in points for n, kk, a, b in spans if k is not None and k == kk and x is not None and a <= x < b)
    for width in (1, 7, 1000):
        got = intervals.in_intervals(spark.createDataFrame(points, "p int, k int, x int"), spark.createDataFrame(spans, "n int, k int, a int, b int"), ["k"], "x", "a", "b", width=width)
        assert sorted((r["p"], r["n"]) for r in got.collect()) == want


def test_details(spark):
    from skyloom.operators import details

    rows = [(1, '{"b": 1, "a": [1, "x", null]}'), (2, None), (3, "nothing"), (4, "[]"), (5, '{"b": "two"}'), (6, '{"b": 1.5, "c": {"d": true}}'), (7, ""), (8, "3")]
    log = details.parsed(spark.createDataFrame(rows, "id int, details string"))
    got = {r["id"]: tuple(r)[1:] for r in log.select("id", "details_bad", details.field("details", "$.b", "int").alias("n"), details.field("details", "$.b", "string").alias("s"), details.field("details", "$.c.d", "boolean").alias("d")).collect()}
    assert got == {1: (False, 1, "1", None), 2: (False, None, None, None), 3: (True, None, None, None), 4: (False, None, None, None), 5: (False, None, "two", None), 6: (False, 1, "1.5", True), 7: (True, None, None, None), 8: (False, None, None, None)}
    back = {r["id"]: r["details"] for r in details.encoded(log.drop("details_bad")).collect()}
    assert back == {1: '{"a":[1,"x",null],"b":1}', 2: None, 3: None, 4: "[]", 5: '{"b":"two"}', 6: '{"b":1.5,"c":{"d":true}}', 7: None, 8: "3"}
    again = details.encoded(details.parsed(details.encoded(log.drop("details_bad"))).drop("details_bad"))
    assert {r["id"]: r["details"] for r in again.collect()} == back
    assert {(r["id"], r["name"], r["kind"]) for r in details.fields(log, "id").where("id <> 1").collect()} == {(5, "b", "STRING"), (6, "b", "DECIMAL(2,1)"), (6, "c", "OBJECT<d: BOOLEAN>")}
