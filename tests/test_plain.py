"""Chart texts against plain Python, written from the rules without the library's formulas (only its fixed values)."""

import datetime as dt
import random

import pytest

from skyloom.functions import elements as E
from skyloom.functions.dialect import text
from skyloom.operators import charts as H
from skyloom.operators import texts as X
from skyloom.operators import dreams
from skyloom.plans import bindings
from skyloom.sources import fixed as V

CYCLE = "木火土金水"
MAKES = {a: CYCLE[(k + 1) % 5] for k, a in enumerate(CYCLE)}
BEATS = {a: CYCLE[(k + 2) % 5] for k, a in enumerate(CYCLE)}
OF_TRIGRAM = dict(zip("乾坤震巽坎离艮兑", "金土木木水火土金", strict=True))
OF_BRANCH = dict(zip("子丑寅卯辰巳午未申酉戌亥", "水土木木土火火土金金土水", strict=True))
LINES = dict(zip("乾坤震巽坎离艮兑", ["111", "000", "100", "011", "010", "101", "001", "110"], strict=True))
QUESTIONS = ["今年事业如何", "收入好吗", "考试能过吗", "孩子怎样", "朋友来吗", "婚姻顺利吗", "天气"]
WANTED = ["官鬼", "妻财", "父母", "子孙", "兄弟", "妻财", "世爻"]


def kin_of(own, other):
    return "兄弟" if own == other else "子孙" if MAKES[own] == other else "妻财" if BEATS[own] == other else "官鬼" if BEATS[other] == own else "父母"


def name_of(upper, lower):
    return V.HEXAGRAMS["乾坤震巽坎离艮兑".index(upper)].split()["乾坤震巽坎离艮兑".index(lower)]


def cast_by_time(ts):
    order = "坤震坎兑艮离巽乾"
    a = (ts.year - 4) % 12 + ts.month + ts.day
    b = a + ((ts.hour + 1) // 2) % 12
    return order[(a - 1) % 8], order[(b - 1) % 8], (b - 1) % 6 + 1


def six_lines(ts, wanted):
    upper, lower, moving = cast_by_time(ts)
    lines = []
    for p in range(6):
        trigram = lower if p < 3 else upper
        row = V.LINE_BRANCHES["乾坤震巽坎离艮兑".index(trigram)]
        branch = row[p % 3]
        lines.append({"branch": branch, "kin": kin_of(OF_TRIGRAM[trigram], OF_BRANCH[branch]), "solid": LINES[trigram][p % 3] == "1", "moving": p + 1 == moving})
    bits = [line["solid"] != line["moving"] for line in lines]
    back = {v: k for k, v in LINES.items()}
    turned = [back["".join("1" if b else "0" for b in bits[k : k + 3])] for k in (0, 3)]
    name, changed = name_of(upper, lower), name_of(turned[1], turned[0])
    own, other = lines[5], lines[2]
    a, b = OF_BRANCH[own["branch"]], OF_BRANCH[other["branch"]]
    relation = "世应同气，关系和谐" if a == b else "世生应，我方有利于对方" if MAKES[a] == b else "应生世，对方有利于我" if MAKES[b] == a else "世克应，我方占上风" if BEATS[a] == b else "应克世，对方占上风"
    self_text = f"世爻6位，{own['kin']}{own['branch']}，应爻3位，{other['kin']}{other['branch']}。{relation}。"
    month = OF_BRANCH["子丑寅卯辰巳午未申酉戌亥"[(ts.month - 1) % 12]]
    days = int((ts - dt.datetime(1900, 1, 1)) / dt.timedelta(days=1))
    day = OF_BRANCH["子丑寅卯辰巳午未申酉戌亥"[(days + 1) % 12]]
    bearing = [(p + 1, line) for p, line in enumerate(lines) if line["kin"] == wanted]
    if wanted == "世爻":
        kin_text = f"以世爻为用神。世爻{own['branch']}，{'动' if own['moving'] else '静'}，在6爻位。"
    elif not bearing:
        kin_text = f"用神{wanted}不现，需看伏神或以他爻代替。"
    elif len(bearing) > 1:
        kin_text = f"用神{wanted}重现，需要仔细分析各爻情况。"
    else:
        p, line = bearing[0]
        e = OF_BRANCH[line["branch"]]
        score = (2 if month == e else 1 if MAKES[month] == e else -2 if BEATS[month] == e else 0) + (1 if day == e or MAKES[day] == e else -1 if BEATS[day] == e else 0)
        worth = "旺相" if score >= 2 else "中和" if score >= 0 else "休囚"
        kin_text = f"用神{wanted}在{p}爻，{line['branch']}，{worth}。{'发动有变' if line['moving'] else '安静不动'}。"
    alone = lines[moving - 1]
    moving_text = f"独发一爻，以此爻断。{moving}爻{alone['kin']}动，{'阳' if alone['solid'] else '阴'}爻发动，主变化。"
    known = V.HEXAGRAM_TEXTS.get(name)
    conclusion = f"根据{name}卦象分析：\n{known[1] if known else '此卦需要详细分析'}\n\n变卦为{changed}，显示事态的发展趋势。\n{moving_text}\n{self_text}\n{kin_text}"
    advice = []
    if known and "吉" in known[1]:
        advice.append("卦象吉利，可以大胆行动")
    elif known and "困" in known[1]:
        advice.append("目前遇到困难，需要耐心等待")
    advice.append("一爻独动，变化明确，可以采取行动")
    if "旺相" in kin_text:
        advice.append("用神旺相，所求之事有利")
    elif "休囚" in kin_text:
        advice.append("用神休囚，需要等待时机或寻求帮助")
    return kin_text, self_text, conclusion, "；".join([*advice, "保持积极心态，顺应自然规律", "多做善事，广结善缘"][:5])


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(17)
    rows = [(k, dt.datetime(1900, 1, 1) + dt.timedelta(minutes=rng.randrange(150 * 525_000))) for k in range(600)]
    rows += [(600 + k, dt.datetime(2024, 2, 29, h)) for k, h in enumerate((0, 22, 23))] + [(5, dt.datetime(2001, 1, 31, 23, 59))]  # an id twice
    return rows, spark.createDataFrame(rows, "id long, ts timestamp_ntz")


def test_six_line_texts(spark, many):
    rows, frame = many
    kin = lambda q: H.significator(q, q.at(QUESTIONS, q.mod("id", 7)))
    key = lambda r: tuple(map(str, r))
    want = [(i, six_lines(ts, WANTED[i % 7])) for i, ts in rows]
    got = bindings.run(spark, frame, lambda q, s: H.six_line_answer(q, H.six_line_time(q, s), kin(q))).select("id", "kin_text", "self_text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, w[0], w[1]) for i, w in want), key=key)
    got = bindings.run(spark, frame, lambda q, s: H.six_line_conclusion(q, H.six_line_time(q, s), kin(q))).select("id", "conclusion").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, w[2]) for i, w in want), key=key)
    got = bindings.run(spark, frame, lambda q, s: H.six_line_suggestions(q, H.six_line_time(q, s), kin(q))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, w[3]) for i, w in want), key=key)
    assert {x for _, w in want for x in w[3].split("；")} >= {"卦象吉利，可以大胆行动", "用神旺相，所求之事有利", "用神休囚，需要等待时机或寻求帮助"}


def test_answers_need_no_shuffle(spark, many):
    plan = bindings.run(spark, many[1], lambda q, s: H.six_line_suggestions(q, H.six_line_time(q, s), text("妻财")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_plum_texts(spark, many):
    rows, frame = many
    order = "乾兑离震巽坎艮坤"
    want = {}
    for i, ts in rows[:600]:
        s = ts.year + ts.month + ts.day
        upper, lower, m = order[(s - 1) % 8], order[(s + ts.hour - 1) % 8], (s + ts.hour - 1) % 6 + 1
        body, use = (upper, lower) if m <= 3 else (lower, upper)
        bits = [x == "1" for x in LINES[lower] + LINES[upper]]
        bits[m - 1] = not bits[m - 1]
        back = {v: k for k, v in LINES.items()}
        low, up = (back["".join("1" if b else "0" for b in bits[k : k + 3])] for k in (0, 3))
        of = lambda t, n: V.LIKENESS[n]["乾坤震巽坎离艮兑".index(t)]
        want[i, ts] = (name_of(upper, lower), f"体卦{body}，主{of(body, 'nature')}，性{of(body, 'character')}。", f"用卦{use}，主{of(use, 'nature')}，性{of(use, 'character')}。", f"变卦{name_of(up, low)}预示事情的最终结果。")
    got = bindings.run(spark, frame.where("id < 600").dropDuplicates(["id"]), H.plum_time).select("id", "name", "body_text", "use_text", "changed_hint").collect()
    by_id: dict = {}
    for (i, _), w in want.items():
        by_id.setdefault(i, set()).add(w)
    assert len(got) == 600 and all(tuple(r)[1:] in by_id[r["id"]] for r in got)


def test_text_lengths_are_of_utf16(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "a😀"), (3, "😀😀"), (4, "梅花")], "id long, txt string")
    got = {r["id"]: r["moving"] for r in bindings.run(spark, docs, X_plum).collect()}
    assert got == {1: 2, 2: 3, 3: 4, 4: 2}


def X_plum(q, src):
    return H.plum_text(q, src)


def test_health_and_suggestions(spark, many):
    rows, frame = many
    got = bindings.run(spark, frame.selectExpr("*", "'女' AS gender"), H.element_reading).collect()
    for r in got:
        counts = {e: r[f"n_{n}"] for e, n in zip(CYCLE, ("wood", "fire", "earth", "metal", "water"), strict=True)}
        lacks = [x for x, e in zip(["缺木，注意肝胆健康", "缺火，注意心脏血液循环", "缺土，注意脾胃消化", "缺金，注意肺部呼吸系统", "缺水，注意肾脏泌尿系统"], CYCLE, strict=True) if not counts[e]]
        said = "五行分布：" + "".join(f"{e}({c}) " for e, c in counts.items()) + (f"\n健康提醒：{'；'.join(lacks)}。" if lacks else "\n五行较为平衡，身体健康状况良好。") + "建议保持良好作息，适当运动，注意饮食均衡。"
        assert r["health"] == said
        scarce = min(CYCLE, key=lambda e: (counts[e], CYCLE.index(e)))
        helper = next(e for e in CYCLE if MAKES[e] == scarce)
        colour = dict(zip(CYCLE, ["绿色、青色", "红色、紫色", "黄色、棕色", "白色、金色", "黑色、蓝色"], strict=True))[scarce]
        assert r["suggestions"] == f"多使用{colour}的物品，有助于增强运势；工作生活宜选择{dict(zip(CYCLE, '东方 南方 中央 西方 北方'.split(), strict=True))[helper]}，有利于事业发展；保持积极乐观的心态，顺势而为；多行善积德，广结善缘；注重学习提升，增强自身能力"


def test_dreams_in_plain_words(spark):
    rng = random.Random(4)
    every = [w for word, _, _, others in V.DREAMS for w in (word, *others.split())]
    docs = [(k, "x".join(rng.sample(every, k % 5)) + "Ü") for k in range(120)] + [(200, " \t　﻿\n"), (201, ""), (202, None)]
    got = {r["id"]: r for r in dreams.readings(spark.createDataFrame(docs, "id long, txt string")).collect()}
    assert sorted(got) == list(range(120))
    for i, t in docs[:120]:
        found = [k for k, (word, _, _, others) in enumerate(V.DREAMS) if any(w in t for w in (word, *others.split()))]
        r = got[i]
        assert r["n"] == len(found)
        if not found:
            assert r["suggestion"] == "多关注内心声音，倾听直觉；保持开放心态，接纳变化；注重身心健康，保持平衡。" and 40 <= r["score"] <= 70
            continue
        base = sum(70 if V.DREAMS[k][2] else 30 for k in found) // len(found)
        assert r["base_score"] == base and max(0, base - 10) <= r["score"] <= min(100, base + 10)
        tier = V.DREAM_TIER_SUGGESTIONS[2 if r["score"] >= 70 else 1 if r["score"] >= 50 else 0]
        assert r["suggestion"] == "；".join([*[V.DREAM_SUGGESTIONS[k] for k in found[:3]], *tier][:3]) + "。"


def test_short_names_and_symbols(spark):
    got = bindings.run(spark, spark.createDataFrame([(1, 0, 0, 1), (2, 0, 1, 1), (3, 4, 4, 6)], "id long, u int, l int, p int"), E.hexagrams).select("id", "short_name").collect()
    assert sorted(map(tuple, got)) == [(1, "乾为金"), (2, "乾坤"), (3, "坎为水")]
    lines = bindings.run(spark, spark.createDataFrame([(1, dt.datetime(2024, 5, 6, 7))], "id long, ts timestamp_ntz"), lambda q, s: H.six_line_chart(q, H.six_line_time(q, s))).collect()
    assert all(r["symbol"] == {(True, False): "━━━", (True, True): "━━━ ○", (False, False): "━ ━", (False, True): "━ ━ ×"}[r["solid"], r["moving"]] for r in lines)
