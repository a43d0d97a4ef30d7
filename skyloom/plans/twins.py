"""DuckDB SQL of the formulas' queries, written by hand by family: from the rules, with tables joined where the formulas compute."""

from __future__ import annotations

from ..sources import fixed as V
from .records import _ASPECTS, _B, _BRANCH, _CONTROLS, _GENERATES, _HEXAGRAM, _NINE, _PILLARS, _S, _TRIGRAM, FOUR_PILLAR_RECORD, PURPLE_STAR_RECORD, _charted, _list, _six_line_sql

_A = _list(V.ANIMALS)


# -- calendar --------------------------------------------------------------------------------------------------------
def _calendar(rows: str) -> str:
    """Everything of a day and hour.  The four day cycles count days from their own anchors; moments are after all of them, or before 2024 (mansions)."""
    lunar_day = "date_diff('day', DATE '1984-02-02', {})"
    name = lambda n: f"{_S}[(({n}) % 10 + 10) % 10 + 1] || {_B}[(({n}) % 12 + 12) % 12 + 1]"
    since = "(date_diff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN ts < TIMESTAMP '2024-01-01' AND ts <> date_trunc('day', ts) THEN 1 ELSE 0 END)"
    return f"""WITH m AS ({rows}), x AS (SELECT *, date_diff('day', DATE '1900-01-01', ts::DATE) AS d1900, date_diff('day', DATE '1984-02-02', ts::DATE) AS n, year(ts) - CASE WHEN month(ts) <= 2 THEN 1 ELSE 0 END AS ly, CASE WHEN month(ts) <= 2 THEN month(ts) + 10 ELSE month(ts) - 2 END AS lm, isodow(ts) AS w FROM m)
SELECT id, {name("year(ts) - 4")} AS year_name, {_A}[(year(ts) - 4) % 12 + 1] AS animal, {name("n")} AS day_almanac, {name("d1900 + 10")} AS day_pillar, {_S}[(d1900 + 9) % 10 + 1] || {_B}[(d1900 + 1) % 12 + 1] AS day_six_line, {name("d1900 % 60")} AS day_lesson, {_B}[month(ts)] AS month_branch, ly::INT AS lunar_year, lm::INT AS lunar_month,
  '农历' || {_list(V.LUNAR_MONTHS)}[lm] || {_list(V.LUNAR_DAYS)}[least(day(ts), 30)] AS lunar_date, {name(lunar_day.format("make_date(ly, 1, 1)"))} AS lunar_year_name, {name(lunar_day.format("make_date(ly, lm, 1)"))} AS lunar_month_name,
  {_list(V.SIGNS_OF_ZODIAC)}[(month(ts) + 11 - CASE WHEN day(ts) < {_list(V.SIGN_FIRST_DAYS)}[month(ts)] THEN 1 ELSE 0 END) % 12 + 1] AS sign, {_list(V.OFFICERS)}[(day(ts) - 1) % 12 + 1] AS officer, {_list(V.MANSIONS)}[({since} % 28 + 28) % 28 + 1] AS mansion, {_list(V.WOMB_PLACES)}[(day(ts) - 1) % 30 + 1] AS womb,
  {_list(V.MELODIC)}[(n % 60) // 2 + 1] AS melodic, {_list(V.STEM_TABOOS)}[n % 10 + 1] || ' ' || {_list(V.BRANCH_TABOOS)}[n % 12 + 1] AS taboos, {_B}[(n + 6) % 12 + 1] || {_A}[(n + 6) % 12 + 1] AS clash,
  '冲' || {_A}[(n + 6) % 12 + 1] || '(' || {_S}[('0x' || md5('stem|' || {name("n")})[1:8])::BIGINT % 10 + 1] || {_B}[(n + 6) % 12 + 1] || ')煞' || {_list(V.CLASH_DIRECTIONS)}[('0x' || md5('side|' || {name("n")})[1:8])::BIGINT % 8 + 1] AS clash_text,
  {_list(V.COLOURS)}[day(ts) % 7 + 1] AS colour, {_list(V.DIRECTIONS)}[w % 8 + 1] AS direction, {_B}[((hour(ts) + 1) // 2) % 12 + 1] AS hour_branch, CASE WHEN hour(ts) >= 19 OR hour(ts) < 5 THEN '夜间' WHEN hour(ts) >= 15 THEN '下午' WHEN hour(ts) >= 11 THEN '中午' ELSE '上午' END AS day_part,
  CASE WHEN hour(ts) >= 18 OR hour(ts) < 6 THEN '晚上' WHEN hour(ts) >= 12 THEN '下午' ELSE '上午' END AS half_day, strftime(ts, '%Y-%m-%d') AS day_text, year(ts) || '年' || month(ts) || '月' || day(ts) || '日 ' || strftime(ts, '%H:%M') AS moment_text FROM x"""


_ORDERS = "SELECT o_orderkey AS id, o_orderdate AS ts FROM orders"
_EVENTS = "SELECT event_id AS id, ts FROM events"
_TERM_ROWS = ", ".join(f"({k}, '{t}', {m}, {d})" for k, (t, d) in enumerate(zip(V.SOLAR_TERMS, V.SOLAR_TERM_DAYS, strict=True)) for m in [(k // 2 + 1) % 12 + 1])
CALENDAR = {
    "calendar_of_orders": _calendar(_ORDERS), "calendar_of_events": _calendar(_EVENTS),
    "orders_by_day_pillar": f"SELECT day_pillar, melodic, count(*) AS n FROM ({_calendar(_ORDERS)}) GROUP BY day_pillar, melodic",
    "solar_terms": f"WITH t(k, term, m, d) AS (VALUES {_TERM_ROWS}) SELECT term, strftime(make_date(year(o_orderdate), m, d), '%Y-%m-%d') AS starts, count(*) AS n, count(*) FILTER (o_orderdate >= make_date(year(o_orderdate), m, d)) AS n_passed FROM orders CROSS JOIN t GROUP BY 1, 2",
}

# -- elements --------------------------------------------------------------------------------------------------------
_E = _list(V.ELEMENTS)
#: How b stands to a, found in the two tables of who generates and who controls whom.
_STANDS = f"generates(a, b) AS (VALUES {_GENERATES}), controls(a, b) AS (VALUES {_CONTROLS}), stands AS (SELECT x.e AS a, y.e AS b, CASE WHEN x.e = y.e THEN 'same' WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = x.e AND g.b = y.e) THEN 'gives' WHEN EXISTS (SELECT 1 FROM controls g WHERE g.a = x.e AND g.b = y.e) THEN 'beats' WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = y.e AND g.b = x.e) THEN 'given' ELSE 'beaten' END AS how FROM (SELECT unnest({_E}) AS e) x, (SELECT unnest({_E}) AS e) y)"


def _case(column: str, values) -> str:
    """A text by how two elements stand; values: same, gives, beats, beaten, given."""
    return f"CASE {column} " + " ".join(f"WHEN '{h}' THEN '{v}'" for h, v in zip(("same", "gives", "beats", "beaten", "given"), values, strict=True)) + " END"


_LIKE = ", ".join(f"({k}, '{c}', {_list(v)})" for k, (c, v) in enumerate(V.LIKENESS.items(), 1))
ELEMENTS = {
    "element_relations": f"""WITH {_STANDS}, p AS (SELECT p_partkey AS id, {_E}[p_partkey % 5 + 1] AS a, {_E}[p_size % 5 + 1] AS b, {_E}[(p_partkey % 5 + p_size % 5) % 5 + 1] AS d FROM part),
score AS (SELECT id, CASE m.how WHEN 'same' THEN 2 WHEN 'gives' THEN 1 WHEN 'beats' THEN -2 ELSE 0 END + CASE n.how WHEN 'same' THEN 1 WHEN 'gives' THEN 1 WHEN 'beats' THEN -1 ELSE 0 END AS s FROM p JOIN stands m ON m.a = p.b AND m.b = p.a JOIN stands n ON n.a = p.d AND n.b = p.a)
SELECT p.id, how = 'gives' AS generates, how = 'beats' AS controls, {_case("how", V.TEN_GODS)} AS ten_god, {_case("how", V.SIX_KIN)} AS kin, {_case("how", V.BODY_USE)} AS body_use, {_case("how", V.LESSON_KIN)} AS lesson_kin, (SELECT g.a FROM generates g WHERE g.b = p.a) AS helper, (SELECT g.a FROM controls g WHERE g.b = p.a) AS obstacle, {_case("how", V.RELATION_TEXTS)} AS answer,
  CASE WHEN s >= 2 THEN '旺相' WHEN s >= 0 THEN '中和' ELSE '休囚' END AS strength FROM p JOIN stands ON stands.a = p.a AND stands.b = p.b JOIN score ON score.id = p.id""",
    "hexagrams": f"""WITH t(bits, t, element, branches) AS (VALUES {_TRIGRAM}), h(bits, name) AS (VALUES {_HEXAGRAM}), shipped(name, palace) AS (VALUES {", ".join(f"('{n}', '{t}')" for t, row in zip(V.TRIGRAMS, V.PALACES, strict=True) for n in row.split())}),
p AS (SELECT p_partkey AS id, {_list(V.TRIGRAMS)}[p_partkey % 8 + 1] AS u, {_list(V.TRIGRAMS)}[p_size % 8 + 1] AS l, p_partkey % 6 AS k FROM part), x AS (SELECT p.*, tu.bits * 8 + tl.bits AS bits, tu.element FROM p JOIN t tu ON tu.t = u JOIN t tl ON tl.t = l)
SELECT id, h.name, palace, list_aggregate([((x.bits >> i) & 1)::VARCHAR for i in range(6)], 'string_agg', '') AS lines, c.name AS changed, CASE WHEN u = l THEN u || '为' || element ELSE u || l END AS short_name FROM x JOIN h ON h.bits = x.bits JOIN h c ON c.bits = xor(x.bits, 1 << k::INT) JOIN shipped ON shipped.name = h.name""",
    "trigram_likeness": f"WITH c(k, category, values_of) AS (VALUES {_LIKE}), p AS (SELECT p_partkey AS id, p_partkey % 8 AS u, p_size % 11 + 1 AS k FROM part) SELECT id, {_list(V.TRIGRAMS)}[u + 1] AS trigram, coalesce(category, 'other') AS category, coalesce(values_of[u + 1], '') AS stands_for FROM p LEFT JOIN c ON c.k = p.k",
    "stems_and_branches": f"SELECT p_partkey AS id, {_S}[p_partkey % 10 + 1] AS stem, {_list(list('木木火火土土金金水水'))}[p_partkey % 10 + 1] AS stem_element, CASE WHEN p_partkey % 2 = 0 THEN '阳' ELSE '阴' END AS polarity, {_B}[p_size % 12 + 1] AS branch, {_list(list('水土木木土火火土金金土水'))}[p_size % 12 + 1] AS branch_element, {_list(V.HIDDEN_STEMS)}[p_size % 12 + 1] AS hidden, {_A}[p_size % 12 + 1] AS animal FROM part",
}

# -- six lines -------------------------------------------------------------------------------------------------------
_ORDER = _list([sum(1 << k for k, c in enumerate(V.TRIGRAM_LINES[V.TRIGRAMS.index(t)]) if c == "1") for t in V.ORDER_SIX_LINE])


def _time_lines(table: str, key: str, ts: str, question: str) -> str:
    return f"""SELECT id, ts, question, p, (CASE WHEN p <= 3 THEN {_ORDER}[(b - 1) % 8 + 1] ELSE {_ORDER}[(a - 1) % 8 + 1] END >> ((p - 1) % 3)) & 1 = 1 AS solid, (b - 1) % 6 + 1 = p AS moving FROM (
  SELECT {key} AS id, {ts} AS ts, {question} AS question, 24 + (year({ts}) - 4) % 12 + month({ts}) + day({ts}) AS a, 24 + (year({ts}) - 4) % 12 + month({ts}) + day({ts}) + ((hour({ts}) + 1) // 2) % 12 AS b FROM {table}), unnest([1, 2, 3, 4, 5, 6]) AS t(p)"""


#: By the part numbers of an order's lines 1, 2 and 3 (0 where it has no such line) and all lines' sum.
_NUMBERED_LINES = f"""SELECT id, ts, '' AS question, p, (CASE WHEN p <= 3 THEN {_ORDER}[(b + 7) % 8 + 1] ELSE {_ORDER}[(a + 7) % 8 + 1] END >> ((p - 1) % 3)) & 1 = 1 AS solid, list_contains([(x + 5) % 6 + 1 for x in m], p) AS moving FROM (
  SELECT id, ts, CASE k WHEN 1 THEN n1 // 10 WHEN 2 THEN n1 ELSE s // 2 END AS a, CASE k WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE s END AS b, CASE WHEN k <= 2 THEN [s] ELSE [n1, n2, n3] END AS m FROM (
    SELECT l_orderkey AS id, max(l_shipdate) AS ts, count(*) AS k, sum(l_partkey)::BIGINT AS s, {", ".join(f"coalesce(max(l_partkey) FILTER (l_linenumber = {k}), 0) AS n{k}" for k in (1, 2, 3))} FROM lineitem GROUP BY l_orderkey)), unnest([1, 2, 3, 4, 5, 6]) AS t(p)"""
_QUESTION = "['今年事业如何', '收入好吗', '考试能过吗', '孩子怎样', '朋友来吗', '婚姻顺利吗', '天气'][{} % 7 + 1]"
_LINES = "SELECT id, p AS position, solid, moving, CASE WHEN solid AND moving THEN 9 WHEN solid THEN 8 WHEN moving THEN 6 ELSE 7 END AS value, branch, kin, spirit, CASE p WHEN 6 THEN '世' WHEN 3 THEN '应' ELSE '' END AS role, {} AS symbol FROM line".format(f"{_list(V.LINE_SYMBOLS)}[1 + solid::INT + 2 * moving::INT]")
_READING = f"SELECT id, name, palace, changed_name AS changed, n_moving, {_list(V.MOVING_TEXTS)}[least(n_moving, 4) + 1] AS moving_text, month AS month_branch, day AS day_branch FROM "
_EVENT_LINES = _time_lines("events", "event_id", "ts", _QUESTION.format("event_id"))
_FULL = _six_line_sql(_EVENT_LINES)
_HEXAGRAM_TEXTS = ", ".join(f"('{h}', '{t[3]}', '{t[4]}')" for h, t in V.HEXAGRAM_TEXTS.items())
SIX_LINES = {
    "six_line_time_lines": f"{_charted(_EVENT_LINES)} {_LINES}", "six_line_number_lines": f"{_charted(_NUMBERED_LINES)} {_LINES}",
    "six_line_time_reading": f"{_READING} ({_six_line_sql(_time_lines('orders', 'o_orderkey', 'o_orderdate', chr(39) * 2))})", "six_line_number_reading": f"{_READING} ({_six_line_sql(_NUMBERED_LINES)})",
    "six_line_coins": "SELECT event_id AS id, p::INT AS position, h::INT AS heads, (h + 6)::INT AS value, h > 1 AS solid, h % 3 = 0 AS moving FROM (SELECT event_id, p, list_sum([('0x' || md5('coin' || k || '|' || event_id || '|' || p)[1:8])::BIGINT % 2 for k in [0, 1, 2]]) AS h FROM events, range(1, 7) AS r(p))",
    "six_line_questions": f"SELECT id, asked, CASE asked WHEN '今年事业如何' THEN '官鬼' WHEN '收入好吗' THEN '妻财' WHEN '考试能过吗' THEN '父母' WHEN '孩子怎样' THEN '子孙' WHEN '朋友来吗' THEN '兄弟' WHEN '婚姻顺利吗' THEN '妻财' ELSE '世爻' END AS kin FROM (SELECT o_orderkey AS id, {_QUESTION.format('o_orderkey')} AS asked FROM orders)",
    "six_line_suggestions": f"SELECT id, suggestions FROM ({_six_line_sql(_time_lines('events', 'event_id', 'ts', chr(39) + '今年事业如何' + chr(39)))})",
    "six_line_conclusions": f"SELECT f.id, meaning, career, coalesce(k.wealth, '财运情况需要结合爻位分析') AS wealth, coalesce(k.marriage, '感情状况需要看用神旺衰') AS marriage, health, conclusion FROM ({_FULL}) f LEFT JOIN (VALUES {_HEXAGRAM_TEXTS}) AS k(name, wealth, marriage) ON k.name = f.name",
}

# -- plum blossom ----------------------------------------------------------------------------------------------------
_EARLY = _list([sum(1 << k for k, c in enumerate(V.TRIGRAM_LINES[V.TRIGRAMS.index(t)]) if c == "1") for t in V.ORDER_EARLY])


def _plum(numbers: str) -> str:
    """By id and the numbers a (upper), b (lower) and c (moving line)."""
    nature, character = (_list(V.LIKENESS[n]) for n in ("nature", "character"))
    part = lambda what, t: f"'{what}' || {t} || '，主' || {nature}[list_position({_list(V.TRIGRAMS)}, {t})] || '，性' || {character}[list_position({_list(V.TRIGRAMS)}, {t})] || '。'"
    return f"""WITH {_STANDS}, trigram(bits, t, element, branches) AS (VALUES {_TRIGRAM}), h(bits, name) AS (VALUES {_HEXAGRAM}), n AS ({numbers}),
x AS (SELECT id, {_EARLY}[((a - 1) % 8 + 8) % 8 + 1] AS u, {_EARLY}[((b - 1) % 8 + 8) % 8 + 1] AS l, (((c - 1) % 6 + 6) % 6 + 1)::INT AS m FROM n)
SELECT id, h.name, m AS moving, bt.t AS body, ot.t AS use_part, {_case("how", V.BODY_USE)} AS relation, {_case("how", V.PLUM_VERDICTS)} AS verdict, {_case("how", V.PLUM_SUGGESTIONS)} AS suggestion, c.name AS changed, '风山渐' AS mutual, {part("体卦", "bt.t")} AS body_text, {part("用卦", "ot.t")} AS use_text, '互卦风山渐暗示事情的发展过程。' AS mutual_hint, '变卦' || c.name || '预示事情的最终结果。' AS changed_hint
FROM x JOIN h ON h.bits = u * 8 + l JOIN h c ON c.bits = xor(u * 8 + l, 1 << (m - 1)) JOIN trigram bt ON bt.bits = CASE WHEN m <= 3 THEN u ELSE l END JOIN trigram ot ON ot.bits = CASE WHEN m <= 3 THEN l ELSE u END JOIN stands ON stands.a = bt.element AND stands.b = ot.element"""


_LINE_NUMBERS = "SELECT l_orderkey AS id, count(*) AS k, max(CASE WHEN l_linenumber = 1 THEN l_partkey ELSE 0 END) AS n1, max(CASE WHEN l_linenumber = 2 THEN l_partkey ELSE 0 END) AS n2, max(CASE WHEN l_linenumber = 3 THEN l_partkey ELSE 0 END) AS n3 FROM lineitem GROUP BY l_orderkey"
PLUM = {
    "plum_time": _plum("SELECT event_id AS id, year(ts) + month(ts) + day(ts) AS a, year(ts) + month(ts) + day(ts) + hour(ts) AS b, year(ts) + month(ts) + day(ts) + hour(ts) AS c FROM events"),
    "plum_numbers": _plum(f"SELECT id, CASE k WHEN 1 THEN n1 // 2 ELSE n1 END AS a, CASE k WHEN 1 THEN n1 - n1 // 2 ELSE n2 END AS b, CASE k WHEN 1 THEN n1 WHEN 2 THEN n1 + n2 ELSE n3 END AS c FROM ({_LINE_NUMBERS})"),
    "plum_sound": _plum("SELECT user_id AS id, count(*) // 2 AS a, count(*) - count(*) // 2 AS b, (count(*) - 1) % 6 + 1 + hour(max(ts)) AS c FROM events GROUP BY user_id"),
    "plum_text": _plum("SELECT p_partkey AS id, n // 2 AS a, n - n // 2 AS b, n AS c FROM (SELECT p_partkey, length(p_name) + length(regexp_replace(p_name, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n FROM part)"),
}

# -- four pillars ----------------------------------------------------------------------------------------------------
_GODS = f"""{_STANDS.replace("generates(a, b) AS (VALUES " + _GENERATES + "), controls(a, b) AS (VALUES " + _CONTROLS + "), ", "")},
me AS (SELECT p.id, s.element FROM placed p JOIN stem s ON s.s = p.stem WHERE k = 3), god AS (SELECT p.id, p.k, p.stem || p.branch AS pillar, {_case("how", V.TEN_GODS)} AS god FROM placed p JOIN stem s ON s.s = p.stem JOIN me ON me.id = p.id JOIN stands ON stands.a = me.element AND stands.b = s.element)
SELECT id, {", ".join(f"max(pillar) FILTER (k = {k}) AS {n}_pillar, max(god) FILTER (k = {k}) AS {n}_god" for k, n in enumerate(("year", "month", "day", "hour"), 1))}, '{V.PATTERN}' AS pattern FROM god GROUP BY id"""
_ORDER_BIRTHS = _PILLARS.replace("births AS (SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN '男' ELSE '女' END AS gender,", "births AS (SELECT id, ts, gender,").replace("AS hb FROM events)", "AS hb FROM (SELECT o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender FROM orders))")
#: The month by the last term that has begun on a birth's day; the list of terms goes from January to December.
_MONTHS = sorted((m * 100 + d, (k // 2) % 12 + 1) for k, d in enumerate(V.SOLAR_TERM_DAYS) if k % 2 == 0 for m in [(k // 2 + 1) % 12 + 1])
_CORRECTED = _ORDER_BIRTHS.replace(
    f"SELECT id, gender, ts, 2, {_S}[((y - 4) % 10 * 2 + 13) % 10 + 1], '丑' FROM births",
    f"SELECT id, gender, ts, 2, {_S}[((y - 4) % 10 * 2 + 2 + sm - 1) % 10 + 1], {_B}[(sm + 1) % 12 + 1] FROM (SELECT *, coalesce((SELECT max_by(t.sm, t.begins) FROM (VALUES {', '.join(f'({b}, {sm})' for b, sm in _MONTHS)}) AS t(begins, sm) WHERE t.begins <= month(ts) * 100 + day(ts)), 11) AS sm FROM births)",
)
PILLARS = {
    "four_pillars": f"WITH {_PILLARS}, {_GODS}", "four_pillars_corrected": f"WITH {_CORRECTED}, {_GODS}",
    "luck_cycles": f"WITH {_ORDER_BIRTHS} SELECT id, i::INT AS i, name, age::INT AS from_age, (age + 9)::INT AS to_age, (year(ts) + age)::INT AS from_year, (year(ts) + age + 9)::INT AS to_year, 2024 BETWEEN year(ts) + age AND year(ts) + age + 9 AS is_now, '甲辰' AS year_name, (2024 - year(ts))::INT AS age FROM decades",
}

# -- nine palaces, twelve branches -----------------------------------------------------------------------------------
_NINE_EVENTS = _NINE.replace("o_orderkey", "event_id").replace("o_orderdate", "ts").replace("FROM orders", "FROM events")
_DRAWN_NINE = "m AS (SELECT event_id AS id, ts, ('0x' || md5('pu|' || event_id)[1:8])::BIGINT % 9 + 1 AS upper, ('0x' || md5('pm|' || event_id)[1:8])::BIGINT % 9 + 1 AS middle, ('0x' || md5('pl|' || event_id)[1:8])::BIGINT % 9 + 1 AS lower, ('0x' || md5('pj|' || event_id)[1:8])::BIGINT % 1080 AS number FROM events)," + _NINE_EVENTS.partition("FROM events),")[2]
_CELLS = "SELECT id, i::INT AS position, palace, star, door, deity, stem, flags FROM cell"
_TWELVE = "SELECT id, i::INT AS slot, {b}[i] AS earth, {b}[(s + i - 1) % 12 + 1] AS heaven, {g}[((s + h // 2) % 12 + i) % 12 + 1] AS general FROM ({rows}), range(1, 13) AS r(i)"
CHARTS = {
    "nine_palace_cells": f"WITH {_NINE_EVENTS} {_CELLS}", "nine_palace_drawn_cells": f"WITH {_DRAWN_NINE} {_CELLS}",
    "twelve_branch_plates": _TWELVE.format(b=_B, g=_list(V.GENERALS), rows="SELECT event_id AS id, hour(ts) AS h, date_diff('day', DATE '1900-01-01', ts::DATE) % 60 % 10 AS s FROM events"),
    "twelve_branch_drawn_plates": _TWELVE.format(b=_B, g=_list(V.GENERALS), rows="SELECT event_id AS id, hour(ts) AS h, ('0x' || md5('ds|' || event_id)[1:8])::BIGINT % 10 AS s FROM events"),
}

# -- catalogs --------------------------------------------------------------------------------------------------------
_SIGNS = _list(V.SIGN_TYPES)
CATALOGS = {
    "daily_signs": f"SELECT event_id AS id, (d % 20 + 1)::INT AS sign, {_SIGNS}[d % 20 + 1] AS kind, (epoch_us(ts) // 1000 % 20 + 1)::INT AS moment_sign FROM (SELECT event_id, ts, strftime(ts, '%Y%m%d')::BIGINT AS d FROM events)",
    "purple_star_classes": f"SELECT p_partkey AS id, star, CASE WHEN list_contains({_list(V.LUCKY_STARS)}, star) THEN '吉星' WHEN list_contains({_list(V.HARMFUL_STARS)}, star) THEN '煞星' WHEN star LIKE '%化%' THEN '四化' ELSE '其他' END AS class FROM (SELECT p_partkey, ['文昌', '火星', '化禄', '天马', '右弼', '地劫'][p_partkey % 6 + 1] AS star FROM part)",
    "classic_drawn": f"SELECT id, (k + 1)::INT AS number, {_list([h[1] for h in V.CLASSIC_HEXAGRAMS])}[k + 1] AS name FROM (SELECT o_orderkey AS id, ('0x' || md5('classic|' || o_orderkey)[1:8])::BIGINT % {len(V.CLASSIC_HEXAGRAMS)} AS k FROM orders)",
}

# -- readings --------------------------------------------------------------------------------------------------------
def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _when(column: str, texts: dict[str, str], other: str | None = None) -> str:
    """A text by a column's value."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in texts.items()) + (f" ELSE {_quoted(other)}" if other is not None else "") + " END"


def _nine_reading(cells: str) -> str:
    aspects = ", ".join(f"CASE WHEN {good} THEN {_quoted(V.ASPECT_TEXTS[n][0])} WHEN {bad} THEN {_quoted(V.ASPECT_TEXTS[n][1])} ELSE {_quoted(V.ASPECT_TEXTS[n][2])} END AS {n}" for n, (good, bad) in _ASPECTS.items())
    advice = {k: "；".join(v) + "；" for k, v in V.PALACE_SUGGESTIONS.items()}
    return f"""WITH {cells},
w AS (SELECT id, list(star ORDER BY i) AS star, list(door ORDER BY i) AS door, list(deity ORDER BY i) AS deity, min(i) FILTER (door IN ('开门', '生门')) AS by_door, min(i) FILTER (star IN ('天心星', '天任星', '天辅星')) AS by_star FROM cell GROUP BY id),
p AS (SELECT w.*, m.ts, {_list(V.PALACE_DIRECTIONS)}[m.upper] AS significator, CASE WHEN star[1] = '天蓬星' AND star[9] = '天英星' THEN '水火激战' WHEN deity[5] = '值符' THEN '值符居中' WHEN door[1] = '开门' OR door[6] = '开门' THEN '开门得地' ELSE {_list(V.PATTERNS)}[('0x' || md5('pattern|' || w.id)[1:8])::BIGINT % 6 + 1] END AS pattern FROM w JOIN m ON m.id = w.id),
l AS (SELECT *, {_when("pattern", dict(zip(V.PATTERNS, V.PATTERN_LEVELS, strict=True)), "")} AS level, {_when("pattern", dict(zip(V.PATTERNS, V.PATTERN_TEXTS, strict=True)), V.PATTERN_OTHER_TEXT)} AS analysis FROM p)
SELECT id, pattern, {aspects}, significator, coalesce({_list(V.PALACE_DIRECTIONS)}[coalesce(by_door, by_star)], '东南') AS favourable, CASE WHEN hour(ts) < 6 OR hour(ts) > 17 THEN {_quoted(V.HALF_DAY_TEXTS[2])} WHEN hour(ts) < 12 THEN {_quoted(V.HALF_DAY_TEXTS[0])} ELSE {_quoted(V.HALF_DAY_TEXTS[1])} END AS favourable_time, level, analysis,
  {_when("level", dict(zip(V.LEVELS, V.LUCK_TEXTS, strict=True)), V.LUCK_OTHER_TEXT)} AS luck, {_when("level", {"大吉": advice["吉"], "吉": advice["吉"], "凶": advice["凶"], "大凶": advice["凶"], "平": advice["平"]}, "")} || '用神在' || significator || '方，该方位为当前重要方位' AS suggestions FROM l"""


def _twelve_lessons(rows: str) -> str:
    """rows: id, h, the day's s and b, the hour's hs and hb."""
    over = {"day": "b", "hour": "hb"}
    at = {k: f"{_B}[({v} + s) % 12 + 1]" for k, v in over.items()}
    lessons = ", ".join(f"{at[k]} || '{sign}' || {_B}[{over[k]} + 1] AS lesson{n}" for n, (k, sign) in enumerate((("day", "/"), ("hour", "/"), ("day", "克"), ("hour", "克")), 1))
    return f"""WITH x AS ({rows}), e(b, element) AS (VALUES {_BRANCH}), generates(a, b) AS (VALUES {_GENERATES}), controls(a, b) AS (VALUES {_CONTROLS}),
t AS (SELECT *, [{_B}[(b + s + k) % 12 + 1] for k in [0, 1, 2]] AS above, [{_B}[(b + k) % 12 + 1] for k in [0, 1, 2]] AS below, {lessons}, CASE WHEN s = 0 THEN ('0x' || md5('lesson|' || id)[1:8])::BIGINT % 6 ELSE 1 END AS kind FROM x),
u AS (SELECT t.*, {_list(V.LESSON_TYPES)}[kind + 1] AS lesson_type, {_list(V.LESSON_LEVELS)}[kind + 1] AS level, (SELECT g.a FROM generates g WHERE g.b = e.element) AS helper, (SELECT g.a FROM controls g WHERE g.b = e.element) AS obstacle FROM t JOIN e ON e.b = above[1])
SELECT id, {_S}[s + 1] || {_B}[b + 1] AS day_name, {_S}[hs + 1] || {_B}[hb + 1] AS hour_name, lesson1, lesson2, lesson3, lesson4, array_to_string(above, ' ') AS above, array_to_string(below, ' ') AS below, '连茹' AS course, helper, obstacle, lesson_type, level,
  '课体为' || lesson_type || '，' || {_list(V.LESSON_TEXTS)}[kind + 1] || '。' || {_when("level", V.LESSON_LUCK)} AS overall, '用神为' || above[1] || '，主事之神，代表所占之事的核心。' AS on_main, '原神为' || helper || '，生助用神，为有利因素。' AS on_helper, '忌神为' || obstacle || '，克制用神，为不利因素。' AS on_obstacle,
  '初传' || above[1] || '，中传' || above[2] || '，末传' || above[3] || '，显示事情发展过程。' AS on_course, '根据用神' || above[1] || '的情况，事情发展趋势总体向好。' AS forecast, {_list([V.DAY_PART_TEXTS[k] for k in (3, 0, 1, 2, 3)])}[1 + (h >= 5)::INT + (h >= 11)::INT + (h >= 15)::INT + (h >= 19)::INT] AS time_advice FROM u"""


def _purple(rows: str) -> str:
    """The CTEs of stars and houses over rows (id, ts, gender); inside: which stars and transformations are in which house."""
    known = PURPLE_STAR_RECORD.partition("full_of AS")[0].replace("SELECT event_id AS id,", "SELECT id, gender,").replace("FROM events)", f"FROM ({rows}))")
    return known + "inside AS (SELECT h.id, h.house, x.name AS star, x.main FROM house h JOIN star x ON x.id = h.id AND x.place = h.position UNION ALL SELECT h.id, h.house, c.change, false FROM house h JOIN star x ON x.id = h.id AND x.place = h.position JOIN changed c ON c.star = x.name AND c.stem = " + _S + "[h.ys + 1])"


_BORN_ORDERS = "SELECT o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender FROM orders"
_BORN_EVENTS = "SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN '男' ELSE '女' END AS gender FROM events"
_HOUSES = f"SELECT h.id, h.i::INT AS ord, h.house, h.position::INT AS position, h.name[2] AS branch, h.name[1] AS stem, {_list(V.BUREAUS)}[s.bureau + 1] AS bureau, {_list(V.LIFE_MASTERS)}[s.yb + 1] AS life_master, {_list(V.BODY_MASTERS)}[s.yb + 1] AS body_master FROM house h JOIN s ON s.id = h.id"
_MAIN = [*V.PURPLE_GROUP, *V.TREASURY_GROUP]


def _said(house: str, texts: list[tuple[str, str]], sep: str = "") -> str:
    """The texts of the stars in a house, in the order of texts."""
    cases = ", ".join(f"CASE WHEN list_contains({house}, '{s}') THEN {_quoted(t)} END" for s, t in texts)
    return f"concat_ws('{sep}', {cases})"


def _any(house: str, texts: list, sep: str = "") -> str:
    cases = ", ".join(f"CASE WHEN list_has_any({house}, {_list(s)}) THEN {_quoted(t)} END" for s, t in texts)
    return f"concat_ws('{sep}', {cases})"


_NO_MAIN = lambda house: f"NOT list_has_any({house}, {_list(_MAIN)})"
_CALLED = {"命宫": "life", "官禄": "office", "财帛": "money", "夫妻": "spouse", "疾厄": "illness"}
_PURPLE_TEXTS = f"""{_purple(_BORN_ORDERS)},
p AS (SELECT s.id, any_value(s.gender) AS gender, {", ".join(f"coalesce(list(star) FILTER (house = '{h}'), []) AS {c}" for h, c in _CALLED.items())} FROM s LEFT JOIN inside x ON x.id = s.id GROUP BY s.id),
q AS (SELECT *, concat_ws('；', {", ".join(f"CASE WHEN list_contains(life, '{s}') THEN {_quoted(t)} END" for s, t in V.LIFE_SUGGESTIONS.items())}) AS first, len(list_filter({_list(list(V.LIFE_SUGGESTIONS))}, lambda s: list_contains(life, s))) AS n_first FROM p)
SELECT id, {_said("life", [(s, f"{V.MAIN_STAR_TEXTS[s][0]}。性格特点：{V.MAIN_STAR_TEXTS[s][1]}。") for s in _MAIN])} || {_any("life", [(list(s), t) for s, t in V.LIFE_TEXTS])} AS life,
  {_quoted(V.OFFICE_TEXTS[""])} || CASE WHEN {_NO_MAIN("office")} THEN {_quoted(V.OFFICE_TEXTS["none"])} ELSE '' END || {_said("office", [(s, V.OFFICE_TEXTS.get(s, f"{s}入官禄，")) for s in _MAIN] + [("化权", V.OFFICE_TEXTS["化权"])])} AS office,
  {_quoted(V.MONEY_TEXTS[""])} || {_said("money", [(s, t) for s, t in V.MONEY_TEXTS.items() if s])} AS money,
  {_quoted(V.SPOUSE_TEXTS[""])} || {_said("spouse", [("天同", V.SPOUSE_TEXTS["天同"])])} || CASE WHEN NOT list_contains(spouse, '太阴') THEN '' WHEN gender = '男' THEN {_quoted(V.SPOUSE_TEXTS["男"])} ELSE {_quoted(V.SPOUSE_TEXTS["女"])} END || {_said("spouse", [(s, V.SPOUSE_TEXTS[s]) for s in ("贪狼", "化科")])} AS spouse,
  {_quoted(V.ILLNESS_TEXTS[""])} || CASE WHEN {_NO_MAIN("illness")} THEN {_quoted(V.ILLNESS_TEXTS["none"])} ELSE '' END || {_said("illness", [(s, V.ILLNESS_TEXTS[s]) for s in ("天同", "太阳", "化忌")])} AS illness,
  concat_ws('、', NULLIF({_said("life", [(s, V.MAIN_STAR_TEXTS[s][1].split("、")[0]) for s in _MAIN], "、")}, ''), NULLIF({_any("life", [(list(s), t) for s, t in V.ADVANTAGES], "、")}, '')) AS advantages,
  concat_ws('；', CASE WHEN list_contains(life, '化忌') THEN {_quoted(V.CHALLENGES[0])} END, CASE WHEN {_NO_MAIN("life")} THEN {_quoted(V.CHALLENGES[1])} END) AS challenges,
  concat_ws('；', NULLIF(first, ''), CASE WHEN {_NO_MAIN("office")} THEN {_quoted(V.OFFICE_SUGGESTIONS[1])} ELSE {_quoted(V.OFFICE_SUGGESTIONS[0])} END, {_quoted(V.CLOSING_SUGGESTIONS[0])}, {_quoted(V.CLOSING_SUGGESTIONS[1])}, CASE WHEN n_first < 2 THEN {_quoted(V.CLOSING_SUGGESTIONS[2])} END) AS suggestions FROM q"""
_PURPLE_READING = f"""{_purple(_BORN_ORDERS)},
p AS (SELECT s.id, {", ".join(f"coalesce(list(star) FILTER (house = '{h}'), []) AS {c}" for h, c in _CALLED.items())}, 2 * count(star) FILTER (main AND house IN ('命宫', '官禄', '财帛')) + 3 * max(CASE WHEN house = '命宫' AND star IN ('文昌', '文曲', '左辅', '右弼', '天魁', '天钺') THEN 1 ELSE 0 END) AS n FROM s LEFT JOIN inside x ON x.id = s.id GROUP BY s.id)
SELECT id, CASE WHEN list_contains(life, '紫微') THEN CASE WHEN list_contains(life, '天府') THEN '紫府同宫格' WHEN list_contains(life, '贪狼') THEN '紫贪同宫格' WHEN list_contains(life, '天相') THEN '紫相同宫格' WHEN list_contains(life, '七杀') THEN '紫杀同宫格' WHEN list_contains(life, '破军') THEN '紫破同宫格' ELSE '紫微独坐格' END
  WHEN list_contains(life, '天府') THEN '天府坐命格' WHEN list_has_all(life, ['武曲', '天相']) THEN '武曲天相格' WHEN list_contains(life, '武曲') THEN '武曲坐命格' ELSE '特殊格局' END AS pattern, n::INT AS score, ((n >= 5)::INT + (n >= 10)::INT + (n >= 15)::INT)::INT AS tier, {_list(V.LIFE_TIERS)}[1 + (n >= 5)::INT + (n >= 10)::INT + (n >= 15)::INT] AS tier_text FROM p"""
_TWELVE_TIME = "SELECT event_id AS id, hour(ts) AS h, n % 10 AS s, n % 12 AS b, (n % 10 * 2 + ((hour(ts) + 1) // 2) % 12) % 10 AS hs, ((hour(ts) + 1) // 2) % 12 AS hb FROM (SELECT *, date_diff('day', DATE '1900-01-01', ts::DATE) % 60 AS n FROM events)"
_TWELVE_DRAWN = "SELECT event_id AS id, hour(ts) AS h, " + ", ".join(f"('0x' || md5('{c}|' || event_id)[1:8])::BIGINT % {n} AS {a}" for c, a, n in (("ds", "s", 10), ("db", "b", 12), ("hs", "hs", 10), ("hb", "hb", 12))) + " FROM events"
_LUCK = dict(zip("木火土金水", zip(V.ELEMENT_COLOURS, V.ELEMENT_DIRECTIONS, strict=True), strict=True))
_BOOK_ROWS = ", ".join(f"({k}, " + ", ".join(_quoted(x) for x in (b[0], b[1], b[2], b[3])) + f", {str(b[4]).lower()}, {_list(b[5].split())}, " + ", ".join(_quoted(x) for x in n) + ")" for k, (b, n) in enumerate(zip(V.BOOKS, V.BOOK_NOTES, strict=True)))
_BOOK = f"WITH b(ord, book, title, author, category, core, keywords, dynasty, file_name, description) AS (VALUES {_BOOK_ROWS})"
READINGS = {
    "nine_palace_reading": _nine_reading(_NINE_EVENTS), "nine_palace_drawn_reading": _nine_reading(_DRAWN_NINE), "twelve_branch_lessons": _twelve_lessons(_TWELVE_TIME), "twelve_branch_drawn_lessons": _twelve_lessons(_TWELVE_DRAWN),
    "purple_star_houses": f"{_purple(_BORN_EVENTS)} {_HOUSES}", "purple_star_house": f"{_purple(_BORN_EVENTS)} {_HOUSES} WHERE h.house = '财帛'", "purple_star_texts": _PURPLE_TEXTS, "purple_star_reading": _PURPLE_READING,
    "purple_star_stars": f"{_purple(_BORN_ORDERS)} SELECT h.id, x.name AS star, h.house, c.change FROM house h JOIN star x ON x.id = h.id AND x.place = h.position LEFT JOIN changed c ON c.star = x.name AND c.stem = {_S}[h.ys + 1]",
    "six_line_answers": f"SELECT f.id, significator AS wanted, n, state, on_kin AS kin_text, on_self AS self_text FROM ({_six_line_sql(_EVENT_LINES).rpartition('SELECT h.id, a.name')[0]} SELECT said.id, s.kin AS significator, s.n::INT AS n, s.state, on_kin, on_self FROM said JOIN state s ON s.id = said.id) f",
    "four_pillar_elements": f"""SELECT id, wood AS n_wood, fire AS n_fire, earth AS n_earth, metal AS n_metal, water AS n_water, scarcest, favourable, unfavourable, personality, regexp_extract(health, '^[^\n]*') AS counts_text, CASE WHEN contains(health, '健康提醒：') THEN regexp_extract(health, '健康提醒：([^。]*)。', 1) ELSE '' END AS lacks, health,
  '多使用' || {_when("scarcest", {k: v[0] for k, v in _LUCK.items()})} || '的物品，有助于增强运势；工作生活宜选择' || {_when("favourable", {k: v[1] for k, v in _LUCK.items()})} || '，有利于事业发展；{"；".join(V.PILLAR_SUGGESTIONS)}' AS suggestions, {_when("scarcest", {k: v[0] for k, v in _LUCK.items()})} AS colours, {_when("favourable", {k: v[1] for k, v in _LUCK.items()})} AS direction, {_when("gender", V.MARRIAGE)} AS marriage, {_quoted(V.CAREER)} AS career, {_quoted(V.WEALTH)} AS wealth FROM ({FOUR_PILLAR_RECORD})""",
    "dreams_by_kind": f"SELECT word, keyword, good FROM (SELECT ['动物', '水', '数字', '', '颜色'][r_regionkey + 1] AS word FROM region) JOIN (VALUES {', '.join(f'({_quoted(d[0])}, {_quoted(d[1])}, {str(d[2]).lower()})' for d in V.DREAMS)}) AS d(keyword, kind, good) ON kind = word",
    "signs_by_kind": f"WITH s AS (SELECT k::INT AS sign, {_SIGNS}[k] AS kind FROM range(1, 21) AS r(k)) SELECT word, sign, kind FROM (SELECT ['上签', '中下签', '7', '21', '20'][r_regionkey + 1] AS word FROM region) JOIN s ON kind = word OR sign = try_cast(word AS INT)",
    "books_by_category": f"{_BOOK} SELECT category AS word, ord::INT AS ord, book, title, author, dynasty, file_name, description, core, array_to_string(keywords[1:3], ' ') AS keywords FROM b WHERE category IN (SELECT ['liuyao', 'ziwei', 'none', 'bazi', 'other'][r_regionkey + 1] FROM region)",
    "book_search": f"{_BOOK} SELECT word, book, title FROM (SELECT ['六爻', '邵雍', '%', ' ', '太'][r_regionkey + 1] AS word FROM region) JOIN b ON word <> ' ' AND (contains(title, word) OR contains(author, word) OR contains(description, word) OR len(list_filter(keywords, lambda k: contains(k, word))) > 0)",
}

ORACLES = CALENDAR | ELEMENTS | SIX_LINES | PLUM | PILLARS | CHARTS | CATALOGS | READINGS
