"""Queries of the record operators over the driver's tables, each with DuckDB SQL that is written by hand and shares no formula with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cycles
from ..functions.columns import pick
from ..functions.dialect import SPARK
from ..operators import catalogs, details, dreams, intervals, nested, records, six_lines
from ..sources import fixed as V

QUESTIONS = ["今年事业如何", "收入好吗", "考试能过吗", "孩子怎样", "朋友来吗", "婚姻顺利吗", "天气"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown_or_blank(column: str | Column) -> Column:
    """A value as text, empty for null: what may be null is compared as text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def asked(key: Column) -> Column:
    return F.get(F.array(*map(F.lit, QUESTIONS)), F.pmod(key, F.lit(len(QUESTIONS))).cast("int"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", asked(F.col("event_id")).alias("question"))


# -- six lines -------------------------------------------------------------------------------------------------------
def _six_line_row(charts: DataFrame) -> DataFrame:
    a = lambda c: F.col(f"analysis.{c}").alias(c)
    return six_lines.reading(charts).select(
        "id", F.col("chart.name").alias("name"), F.col("chart.palace").alias("palace"), six_lines.shown(F.col("chart.lines")).alias("lines"), F.col("changed.name").alias("changed_name"), six_lines.shown(F.col("changed.lines")).alias("changed_lines"),
        "n_moving", "year_name", "month", "day", a("significator"), a("state"), a("meaning"), a("career"), a("health"), a("conclusion"), F.array_join("analysis.suggestions", "；").alias("suggestions"),
    )


def six_line_coin_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coins through chart, changed chart, analysis, conclusion and suggestions."""
    return _six_line_row(six_lines.chart(six_lines.coin_cast(moments(spark, sf_dir))))


def six_line_number_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the part numbers of an order's lines, however many."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("ts"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("numbers"))
    return _six_line_row(six_lines.chart(six_lines.number_cast(items.withColumn("question", asked(F.col("id"))))))


def six_line_coin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six_lines.lines(six_lines.chart(six_lines.coin_cast(moments(spark, sf_dir)))).withColumn("changed_solid", shown_or_blank("changed_solid"))


def six_line_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected mode: palace, self and answer lines by the eight palaces' generations, and the mutual hexagram, of all 64."""
    charts = six_lines.chart(six_lines.coin_cast(moments(spark, sf_dir)), corrected=True)
    of = lambda c: [F.col(f"{c}.{x}").alias(f"{c}_{x}") for x in ("name", "palace", "self_line", "answer_line", "mutual")]
    return charts.select("id", *of("chart"), *(shown_or_blank(f"changed.{x}").alias(f"changed_{x}") for x in ("name", "palace", "self_line", "answer_line", "mutual")))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


#: DuckDB macros of the six-line queries: bits are counted from the bottom line, 1 to 32.
_BITS = {t: sum(1 << k for k, c in enumerate(x) if c == "1") for t, x in zip(V.TRIGRAMS, V.TRIGRAM_LINES, strict=True)}
_TRIGRAM = ", ".join(f"({b}, '{t}', '{e}', {_list(list(n[:3]))})" for (t, b), e, n in zip(_BITS.items(), V.TRIGRAM_ELEMENTS, V.LINE_BRANCHES, strict=True))
_HEXAGRAM = ", ".join(f"({_BITS[u] * 8 + _BITS[lo]}, '{n}')" for u, row in zip(V.TRIGRAMS, V.HEXAGRAMS, strict=True) for lo, n in zip(V.TRIGRAMS, row.split(), strict=True))
_SHIPPED_PALACE = ", ".join(f"('{n}', '{t}')" for t, row in zip(V.TRIGRAMS, V.PALACES, strict=True) for n in row.split())
_BRANCH = ", ".join(f"('{b}', '{e}')" for b, e in zip(V.BRANCHES, V.BRANCH_ELEMENTS, strict=True))
#: Who generates whom, and who controls whom, of the five elements.
_GENERATES = "('木','火'), ('火','土'), ('土','金'), ('金','水'), ('水','木')"
_CONTROLS = "('木','土'), ('土','水'), ('水','火'), ('火','金'), ('金','木')"
_TEXTS = ", ".join(f"('{h}', " + ", ".join("'" + x + "'" for x in t) + ")" for h, t in V.HEXAGRAM_TEXTS.items())
_COINS = """SELECT event_id AS id, ts, ['今年事业如何', '收入好吗', '考试能过吗', '孩子怎样', '朋友来吗', '婚姻顺利吗', '天气'][event_id % 7 + 1] AS question, p,
  list_sum([('0x' || md5('coin' || k || '|' || event_id || '|' || p)[1:8])::BIGINT % 2 for k in [0, 1, 2]])::INT AS heads FROM events, unnest([1, 2, 3, 4, 5, 6]) AS t(p)"""
_COIN_LINES = f"SELECT id, ts, question, p, heads >= 2 AS solid, heads IN (0, 3) AS moving FROM ({_COINS})"
_NUMBER_LINES = f"""SELECT id, ts, {_list(QUESTIONS)}[id % 7 + 1] AS question, p, (CASE WHEN p <= 3 THEN lo ELSE up END >> ((p - 1) % 3)) & 1 = 1 AS solid, list_contains(stir, p) AS moving FROM (
  SELECT id, ts, {_list([_BITS[t] for t in V.ORDER_SIX_LINE])}[CASE u % 8 WHEN 0 THEN 8 ELSE u % 8 END] AS up, {_list([_BITS[t] for t in V.ORDER_SIX_LINE])}[CASE l % 8 WHEN 0 THEN 8 ELSE l % 8 END] AS lo, [CASE x % 6 WHEN 0 THEN 6 ELSE x % 6 END for x in m] AS stir FROM (
    SELECT id, ts, CASE len(n) WHEN 1 THEN n[1] // 10 WHEN 2 THEN n[1] ELSE list_sum(n)::BIGINT // 2 END AS u, CASE len(n) WHEN 1 THEN n[1] WHEN 2 THEN n[2] ELSE list_sum(n)::BIGINT END AS l, CASE WHEN len(n) <= 2 THEN [list_sum(n)::BIGINT] ELSE n[1:3] END AS m FROM (
      SELECT l_orderkey AS id, max(l_shipdate) AS ts, list(l_partkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem GROUP BY l_orderkey))), unnest([1, 2, 3, 4, 5, 6]) AS t(p)"""


def _charted(lines: str) -> str:
    """CTEs over one row a line: line (with branch, kin, spirit), hexa (bits and changed bits of each cast)."""
    return f"""WITH cast_line AS ({lines}), trigram(bits, t, element, branches) AS (VALUES {_TRIGRAM}), hexagram(bits, name) AS (VALUES {_HEXAGRAM}), branch(b, element) AS (VALUES {_BRANCH}), shipped(name, palace) AS (VALUES {_SHIPPED_PALACE}),
generates(a, b) AS (VALUES {_GENERATES}), controls(a, b) AS (VALUES {_CONTROLS}), known(name, meaning, interpretation, career, wealth, marriage, health) AS (VALUES {_TEXTS}),
hexa AS (SELECT id, any_value(ts) AS ts, any_value(question) AS question, sum(CASE WHEN solid THEN 1 << (p - 1) ELSE 0 END)::INT AS bits, sum(CASE WHEN solid <> moving THEN 1 << (p - 1) ELSE 0 END)::INT AS now, count(*) FILTER (moving)::INT AS n_moving,
  (date_diff('day', DATE '1900-01-01', any_value(ts)::DATE))::INT AS days FROM cast_line GROUP BY id),
kin AS (SELECT x.element AS mine, y.element AS other, CASE WHEN x.element = y.element THEN '兄弟' WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = x.element AND g.b = y.element) THEN '子孙' WHEN EXISTS (SELECT 1 FROM controls g WHERE g.a = x.element AND g.b = y.element) THEN '妻财'
  WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = y.element AND g.b = x.element) THEN '父母' ELSE '官鬼' END AS kin FROM (SELECT DISTINCT element FROM branch) x, (SELECT DISTINCT element FROM branch) y),
line AS (SELECT l.id, l.p, l.solid, l.moving, t.branches[(l.p - 1) % 3 + 1] AS branch, b.element, k.kin, ['青龙', '朱雀', '勾陈', '腾蛇', '白虎', '玄武'][(l.p - 1 + [0, 0, 1, 1, 2, 3, 4, 4, 5, 5][(h.days + 9) % 10 + 1]) % 6 + 1] AS spirit, h.n_moving
  FROM cast_line l JOIN hexa h ON l.id = h.id JOIN trigram t ON t.bits = CASE WHEN l.p <= 3 THEN h.bits % 8 ELSE h.bits // 8 END JOIN branch b ON b.b = t.branches[(l.p - 1) % 3 + 1] JOIN kin k ON k.mine = t.element AND k.other = b.element)"""


_ONE_LINE = "p || ' ' || CASE WHEN {0} THEN '阳' ELSE '阴' END || ' ' || {1} || ' ' || branch || ' ' || kin || ' ' || spirit"


def _six_line_sql(lines: str) -> str:
    plain, turned = _ONE_LINE.format("solid", "CASE WHEN moving THEN '动' ELSE '静' END"), _ONE_LINE.format("solid <> moving", "'静'")
    return f"""{_charted(lines)},
shown AS (SELECT id, string_agg({plain}, '；' ORDER BY p) AS lines, string_agg({turned}, '；' ORDER BY p) AS turned, min(struct_pack(p := p, kin := kin, solid := solid)) FILTER (moving) AS lone, any_value(struct_pack(branch := branch, kin := kin, element := element, moving := moving)) FILTER (p = 6) AS me, any_value(struct_pack(branch := branch, kin := kin, element := element)) FILTER (p = 3) AS you FROM line GROUP BY id),
wanted AS (SELECT id, CASE WHEN regexp_matches(question, '工作|事业|官|职') THEN '官鬼' WHEN regexp_matches(question, '财|钱|收入|投资') THEN '妻财' WHEN regexp_matches(question, '考试|学习|文书|合同') THEN '父母' WHEN regexp_matches(question, '子女|孩子|下属|晚辈') THEN '子孙' WHEN regexp_matches(question, '朋友|兄弟|姐妹|同事') THEN '兄弟' WHEN regexp_matches(question, '婚姻|恋爱|感情|配偶') THEN '妻财' ELSE '世爻' END AS kin FROM hexa),
over AS (SELECT id, {_list(V.BRANCHES)}[month(ts)] AS month, {_list(V.BRANCHES)}[(days + 1) % 12 + 1] AS day FROM hexa),
hit AS (SELECT l.id, count(*) AS n, min(struct_pack(p := l.p, branch := l.branch, element := l.element, moving := l.moving)) AS x FROM line l JOIN wanted w ON l.id = w.id AND l.kin = w.kin GROUP BY l.id),
worth AS (SELECT hit.id, CASE WHEN m.element = x.element THEN 2 WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = m.element AND g.b = x.element) THEN 1 WHEN EXISTS (SELECT 1 FROM controls g WHERE g.a = m.element AND g.b = x.element) THEN -2 ELSE 0 END
  + CASE WHEN d.element = x.element THEN 1 WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = d.element AND g.b = x.element) THEN 1 WHEN EXISTS (SELECT 1 FROM controls g WHERE g.a = d.element AND g.b = x.element) THEN -1 ELSE 0 END AS score FROM hit JOIN over ON hit.id = over.id JOIN branch m ON m.b = over.month JOIN branch d ON d.b = over.day),
state AS (SELECT w.id, w.kin, coalesce(hit.n, 0) AS n, x, CASE WHEN w.kin = '世爻' THEN '世爻' WHEN hit.n IS NULL THEN '不现' WHEN hit.n > 1 THEN '重现' WHEN score >= 2 THEN '旺相' WHEN score >= 0 THEN '中和' ELSE '休囚' END AS state FROM wanted w LEFT JOIN hit ON w.id = hit.id LEFT JOIN worth ON w.id = worth.id),
said AS (SELECT s.id, CASE WHEN s.kin = '世爻' THEN '以世爻为用神。世爻' || me.branch || '，' || CASE WHEN me.moving THEN '动' ELSE '静' END || '，在6爻位。' WHEN n = 0 THEN '用神' || s.kin || '不现，需看伏神或以他爻代替。' WHEN n > 1 THEN '用神' || s.kin || '重现，需要仔细分析各爻情况。' ELSE '用神' || s.kin || '在' || x.p || '爻，' || x.branch || '，' || state || '。' || CASE WHEN x.moving THEN '发动有变' ELSE '安静不动' END || '。' END AS on_kin,
  '世爻6位，' || me.kin || me.branch || '，应爻3位，' || you.kin || you.branch || '。' || CASE k.kin WHEN '兄弟' THEN '世应同气，关系和谐' WHEN '子孙' THEN '世生应，我方有利于对方' WHEN '父母' THEN '应生世，对方有利于我' WHEN '妻财' THEN '世克应，我方占上风' ELSE '应克世，对方占上风' END || '。' AS on_self
  FROM state s JOIN shown v ON s.id = v.id JOIN kin k ON k.mine = me.element AND k.other = you.element),
moves AS (SELECT h.id, CASE h.n_moving WHEN 0 THEN '无动爻，以本卦静断' WHEN 1 THEN '独发一爻，以此爻断。' || lone.p || '爻' || lone.kin || '动，' || CASE WHEN lone.solid THEN '阳' ELSE '阴' END || '爻发动，主变化。' WHEN 2 THEN '二爻齐动，以上爻为主。两爻相互作用，需观察生克关系。' WHEN 3 THEN '三爻皆动，以中爻为主。变化较大，事态复杂。' ELSE '多爻齐动，以静爻为主。变化极大，需要谨慎。' END AS t FROM hexa h JOIN shown v ON h.id = v.id)
SELECT h.id, a.name, shipped.palace, v.lines, CASE WHEN h.n_moving > 0 THEN c.name END AS changed_name, CASE WHEN h.n_moving > 0 THEN v.turned END AS changed_lines, h.n_moving, {_list(V.STEMS)}[(year(h.ts) - 4) % 10 + 1] || {_list(V.BRANCHES)}[(year(h.ts) - 4) % 12 + 1] AS year_name, o.month, o.day, s.kin AS significator, s.state,
  coalesce(known.meaning, '待查') AS meaning, coalesce(known.career, '事业运势需要结合具体情况分析') AS career, coalesce(known.health, '健康状况需要观察疾病用神') AS health,
  '根据' || a.name || '卦象分析：' || chr(10) || coalesce(known.interpretation, '此卦需要详细分析') || chr(10) || CASE WHEN h.n_moving > 0 THEN chr(10) || '变卦为' || c.name || '，显示事态的发展趋势。' || chr(10) || m.t ELSE '' END || chr(10) || on_self || chr(10) || on_kin AS conclusion,
  concat_ws('；', CASE WHEN known.interpretation LIKE '%吉%' THEN '卦象吉利，可以大胆行动' WHEN known.interpretation LIKE '%困%' THEN '目前遇到困难，需要耐心等待' END, CASE h.n_moving WHEN 0 THEN '无动爻，事态稳定，维持现状即可' WHEN 1 THEN '一爻独动，变化明确，可以采取行动' ELSE '多爻齐动，情况复杂，需要谨慎考虑' END, CASE s.state WHEN '旺相' THEN '用神旺相，所求之事有利' WHEN '休囚' THEN '用神休囚，需要等待时机或寻求帮助' END, '保持积极心态，顺应自然规律', '多做善事，广结善缘') AS suggestions
FROM hexa h JOIN hexagram a ON a.bits = h.bits JOIN hexagram c ON c.bits = h.now JOIN shipped ON shipped.name = a.name JOIN shown v ON v.id = h.id JOIN over o ON o.id = h.id JOIN state s ON s.id = h.id JOIN said ON said.id = h.id JOIN moves m ON m.id = h.id LEFT JOIN known ON known.name = a.name"""


SIX_LINE_COIN_LINES = f"""{_charted(_COIN_LINES)}
SELECT id, p AS position, solid, moving, branch, kin, spirit, CASE p WHEN 6 THEN '世' WHEN 3 THEN '应' ELSE '' END AS role, CASE WHEN n_moving = 0 THEN '' WHEN solid <> moving THEN 'true' ELSE 'false' END AS changed_solid FROM line"""

#: The eight palaces, made by turning lines of the doubled trigram, generation by generation.
SIX_LINE_GENERATIONS = f"""{_charted(_COIN_LINES)},
palace AS (SELECT xor(t.bits * 9, g.turned)::INT AS bits, t.t AS palace, g.self_line, CASE WHEN g.self_line > 3 THEN g.self_line - 3 ELSE g.self_line + 3 END AS answer_line FROM trigram t, (VALUES (0, 6), (1, 1), (3, 2), (7, 3), (15, 4), (31, 5), (23, 4), (16, 3)) AS g(turned, self_line)),
full_of AS (SELECT h.bits, h.name, p.palace, p.self_line, p.answer_line, m.name AS mutual FROM hexagram h JOIN palace p ON p.bits = h.bits JOIN hexagram m ON m.bits = ((h.bits >> 2) & 7) * 8 + ((h.bits >> 1) & 7))
SELECT h.id, a.name AS chart_name, a.palace AS chart_palace, a.self_line AS chart_self_line, a.answer_line AS chart_answer_line, a.mutual AS chart_mutual, coalesce(c.name, '') AS changed_name, coalesce(c.palace, '') AS changed_palace, coalesce(c.self_line::VARCHAR, '') AS changed_self_line, coalesce(c.answer_line::VARCHAR, '') AS changed_answer_line, coalesce(c.mutual, '') AS changed_mutual
FROM hexa h JOIN full_of a ON a.bits = h.bits LEFT JOIN full_of c ON c.bits = h.now AND h.n_moving > 0"""

# -- nested records --------------------------------------------------------------------------------------------------
def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.when(F.col("user_id") % 2 == 0, "男").otherwise("女").alias("gender"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


def _texts(array: str, *fields: str, sep: str = " ") -> Column:
    """An array of structs as text: fields parted by blanks, entries by semicolons."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(sep, *(x[f].cast("string") for f in fields))), "；")


def four_pillar_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.four_pillar_record(births(spark, sf_dir), 2024)
    return r.select("id", "gender", _texts("pillars", "stem", "branch", "stem_element", "branch_element", "polarity", "god", sep="").alias("pillars"), F.array_join(F.transform("pillars", lambda p: F.array_join(p["hidden"], "")), " ").alias("hidden"), _texts("luck", "name", "from_age", "to_year").alias("luck"),
        F.col("year.name").alias("year_name"), F.col("year.age").alias("age"), shown_or_blank("year.decade").alias("decade"), "elements.wood", "elements.fire", "elements.earth", "elements.metal", "elements.water", "analysis.scarcest", "analysis.favourable", "analysis.unfavourable", "analysis.personality", "analysis.health")


def four_pillar_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational form of the record's decades."""
    return records.exploded(records.four_pillar_record(births(spark, sf_dir), 2024), "luck")


def nine_palace_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.nine_palace_record(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")))
    return r.select("id", *(F.col(f"parameters.{c}").alias(c) for c in ("upper", "middle", "lower", "number")), _texts("cells", "palace", "star", "door", "deity", "stem", "flags").alias("cells"), *(F.col(f"pattern.{c}").alias(f"pattern_{c}") for c in ("name", "level")), *(F.col(f"aspects.{c}").alias(c) for c in ("career", "wealth", "love", "health", "study")), "direction")


def twelve_branch_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.twelve_branch_record(moments(spark, sf_dir))
    return r.select("id", "day_name", "hour_name", F.array_join("lessons", " ").alias("lessons"), _texts("transmissions", "above", "below", sep="").alias("transmissions"), _texts("plate", "earth", "heaven", "general", sep="").alias("plate"), F.col("type.name").alias("type_name"), F.col("type.level").alias("level"), "helper", "obstacle", F.col("analysis.on_course").alias("on_course"))


def purple_star_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.purple_star_record(births(spark, sf_dir))
    star = lambda x: F.concat(x["star"], F.when(x["main"], "*").otherwise(""), F.coalesce(x["change"], F.lit("")))
    house = lambda h: F.concat_ws(" ", h["house"], F.concat(h["stem"], h["branch"]), h["position"].cast("string"), F.array_join(F.array_sort(F.transform(h["stars"], star)), ","))
    return r.select("id", "bureau", "life_master", "body_master", F.array_join(F.transform("houses", house), "；").alias("houses"), "score")


def almanac_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.almanac_record(dates(spark, sf_dir))
    return r.select(F.date_format("d", "yyyy-MM-dd").alias("day"), *(F.array_join(c, " ").alias(c) for c in ("suitable", "taboo", "good", "bad")), F.col("level.value").alias("level"), F.col("level.text").alias("level_text"), "calendar.animal", "calendar.day_almanac", "calendar.officer", "calendar.mansion", "calendar.lunar_date", "fortune.lucky_number", "fortune.love", _texts("advice", "activity", "advice").alias("advice"))


_S, _B = _list(V.STEMS), _list(V.BRANCHES)
#: Pillars as places 0 to 59 of the cycle of sixty: the year from February 4, the twelfth month, days from 1900 (a 甲戌 day), hours from the day's stem.
_PILLARS = f"""births AS (SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN '男' ELSE '女' END AS gender, year(ts) - CASE WHEN month(ts) = 1 OR (month(ts) = 2 AND day(ts) < 4) THEN 1 ELSE 0 END AS y, date_diff('day', DATE '1900-01-01', ts::DATE) AS days, ((hour(ts) + 1) // 2) % 12 AS hb FROM events),
sixty(n, stem, branch) AS (SELECT n, {_S}[n % 10 + 1], {_B}[n % 12 + 1] FROM range(60) AS r(n)),
stem(s, element, polarity) AS (SELECT {_S}[k], {_list(list("木木火火土土金金水水"))}[k], {_list(list("阳阴阳阴阳阴阳阴阳阴"))}[k] FROM range(1, 11) AS r(k)),
branch(b, element, hidden) AS (VALUES {", ".join(f"('{b}', '{e}', '{h}')" for b, e, h in zip(V.BRANCHES, V.BRANCH_ELEMENTS, V.HIDDEN_STEMS, strict=True))}),
generates(a, b) AS (VALUES {_GENERATES}), controls(a, b) AS (VALUES {_CONTROLS}),
placed AS (SELECT id, gender, ts, 1 AS k, sixty.stem, sixty.branch FROM births JOIN sixty ON sixty.n = (y - 4) % 60 UNION ALL
  SELECT id, gender, ts, 2, {_S}[((y - 4) % 10 * 2 + 13) % 10 + 1], '丑' FROM births UNION ALL
  SELECT id, gender, ts, 3, sixty.stem, sixty.branch FROM births JOIN sixty ON sixty.n = (days + 10) % 60 UNION ALL
  SELECT id, gender, ts, 4, {_S}[((days + 10) % 10 * 2 + hb) % 10 + 1], {_B}[hb + 1] FROM births),
decades AS (SELECT p.id, p.ts, i, s2.stem || s2.branch AS name, CASE p.gender WHEN '男' THEN 8 ELSE 7 END + 10 * i AS age FROM placed p JOIN sixty s ON s.stem = p.stem AND s.branch = p.branch AND p.k = 2 JOIN stem t ON t.s = p.stem, unnest(range(8)) AS r(i) JOIN sixty s2 ON s2.n = (s.n + CASE WHEN (p.gender = '男') = (t.polarity = '阳') THEN i + 1 ELSE 59 - i END) % 60)"""

FOUR_PILLAR_DECADES = f"WITH {_PILLARS} SELECT id, i::INT AS i, name, age::INT AS from_age, (age + 9)::INT AS to_age, (year(ts) + age)::INT AS from_year, (year(ts) + age + 9)::INT AS to_year FROM decades"

FOUR_PILLAR_RECORD = f"""WITH {_PILLARS},
me AS (SELECT p.id, p.stem, s.element FROM placed p JOIN stem s ON s.s = p.stem WHERE k = 3),
told AS (SELECT p.id, p.k, p.stem || p.branch || s.element || b.element || s.polarity || CASE WHEN s.element = me.element THEN '比肩' WHEN EXISTS (SELECT 1 FROM generates g WHERE g.a = me.element AND g.b = s.element) THEN '食神' WHEN EXISTS (SELECT 1 FROM controls g WHERE g.a = me.element AND g.b = s.element) THEN '正财' WHEN EXISTS (SELECT 1 FROM controls g WHERE g.a = s.element AND g.b = me.element) THEN '正官' ELSE '正印' END AS t, b.hidden FROM placed p JOIN stem s ON s.s = p.stem JOIN branch b ON b.b = p.branch JOIN me ON me.id = p.id),
part AS (SELECT p.id, s.element FROM placed p JOIN stem s ON s.s = p.stem UNION ALL SELECT p.id, b.element FROM placed p JOIN branch b ON b.b = p.branch UNION ALL SELECT p.id, s.element FROM placed p JOIN branch b ON b.b = p.branch JOIN stem s ON contains(b.hidden, s.s)),
n AS (SELECT id, count(*) FILTER (element = '木')::INT AS wood, count(*) FILTER (element = '火')::INT AS fire, count(*) FILTER (element = '土')::INT AS earth, count(*) FILTER (element = '金')::INT AS metal, count(*) FILTER (element = '水')::INT AS water FROM part GROUP BY id),
few AS (SELECT *, CASE least(wood, fire, earth, metal, water) WHEN wood THEN '木' WHEN fire THEN '火' WHEN earth THEN '土' WHEN metal THEN '金' ELSE '水' END AS scarcest, '五行分布：木(' || wood || ') 火(' || fire || ') 土(' || earth || ') 金(' || metal || ') 水(' || water || ') ' AS shown,
  concat_ws('；', CASE WHEN wood = 0 THEN {{0}} END, CASE WHEN fire = 0 THEN {{1}} END, CASE WHEN earth = 0 THEN {{2}} END, CASE WHEN metal = 0 THEN {{3}} END, CASE WHEN water = 0 THEN {{4}} END) AS lacks FROM n)
SELECT b.id, b.gender, t.pillars, t.hidden, d.luck, '甲辰' AS year_name, (2024 - year(b.ts))::INT AS age, coalesce(d.decade::VARCHAR, '') AS decade, few.wood, few.fire, few.earth, few.metal, few.water, few.scarcest, (SELECT a FROM generates g WHERE g.b = few.scarcest) AS favourable, (SELECT a FROM controls g WHERE g.b = few.scarcest) AS unfavourable,
  '日主' || me.stem || me.element || '，' || CASE me.element WHEN '木' THEN {{5}} WHEN '火' THEN {{6}} WHEN '土' THEN {{7}} WHEN '金' THEN {{8}} ELSE {{9}} END AS personality, shown || chr(10) || CASE WHEN lacks = '' THEN {{10}} ELSE '健康提醒：' || lacks || '。' END || {{11}} AS health
FROM births b JOIN me ON me.id = b.id JOIN few ON few.id = b.id JOIN (SELECT id, string_agg(t, '；' ORDER BY k) AS pillars, string_agg(hidden, ' ' ORDER BY k) AS hidden FROM told GROUP BY id) t ON t.id = b.id
JOIN (SELECT id, string_agg(name || ' ' || age || ' ' || (year(ts) + age + 9), '；' ORDER BY i) AS luck, (min(i) FILTER (2024 BETWEEN year(ts) + age AND year(ts) + age + 9))::INT AS decade FROM decades GROUP BY id) d ON d.id = b.id""".format(*("'" + x + "'" for x in (*V.LACKS, *V.PERSONALITY, *V.HEALTH_TEXTS)))

_NINE = f"""m AS (SELECT o_orderkey AS id, o_orderdate AS ts, (year(o_orderdate) % 60 + month(o_orderdate)) % 9 + 1 AS upper, (month(o_orderdate) + day(o_orderdate)) % 9 + 1 AS middle, (day(o_orderdate) + hour(o_orderdate)) % 9 + 1 AS lower, (year(o_orderdate) % 60 * 365 + month(o_orderdate) * 30 + day(o_orderdate) * 24 + hour(o_orderdate)) % 1080 AS number FROM orders),
cell AS (SELECT id, i, {_list(V.PALACE_NAMES)}[i] AS palace, {_list(V.STARS)}[(number + i - 1) % 9 + 1] AS star, {_list([*V.DOORS[:4], V.DOORS[7], *V.DOORS[5:8]])}[(upper + i - 1) % 8 + 1] AS door, {_list(V.DEITIES)}[(middle + i - 1) % 8 + 1] AS deity, {_S}[(lower + i - 1) % 10 + 1] AS stem,
  concat_ws(' ', CASE WHEN i = 1 THEN '值符' END, CASE WHEN i = upper THEN '用神' END, CASE WHEN (number + i - 1) % 9 + 1 IN (1, 3, 7, 9) THEN '凶星' END) AS flags FROM m, unnest(range(1, 10)) AS r(i))"""
_ASPECTS = {
    "career": ("star[6] IN ('天心星', '天辅星')", "star[6] IN ('天冲星', '天柱星')"), "wealth": ("star[2] = '天任星' OR door[8] = '生门'", "star[2] = '天蓬星' OR door[8] = '死门'"), "love": ("deity[4] = '六合' OR door[7] = '开门'", "star[4] = '天冲星' OR door[7] = '伤门'"),
    "health": ("star[3] = '天心星' OR door[6] = '生门'", "star[3] = '天英星' OR door[6] = '伤门'"), "study": ("star[4] = '天辅星' OR door[9] = '景门'", "star[4] = '天冲星' OR door[9] = '杜门'"),
}
NINE_PALACE_RECORD = f"""WITH {_NINE},
w AS (SELECT id, list(star ORDER BY i) AS star, list(door ORDER BY i) AS door, list(deity ORDER BY i) AS deity, string_agg(concat_ws(' ', palace, star, door, deity, stem, flags), '；' ORDER BY i) AS cells, min(i) FILTER (door IN ('开门', '生门')) AS by_door, min(i) FILTER (star IN ('天心星', '天任星', '天辅星')) AS by_star FROM cell GROUP BY id),
p AS (SELECT *, CASE WHEN star[1] = '天蓬星' AND star[9] = '天英星' THEN '水火激战' WHEN deity[5] = '值符' THEN '值符居中' WHEN door[1] = '开门' OR door[6] = '开门' THEN '开门得地' ELSE {_list(V.PATTERNS)}[('0x' || md5('pattern|' || id)[1:8])::BIGINT % 6 + 1] END AS pattern_name FROM w)
SELECT p.id, m.upper::INT AS upper, m.middle::INT AS middle, m.lower::INT AS lower, m.number::INT AS number, cells, pattern_name, CASE pattern_name {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(V.PATTERNS, V.PATTERN_LEVELS, strict=True))} ELSE '' END AS pattern_level,
  {", ".join(f"CASE WHEN {good} THEN '{V.ASPECT_TEXTS[n][0]}' WHEN {bad} THEN '{V.ASPECT_TEXTS[n][1]}' ELSE '{V.ASPECT_TEXTS[n][2]}' END AS {n}" for n, (good, bad) in _ASPECTS.items())}, coalesce({_list(V.PALACE_DIRECTIONS)}[coalesce(by_door, by_star)], '东南') AS direction FROM p JOIN m ON m.id = p.id"""

TWELVE_BRANCH_RECORD = f"""WITH m AS (SELECT event_id AS id, hour(ts) AS h, date_diff('day', DATE '1900-01-01', ts::DATE) % 60 AS n, ((hour(ts) + 1) // 2) % 12 AS hb FROM events),
x AS (SELECT *, n % 10 AS s, n % 12 AS b FROM m),
plate AS (SELECT id, i, {_B}[i] AS earth, {_B}[(s + i - 1) % 12 + 1] AS heaven, {_list(V.GENERALS)}[((s + h // 2) % 12 + i) % 12 + 1] AS general FROM x, unnest(range(1, 13)) AS r(i)),
p AS (SELECT id, string_agg(earth || heaven || general, '；' ORDER BY i) AS plate, list(heaven ORDER BY i) AS heaven, list(earth ORDER BY i) AS earth FROM plate GROUP BY id),
t AS (SELECT x.*, p.plate, heaven[b + 1] AS over_day, heaven[hb + 1] AS over_hour, [heaven[(b + k) % 12 + 1] for k in [0, 1, 2]] AS above, [earth[(b + k) % 12 + 1] for k in [0, 1, 2]] AS below, CASE WHEN s = 0 THEN ('0x' || md5('lesson|' || x.id)[1:8])::BIGINT % 6 ELSE 1 END AS kind FROM x JOIN p ON p.id = x.id),
e(b, element) AS (VALUES {_BRANCH}), generates(a, b) AS (VALUES {_GENERATES}), controls(a, b) AS (VALUES {_CONTROLS})
SELECT id, {_S}[s + 1] || {_B}[t.b + 1] AS day_name, {_S}[(s * 2 + hb) % 10 + 1] || {_B}[hb + 1] AS hour_name, concat_ws(' ', over_day || '/' || {_B}[t.b + 1], over_hour || '/' || {_B}[hb + 1], over_day || '克' || {_B}[t.b + 1], over_hour || '克' || {_B}[hb + 1]) AS lessons,
  concat_ws('；', above[1] || below[1], above[2] || below[2], above[3] || below[3]) AS transmissions, plate, {_list(V.LESSON_TYPES)}[kind + 1] AS type_name, {_list(V.LESSON_LEVELS)}[kind + 1] AS level, (SELECT a FROM generates g WHERE g.b = e.element) AS helper, (SELECT a FROM controls g WHERE g.b = e.element) AS obstacle,
  '初传' || above[1] || '，中传' || above[2] || '，末传' || above[3] || '，显示事情发展过程。' AS on_course FROM t JOIN e ON e.b = over_day"""

#: The first star's place by bureau, days 1 to 30, as the tables list it.
_FIRST_STAR = [[(d // 2) % 12 + 1 if n == 2 else ((d - 1) // (n - 1) + n - 2 - (d - 1) % (n - 1)) % 12 + 1 for d in range(1, 31)] for n in range(2, 7)]
_CHANGED = ", ".join(f"('{V.STEMS[g]}', '{s}', '{c}')" for g, row in enumerate(V.CHANGED_STARS) for s, c in zip(row.split(), V.CHANGES, strict=True))
PURPLE_STAR_RECORD = f"""WITH b AS (SELECT event_id AS id, month(ts) AS m, day(ts) AS d, (year(ts) + month(ts) + day(ts)) % 5 AS bureau, (year(ts) - 4) % 10 AS ys, (year(ts) - 4) % 12 AS yb, CASE WHEN ((hour(ts) + 1) // 2) % 12 = 0 THEN 12 ELSE ((hour(ts) + 1) // 2) % 12 END AS h FROM events),
l AS (SELECT *, (26 - m - 1) % 12 + 1 AS month_house FROM b),
z AS (SELECT *, (month_house + h - 2) % 12 + 1 AS life, [{", ".join(_list(r) for r in _FIRST_STAR)}][bureau + 1][least(d, 30)] AS z FROM l),
s AS (SELECT *, (z + 5) % 12 + 1 AS t FROM z),
star AS (SELECT id, name, main, place FROM (SELECT id, unnest([{", ".join(f"{{name: '{n}', main: true, place: (z + {o} + 23) % 12 + 1}}" for n, o in V.PURPLE_GROUP.items())}, {", ".join(f"{{name: '{n}', main: true, place: (t + {o} + 11) % 12 + 1}}" for n, o in V.TREASURY_GROUP.items())},
  {{name: '文昌', main: false, place: (m + 3) % 12 + 1}}, {{name: '文曲', main: false, place: (15 - m) % 12 + 1}}, {{name: '左辅', main: false, place: (m + 1) % 12 + 1}}, {{name: '右弼', main: false, place: (13 - m) % 12 + 1}}, {{name: '天魁', main: false, place: {_list([a for a, _ in V.NOBLE_PLACES])}[ys + 1]}}, {{name: '天钺', main: false, place: {_list([a for _, a in V.NOBLE_PLACES])}[ys + 1]}}], recursive := true) FROM s)),
house AS (SELECT id, i, {_list(V.HOUSES)}[i + 1] AS house, (life + i - 1) % 12 + 1 AS position, {_S}[(ys * 2 + life - 1 + i) % 10 + 1] || {_B}[(life + i + 1) % 12 + 1] AS name, ys FROM s, unnest(range(12)) AS r(i)),
changed(stem, star, change) AS (VALUES {_CHANGED}),
full_of AS (SELECT h.id, h.i, h.house || ' ' || h.name || ' ' || h.position || ' ' || coalesce(string_agg(x.name || CASE WHEN x.main THEN '*' ELSE '' END || coalesce(c.change, ''), ',' ORDER BY encode(x.name || CASE WHEN x.main THEN '*' ELSE '' END || coalesce(c.change, ''))), '') AS t, count(x.name) FILTER (x.main) AS n_main, count(x.name) FILTER (NOT x.main) AS n_lucky FROM house h LEFT JOIN star x ON x.id = h.id AND x.place = h.position LEFT JOIN changed c ON c.star = x.name AND c.stem = {_S}[h.ys + 1] GROUP BY h.id, h.i, h.house, h.name, h.position)
SELECT s.id, {_list(V.BUREAUS)}[bureau + 1] AS bureau, {_list(V.LIFE_MASTERS)}[yb + 1] AS life_master, {_list(V.BODY_MASTERS)}[yb + 1] AS body_master, f.houses, f.score FROM s JOIN (SELECT id, string_agg(t, '；' ORDER BY i) AS houses, (sum(CASE WHEN i IN (0, 4, 8) THEN 2 * n_main ELSE 0 END) + max(CASE WHEN i = 0 AND n_lucky > 0 THEN 3 ELSE 0 END))::INT AS score FROM full_of GROUP BY id) f ON f.id = s.id"""


def _draw(name: str, pool: list[str], n: str, forced: str, twice: bool) -> str:
    """One list of each date by a window over date and pool."""
    key = "day || x || (k - 1)::VARCHAR" if twice else "day || x"
    return f"""{name} AS (SELECT day, string_agg(x, ' ' ORDER BY r) AS items, count(*) AS n, list(x) AS l FROM (SELECT day, x, row_number() OVER (PARTITION BY day ORDER BY {forced}, ('0x' || md5('{name}|' || {key})[1:8])::BIGINT, encode(x), k) AS r, ('0x' || md5('{name}|' || day)[1:8])::BIGINT % {n.split()[0]} + {n.split()[1]} AS most FROM dates, (SELECT unnest({_list(pool)}) AS x, generate_subscripts({_list(pool)}, 1) AS k)) WHERE r <= most GROUP BY day)"""


_ALMANAC = f"""WITH dates AS (SELECT DISTINCT o_orderdate::DATE AS d, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
{_draw("suitable", list(dict.fromkeys(V.SUITABLE)), "4 4", "CASE WHEN x = '嫁娶' AND isodow(d) >= 6 THEN 0 WHEN x = '出行' AND isodow(d) >= 6 THEN 1 WHEN x = '开市' AND day(d) <= 8 THEN 2 WHEN x = '入宅' AND day(d) <= 8 THEN 3 ELSE 99 END", False)},
{_draw("taboo", list(dict.fromkeys(V.TABOO)), "3 3", "CASE WHEN x = '嫁娶' AND day(d) = 13 THEN 0 WHEN x = '安葬' AND isodow(d) = 5 THEN 1 ELSE 99 END", False)},
{_draw("good", V.GOOD_SPIRITS, "3 2", "0", True)},
{_draw("bad", V.BAD_SPIRITS, "3 2", "0", True)},
listed AS (SELECT d, dates.day, s.items AS suitable, t.items AS taboo, g.items AS good, b.items AS bad, s.l AS fit, t.l AS unfit, 2 * s.n - t.n + g.n - b.n AS points FROM dates JOIN suitable s ON s.day = dates.day JOIN taboo t ON t.day = dates.day JOIN good g ON g.day = dates.day JOIN bad b ON b.day = dates.day),
told AS (SELECT *, (1 + (points >= 0)::INT + (points >= 5)::INT + (points >= 10)::INT + (points >= 15)::INT)::INT AS level FROM listed),
lucky AS (SELECT *, {_list(V.LUCK_LEVELS)}[level] AS level_text, (('0x' || md5('number|' || day)[1:8])::BIGINT % 99 + 1)::INT AS lucky_number, {", ".join(f"{_list(x)}[('0x' || md5('{n}|' || day)[1:8])::BIGINT % 4 + 1] AS {n}" for n, x in (("love", V.LOVE_ADVICE), ("career", V.CAREER_ADVICE), ("wealth", V.WEALTH_ADVICE), ("health", V.HEALTH_ADVICE)))},
  date_diff('day', DATE '1984-02-02', d) % 60 AS n60, date_diff('day', DATE '2024-01-01', d) AS n28, year(d) - 4 AS y FROM told),
advice AS (SELECT day, k, a AS activity, CASE WHEN fits AND NOT unfits THEN '非常适宜' WHEN fits THEN '谨慎进行' WHEN unfits THEN '不宜进行' ELSE '普通日子' END AS advice FROM (SELECT day, k, a, len(list_filter(fit, lambda x: contains(x, a))) > 0 AS fits, len(list_filter(unfit, lambda x: contains(x, a))) > 0 AS unfits FROM lucky, (SELECT unnest({_list(V.ACTIVITIES)}) AS a, generate_subscripts({_list(V.ACTIVITIES)}, 1) AS k)))"""
_DAY = f"""'农历' || {_list(V.LUNAR_MONTHS)}[CASE WHEN month(d) <= 2 THEN month(d) + 10 ELSE month(d) - 2 END] || {_list(V.LUNAR_DAYS)}[least(day(d), 30)] AS lunar_date, {_S}[n60 % 10 + 1] || {_B}[n60 % 12 + 1] AS day_almanac, {_list(V.ANIMALS)}[y % 12 + 1] AS animal, {_list(V.OFFICERS)}[(day(d) - 1) % 12 + 1] AS officer, {_list(V.MANSIONS)}[(n28 % 28 + 28) % 28 + 1] AS mansion"""
ALMANAC_LISTS = f"{_ALMANAC} SELECT day, suitable, taboo, good, bad, level, level_text, lucky_number, love, career, wealth, health FROM lucky"
ACTIVITY_ADVICE = f"{_ALMANAC} SELECT day, activity, advice FROM advice"
ALMANAC_RECORD = f"{_ALMANAC} SELECT lucky.day, suitable, taboo, good, bad, level, level_text, {_DAY}, lucky_number, love, a.advice FROM lucky JOIN (SELECT day, string_agg(activity || ' ' || advice, '；' ORDER BY k) AS advice FROM advice GROUP BY day) a ON a.day = lucky.day"
ALMANAC_DAY = f"""{_ALMANAC} SELECT day, suitable, taboo, good, bad, level, level_text, lucky_number, love, career, wealth, health, {_DAY},
  {_list(V.SIGNS_OF_ZODIAC)}[(month(d) - CASE WHEN day(d) < {_list(V.SIGN_FIRST_DAYS)}[month(d)] THEN 1 ELSE 0 END + 11) % 12 + 1] AS sign, {_list(V.STEM_TABOOS)}[n60 % 10 + 1] || ' ' || {_list(V.BRANCH_TABOOS)}[n60 % 12 + 1] AS taboos, {_list(V.MELODIC)}[n60 // 2 + 1] AS melodic, {_list(V.WOMB_PLACES)}[(day(d) - 1) % 30 + 1] AS womb, {_list(V.COLOURS)}[day(d) % 7 + 1] AS colour, {_list(V.DIRECTIONS)}[isodow(d) % 8 + 1] AS direction,
  '冲' || {_list(V.ANIMALS)}[(n60 + 6) % 12 + 1] || '(' || {_S}[('0x' || md5('stem|' || {_S}[n60 % 10 + 1] || {_B}[n60 % 12 + 1])[1:8])::BIGINT % 10 + 1] || {_B}[(n60 + 6) % 12 + 1] || ')煞' || {_list(V.CLASH_DIRECTIONS)}[('0x' || md5('side|' || {_S}[n60 % 10 + 1] || {_B}[n60 % 12 + 1])[1:8])::BIGINT % 8 + 1] AS clash_text FROM lucky"""

#: A label by seconds between two moments, in words of the day.
AGE_LABELS = """SELECT id, CASE WHEN trunc(gone / 86400) = 0 THEN '今天' WHEN trunc(gone / 86400) = 1 THEN '昨天' ELSE month(ts) || '月' || day(ts) || '日' END || strftime(ts, ' %H:%M') AS label
FROM (SELECT event_id AS id, ts, floor(epoch(max(ts) OVER (PARTITION BY user_id))) - floor(epoch(ts)) AS gone FROM events)"""

# -- dreams ----------------------------------------------------------------------------------------------------------
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("txt"))


def dream_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dreams.entries(_documents(spark, sf_dir))


def dream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dreams.statistics(_documents(spark, sf_dir))


def dream_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dreams.readings(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("txt")))


#: Words that events are told in: some of the dictionary, some not.
_TOLD = ["龙", "大蛇", "红色", "的", "白色", "金色", "父母", "钱", "UFO", "飞翔", "大雨", "房子", "猫", "火", "  ", "鱼"]


def dream_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four words, named by an event's number, user and kind."""
    word = lambda n: F.get(F.array(*map(F.lit, _TOLD)), F.pmod(n, F.lit(len(_TOLD))).cast("int"))
    told = F.concat(word(F.col("event_id")), word(F.col("user_id")), F.when(F.col("event_id") % 3 == 0, word(F.floor(F.col("event_id") / 7))).otherwise(""), F.when(F.col("event_id") % 5 == 0, word(F.length("event_type") + F.col("user_id"))).otherwise(""))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), told.alias("txt"))


def dream_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dreams.readings(dream_texts(spark, sf_dir))


_ENTRIES = ", ".join(f"({k}, '{w}', '{kind}', {str(good).lower()}, {_list([w, *others.split()])}, '{advice}')" for k, ((w, kind, good, others), advice) in enumerate(zip(V.DREAMS, V.DREAM_SUGGESTIONS, strict=True)))
_KINDS = ", ".join(f"('{k}', '{t}')" for k, t in V.DREAM_TYPE_TEXTS.items())
_DREAM_DOCUMENTS = "SELECT row_number() OVER () AS r, doc_id AS id, text AS txt FROM documents"
_DREAM_TURNS = "SELECT row_number() OVER () AS r, conv_id * 1000 + turn AS id, text AS txt FROM conversations"
_DREAM_EVENTS = f"""SELECT event_id AS r, event_id AS id, w[event_id % 16 + 1] || w[user_id % 16 + 1] || CASE WHEN event_id % 3 = 0 THEN w[(event_id // 7) % 16 + 1] ELSE '' END || CASE WHEN event_id % 5 = 0 THEN w[(length(event_type) + user_id) % 16 + 1] ELSE '' END AS txt FROM events, (SELECT {_list(_TOLD)} AS w)"""


def _dreamt(told: str) -> str:
    return f"""WITH dictionary(ord, keyword, kind, good, words, advice) AS (VALUES {_ENTRIES}), kinds(kind, said) AS (VALUES {_KINDS}), told AS ({told}),
found AS (SELECT r, id, d.* FROM told JOIN dictionary d ON len(list_filter(d.words, lambda w: contains(lower(txt), lower(w)))) > 0)"""


def _reading_sql(told: str) -> str:
    day = lambda salt, n: f"('0x' || md5(concat_ws('|', '{salt}', t.id))[1:8])::BIGINT % {n}"
    tier = lambda values: f"CASE WHEN score >= 80 THEN '{values[3]}' WHEN score >= 60 THEN '{values[2]}' WHEN score >= 40 THEN '{values[1]}' ELSE '{values[0]}' END"
    # Lists without repeats keep the first place of each item.
    once = lambda items: f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
    return f"""{_dreamt(told)},
n AS (SELECT r, count(*)::INT AS n, (sum(CASE WHEN good THEN 70 ELSE 30 END) // count(*))::INT AS base, bool_or(good) AS lucky, list(keyword) AS words, list(advice ORDER BY ord) AS advice FROM found GROUP BY r),
groups AS (SELECT r, string_agg(said, '；' ORDER BY first) AS meaning FROM (SELECT r, coalesce(any_value(k.said), '{V.DREAM_OTHER_TEXT}') AS said, min(ord) AS first FROM found f LEFT JOIN kinds k ON k.kind = f.kind GROUP BY r, f.kind) GROUP BY r),
s AS (SELECT t.r, t.id, coalesce(n, 0) AS n, coalesce(base, 50) AS base, (CASE WHEN n.r IS NULL THEN {day("generic", 31)} + 40 ELSE least(greatest(base + {day("jitter", 21)} - 10, 0), 100) END)::INT AS score, lucky, words, advice, groups.meaning, {day("meaning", 5)} AS generic, ({day("number1", 49)} + 1)::INT AS one, ({day("number2", 49)} + 1)::INT AS two
  FROM told t LEFT JOIN n ON n.r = t.r LEFT JOIN groups ON groups.r = t.r WHERE length(regexp_replace(t.txt, '[\\t\\n\\x0b\\x0c\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]', '', 'g')) > 0),
w AS (SELECT *, list_concat(list_filter(['红色', '金色', '白色'], lambda c: list_contains(coalesce(words, []), c)), CASE WHEN lucky THEN ['红色', '金色', '绿色'] ELSE ['蓝色', '紫色', '白色'] END, ['黄色', '橙色', '粉色']) AS c, [n, 3, 6, 8, one, two] AS m, list_concat(coalesce(advice, [])[1:3], CASE WHEN score >= 70 THEN {_list(V.DREAM_TIER_SUGGESTIONS[2])} WHEN score >= 50 THEN {_list(V.DREAM_TIER_SUGGESTIONS[1])} ELSE {_list(V.DREAM_TIER_SUGGESTIONS[0])} END) AS a FROM s)
SELECT id, n, base AS base_score, score, CASE WHEN n > 0 THEN meaning || '。' || {tier(V.DREAM_SUMMARIES)} ELSE {_list(V.DREAM_GENERIC_TEXTS)}[generic + 1] END AS meaning, CASE WHEN n > 0 THEN {tier(V.DREAM_TIMES)} ELSE '{V.DREAM_TIMES[2]}' END AS time_frame, CASE WHEN n > 0 THEN array_to_string(({once("c")})[1:5], ' ') ELSE '蓝色 绿色 白色' END AS colours,
  CASE WHEN n > 0 THEN array_to_string(({once("m")})[1:6], ' ') ELSE '7 14 21 28' END AS numbers, CASE WHEN n > 0 THEN array_to_string(a[1:3], '；') || '。' ELSE '{V.DREAM_GENERIC_SUGGESTION}' END AS suggestion FROM w"""


DREAM_ELEMENTS = f"{_dreamt(_DREAM_DOCUMENTS)} SELECT id, ord::INT AS ord, keyword, kind, good FROM found"
DREAM_STATISTICS = f"{_dreamt(_DREAM_DOCUMENTS)} SELECT kind, count(*) AS n, count(*) FILTER (good) AS n_good FROM found GROUP BY kind"

# -- joins by time ---------------------------------------------------------------------------------------------------
def event_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase"), F.col("value").alias("paid"))
    return intervals.as_of(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "bought", ["purchase", "paid"], strict=True).select("event_id", "user_id", shown_or_blank(F.date_format("bought", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("bought"), shown_or_blank("purchase").alias("purchase"), shown_or_blank(F.col("paid").cast("decimal(18,4)")).alias("paid"))


def order_solar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the solar term that its date is in: the last one that has begun, of its year or of the year before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    years = orders.select(F.explode(F.array(F.year("o_orderdate"), F.year("o_orderdate") - 1)).alias("y")).distinct()
    terms = years.select(F.inline(F.array(*(F.struct(F.expr(f"CAST({cycles.term_date(SPARK, 'y', k)} AS TIMESTAMP_NTZ)").alias("begun"), F.lit(t).alias("term")) for k, t in enumerate(V.SOLAR_TERMS)))))
    return intervals.as_of(orders, terms, [], "o_orderdate", "begun", ["term"], seconds=400 * 86_400).select("o_orderkey", "term", F.date_format("begun", "yyyy-MM-dd").alias("begun"))


def orders_in_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the luck decade that its customer is in; births are made from the customers' keys."""
    customers = table(spark, sf_dir, "customer")
    born = customers.select(F.col("c_custkey").alias("id"), (F.lit("1955-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") * 37 % 14_000).cast("int"), (F.col("c_custkey") % 24).cast("int"))).alias("ts"), F.when(F.col("c_nationkey") % 2 == 0, "男").otherwise("女").alias("gender"))
    decades = records.exploded(records.four_pillar_record(born, 2024), "luck").select(F.col("id").alias("o_custkey"), "i", "name", "from_age", "from_year", (F.col("to_year") + 1).alias("until"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    met = intervals.in_intervals(orders, decades, ["o_custkey"], "year", "from_year", "until", width=10)
    return met.select("o_orderkey", "o_custkey", "year", F.col("i").alias("decade"), "name", (F.col("from_age") + F.col("year") - F.col("from_year")).alias("age"))


#: The term of each month's early and late date; January's belong to the list's end.
_TERMS = ", ".join(f"({(k // 2 + 1) % 12 + 1}, {d}, '{t}')" for k, (t, d) in enumerate(zip(V.SOLAR_TERMS, V.SOLAR_TERM_DAYS, strict=True)))
EVENT_LAST_PURCHASE = "WITH p AS (SELECT user_id, ts AS bought, event_id AS purchase, value AS paid FROM events WHERE event_type = 'purchase') SELECT e.event_id, e.user_id, coalesce(strftime(bought, '%Y-%m-%d %H:%M:%S.%f'), '') AS bought, coalesce(purchase::VARCHAR, '') AS purchase, coalesce(paid::DECIMAL(18, 4)::VARCHAR, '') AS paid FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.bought"
ORDER_SOLAR_TERMS = f"WITH t AS (SELECT make_timestamp(y, m, d, 0, 0, 0) AS begun, term FROM (VALUES {_TERMS}) AS x(m, d, term), range(1990, 2030) AS r(y)) SELECT o_orderkey, term, strftime(begun, '%Y-%m-%d') AS begun FROM orders ASOF JOIN t ON o_orderdate >= begun"
ORDERS_IN_DECADES = "WITH " + _PILLARS.replace("births AS (SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN '男' ELSE '女' END AS gender,", "births AS (SELECT id, ts, gender,").replace("AS hb FROM events)", "AS hb FROM (SELECT c_custkey AS id, TIMESTAMP '1955-01-01' + to_days((c_custkey * 37 % 14000)::INT) + to_hours(c_custkey % 24) AS ts, CASE WHEN c_nationkey % 2 = 0 THEN '男' ELSE '女' END AS gender FROM customer))") + " SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS year, i::INT AS decade, name, (year(o_orderdate) - year(ts))::INT AS age FROM orders JOIN decades ON o_custkey = id AND year(o_orderdate) BETWEEN year(ts) + age AND year(ts) + age + 9"


# -- details of mixed shape ------------------------------------------------------------------------------------------
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with details of four shapes: an object of one field, a list, a nested object, and text that isn't JSON."""
    s = lambda c: F.col(c).cast("string")
    kind = F.col("event_id") % 4
    shaped = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('["a", '), s("user_id"), F.lit("]"))).when(kind == 2, F.concat(F.lit('{"user": '), s("user_id"), F.lit(', "at": {"type": "'), F.col("event_type"), F.lit('"}}'))).otherwise(F.concat(F.lit("{not json "), s("user_id")))
    return details.parsed(table(spark, sf_dir, "events").select("event_id", shaped.alias("details")))


def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of mixed details, and the round trip to text."""
    of = details.field
    typed = [of("details", "$.k", "int").alias("k"), of("details", "$.user", "bigint").alias("user"), of("details", "$.at.type", "string").alias("type"), of("details", "$[0]", "string").alias("first"), of("details", "$[1]", "int").alias("second"), of("details", "$.at", "int").alias("not_a_number")]
    rows = details.encoded(_mixed(spark, sf_dir).select("event_id", "details", "details_bad", *typed))
    return rows.select("event_id", "details_bad", *(shown_or_blank(c).alias(c) for c in rows.columns[3:]), shown_or_blank("details").alias("details"))


def event_detail_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.kinds(_mixed(spark, sf_dir)).withColumn("shape", shown_or_blank("shape"))


def event_detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a field of an object and an entry of a list."""
    return details.fields(_mixed(spark, sf_dir), "event_id").withColumn("name", shown_or_blank("name"))


EVENT_DETAILS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN '["a",' || user_id || ']' WHEN 2 THEN '{"at":{"type":"' || event_type || '"},"user":' || user_id || '}' ELSE '' END AS details, event_id % 4 = 3 AS details_bad, CASE WHEN event_id % 4 = 0 THEN props ->> '$.k' ELSE '' END AS k,
  CASE WHEN event_id % 4 = 2 THEN user_id::VARCHAR ELSE '' END AS user, CASE WHEN event_id % 4 = 2 THEN event_type ELSE '' END AS type, CASE WHEN event_id % 4 = 1 THEN 'a' ELSE '' END AS first, CASE WHEN event_id % 4 = 1 THEN user_id::VARCHAR ELSE '' END AS second, '' AS not_a_number FROM events"""
EVENT_DETAIL_SHAPES = "SELECT CASE event_id % 4 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'ARRAY<VARIANT>' WHEN 2 THEN 'OBJECT<at: OBJECT<type: STRING>, user: BIGINT>' ELSE '' END AS shape, count(*) AS n FROM events GROUP BY 1"
EVENT_DETAIL_FIELDS = """SELECT event_id, 'k' AS name, 'BIGINT' AS kind, props ->> '$.k' AS value FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, '', 'STRING', '"a"' FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, '', 'BIGINT', user_id::VARCHAR FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'user', 'BIGINT', user_id::VARCHAR FROM events WHERE event_id % 4 = 2 UNION ALL SELECT event_id, 'at', 'OBJECT<type: STRING>', '{"type":"' || event_type || '"}' FROM events WHERE event_id % 4 = 2"""


# -- nested searches -------------------------------------------------------------------------------------------------
def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations, nested by conversation and hundreds of turns, with each turn's words as a list."""
    turns = table(spark, sf_dir, "conversations").withColumn("words", F.split("text", " "))
    return nested.nest(turns, "conv_id", "turn", "turns", page=100)


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that have a word in their text or role, whatever its case, with their place among those of their page."""
    found = nested.search(_conversations(spark, sf_dir), "SCH", ["text", "role"], name="turns")
    return nested.flattened(found, "conv_id", "turns").select("conv_id", "place", "turn", "role", "text")


def conversation_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the entries of a list inside the turns: how many turns of a conversation, and which are the first and the last."""
    found = nested.search(_conversations(spark, sf_dir), "ich", [], ["words"], "turns")
    return found.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("n"), F.min(F.get("turns", F.lit(0))["turn"]).alias("first"), F.max(F.element_at("turns", -1)["turn"]).alias("last"))


def conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and words of each conversation, and its first turn that isn't the system's (an error where a page has none)."""
    pages = _conversations(spark, sf_dir)
    first = nested.first_with("turns", lambda x: x["role"] != "system", "of another role")["turn"].alias("first_turn")
    counted = nested.counts(pages.withColumn("k", F.struct("conv_id", first)), "k", "words", "turns").select("k.*", "n", "n_inner")
    return counted.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("n_inner").alias("n_inner"), F.min("first_turn").alias("first_turn"))


CONVERSATION_SEARCH = "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id, turn // 100 ORDER BY turn) - 1)::INT AS place, turn, role, text FROM conversations WHERE contains(lower(text), 'sch') OR contains(lower(role), 'sch')"
CONVERSATION_WORD_SEARCH = "SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last FROM conversations WHERE len(list_filter(string_split(text, ' '), lambda w: contains(lower(w), 'ich'))) > 0 GROUP BY conv_id"
CONVERSATION_COUNTS = "SELECT conv_id, count(*) AS n, sum(len(string_split(text, ' ')))::BIGINT AS n_inner, min(turn) FILTER (role <> 'system') AS first_turn FROM conversations GROUP BY conv_id"

# -- catalogs --------------------------------------------------------------------------------------------------------
def good_omens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended keywords of every user."""
    return catalogs.recommended(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id")


def bad_omens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of ill omen in what events tell, with the number of events that have them."""
    told = dreams.entries(dream_texts(spark, sf_dir)).where("NOT good")
    return told.groupBy("ord", "keyword", "kind").agg(F.count("*").alias("n"))


def _readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.read_books(table(spark, sf_dir, "customer"), "c_custkey")


def core_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core books in order, with their readers among the customers."""
    return catalogs.shipped_books(spark).where("core").join(_readers(spark, sf_dir), "ord", "left").select("ord", "book", "title", F.coalesce("n", F.lit(0)).alias("n"))


def book_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books, core books and readers of each category."""
    return catalogs.shipped_books(spark).join(_readers(spark, sf_dir), "ord", "left").groupBy("category").agg(F.count("*").alias("n_books"), F.count_if("core").alias("n_core"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_readers"))


def classic_hexagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classic hexagrams with the number of orders that draw them."""
    hexagrams = spark.createDataFrame(V.CLASSIC_HEXAGRAMS, "number int, name string, symbol string, description string, reading string")
    drawn = table(spark, sf_dir, "orders").groupBy((pick("classic", F.col("o_orderkey").cast("string"), len(V.CLASSIC_HEXAGRAMS))).alias("k")).agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*(F.lit(h[0]) for h in V.CLASSIC_HEXAGRAMS)), F.col("number")) - 1
    return hexagrams.withColumn("k", order.cast("int")).join(drawn, "k", "left").select("number", "name", "symbol", "description", "reading", F.coalesce("n", F.lit(0)).alias("n"))


_BOOKS = ", ".join(f"({k}, '{b[0]}', '{b[1]}', '{b[3]}', {str(b[4]).lower()})" for k, b in enumerate(V.BOOKS))
_CLASSIC = ", ".join(f"({k}, {h[0]}, " + ", ".join("'" + x.replace("'", "''") + "'" for x in h[1:]) + ")" for k, h in enumerate(V.CLASSIC_HEXAGRAMS))
GOOD_OMENS = f"WITH d(ord, keyword, kind, good, words, advice) AS (VALUES {_ENTRIES}) SELECT * FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ('0x' || md5('keywords|' || user_id || keyword)[1:8])::BIGINT, encode(keyword)))::INT AS r, keyword, kind FROM (SELECT DISTINCT user_id FROM events), d WHERE good) WHERE r <= 10"
BAD_OMENS = f"{_dreamt(_DREAM_EVENTS)} SELECT ord::INT AS ord, keyword, kind, count(*) AS n FROM found WHERE NOT good GROUP BY ALL"
_READ = f"WITH b(ord, book, title, category, core) AS (VALUES {_BOOKS}), r AS (SELECT ('0x' || md5('book|' || c_custkey)[1:8])::BIGINT % {len(V.BOOKS)} AS ord, count(*) AS n FROM customer GROUP BY 1)"
CORE_BOOKS = f"{_READ} SELECT b.ord::INT AS ord, book, title, coalesce(n, 0) AS n FROM b LEFT JOIN r ON r.ord = b.ord WHERE core"
BOOK_COUNTS = f"{_READ} SELECT category, count(*) AS n_books, count(*) FILTER (core) AS n_core, coalesce(sum(n), 0)::BIGINT AS n_readers FROM b LEFT JOIN r ON r.ord = b.ord GROUP BY category"
CLASSIC_HEXAGRAMS = f"WITH h(k, number, name, symbol, description, reading) AS (VALUES {_CLASSIC}) SELECT number::INT AS number, name, symbol, description, reading, coalesce(n, 0) AS n FROM h LEFT JOIN (SELECT ('0x' || md5('classic|' || o_orderkey)[1:8])::BIGINT % {len(V.CLASSIC_HEXAGRAMS)} AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = h.k"

QUERIES = {f.__name__: f for f in (six_line_coin_reading, six_line_number_record, six_line_coin_lines, six_line_generations, four_pillar_record, four_pillar_decades, nine_palace_record, twelve_branch_record, purple_star_record, almanac_record, dream_elements, dream_statistics, dream_reading, dream_told,
    event_last_purchase, order_solar_terms, orders_in_decades, event_details, event_detail_shapes, event_detail_fields, conversation_search, conversation_word_search, conversation_counts, good_omens, bad_omens, core_books, book_counts, classic_hexagrams)}
ORACLES = {"six_line_coin_reading": _six_line_sql(_COIN_LINES), "six_line_number_record": _six_line_sql(_NUMBER_LINES), "six_line_coin_lines": SIX_LINE_COIN_LINES, "six_line_generations": SIX_LINE_GENERATIONS,
    "four_pillar_record": FOUR_PILLAR_RECORD, "four_pillar_decades": FOUR_PILLAR_DECADES, "nine_palace_record": NINE_PALACE_RECORD, "twelve_branch_record": TWELVE_BRANCH_RECORD, "purple_star_record": PURPLE_STAR_RECORD, "almanac_record": ALMANAC_RECORD,
    "almanac_lists": ALMANAC_LISTS, "almanac_day": ALMANAC_DAY, "activity_advice": ACTIVITY_ADVICE, "age_labels": AGE_LABELS,
    "dream_elements": DREAM_ELEMENTS, "dream_statistics": DREAM_STATISTICS, "dream_reading": _reading_sql(_DREAM_TURNS), "dream_told": _reading_sql(_DREAM_EVENTS),
    "event_last_purchase": EVENT_LAST_PURCHASE, "order_solar_terms": ORDER_SOLAR_TERMS, "orders_in_decades": ORDERS_IN_DECADES, "event_details": EVENT_DETAILS, "event_detail_shapes": EVENT_DETAIL_SHAPES, "event_detail_fields": EVENT_DETAIL_FIELDS,
    "conversation_search": CONVERSATION_SEARCH, "conversation_word_search": CONVERSATION_WORD_SEARCH, "conversation_counts": CONVERSATION_COUNTS,
    "good_omens": GOOD_OMENS, "bad_omens": BAD_OMENS, "core_books": CORE_BOOKS, "book_counts": BOOK_COUNTS, "classic_hexagrams": CLASSIC_HEXAGRAMS}
