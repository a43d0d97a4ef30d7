"""The six-line chart as one record: six struct lines in an array, whatever casts them, and all that is read from them in the row.

A cast is a frame of (id, ts, question, method, throws), throws being six (solid, moving) from the bottom line up; up to
six of them move.  `chart` makes the record of it, `reading` the analysis, `lines` the relational form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions.columns import at, day_branch, day_stem, hour_branch, joined, kept, pick
from ..sources import fixed as V

TRIGRAM_BY_BITS = [E.BITS.index(b) for b in range(8)]
#: By which of the pairs of lines 1-4, 2-5 and 3-6 differ (4, 2 and 1): the self line, and where the palace comes from.
SELF_LINES = [6, 5, 3, 4, 1, 4, 2, 3]
PALACE_FROM = ["upper", "turned", "lower", "turned", "upper", "turned", "upper", "upper"]


# -- casts -----------------------------------------------------------------------------------------------------------
def coin_cast(rows: DataFrame) -> DataFrame:
    """rows (id, ts, question) by six throws of three coins, drawn by keyed hashes: three heads are a moving solid line, two a solid, one a broken, none a moving broken one."""
    heads = lambda p: reduce(lambda a, b: a + b, (pick(f"coin{k}", F.concat_ws("|", F.col("id").cast("string"), F.lit(str(p))), 2) for k in range(3)))
    thrown = rows.withColumn("heads", F.array(*(heads(p) for p in range(1, 7))))
    return _cast(thrown, F.transform("heads", lambda h: F.struct((h >= 2).alias("solid"), h.isin(0, 3).alias("moving"))), "铜钱起卦")


def time_cast(rows: DataFrame) -> DataFrame:
    """rows (id, ts, question) by year's branch, month, day and hour."""
    day = F.pmod(F.year("ts") - 4, F.lit(12)) + F.month("ts") + F.day("ts")
    return _of_numbers(rows, day, day + hour_branch("ts"), F.array(day + hour_branch("ts")), "时间起卦")


def number_cast(rows: DataFrame) -> DataFrame:
    """rows (id, ts, question, numbers): one, two or more non-negative numbers; rows without any have no chart."""
    n = lambda k: F.get("numbers", F.lit(k))
    total = F.aggregate("numbers", F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.size("numbers")
    upper = F.when(size == 1, F.floor(n(0) / 10)).when(size == 2, n(0)).otherwise(F.floor(total / 2))
    lower = F.when(size == 1, n(0)).when(size == 2, n(1)).otherwise(total)
    stir = F.when(size <= 2, F.array(total)).otherwise(F.slice("numbers", 1, 3))
    return _of_numbers(rows.where(F.coalesce(size, F.lit(0)) > 0), upper, lower, stir, "数字起卦")


def _of_numbers(rows: DataFrame, upper: Column, lower: Column, stir: Column, method: str) -> DataFrame:
    """By two numbers for the trigrams and a list of numbers for the moving lines, each by its residue."""
    residue = lambda x, n: F.pmod(x - 1, F.lit(n)) + 1
    found = rows.withColumns({"__u": at(E.SIX_LINE, residue(upper, 8) - 1), "__l": at(E.SIX_LINE, residue(lower, 8) - 1), "__m": F.transform(stir, lambda x: residue(x, 6).cast("int"))})
    bit = lambda p: at([c == "1" for x in V.TRIGRAM_LINES for c in x], F.col("__l" if p <= 3 else "__u") * 3 + (p - 1) % 3)
    throws = F.array(*(F.struct(bit(p).alias("solid"), F.array_contains("__m", p).alias("moving")) for p in range(1, 7)))
    return _cast(found, throws, method)


def _cast(rows: DataFrame, throws: Column, method: str) -> DataFrame:
    return rows.select("id", "ts", "question", F.lit(method).alias("method"), throws.alias("throws"))


# -- the record ------------------------------------------------------------------------------------------------------
def _trigram(solid: Column, first: int) -> Column:
    """The trigram of three of six solid flags, from `first` on."""
    return at(TRIGRAM_BY_BITS, reduce(lambda a, b: a + b, (F.when(F.get(solid, F.lit(first + k)), 4 >> k).otherwise(0) for k in range(3))))


def _hexagram(solid: str, lines: Column, corrected: bool) -> Column:
    """A struct of what six solid flags (a column's name) amount to, with lines.  corrected: self and answer lines and palace by the eight palaces' generations, else the sixth and third and the shipped palaces."""
    lower, upper = _trigram(F.col(solid), 0), _trigram(F.col(solid), 3)
    differ = reduce(lambda a, b: a + b, (F.when(F.get(solid, F.lit(k)) != F.get(solid, F.lit(k + 3)), 4 >> k).otherwise(0) for k in range(3)))
    self_line = at(SELF_LINES, differ) if corrected else F.lit(6)
    turned = at([E.BITS.index(7 - b) for b in E.BITS], lower)
    palace = reduce(lambda c, n: c.when(differ == n[0], {"upper": upper, "lower": lower, "turned": turned}[n[1]]), enumerate(PALACE_FROM), F) if corrected else at(E.PALACE_OF, upper * 8 + lower)
    inner = lambda first: _trigram(F.col(solid), first)
    mutual = at(E.NAMES, inner(2) * 8 + inner(1))
    return F.struct(
        at(V.TRIGRAMS, upper).alias("upper"), at(V.TRIGRAMS, lower).alias("lower"), at(E.NAMES, upper * 8 + lower).alias("name"), at(V.TRIGRAMS, palace).alias("palace"),
        self_line.alias("self_line"), (F.pmod(self_line + 2, F.lit(6)) + 1).alias("answer_line"), mutual.alias("mutual"), lines.alias("lines"),
    )


def chart(cast: DataFrame, *, corrected: bool = False) -> DataFrame:
    """id, ts, question, method, chart (upper, lower, name, palace, self_line, answer_line, mutual, lines), changed (the same of the changed hexagram, null without moving lines), n_moving, year_name, month, day.

    A line is (position, solid, moving, branch, kin, spirit); a changed one keeps branch, kin and spirit, and none
    moves.  mutual has the lines 2 to 4 under the lines 3 to 5.  One projection in stages: no shuffle, no UDF.
    """
    branches = [V.BRANCHES.index(b) for row in V.LINE_BRANCHES for b in row[:3]]  # the upper trigram uses the lower one's, too
    rows = cast.withColumns({"__solid": F.transform("throws", lambda x: x["solid"]), "__spirit": at(V.SPIRIT_OF_STEM, day_stem("ts", "six_line"))})
    rows = rows.withColumns({"__l": _trigram(F.col("__solid"), 0), "__u": _trigram(F.col("__solid"), 3)})

    def line(x: Column, i: Column) -> Column:
        of = F.when(i < 3, F.col("__l")).otherwise(F.col("__u"))
        branch = at(branches, of * 3 + F.pmod(i, F.lit(3)))
        kin = at(V.SIX_KIN, F.pmod(at(E.BRANCH_ELEMENT, branch) - at(E.TRIGRAM_ELEMENT, of), F.lit(5)))
        return F.struct((i + 1).alias("position"), x["solid"].alias("solid"), x["moving"].alias("moving"), at(V.BRANCHES, branch).alias("branch"), kin.alias("kin"), at(V.SPIRITS, F.pmod(i + F.col("__spirit"), F.lit(6))).alias("spirit"))

    rows = rows.withColumn("__lines", F.transform("throws", line))
    turned = F.transform("__lines", lambda x: x.withField("solid", x["solid"] != x["moving"]).withField("moving", F.lit(False)))
    rows = rows.withColumns({"__turned": turned, "n_moving": F.size(F.filter("throws", lambda x: x["moving"]))})
    rows = rows.withColumn("__now", F.transform("__turned", lambda x: x["solid"]))
    year = F.year("ts") - 4
    return rows.select(
        "id", "ts", "question", "method", _hexagram("__solid", F.col("__lines"), corrected).alias("chart"), F.when(F.col("n_moving") > 0, _hexagram("__now", F.col("__turned"), corrected)).alias("changed"), "n_moving",
        F.concat(at(V.STEMS, F.pmod(year, F.lit(10))), at(V.BRANCHES, F.pmod(year, F.lit(12)))).alias("year_name"), at(V.BRANCHES, F.month("ts") - 1).alias("month"), at(V.BRANCHES, day_branch("ts", "six_line")).alias("day"),
    )


# -- what is read from it --------------------------------------------------------------------------------------------
def significator(question: Column) -> Column:
    """The kin that a question is about: the first group with one of its words; the self line otherwise, for null, too."""
    chosen = F
    for kin, words in V.QUESTION_KINDS:
        chosen = chosen.when(reduce(lambda a, b: a | b, (question.contains(w) for w in words.split())), kin)
    return chosen.otherwise("世爻")


def _element(branch: Column) -> Column:
    return at(E.BRANCH_ELEMENT, F.array_position(F.array(*map(F.lit, V.BRANCHES)), branch) - 1)


def _strength(branch: Column) -> Column:
    """A line's strength under month and day."""
    of = lambda over: F.pmod(_element(branch) - _element(F.col(over)), F.lit(5))
    score = at([2, 1, -2, 0, 0], of("month")) + at([1, 1, -1, 0, 0], of("day"))
    return F.when(score >= 2, "旺相").when(score >= 0, "中和").otherwise("休囚")


def reading(charts: DataFrame) -> DataFrame:
    """charts with analysis: a struct of the significator and its state, the texts of moving, self and significator lines, the hexagram's texts (with defaults), the conclusion and at most five suggestions."""
    line = lambda n: F.element_at("chart.lines", F.col(f"chart.{n}"))
    rows = charts.withColumns({"__wanted": significator(F.col("question")), "__self": line("self_line"), "__answer": line("answer_line"), "__lone": F.get(F.filter("chart.lines", lambda x: x["moving"]), F.lit(0))})
    rows = rows.withColumn("__found", F.filter("chart.lines", lambda x: x["kin"] == F.col("__wanted")))
    rows = rows.withColumn("__one", F.get("__found", F.lit(0)))
    rows = rows.withColumn("__worth", _strength(F.col("__one.branch")))
    number = lambda c: F.col(c).cast("string")
    n, wanted = F.size("__found"), F.col("__wanted")
    state = F.when(wanted == "世爻", "世爻").when(n == 0, "不现").when(n == 1, F.col("__worth")).otherwise("重现")
    on_wanted = (
        F.when(wanted == "世爻", F.concat(F.lit("以世爻为用神。世爻"), "__self.branch", F.lit("，"), F.when(F.col("__self.moving"), "动").otherwise("静"), F.lit("，在"), number("__self.position"), F.lit("爻位。")))
        .when(n == 0, F.concat(F.lit("用神"), wanted, F.lit("不现，需看伏神或以他爻代替。")))
        .when(n == 1, F.concat(F.lit("用神"), wanted, F.lit("在"), number("__one.position"), F.lit("爻，"), "__one.branch", F.lit("，"), "__worth", F.lit("。"), F.when(F.col("__one.moving"), "发动有变").otherwise("安静不动"), F.lit("。")))
        .otherwise(F.concat(F.lit("用神"), wanted, F.lit("重现，需要仔细分析各爻情况。")))
    )
    answers = at(V.RELATION_TEXTS, F.pmod(_element(F.col("__answer.branch")) - _element(F.col("__self.branch")), F.lit(5)))
    on_self = F.concat(F.lit("世爻"), number("__self.position"), F.lit("位，"), "__self.kin", "__self.branch", F.lit("，应爻"), number("__answer.position"), F.lit("位，"), "__answer.kin", "__answer.branch", F.lit("。"), answers, F.lit("。"))
    lone = F.concat(F.lit(V.MOVING_TEXTS[1]), number("__lone.position"), F.lit("爻"), "__lone.kin", F.lit("动，"), F.when(F.col("__lone.solid"), "阳").otherwise("阴"), F.lit("爻发动，主变化。"))
    on_moving = F.when(F.col("n_moving") == 1, lone).otherwise(at(V.MOVING_TEXTS, F.least(F.col("n_moving"), F.lit(4))))
    known = F.create_map(*(x for h, t in V.HEXAGRAM_TEXTS.items() for x in (F.lit(h), F.array(*map(F.lit, t)))))
    rows = rows.withColumns({"__state": state, "__on_wanted": on_wanted, "__on_self": on_self, "__on_moving": on_moving, "__texts": F.try_element_at(known, F.col("chart.name"))})
    texts = F.coalesce("__texts", F.array(*map(F.lit, V.HEXAGRAM_DEFAULTS)))
    says = F.get("__texts", F.lit(1))
    by_text = reduce(lambda c, p: c.when(says.contains(p[0]), p[1]), V.HEXAGRAM_SUGGESTIONS, F)
    by_state = reduce(lambda c, p: c.when(F.col("__state") == p[0], p[1]), V.STRENGTH_SUGGESTIONS.items(), F)
    advice = kept(by_text, at(V.MOVING_SUGGESTIONS, F.least(F.col("n_moving"), F.lit(2))), by_state, *map(F.lit, V.COMMON_SUGGESTIONS))
    conclusion = F.concat(
        F.lit("根据"), "chart.name", F.lit("卦象分析：\n"), F.get(texts, F.lit(1)), F.lit("\n"), F.coalesce(F.concat(F.lit("\n变卦为"), "changed.name", F.lit("，显示事态的发展趋势。")), F.lit("")),
        F.when(F.col("n_moving") > 0, F.concat(F.lit("\n"), "__on_moving")).otherwise(""), F.lit("\n"), "__on_self", F.lit("\n"), "__on_wanted",
    )
    named = [F.get(texts, F.lit(k)).alias(c) for k, c in enumerate(("meaning", "interpretation", "career", "wealth", "marriage", "health"))]
    analysis = F.struct(*named, wanted.alias("significator"), F.col("__state").alias("state"), F.col("__on_moving").alias("on_moving"), F.col("__on_self").alias("on_self"), F.col("__on_wanted").alias("on_significator"), conclusion.alias("conclusion"), F.slice(advice, 1, 5).alias("suggestions"))
    return rows.select(*charts.columns, analysis.alias("analysis"))


def lines(charts: DataFrame) -> DataFrame:
    """One row a line of each chart: id, position, solid, moving, branch, kin, spirit, role (self, answer or empty) and changed_solid (null without moving lines)."""
    fields = ("position", "solid", "moving", "branch", "kin", "spirit")

    def row(x: Column) -> Column:
        role = F.when(x["position"] == F.col("chart.self_line"), "世").when(x["position"] == F.col("chart.answer_line"), "应").otherwise("")
        return F.struct(*(x[f].alias(f) for f in fields), role.alias("role"), F.get("changed.lines", x["position"] - 1)["solid"].alias("changed_solid"))

    # The rows are made as structs first: exploding the record's own array would compute the record once for each of its fields.
    return charts.select("id", F.inline(F.transform("chart.lines", row)))


def shown(lines: Column) -> Column:
    """Lines as one text."""
    return joined(F.transform(lines, lambda x: F.concat_ws(" ", x["position"].cast("string"), F.when(x["solid"], "阳").otherwise("阴"), F.when(x["moving"], "动").otherwise("静"), x["branch"], x["kin"], x["spirit"])), "；")
