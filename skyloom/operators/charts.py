"""Chart builders: SQL over a source of (id, ts, ...) rows for an engine's dialect; no clock, and no randomness but keyed hashes."""

from __future__ import annotations

from ..functions import cycles as C
from ..functions import elements as E
from ..functions.dialect import SPARK, Dialect, chain, integer, text
from ..sources import fixed as V


def select(columns: dict[str, str], src: str, tail: str = "") -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {src} {tail}"


# -- six lines -------------------------------------------------------------------------------------------------------
def six_line_time(q: Dialect, src: str) -> str:
    """id, ts, u, l (trigrams) and m1, m2, m3 (moving lines, 0: none) by the time."""
    a = f"({C.year_index(q, 'year(ts)', 12)} + month(ts) + day(ts))"
    b = f"({a} + {C.hour_branch(q, 'ts')})"
    return select({"id": "id", "ts": "ts", "u": q.at(E.SIX_LINE, f"{E.residue(q, a, 8)} - 1"), "l": q.at(E.SIX_LINE, f"{E.residue(q, b, 8)} - 1"), "m1": integer(E.residue(q, b, 6)), "m2": "0", "m3": "0"}, src)


def six_line_numbers(q: Dialect, src: str) -> str:
    """The same by k numbers n1, n2, n3 whose sum is total; numbers beyond the third count in total alone."""
    upper = chain([("k = 1", q.div("n1", 10)), ("k = 2", "n1")], q.div("total", 2))
    lower = chain([("k = 1", "n1"), ("k = 2", "n2")], "total")
    one = chain([("k <= 2", "total")], "n1")
    second, third = (E.residue(q, n, 6) for n in ("n2", "n3"))
    first = E.residue(q, one, 6)
    m2 = f"CASE WHEN k >= 3 AND {second} <> {first} THEN {second} ELSE 0 END"
    m3 = f"CASE WHEN k >= 3 AND {third} <> {first} AND {third} <> {second} THEN {third} ELSE 0 END"
    return select({"id": "id", "ts": "ts", "u": q.at(E.SIX_LINE, f"{E.residue(q, upper, 8)} - 1"), "l": q.at(E.SIX_LINE, f"{E.residue(q, lower, 8)} - 1"), "m1": integer(first), "m2": integer(m2), "m3": integer(m3)}, src, "WHERE k >= 1")


def six_line_coins(q: Dialect, src: str) -> str:
    """id, position, heads, value, solid, moving: six throws of three coins by keyed hashes; heads 3, 2, 1, 0 give 9, 8, 7, 6."""
    heads = " + ".join(q.pick(f"coin{k}", "concat_ws('|', CAST(id AS STRING), CAST(p AS STRING))", 2) for k in range(3))
    inner = f"SELECT id, p AS position, {heads} AS heads FROM {src} {q.each(1, 6, 'p')}"
    return f"SELECT id, {integer('position')} AS position, {integer('heads')} AS heads, {integer('heads + 6')} AS value, heads >= 2 AS solid, heads IN (0, 3) AS moving FROM ({inner})"


def six_line_lines(q: Dialect, cast: str) -> str:
    """cast's rows by line: position, solid, moving, value, branch, kin, spirit, elements (lu, self and answer lines are the sixth and third)."""
    of = "CASE WHEN p <= 3 THEN l ELSE u END"
    solid = E.line(q, of, q.mod("(p - 1)", 3) + " + 1")
    moving = "(m1 = p OR m2 = p OR m3 = p)"
    branches = [V.BRANCHES.index(b) for row in V.LINE_BRANCHES for b in row[:3]]  # the upper trigram uses the lower one's, too
    inner = f"SELECT *, {solid} AS solid, {moving} AS moving, {q.at(branches, f'({of}) * 3 + ' + q.mod('(p - 1)', 3))} AS branch, {E.palace(q, 'u', 'l')} AS pal FROM ({cast}) __c {q.each(1, 6, 'p')}"
    kin = q.at(V.SIX_KIN, E.rel(q, q.at(E.TRIGRAM_ELEMENT, "OWNER"), E.branch_element(q, "branch"))).replace("OWNER", of)
    spirit = q.at(V.SPIRITS, q.mod(f"(p - 1 + {q.at(V.SPIRIT_OF_STEM, C.day_stem(q, 'ts', 'six_line'))})", 6))
    return f"SELECT id, ts, u, l, pal, {integer('p')} AS position, solid = 1 AS solid, moving, {integer('CASE WHEN solid = 1 THEN CASE WHEN moving THEN 9 ELSE 8 END ELSE CASE WHEN moving THEN 6 ELSE 7 END END')} AS value, branch, {kin} AS kin, {spirit} AS spirit FROM ({inner})"


def six_line_chart(q: Dialect, cast: str) -> str:
    """One row a line."""
    return select({"id": "id", "position": "position", "solid": "solid", "moving": "moving", "value": "value", "branch": q.at(V.BRANCHES, "branch"), "kin": "kin", "spirit": "spirit", "role": chain([("position = 6", "'世'"), ("position = 3", "'应'")], "''"), "symbol": E.line_symbol(q, "solid", "moving")}, f"({six_line_lines(q, cast)})")


def six_line_reading(q: Dialect, cast: str) -> str:
    """id, name, palace, changed (null without moving lines), n_moving, moving_text, month and day branch."""
    n = "(CASE WHEN m1 > 0 THEN 1 ELSE 0 END + CASE WHEN m2 > 0 THEN 1 ELSE 0 END + CASE WHEN m3 > 0 THEN 1 ELSE 0 END)"
    return select(
        {"id": "id", "name": "name", "palace": q.at(V.TRIGRAMS, E.palace(q, "u", "l")), "changed": "changed", "n_moving": integer(n), "moving_text": q.at(V.MOVING_TEXTS, f"least({n}, 4)"),
         "month_branch": C.month_branch(q, "ts"), "day_branch": q.at(V.BRANCHES, C.day_branch(q, "ts", "six_line"))},
        f"(SELECT *, {six_line_names(q)} FROM ({cast}) __c) __r",
    )


def significator(q: Dialect, question: str) -> str:
    """The kin that a question is about: the first group with one of its words."""
    return chain([(" OR ".join(q.contains(question, text(w)) for w in words.split()), text(kin)) for kin, words in V.QUESTION_KINDS], "'世爻'")


def six_line_analysis(q: Dialect, cast: str, kin: str) -> str:
    """One row a cast, all in the row: the six lines' branches (b1 to b6) and kin (k1 to k6), the significator (kin, an expression of cast's columns), and every text of the analysis."""
    branches = [V.BRANCHES.index(b) for row in V.LINE_BRANCHES for b in row[:3]]
    six = range(1, 7)
    of = {p: "l" if p <= 3 else "u" for p in six}
    b = ", ".join(f"{q.at(branches, f'({of[p]}) * 3 + {(p - 1) % 3}')} AS b{p}" for p in six)
    inner = f"SELECT *, {kin} AS wanted, {b} FROM ({cast}) __c"
    k = ", ".join(f"{q.at(V.SIX_KIN, E.rel(q, q.at(E.TRIGRAM_ELEMENT, of[p]), E.branch_element(q, f'b{p}')))} AS k{p}" for p in six)
    inner = f"SELECT *, {k} FROM ({inner}) __b"
    first = chain([(f"k{p} = wanted", str(p)) for p in six], "0")
    n_moving = " + ".join(f"CASE WHEN {m} > 0 THEN 1 ELSE 0 END" for m in ("m1", "m2", "m3"))
    inner = f"SELECT *, {' + '.join(f'CASE WHEN k{p} = wanted THEN 1 ELSE 0 END' for p in six)} AS n, {first} AS place, {n_moving} AS n_moving, greatest(m1, m2, m3) AS lone FROM ({inner}) __k"
    line = lambda c, place: chain([(f"{place} = {p}", f"{c}{p}") for p in range(1, 6)], f"{c}6")
    month, day = E.branch_element(q, q.mod("(month(ts) - 1)", 12)), E.branch_element(q, C.day_branch(q, "ts", "six_line"))
    worth = E.strength(q, E.branch_element(q, "branch"), month, day)
    inner = f"SELECT *, {line('b', 'place')} AS branch, {line('k', 'lone')} AS lone_kin, {E.line(q, 'CASE WHEN lone <= 3 THEN l ELSE u END', q.mod('(lone - 1)', 3) + ' + 1')} AS lone_solid FROM ({inner}) __n"
    inner = f"SELECT *, {worth} AS worth, place IN (m1, m2, m3) AS stirs, {six_line_names(q)} FROM ({inner}) __w"
    name = lambda branch: q.at(V.BRANCHES, branch)
    kin_text = chain(
        [("wanted = '世爻'", f"'以世爻为用神。世爻' || {name('b6')} || '，' || CASE WHEN 6 IN (m1, m2, m3) THEN '动' ELSE '静' END || '，在6爻位。'"),
         ("n = 0", "'用神' || wanted || '不现，需看伏神或以他爻代替。'"),
         ("n = 1", f"'用神' || wanted || '在' || CAST(place AS STRING) || '爻，' || {name('branch')} || '，' || worth || '。' || CASE WHEN stirs THEN '发动有变' ELSE '安静不动' END || '。'")],
        "'用神' || wanted || '重现，需要仔细分析各爻情况。'",
    )
    relation = q.at(V.RELATION_TEXTS, E.rel(q, E.branch_element(q, "b6"), E.branch_element(q, "b3")))
    self_text = f"'世爻6位，' || k6 || {name('b6')} || '，应爻3位，' || k3 || {name('b3')} || '。' || {relation} || '。'"
    moving_text = f"CASE WHEN n_moving = 1 THEN {text(V.MOVING_TEXTS[1])} || CAST(lone AS STRING) || '爻' || lone_kin || '动，' || CASE WHEN lone_solid = 1 THEN '阳' ELSE '阴' END || '爻发动，主变化。' ELSE {q.at(V.MOVING_TEXTS, 'least(n_moving, 4)')} END"
    state = chain([("wanted = '世爻'", "'世爻'"), ("n = 0", "'不现'"), ("n = 1", "worth")], "'重现'")
    said = {n: chain([(f"name = {text(h)}", text(t[i])) for h, t in V.HEXAGRAM_TEXTS.items()], text(V.HEXAGRAM_DEFAULTS[i])) for i, n in enumerate(("meaning", "reading", "career", "wealth", "marriage", "health"))}
    columns = {"id": "id", "name": "name", "changed": "changed", "wanted": "wanted", "n": integer("n"), "state": state, "n_moving": integer("n_moving"), "kin_text": kin_text, "self_text": self_text, "moving_text": moving_text}
    return select(columns | said, f"({inner}) __a")


def six_line_names(q: Dialect) -> str:
    """Two columns of a cast: name, and changed (null without moving lines)."""
    turned = {t: t for t in "lu"}
    for t, first in (("l", 1), ("u", 4)):
        for k in (1, 2, 3):
            turned[t] = f"CASE WHEN {first + k - 1} IN (m1, m2, m3) THEN {E.flip(q, turned[t], str(k))} ELSE {turned[t]} END"
    return f"{E.hexagram(q, 'u', 'l')} AS name, CASE WHEN m1 + m2 + m3 > 0 THEN {E.hexagram(q, turned['u'], turned['l'])} END AS changed"


def six_line_answer(q: Dialect, cast: str, kin: str) -> str:
    """id, the significator, how many lines carry it, its state and text, and what self and answer lines are to each other.  Without a group of words the self line is described."""
    return select({c: c for c in ("id", "wanted", "n", "state", "kin_text", "self_text")}, f"({six_line_analysis(q, cast, kin)}) __r")


def six_line_conclusion(q: Dialect, cast: str, kin: str) -> str:
    """id, the hexagram's texts (with defaults), and the conclusion."""
    parts = ["'根据' || name || '卦象分析：' || chr(10) || reading || chr(10)", "CASE WHEN changed IS NULL THEN '' ELSE chr(10) || '变卦为' || changed || '，显示事态的发展趋势。' END", "CASE WHEN n_moving = 0 THEN '' ELSE chr(10) || moving_text END", "chr(10) || self_text || chr(10) || kin_text"]
    return select({c: c for c in ("id", "meaning", "career", "wealth", "marriage", "health")} | {"conclusion": " || ".join(f"({p})" for p in parts)}, f"({six_line_analysis(q, cast, kin)}) __r")


def six_line_suggestions(q: Dialect, cast: str, kin: str) -> str:
    """id, suggestions: by the hexagram's text, the number of moving lines, the significator's strength, and two common ones; never more than five."""
    known = " OR ".join(f"name = {text(h)}" for h in V.HEXAGRAM_TEXTS)
    nothing = f"CAST(NULL AS {'STRING' if q.spark else 'VARCHAR'})"
    by_text = chain([(f"({known}) AND {q.contains('reading', text(w))}", text(t)) for w, t in V.HEXAGRAM_SUGGESTIONS], nothing)
    of_state = chain([(f"state = {text(k)}", text(v)) for k, v in V.STRENGTH_SUGGESTIONS.items()], nothing)
    every = ", ".join([by_text, q.at(V.MOVING_SUGGESTIONS, "least(n_moving, 2)"), of_state, *map(text, V.COMMON_SUGGESTIONS)])
    return f"SELECT id, concat_ws('；', {every}) AS suggestions FROM ({six_line_analysis(q, cast, kin)}) __r"


# -- plum blossom ----------------------------------------------------------------------------------------------------
def plum(q: Dialect, src: str, upper: str, lower: str, moving: str) -> str:
    """id, name, moving, body, use, relation, verdict, suggestion, changed, mutual (constant) from three numbers."""
    u, lo = (q.at(E.EARLY, f"{E.residue(q, x, 8)} - 1") for x in (upper, lower))
    inner = f"SELECT id, {u} AS u, {lo} AS l, {integer(E.residue(q, moving, 6))} AS m FROM {src}"
    inner = f"SELECT *, CASE WHEN m <= 3 THEN u ELSE l END AS body, CASE WHEN m <= 3 THEN l ELSE u END AS other FROM ({inner})"
    r = E.rel(q, q.at(E.TRIGRAM_ELEMENT, "body"), q.at(E.TRIGRAM_ELEMENT, "other"))
    changed = E.hexagram(q, f"CASE WHEN m <= 3 THEN u ELSE {E.flip(q, 'u', 'greatest(m - 3, 1)')} END", f"CASE WHEN m <= 3 THEN {E.flip(q, 'l', 'least(m, 3)')} ELSE l END")
    described = lambda part, t: f"'{part}' || {q.at(V.TRIGRAMS, t)} || '，主' || {q.at(V.LIKENESS['nature'], t)} || '，性' || {q.at(V.LIKENESS['character'], t)} || '。'"
    return select({"id": "id", "name": E.hexagram(q, "u", "l"), "moving": "m", "body": q.at(V.TRIGRAMS, "body"), "use_part": q.at(V.TRIGRAMS, "other"), "relation": q.at(V.BODY_USE, r), "verdict": q.at(V.PLUM_VERDICTS, r), "suggestion": q.at(V.PLUM_SUGGESTIONS, r), "changed": changed, "mutual": "'风山渐'",
        "body_text": described("体卦", "body"), "use_text": described("用卦", "other"), "mutual_hint": "'互卦风山渐暗示事情的发展过程。'", "changed_hint": f"'变卦' || {changed} || '预示事情的最终结果。'"}, f"({inner})")


def plum_time(q: Dialect, src: str) -> str:
    s = "(year(ts) + month(ts) + day(ts))"
    return plum(q, src, s, f"{s} + hour(ts)", f"{s} + hour(ts)")


def plum_numbers(q: Dialect, src: str) -> str:
    """By k numbers n1, n2, n3."""
    half = q.div("n1", 2)
    return plum(q, src, chain([("k = 1", half)], "n1"), chain([("k = 1", f"n1 - {half}")], "n2"), chain([("k = 1", "n1"), ("k = 2", "n1 + n2")], "n3"))


def plum_sound(q: Dialect, src: str) -> str:
    """By a count n, with the hour of ts added to the moving line."""
    half = q.div("n", 2)
    return plum(q, src, half, f"n - {half}", f"{E.residue(q, 'n', 6)} + hour(ts)")


def plum_text(q: Dialect, src: str) -> str:
    """By the length of txt in UTF-16 units, as one number."""
    n = q.units("txt")
    half = q.div(n, 2)
    return plum(q, src, half, f"{n} - {half}", n)


# -- four pillars ----------------------------------------------------------------------------------------------------
def four_pillars(q: Dialect, src: str, mode: str = "compat") -> str:
    """id, pillars, ten gods of the stems by the day's."""
    god = lambda s: q.at(V.TEN_GODS, E.rel(q, E.stem_element(q, "ds"), E.stem_element(q, s)))
    columns = {"id": "id"} | {f"{n}_pillar": C.named(q, f"{k}s", f"{k}b") for n, k in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"))} | {f"{n}_god": god(f"{k}s") for n, k in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"))}
    return select(columns | {"pattern": text(V.PATTERN)}, f"({C.pillars(q, src, mode)})")


def element_counts(q: Dialect, src: str, mode: str = "compat") -> str:
    """pillars' rows with the five counts c0 to c4 over stems, branches and hidden stems."""
    def of_branch(e: int) -> list[int]:
        return [(E.BRANCH_ELEMENT[b] == e) + sum(V.STEMS.index(s) // 2 == e for s in V.HIDDEN_STEMS[b]) for b in range(12)]

    counts = {f"c{e}": " + ".join(f"CASE WHEN {E.stem_element(q, k + 's')} = {e} THEN 1 ELSE 0 END + {q.at(of_branch(e), k + 'b')}" for k in "ymdh") for e in range(5)}
    return f"SELECT *, {', '.join(f'{integer(v)} AS {k}' for k, v in counts.items())} FROM ({C.pillars(q, src, mode)})"


def scarcest(q: Dialect) -> str:
    """The least of the counts c0 to c4, the first of equals."""
    return chain([(f"c{e} = least(c0, c1, c2, c3, c4)", str(e)) for e in range(4)], "4")


def element_texts(q: Dialect) -> dict[str, str]:
    """Columns over the counts c0 to c4, the scarcest element k, ds and gender."""
    shown = " || ".join(f"'{V.ELEMENTS[e]}(' || CAST(c{e} AS STRING) || ') '" for e in range(5))
    empty = f"concat_ws('；', {', '.join(f'CASE WHEN c{e} = 0 THEN {text(V.LACKS[e])} END' for e in range(5))})"
    day = E.stem_element(q, "ds")
    return (
        {f"n_{n}": f"c{e}" for e, n in enumerate(("wood", "fire", "earth", "metal", "water"))}
        | {"scarcest": q.at(V.ELEMENTS, "k"), "favourable": q.at(V.ELEMENTS, q.mod("(k - 1)", 5)), "unfavourable": q.at(V.ELEMENTS, q.mod("(k + 3)", 5)),
           "personality": f"('日主' || {q.at(V.STEMS, 'ds')} || {q.at(V.ELEMENTS, day)} || '，' || {q.at(V.PERSONALITY, day)})", "counts_text": f"('五行分布：' || {shown})", "lacks": empty, "health": f"('五行分布：' || {shown} || chr(10) || CASE WHEN {empty} = '' THEN {text(V.HEALTH_TEXTS[0])} ELSE '健康提醒：' || {empty} || '。' END || {text(V.HEALTH_TEXTS[1])})",
           "suggestions": f"('多使用' || {q.at(V.ELEMENT_COLOURS, 'k')} || '的物品，有助于增强运势；工作生活宜选择' || {q.at(V.ELEMENT_DIRECTIONS, q.mod('(k - 1)', 5))} || '，有利于事业发展；' || {text('；'.join(V.PILLAR_SUGGESTIONS))})",
           "colours": q.at(V.ELEMENT_COLOURS, "k"), "direction": q.at(V.ELEMENT_DIRECTIONS, q.mod("(k - 1)", 5)), "marriage": f"CASE WHEN gender = '男' THEN {text(V.MARRIAGE['男'])} ELSE {text(V.MARRIAGE['女'])} END", "career": text(V.CAREER), "wealth": text(V.WEALTH)}
    )


def element_reading(q: Dialect, src: str) -> str:
    """id, counts, the scarcest element (the first of equals), favourable and unfavourable ones, texts."""
    return select({"id": "id"} | element_texts(q), f"(SELECT *, {scarcest(q)} AS k FROM ({element_counts(q, src)}))")


def luck_columns(q: Dialect, i: str) -> dict[str, str]:
    """The decade i (from 0) of pillars' rows."""
    forward = f"((gender = '男' AND {q.mod('ms', 2)} = 0) OR (gender = '女' AND {q.mod('ms', 2)} = 1))"
    n = q.mod(f"({C.sixty(q, 'ms', 'mb')} + CASE WHEN {forward} THEN {i} + 1 ELSE -{i} - 1 END)", 60)
    age = f"(CASE WHEN gender = '男' THEN 8 ELSE 7 END + {i} * 10)"
    return {"i": integer(i), "name": C.named(q, q.mod(n, 10), q.mod(n, 12)), "from_age": integer(age), "to_age": integer(f"{age} + 9"), "from_year": integer(f"year(ts) + {age}"), "to_year": integer(f"year(ts) + {age} + 9")}


def luck_cycles(q: Dialect, src: str, as_of_year: int) -> str:
    """id, i, name, ages and years of eight decades, and which of them holds as_of_year; with the year's own name and age."""
    columns = luck_columns(q, "i")
    now = {"is_now": f"{as_of_year} BETWEEN {columns['from_year']} AND {columns['to_year']}", "year_name": C.named(q, C.year_index(q, str(as_of_year), 10), C.year_index(q, str(as_of_year), 12)), "age": integer(f"{as_of_year} - year(ts)")}
    return select({"id": "id"} | columns | now, f"({C.pillars(q, src)}) __p", q.each(0, 7, "i"))


# -- nine palaces ----------------------------------------------------------------------------------------------------
def nine_parameters(q: Dialect, src: str, drawn: bool = False) -> str:
    """id, ts and the parameters pu, pm, pl, pj, of the time or drawn by the id."""
    if drawn:
        pick = lambda salt, n: q.pick(salt, "CAST(id AS STRING)", n)
        return select({"id": "id", "ts": "ts"} | {p: integer(f"{pick(p, 9)} + 1") for p in ("pu", "pm", "pl")} | {"pj": integer(pick("pj", 1080))}, src)
    y = q.mod("year(ts)", 60)
    return select({"id": "id", "ts": "ts", "pu": integer(q.mod(f"({y} + month(ts))", 9) + " + 1"), "pm": integer(q.mod("(month(ts) + day(ts))", 9) + " + 1"), "pl": integer(q.mod("(day(ts) + hour(ts))", 9) + " + 1"), "pj": integer(q.mod(f"({y} * 365 + month(ts) * 30 + day(ts) * 24 + hour(ts))", 1080))}, src)


def _cell(q: Dialect, i: str) -> dict[str, str]:
    door = q.mod(f"(pu + {i} - 1)", 8)
    return {"star": q.mod(f"(pj + {i} - 1)", 9), "door": f"CASE WHEN {door} = 4 THEN 7 ELSE {door} END", "deity": q.mod(f"(pm + {i} - 1)", 8), "stem": q.mod(f"(pl + {i} - 1)", 10)}


def nine_columns(q: Dialect, i: str) -> dict[str, str]:
    """The cell i (from 1) of nine_parameters' rows."""
    c = _cell(q, i)
    flags = f"concat_ws(' ', CASE WHEN {i} = 1 THEN '值符' END, CASE WHEN {i} = pu THEN '用神' END, CASE WHEN {c['star']} IN (0, 2, 6, 8) THEN '凶星' END)"
    return {"position": integer(i), "palace": q.at(V.PALACE_NAMES, f"{i} - 1"), "star": q.at(V.STARS, c["star"]), "door": q.at(V.DOORS, c["door"]), "deity": q.at(V.DEITIES, c["deity"]), "stem": q.at(V.STEMS, c["stem"]), "flags": flags}


def nine_cells(q: Dialect, src: str, drawn: bool = False) -> str:
    """id and its nine cells."""
    return select({"id": "id"} | nine_columns(q, "i"), f"({nine_parameters(q, src, drawn)}) __n", q.each(1, 9, "i"))


def nine_reading(q: Dialect, src: str, drawn: bool = False, also: dict[str, str] | None = None) -> str:
    """id, pattern and its level, five aspects, the significator's direction, the favourable direction; also: more columns over nine_parameters."""
    star = lambda i: q.at(V.STARS, _cell(q, str(i))["star"])
    door = lambda i: q.at(V.DOORS, _cell(q, str(i))["door"])
    deity = lambda i: q.at(V.DEITIES, _cell(q, str(i))["deity"])
    key = "CAST(id AS STRING)"
    pattern = chain([(f"{star(1)} = '天蓬星' AND {star(9)} = '天英星'", "'水火激战'"), (f"{deity(5)} = '值符'", "'值符居中'"), (f"{door(1)} = '开门' OR {door(6)} = '开门'", "'开门得地'")], q.at(V.PATTERNS, q.pick("pattern", key, 6)))
    def aspect(name: str, good: str, bad: str) -> str:
        texts = V.ASPECT_TEXTS[name]
        return chain([(good, text(texts[0])), (bad, text(texts[1]))], text(texts[2]))

    is_in = lambda x, *names: f"{x} IN ({', '.join(map(text, names))})"
    aspects = {
        "career": aspect("career", is_in(star(6), "天心星", "天辅星"), is_in(star(6), "天冲星", "天柱星")),
        "wealth": aspect("wealth", f"{star(2)} = '天任星' OR {door(8)} = '生门'", f"{star(2)} = '天蓬星' OR {door(8)} = '死门'"),
        "love": aspect("love", f"{deity(4)} = '六合' OR {door(7)} = '开门'", f"{star(4)} = '天冲星' OR {door(7)} = '伤门'"),
        "health": aspect("health", f"{star(3)} = '天心星' OR {door(6)} = '生门'", f"{star(3)} = '天英星' OR {door(6)} = '伤门'"),
        "study": aspect("study", f"{star(4)} = '天辅星' OR {door(9)} = '景门'", f"{star(4)} = '天冲星' OR {door(9)} = '杜门'"),
    }
    directions = [(is_in(door(i), "开门", "生门"), text(V.PALACE_DIRECTIONS[i - 1])) for i in range(1, 10)] + [(is_in(star(i), "天心星", "天任星", "天辅星"), text(V.PALACE_DIRECTIONS[i - 1])) for i in range(1, 10)]
    inner = select({"id": "id"} | (also or {}) | {"pattern": pattern} | aspects | {"significator": q.at(V.PALACE_DIRECTIONS, "pu - 1"), "favourable": chain(directions, "'东南'"), "favourable_time": chain([("hour(ts) BETWEEN 6 AND 11", text(V.HALF_DAY_TEXTS[0])), ("hour(ts) BETWEEN 12 AND 17", text(V.HALF_DAY_TEXTS[1]))], text(V.HALF_DAY_TEXTS[2]))}, f"({nine_parameters(q, src, drawn)})")
    of_pattern = lambda values, other: chain([(f"pattern = {text(p)}", text(v)) for p, v in zip(V.PATTERNS, values, strict=True)], text(other))
    inner = f"SELECT *, {of_pattern(V.PATTERN_LEVELS, '')} AS level, {of_pattern(V.PATTERN_TEXTS, V.PATTERN_OTHER_TEXT)} AS analysis FROM ({inner})"
    luck = chain([(f"level = {text(lv)}", text(t)) for lv, t in zip(V.LEVELS, V.LUCK_TEXTS, strict=True)], text(V.LUCK_OTHER_TEXT))
    advice = {k: "；".join(v) + "；" for k, v in V.PALACE_SUGGESTIONS.items()}
    first = chain([("level IN ('大吉', '吉')", text(advice["吉"])), ("level IN ('凶', '大凶')", text(advice["凶"])), ("level = '平'", text(advice["平"]))], "''")
    return f"SELECT *, {luck} AS luck, ({first} || '用神在' || significator || '方，该方位为当前重要方位') AS suggestions FROM ({inner})"


# -- twelve branches -------------------------------------------------------------------------------------------------
def _lessons(q: Dialect, src: str, drawn: bool = False) -> str:
    """src with stem ds, branch db, hour branch hb and hour stem hs, of the time or drawn by the id, each for itself."""
    if drawn:
        return f"SELECT *, {', '.join(q.pick(c, 'CAST(id AS STRING)', n) + f' AS {c}' for c, n in (('ds', 10), ('db', 12), ('hs', 10), ('hb', 12)))} FROM {src}"
    inner = f"SELECT *, {C.day_stem(q, 'ts', 'lesson')} AS ds, {C.day_branch(q, 'ts', 'lesson')} AS db, {C.hour_branch(q, 'ts')} AS hb FROM {src}"
    return f"SELECT *, {C.hour_stem(q, 'ds', 'hb')} AS hs FROM ({inner})"


def twelve_lessons(q: Dialect, src: str, drawn: bool = False, also: dict[str, str] | None = None) -> str:
    """id, day and hour, four lessons, three transmissions above and below, helper and obstacle, type and level; also: more columns over the stems and branches ds, db, hs, hb."""
    over = lambda b: q.mod(f"({b} + ds)", 12)
    z = lambda x: q.at(V.BRANCHES, x)
    r, t = over("db"), over("hb")
    above = [q.mod(f"({r} + {k})", 12) for k in range(3)]
    main = E.branch_element(q, r)
    kind = f"CASE WHEN ds = 0 THEN {q.pick('lesson', 'CAST(id AS STRING)', 6)} ELSE 1 END"
    inner = select(
        (also or {}) | {"id": "id", "day_name": C.named(q, "ds", "db"), "hour_name": C.named(q, "hs", "hb"), "lesson1": f"({z(r)} || '/' || {z('db')})", "lesson2": f"({z(t)} || '/' || {z('hb')})", "lesson3": f"({z(r)} || '克' || {z('db')})", "lesson4": f"({z(t)} || '克' || {z('hb')})",
         "above": "(" + " || ' ' || ".join(z(x) for x in above) + ")", "below": "(" + " || ' ' || ".join(z(q.mod(f"({x} - ds)", 12)) for x in above) + ")", "course": "'连茹'", "helper": q.at(V.ELEMENTS, q.mod(f"({main} - 1)", 5)), "obstacle": q.at(V.ELEMENTS, q.mod(f"({main} + 3)", 5)), "kind": kind,
         "main": z(r), "time_advice": chain([("hour(ts) BETWEEN 5 AND 10", text(V.DAY_PART_TEXTS[0])), ("hour(ts) BETWEEN 11 AND 14", text(V.DAY_PART_TEXTS[1])), ("hour(ts) BETWEEN 15 AND 18", text(V.DAY_PART_TEXTS[2]))], text(V.DAY_PART_TEXTS[3]))},
        f"({_lessons(q, src, drawn)})",
    )
    luck = q.at([V.LESSON_LUCK[lv] for lv in V.LESSON_LEVELS], "kind")
    columns = {c: c for c in also or {}} | {c: c for c in "id day_name hour_name lesson1 lesson2 lesson3 lesson4 above below course helper obstacle".split()} | {
        "lesson_type": q.at(V.LESSON_TYPES, "kind"), "level": q.at(V.LESSON_LEVELS, "kind"), "overall": f"('课体为' || {q.at(V.LESSON_TYPES, 'kind')} || '，' || {q.at(V.LESSON_TEXTS, 'kind')} || '。' || {luck})",
        "on_main": "('用神为' || main || '，主事之神，代表所占之事的核心。')", "on_helper": "('原神为' || helper || '，生助用神，为有利因素。')", "on_obstacle": "('忌神为' || obstacle || '，克制用神，为不利因素。')",
        "on_course": "('初传' || substr(above, 1, 1) || '，中传' || substr(above, 3, 1) || '，末传' || substr(above, 5, 1) || '，显示事情发展过程。')", "forecast": "('根据用神' || main || '的情况，事情发展趋势总体向好。')", "time_advice": "time_advice",
    }
    return select(columns, f"({inner})")


def plate_columns(q: Dialect, i: str) -> dict[str, str]:
    """The slot i (from 1)."""
    p = f"({q.mod('(ds + ' + q.div('hour(ts)', 2) + ')', 12)} + 1)"
    return {"slot": integer(i), "earth": q.at(V.BRANCHES, f"{i} - 1"), "heaven": q.at(V.BRANCHES, q.mod(f"(ds + {i} - 1)", 12)), "general": q.at(V.GENERALS, q.mod(f"({p} + {i} - 1)", 12))}


def twelve_plates(q: Dialect, src: str, drawn: bool = False) -> str:
    """id, slot, earth and heaven branches, general of each of twelve slots."""
    return select({"id": "id"} | plate_columns(q, "i"), f"({_lessons(q, src, drawn)}) __l", q.each(1, 12, "i"))


# -- purple star (repaired: the bureau's numeral is read) ------------------------------------------------------------
def star_places() -> list[int]:
    """The first star's position by bureau (2 to 6) and day (1 to 30): days go in groups of bureau - 1, which begin a step later each and run backwards."""
    rows = []
    for n in range(2, 7):
        for d in range(1, 31):
            group, place = divmod(d - 1, n - 1)
            rows.append((d // 2) % 12 + 1 if n == 2 else (group + n - 2 - place) % 12 + 1)
    return rows


def purple_base(q: Dialect, src: str) -> str:
    """src with life (position of the first house), bureau (0 to 4), z and t (first stars' positions), ys and yb."""
    hour = E.residue(q, C.hour_branch(q, "ts"), 12)
    life = E.residue(q, f"({E.residue(q, '(14 - month(ts))', 12)} + {hour} - 1)", 12)
    inner = f"SELECT *, {life} AS life, {q.mod('(year(ts) + month(ts) + day(ts))', 5)} AS bureau, {C.year_index(q, 'year(ts)', 10)} AS ys, {C.year_index(q, 'year(ts)', 12)} AS yb FROM {src}"
    inner = f"SELECT *, {q.at(star_places(), 'bureau * 30 + least(day(ts), 30) - 1')} AS z FROM ({inner})"
    return f"SELECT *, {q.mod('(z + 5)', 12)} + 1 AS t FROM ({inner})"


def house_columns(q: Dialect, i: str) -> dict[str, str]:
    """The house i (from 0) of purple_base's rows."""
    return {"ord": integer(i), "house": q.at(V.HOUSES, i), "position": integer(f"{q.mod(f'(life + {i} - 1)', 12)} + 1"), "branch": q.at(V.BRANCHES, q.mod(f"(life + {i} + 1)", 12)), "stem": q.at(V.STEMS, q.mod(f"(ys * 2 + life - 1 + {i})", 10))}


def master_columns(q: Dialect) -> dict[str, str]:
    return {"bureau": q.at(V.BUREAUS, "bureau"), "life_master": q.at(V.LIFE_MASTERS, "yb"), "body_master": q.at(V.BODY_MASTERS, "yb")}


def purple_houses(q: Dialect, src: str) -> str:
    """id, ord, house, position, stem and branch of each of twelve houses, bureau and masters."""
    return select({"id": "id"} | house_columns(q, "i") | master_columns(q), f"({purple_base(q, src)}) __b", q.each(0, 11, "i"))


def _stars(q: Dialect) -> dict[str, str]:
    """Each star's position, 1 to 12."""
    out = {s: f"({q.mod(f'(z + {o} + 11)', 12)} + 1)" for s, o in V.PURPLE_GROUP.items()}
    out |= {s: f"({q.mod(f'(t + {o} - 1)', 12)} + 1)" for s, o in V.TREASURY_GROUP.items()}
    out |= {"文昌": f"({q.mod('(month(ts) + 3)', 12)} + 1)", "文曲": f"({q.mod('(15 - month(ts))', 12)} + 1)", "左辅": f"({q.mod('(month(ts) + 1)', 12)} + 1)", "右弼": f"({q.mod('(13 - month(ts))', 12)} + 1)"}
    return out | {"天魁": q.at([a for a, _ in V.NOBLE_PLACES], "ys"), "天钺": q.at([b for _, b in V.NOBLE_PLACES], "ys")}


def purple_stars(q: Dialect, src: str) -> str:
    """id, star, house, change: where each star is, and the transformation that the year's stem gives it."""
    places = _stars(q)
    names = list(places)
    at = chain([(f"k = {n}", places[s]) for n, s in enumerate(names[:-1])], places[names[-1]])
    changed = [row.split().index(s) if s in row.split() else -1 for row in V.CHANGED_STARS for s in names]
    inner = f"SELECT id, k, life, {at} AS place, {q.at(changed, f'ys * {len(names)} + k')} AS ch FROM ({purple_base(q, src)}) __b {q.each(0, len(names) - 1, 'k')}"
    return f"SELECT id, {q.at(names, 'k')} AS star, {q.at(V.HOUSES, q.mod('(place - life)', 12))} AS house, CASE WHEN ch >= 0 THEN {q.at(V.CHANGES, 'greatest(ch, 0)')} END AS change FROM ({inner})"


def purple_reading(q: Dialect, src: str, also: dict[str, str] | None = None) -> str:
    """id, pattern of the life house, score (two for each main star of three houses, three for a lucky one in the first); also: more columns over purple_base."""
    s = _stars(q)
    here = lambda star: f"{s[star]} = life"
    purple = chain([(here(x), text(n)) for x, n in (("天府", "紫府同宫格"), ("贪狼", "紫贪同宫格"), ("天相", "紫相同宫格"), ("七杀", "紫杀同宫格"), ("破军", "紫破同宫格"))], "'紫微独坐格'")
    pattern = chain([(here("紫微"), purple), (here("天府"), "'天府坐命格'"), (f"{here('武曲')} AND {here('天相')}", "'武曲天相格'"), (here("武曲"), "'武曲坐命格'")], "'特殊格局'")
    main = [*V.PURPLE_GROUP, *V.TREASURY_GROUP]
    count = lambda house: "(" + " + ".join(f"CASE WHEN {q.mod(f'({s[x]} - life)', 12)} = {house} THEN 1 ELSE 0 END" for x in main) + ")"
    lucky = " OR ".join(here(x) for x in ("文昌", "文曲", "左辅", "右弼", "天魁", "天钺"))
    score = f"(2 * {count(0)} + CASE WHEN {lucky} THEN 3 ELSE 0 END + 2 * {count(8)} + 2 * {count(4)})"
    inner = select({"id": "id", "pattern": pattern, "score": integer(score)} | (also or {}), f"({purple_base(q, src)})")
    return f"SELECT *, {integer(chain([('score >= 15', '3'), ('score >= 10', '2'), ('score >= 5', '1')], '0'))} AS tier, {chain([('score >= 15', text(V.LIFE_TIERS[3])), ('score >= 10', text(V.LIFE_TIERS[2])), ('score >= 5', text(V.LIFE_TIERS[1]))], text(V.LIFE_TIERS[0]))} AS tier_text FROM ({inner})"


def purple_texts(q: Dialect, src: str) -> str:
    return select({"id": "id"} | purple_text_columns(q), f"({purple_base(q, src)})")


def purple_text_columns(q: Dialect) -> dict[str, str]:
    """Over purple_base: the texts on life, office, money, spouse and illness, the tier's text, advantages, challenges and suggestions; src has gender."""
    places = _stars(q)
    main = [*V.PURPLE_GROUP, *V.TREASURY_GROUP]
    changed = {c: chain([(f"ys = {g}", places[row.split()[k]]) for g, row in enumerate(V.CHANGED_STARS[:-1])], places[V.CHANGED_STARS[-1].split()[k]]) for k, c in enumerate(V.CHANGES)}
    house = {h: k for k, h in enumerate(V.HOUSES)}

    def inside(star: str, h: str) -> str:
        return f"({q.mod(f'({places.get(star) or changed[star]} - life)', 12)} = {house[h]})"

    def said(pairs: list[tuple[str, str]], sep: str = "") -> str:
        """The texts whose conditions hold, in order."""
        return f"concat_ws({text(sep)}, {', '.join(f'CASE WHEN {c} THEN {text(t)} END' for c, t in pairs)})"

    def empty(h: str) -> str:
        return f"({' + '.join(f'CASE WHEN {inside(s, h)} THEN 1 ELSE 0 END' for s in main)} = 0)"

    def any_of(stars, h: str) -> str:
        return "(" + " OR ".join(inside(s, h) for s in stars) + ")"

    life = [(inside(s, "命宫"), f"{V.MAIN_STAR_TEXTS[s][0]}。性格特点：{V.MAIN_STAR_TEXTS[s][1]}。") for s in main] + [(any_of(stars, "命宫"), t) for stars, t in V.LIFE_TEXTS]
    office = [("1 = 1", V.OFFICE_TEXTS[""]), (empty("官禄"), V.OFFICE_TEXTS["none"])] + [(inside(s, "官禄"), V.OFFICE_TEXTS.get(s, f"{s}入官禄，")) for s in main] + [(inside("化权", "官禄"), V.OFFICE_TEXTS["化权"])]
    money = [("1 = 1", V.MONEY_TEXTS[""])] + [(inside(s, "财帛"), t) for s, t in V.MONEY_TEXTS.items() if s]
    spouse = [("1 = 1", V.SPOUSE_TEXTS[""]), (inside("天同", "夫妻"), V.SPOUSE_TEXTS["天同"]), (f"{inside('太阴', '夫妻')} AND gender = '男'", V.SPOUSE_TEXTS["男"]), (f"{inside('太阴', '夫妻')} AND gender <> '男'", V.SPOUSE_TEXTS["女"]), (inside("贪狼", "夫妻"), V.SPOUSE_TEXTS["贪狼"]), (inside("化科", "夫妻"), V.SPOUSE_TEXTS["化科"])]
    illness = [("1 = 1", V.ILLNESS_TEXTS[""]), (empty("疾厄"), V.ILLNESS_TEXTS["none"])] + [(inside(s, "疾厄"), V.ILLNESS_TEXTS[s]) for s in ("天同", "太阳", "化忌")]
    # A life house has two main stars at most, so no list below grows beyond five but the suggestions, whose last one may be cut.
    advantages = [(inside(s, "命宫"), V.MAIN_STAR_TEXTS[s][1].split("、")[0]) for s in main] + [(any_of(stars, "命宫"), t) for stars, t in V.ADVANTAGES]
    challenges = [(inside("化忌", "命宫"), V.CHALLENGES[0]), (empty("命宫"), V.CHALLENGES[1])]
    first = [(inside(s, "命宫"), t) for s, t in V.LIFE_SUGGESTIONS.items()]
    n_first = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in first)
    suggestions = first + [(f"NOT {empty('官禄')}", V.OFFICE_SUGGESTIONS[0]), (empty("官禄"), V.OFFICE_SUGGESTIONS[1])] + [(f"{n_first} <= {3 - k}", t) for k, t in enumerate(V.CLOSING_SUGGESTIONS)]
    return {"life": said(life), "office": said(office), "money": said(money), "spouse": said(spouse), "illness": said(illness), "advantages": said(advantages, "、"), "challenges": said(challenges, "；"), "suggestions": said(suggestions, "；")}


# -- almanac lists ---------------------------------------------------------------------------------------------------
def drawn(name: str, pool: list[str], n: str, forced: list[tuple[str, str]], day: str) -> str:
    """An array of n of the pool's items without repeats of an entry, in the row: forced items (item, condition) first, the others by a hash of name, day, item and, as the pool may hold an item twice, place."""
    twice = len(set(pool)) < len(pool)
    first = chain([(f"x = {text(x)} AND {c}", str(k)) for k, (x, c) in enumerate(forced)], "99") if forced else "99"
    digest = SPARK.hashed(name, f"{day} || x" + (" || CAST(k AS STRING)" if twice else ""))
    return f"transform(slice(array_sort(transform(array({', '.join(map(text, pool))}), (x, k) -> struct({first} AS f, {digest} AS h, x AS x, k AS k))), 1, CAST({n} AS INT)), y -> y.x)"


def almanac_base(src: str, *carry: str) -> str:
    """src's dates d with ts, day (text), arrays suitable, taboo, good and bad, and level (1 to 5); Spark SQL without a join, window or shuffle."""
    q = SPARK
    week, early = q.weekday("ts"), "day(ts) <= 8"
    inner = f"SELECT d, CAST(d AS {q.stamp}) AS ts, {q.day_text('d')} AS day{''.join(', ' + c for c in carry)} FROM {src}"
    distinct = lambda pool: list(dict.fromkeys(pool))
    lists = {
        "suitable": drawn("suitable", distinct(V.SUITABLE), f"({q.pick('suitable', 'day', 4)} + 4)", [("嫁娶", f"{week} >= 6"), ("出行", f"{week} >= 6"), ("开市", early), ("入宅", early)], "day"),
        "taboo": drawn("taboo", distinct(V.TABOO), f"({q.pick('taboo', 'day', 3)} + 3)", [("嫁娶", "day(ts) = 13"), ("安葬", f"{week} = 5")], "day"),
        "good": drawn("good", V.GOOD_SPIRITS, f"({q.pick('good', 'day', 3)} + 2)", [], "day"),
        "bad": drawn("bad", V.BAD_SPIRITS, f"({q.pick('bad', 'day', 3)} + 2)", [], "day"),
    }
    inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in lists.items())} FROM ({inner})"
    score = "(2 * size(suitable) - size(taboo) + size(good) - size(bad))"
    return f"SELECT *, {integer(chain([(f'{score} >= 15', '5'), (f'{score} >= 10', '4'), (f'{score} >= 5', '3'), (f'{score} >= 0', '2')], '1'))} AS level FROM ({inner})"


def fortune_columns() -> dict[str, str]:
    """Over almanac_base: the level's text and the day's picks."""
    pick = lambda name, values: SPARK.at(values, SPARK.pick(name, "day", len(values)))
    return {"level_text": SPARK.at(V.LUCK_LEVELS, "level - 1"), "lucky_number": integer(SPARK.pick("number", "day", 99) + " + 1"), "love": pick("love", V.LOVE_ADVICE), "career": pick("career", V.CAREER_ADVICE), "wealth": pick("wealth", V.WEALTH_ADVICE), "health": pick("health", V.HEALTH_ADVICE)}


_LISTS = {"day": "day"} | {n: f"array_join({n}, ' ')" for n in ("suitable", "taboo", "good", "bad")} | {"level": "level"}


def drawn_lists(q: Dialect, src: str) -> str:
    """day, suitable, taboo, good, bad, level, level_text and fortune of each date d: forced items first, the others by keyed hashes without repeats."""
    return select(_LISTS | fortune_columns(), f"({almanac_base(src)})")


def advice_on(activity: str) -> str:
    """What almanac_base's lists say of an activity: one that is in both lists is to be done with care."""
    fit, unfit = (f"exists({n}, x -> contains(x, {activity}))" for n in ("suitable", "taboo"))
    return chain([(f"{fit} AND NOT {unfit}", "'非常适宜'"), (fit, "'谨慎进行'"), (unfit, "'不宜进行'")], "'普通日子'")


def activity_advice(q: Dialect, src: str) -> str:
    """day, activity, advice: ten activities against a day's lists."""
    return f"SELECT day, activity, {advice_on('activity')} AS advice FROM (SELECT l.*, {q.at(V.ACTIVITIES, 'i')} AS activity FROM ({almanac_base(src)}) l {q.each(0, 9, 'i')})"


def almanac_day(q: Dialect, src: str) -> str:
    """One record a date d: what the calendar says of it, its lists and its fortune."""
    taken = ("lunar_date", "day_almanac", "animal", "sign", "clash_text", "taboos", "melodic", "officer", "mansion", "womb", "colour", "direction")
    of_day = C.calendar_columns(q)
    return select(_LISTS | fortune_columns() | {x: of_day[x] for x in taken}, f"({almanac_base(src)})")


def star_classes(q: Dialect, src: str) -> str:
    """star, class: whether each of the lesser stars (star) is lucky, harmful, a transformation or another."""
    listed = lambda names: ", ".join(map(text, names))
    said = chain([(f"star IN ({listed(V.LUCKY_STARS)})", "'吉星'"), (f"star IN ({listed(V.HARMFUL_STARS)})", "'煞星'"), (q.contains("star", "'化'"), "'四化'")], "'其他'")
    return f"SELECT id, star, {said} AS class FROM {src}"
