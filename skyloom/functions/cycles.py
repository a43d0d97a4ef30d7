"""Calendar and sexagenary cycles of a zone-free timestamp expression."""

from __future__ import annotations

from ..sources import fixed as V
from .dialect import Dialect, chain, integer, text

#: The conventions of the day cycle disagree and are never unified: (anchor, stem's offset, branch's offset).
DAY_CYCLES = {"pillar": ("1900-01-01", 10, 10), "almanac": ("1984-02-02", 0, 0), "six_line": ("1900-01-01", 9, 1), "lesson": ("1900-01-01", 0, 0)}
#: The day's number runs through 60 first in this convention.
SIXTY_FIRST = ("lesson",)


def year_index(q: Dialect, y: str, n: int) -> str:
    return q.mod(f"({y} - 4)", n)


def pillar_year(q: Dialect, ts: str) -> str:
    """The year that begins on February 4."""
    return f"(year({ts}) - CASE WHEN month({ts}) * 100 + day({ts}) < 204 THEN 1 ELSE 0 END)"


def term_date(q: Dialect, y: str, term: int) -> str:
    """The date of a solar term, by its number from 0; months wrap inside the year."""
    month = (term // 2 + 1) % 12 + 1
    return f"make_date(CAST({y} AS INT), {month}, {V.SOLAR_TERM_DAYS[term]})"


def solar_month(q: Dialect, ts: str, mode: str = "compat") -> str:
    """1 to 12.  compat: always 12, as the last term that is tried falls in January; corrected: by the last monthly term."""
    if mode == "compat":
        return "12"
    day = f"(month({ts}) * 100 + day({ts}))"
    starts = [((t // 2 + 1) % 12 + 1) * 100 + V.SOLAR_TERM_DAYS[t] for t in range(0, 24, 2)]  # February to January
    return chain([(f"{day} >= {s}", str(k + 1)) for k, s in reversed(list(enumerate(starts[:11])))], f"CASE WHEN {day} >= {starts[11]} THEN 12 ELSE 11 END")


def day_stem(q: Dialect, ts: str, convention: str) -> str:
    anchor, stem, _ = DAY_CYCLES[convention]
    days = q.day_count(anchor, ts)
    return q.mod(q.mod(days, 60) if convention in SIXTY_FIRST else f"({days} + {stem})", 10)


def day_branch(q: Dialect, ts: str, convention: str) -> str:
    anchor, _, branch = DAY_CYCLES[convention]
    days = q.day_count(anchor, ts)
    return q.mod(q.mod(days, 60) if convention in SIXTY_FIRST else f"({days} + {branch})", 12)


def named(q: Dialect, stem: str, branch: str) -> str:
    return f"({q.at(V.STEMS, stem)} || {q.at(V.BRANCHES, branch)})"


def day_name(q: Dialect, ts: str, convention: str) -> str:
    return named(q, day_stem(q, ts, convention), day_branch(q, ts, convention))


def hour_branch(q: Dialect, ts: str) -> str:
    """23:00 is the first hour, of the same day."""
    return q.mod(q.div(f"hour({ts}) + 1", 2), 12)


def hour_stem(q: Dialect, stem: str, branch: str) -> str:
    return q.mod(f"({stem} * 2 + {branch})", 10)


def sixty(q: Dialect, stem: str, branch: str) -> str:
    """The place of a stem and a branch in the cycle of sixty."""
    return q.mod(f"(6 * {stem} - 5 * {branch})", 60)


def lunar_year(q: Dialect, ts: str) -> str:
    return f"(year({ts}) - CASE WHEN month({ts}) <= 2 THEN 1 ELSE 0 END)"


def lunar_month(q: Dialect, ts: str) -> str:
    return f"(month({ts}) + CASE WHEN month({ts}) <= 2 THEN 10 ELSE -2 END)"


def zodiac_sign(q: Dialect, ts: str) -> str:
    """A sign too early by design of the rule: kept as it is."""
    month = f"(month({ts}) - 1)"
    return q.at(V.SIGNS_OF_ZODIAC, q.mod(f"({month} - CASE WHEN day({ts}) < {q.at(V.SIGN_FIRST_DAYS, month)} THEN 1 ELSE 0 END)", 12))


def month_branch(q: Dialect, ts: str) -> str:
    return q.at(V.BRANCHES, q.mod(f"(month({ts}) - 1)", 12))


def pillars(q: Dialect, src: str, mode: str = "compat") -> str:
    """src (id, ts, ...) with the numbers of the four pillars: ys, yb, ms, mb, ds, db, hb, hs."""
    y = pillar_year(q, "ts")
    month = solar_month(q, "ts", mode)
    inner = f"SELECT *, {year_index(q, y, 10)} AS ys, {year_index(q, y, 12)} AS yb, {month} AS sm, {day_stem(q, 'ts', 'pillar')} AS ds, {day_branch(q, 'ts', 'pillar')} AS db, {hour_branch(q, 'ts')} AS hb FROM {src}"
    return f"SELECT *, {q.mod('(ys * 2 + 2 + sm - 1)', 10)} AS ms, {q.mod('(sm + 1)', 12)} AS mb, {hour_stem(q, 'ds', 'hb')} AS hs FROM ({inner})"


def calendar_columns(q: Dialect) -> dict[str, str]:
    """The deterministic attributes of the day and hour of ts."""
    ly, lm = lunar_year(q, "ts"), lunar_month(q, "ts")
    days = q.day_count("1984-02-02", "ts")
    s, b = q.mod(days, 10), q.mod(days, 12)
    return {
        "year_name": named(q, year_index(q, "year(ts)", 10), year_index(q, "year(ts)", 12)),
        "animal": q.at(V.ANIMALS, year_index(q, "year(ts)", 12)),
        "day_almanac": day_name(q, "ts", "almanac"),
        "day_pillar": day_name(q, "ts", "pillar"),
        "day_six_line": day_name(q, "ts", "six_line"),
        "day_lesson": day_name(q, "ts", "lesson"),
        "month_branch": month_branch(q, "ts"),
        "lunar_year": integer(ly),
        "lunar_month": integer(lm),
        "lunar_date": f"('农历' || {q.at(V.LUNAR_MONTHS, f'({lm} - 1)')} || {q.at(V.LUNAR_DAYS, 'least(day(ts), 30) - 1')})",
        "lunar_year_name": day_name(q, q.first_of(f"CAST({ly} AS INT)"), "almanac"),
        "lunar_month_name": day_name(q, q.first_of(f"CAST({ly} AS INT)", f"CAST({lm} AS INT)"), "almanac"),
        "sign": zodiac_sign(q, "ts"),
        "officer": q.at(V.OFFICERS, q.mod("(day(ts) - 1)", 12)),
        "mansion": q.at(V.MANSIONS, q.mod(q.day_count("2024-01-01", "ts"), 28)),
        "womb": q.at(V.WOMB_PLACES, q.mod("(day(ts) - 1)", 30)),
        "melodic": f"CASE WHEN {q.mod(f'({s} - {b})', 2)} = 0 THEN {q.at(V.MELODIC, q.div(sixty(q, s, b), 2))} ELSE '未知' END",
        "taboos": f"({q.at(V.STEM_TABOOS, s)} || ' ' || {q.at(V.BRANCH_TABOOS, b)})",
        "clash": f"({q.at(V.BRANCHES, q.mod(f'({b} + 6)', 12))} || {q.at(V.ANIMALS, q.mod(f'({b} + 6)', 12))})",
        "clash_text": f"('冲' || {q.at(V.ANIMALS, q.mod(f'({b} + 6)', 12))} || '(' || {q.at(V.STEMS, q.pick('stem', day_name(q, 'ts', 'almanac'), 10))} || {q.at(V.BRANCHES, q.mod(f'({b} + 6)', 12))} || ')煞' || {q.at(V.CLASH_DIRECTIONS, q.pick('side', day_name(q, 'ts', 'almanac'), 8))})",
        "colour": q.at(V.COLOURS, q.mod("day(ts)", 7)),
        "direction": q.at(V.DIRECTIONS, q.mod(q.weekday("ts"), 8)),
        "hour_branch": q.at(V.BRANCHES, hour_branch(q, "ts")),
        "day_part": chain([("hour(ts) BETWEEN 5 AND 10", "'上午'"), ("hour(ts) BETWEEN 11 AND 14", "'中午'"), ("hour(ts) BETWEEN 15 AND 18", "'下午'")], "'夜间'"),
        "half_day": chain([("hour(ts) BETWEEN 6 AND 11", "'上午'"), ("hour(ts) BETWEEN 12 AND 17", "'下午'")], "'晚上'"),
        "day_text": q.day_text("ts"),
        "moment_text": f"(CAST(year(ts) AS STRING) || '年' || CAST(month(ts) AS STRING) || '月' || CAST(day(ts) AS STRING) || '日 ' || {q.clock('ts')})",
    }


def calendar(q: Dialect, src: str) -> str:
    return "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in calendar_columns(q).items()) + f" FROM {src}"


def solar_terms(q: Dialect, src: str) -> str:
    """id, term, starts: each of the 24 terms of the year of ts."""
    when = chain([(f"t = {k}", term_date(q, "year(ts)", k)) for k in range(23)], term_date(q, "year(ts)", 23))
    return f"SELECT id, {q.at(V.SOLAR_TERMS, 't')} AS term, CAST({when} AS {q.stamp}) <= ts AS passed, {q.day_text(when)} AS starts FROM {src} {q.each(0, 23, 't')}"


def age_label(q: Dialect, src: str) -> str:
    """id, label of ts as seen from now_ts: today and yesterday by spans of 24 hours, else a date and time."""
    seconds = "(unix_timestamp(CAST(now_ts AS TIMESTAMP)) - unix_timestamp(CAST(ts AS TIMESTAMP)))" if q.spark else "CAST(floor(epoch(now_ts)) - floor(epoch(ts)) AS BIGINT)"
    clock = q.clock("ts")
    days = q.div(seconds, 86400)
    date = "CAST(month(ts) AS STRING) || '月' || CAST(day(ts) AS STRING) || '日'"
    return f"SELECT id, {chain([(f'{days} = 0', text('今天')), (f'{days} = 1', text('昨天'))], date)} || ' ' || {clock} AS label FROM {src}"
