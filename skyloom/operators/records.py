"""Nested result records: each chart once a row, as structs and arrays of structs from one pass over its base, and relational forms exploded from the record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cycles as C
from ..functions import elements as E
from ..functions.dialect import SPARK, integer, text
from ..sources import fixed as V
from . import charts as H


def _struct(columns: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in columns.items()) + ")"


def _each(first: int, last: int, columns) -> str:
    """An array of structs, one for each number, of columns(the number)."""
    return f"transform(sequence({first}, {last}), n -> {_struct(columns('n'))})"


def _over(rows: DataFrame, sql: str) -> DataFrame:
    return rows.sparkSession.sql(sql, rows=rows)


def four_pillar_record(rows: DataFrame, as_of_year: int, mode: str = "compat") -> DataFrame:
    """rows (id, ts, gender): id, pillars (array of name, stem, branch, their elements, polarity, hidden stems, god), luck (eight decades), year (as_of_year's name, the age, the decade that holds it or null), elements (the five counts), analysis."""
    q = SPARK

    def pillar(name: str, k: str) -> str:
        stem, branch = f"{k}s", f"{k}b"
        return _struct({
            "pillar": text(name), "stem": q.at(V.STEMS, stem), "branch": q.at(V.BRANCHES, branch), "stem_element": q.at(V.ELEMENTS, E.stem_element(q, stem)), "branch_element": q.at(V.BRANCH_ELEMENTS, branch), "polarity": q.at(V.STEM_POLARITY, stem),
            "hidden": f"split({q.at(V.HIDDEN_STEMS, branch)}, '')", "god": q.at(V.TEN_GODS, E.rel(q, E.stem_element(q, "ds"), E.stem_element(q, stem))),
        })

    base = f"SELECT *, {H.scarcest(q)} AS k FROM ({H.element_counts(q, '{rows}', mode)})"
    texts = H.element_texts(q)
    analysis = {"pattern": text(V.PATTERN)} | {c: texts[c] for c in ("scarcest", "favourable", "unfavourable", "personality", "career", "wealth", "marriage", "health", "suggestions")}
    inner = f"SELECT id, ts, gender, array({', '.join(pillar(n, n[0]) for n in ('year', 'month', 'day', 'hour'))}) AS pillars, {_each(0, 7, lambda i: H.luck_columns(q, i))} AS luck, {_struct({n: f'c{e}' for e, n in enumerate(('wood', 'fire', 'earth', 'metal', 'water'))})} AS elements, {_struct(analysis)} AS analysis FROM ({base})"
    year = _struct({"year": str(as_of_year), "name": C.named(q, C.year_index(q, str(as_of_year), 10), C.year_index(q, str(as_of_year), 12)), "age": integer(f"{as_of_year} - year(ts)"), "decade": f"get(filter(luck, x -> {as_of_year} BETWEEN x.from_year AND x.to_year), 0).i"})
    return _over(rows, f"SELECT id, gender, pillars, luck, {year} AS year, elements, analysis FROM ({inner})")


def purple_star_record(rows: DataFrame) -> DataFrame:
    """rows (id, ts, gender): id, bureau and masters, houses (twelve, in order, each with its stars in their order and what the year's stem changes), pattern, score, tier text, analysis."""
    q = SPARK
    places = H._stars(q)
    changed = [row.split().index(s) if s in row.split() else -1 for row in V.CHANGED_STARS for s in places]
    stars = "array(" + ", ".join(_struct({"star": text(s), "main": text(k < 14), "place": integer(p), "change": f"CASE WHEN {q.at(changed, f'ys * {len(places)} + {k}')} >= 0 THEN {q.at(V.CHANGES, 'greatest(' + q.at(changed, f'ys * {len(places)} + {k}') + ', 0)')} END"}) for k, (s, p) in enumerate(places.items())) + ")"
    houses = _each(0, 11, lambda i: H.house_columns(q, i))
    base = H.purple_reading(q, "{rows}", also=H.master_columns(q) | {"stars": stars, "houses": houses, "analysis": _struct(H.purple_text_columns(q))})
    mine = "transform(filter(stars, s -> s.place = h.position), s -> named_struct('star', s.star, 'main', s.main, 'change', s.change))"
    return _over(rows, f"SELECT id, bureau, life_master, body_master, transform(houses, h -> named_struct('ord', h.ord, 'house', h.house, 'position', h.position, 'stem', h.stem, 'branch', h.branch, 'stars', {mine})) AS houses, pattern, score, tier_text, analysis FROM ({base})")


def nine_palace_record(rows: DataFrame, drawn: bool = False) -> DataFrame:
    """rows (id, ts): id, parameters, cells (nine), pattern with level and texts, aspects, directions, suggestions."""
    q = SPARK
    also = {"parameters": _struct({"upper": "pu", "middle": "pm", "lower": "pl", "number": "pj"}), "cells": _each(1, 9, lambda i: H.nine_columns(q, i))}
    aspects = _struct({a: a for a in ("career", "wealth", "love", "health", "study")})
    return _over(rows, f"SELECT id, parameters, cells, {_struct({'name': 'pattern', 'level': 'level', 'description': 'analysis', 'luck': 'luck'})} AS pattern, {aspects} AS aspects, significator, favourable AS direction, favourable_time AS time, suggestions FROM ({H.nine_reading(q, '{rows}', drawn, also)})")


def twelve_branch_record(rows: DataFrame, drawn: bool = False) -> DataFrame:
    """rows (id, ts): id, day and hour, lessons (four), transmissions (three, with what is below), plate (twelve slots), type, relations and texts."""
    q = SPARK
    also = {"plate": _each(1, 12, lambda i: H.plate_columns(q, i))}
    inner = H.twelve_lessons(q, "{rows}", drawn, also)
    texts = _struct({c: c for c in ("overall", "on_main", "on_helper", "on_obstacle", "on_course", "forecast", "time_advice")})
    return _over(rows, f"SELECT id, day_name, hour_name, array(lesson1, lesson2, lesson3, lesson4) AS lessons, transform(arrays_zip(split(above, ' '), split(below, ' ')), x -> named_struct('above', x['0'], 'below', x['1'])) AS transmissions, plate, {_struct({'name': 'lesson_type', 'level': 'level', 'course': 'course'})} AS type, helper, obstacle, {texts} AS analysis FROM ({inner})")


def almanac_record(dates: DataFrame) -> DataFrame:
    """dates (d): d, calendar (struct), suitable, taboo, good, bad (arrays), level, fortune (struct), advice (an array of activity and what is said of it)."""
    q = SPARK
    calendar = {c: e for c, e in C.calendar_columns(q).items() if c not in ("hour_branch", "day_part", "half_day", "day_text", "moment_text")}
    fortune = H.fortune_columns()
    activities = f"transform(array({', '.join(map(text, V.ACTIVITIES))}), a -> named_struct('activity', a, 'advice', {H.advice_on('a')}))"
    return _over(dates, f"SELECT d, {_struct(calendar)} AS calendar, suitable, taboo, good, bad, {_struct({'value': 'level', 'text': fortune.pop('level_text')})} AS level, {_struct(fortune)} AS fortune, {activities} AS advice FROM ({H.almanac_base('{rows}')})")


def exploded(records: DataFrame, array: str, key: str = "id") -> DataFrame:
    """The relational form of one of a record's arrays: the key and the structs' fields, one row an entry."""
    return records.select(key, F.inline(array))
