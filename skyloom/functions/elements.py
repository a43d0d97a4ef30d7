"""Relations of the five elements, and the algebra of trigrams and hexagrams.

Elements are 0 to 4 in the order in which each generates the next; rel(a, b) is 0 same, 1 a generates b, 2 a controls
b, 3 b controls a, 4 b generates a.  Trigrams are 0 to 7 in the order of fixed.TRIGRAMS.
"""

from __future__ import annotations

from ..sources import fixed as V
from .dialect import Dialect, chain

BRANCH_ELEMENT = [V.ELEMENTS.index(e) for e in V.BRANCH_ELEMENTS]
TRIGRAM_ELEMENT = [V.ELEMENTS.index(e) for e in V.TRIGRAM_ELEMENTS]
EARLY = [V.TRIGRAMS.index(t) for t in V.ORDER_EARLY]
SIX_LINE = [V.TRIGRAMS.index(t) for t in V.ORDER_SIX_LINE]
NAMES = [n for row in V.HEXAGRAMS for n in row.split()]
PALACE_OF = [next(k for k, row in enumerate(V.PALACES) if n in row.split()) for n in NAMES]
#: A trigram's lines as a number: the bottom line is 4.
BITS = [int(x, 2) for x in V.TRIGRAM_LINES]
FLIPPED = [[BITS.index(b ^ (1 << (3 - p))) for p in (1, 2, 3)] for b in BITS]


def rel(q: Dialect, a: str, b: str) -> str:
    return q.mod(f"({b} - {a})", 5)


def stem_element(q: Dialect, stem: str) -> str:
    return q.div(stem, 2)


def branch_element(q: Dialect, branch: str) -> str:
    return q.at(BRANCH_ELEMENT, branch)


def residue(q: Dialect, x: str, n: int) -> str:
    """1 to n."""
    return f"({q.mod(f'({x} - 1)', n)} + 1)"


def hexagram(q: Dialect, upper: str, lower: str) -> str:
    return q.at(NAMES, f"({upper}) * 8 + ({lower})")


def palace(q: Dialect, upper: str, lower: str) -> str:
    return q.at(PALACE_OF, f"({upper}) * 8 + ({lower})")


def line(q: Dialect, trigram: str, p: str) -> str:
    """1 if the trigram's line p (1 to 3 from the bottom) is solid."""
    return q.at([int(c) for x in V.TRIGRAM_LINES for c in x], f"({trigram}) * 3 + ({p}) - 1")


def flip(q: Dialect, trigram: str, p: str) -> str:
    """The trigram with line p turned."""
    return q.at([f for row in FLIPPED for f in row], f"({trigram}) * 3 + ({p}) - 1")


def strength(q: Dialect, element: str, month: str, day: str) -> str:
    """An element's strength under those of the month and the day."""
    score = f"({q.at([2, 1, -2, 0, 0], rel(q, month, element))} + {q.at([1, 1, -1, 0, 0], rel(q, day, element))})"
    return chain([(f"{score} >= 2", "'旺相'"), (f"{score} >= 0", "'中和'")], "'休囚'")


def relations(q: Dialect, src: str) -> str:
    """id and every table of relations, for elements a and b of src."""
    r = rel(q, "a", "b")
    columns = {
        "generates": f"({r} = 1)", "controls": f"({r} = 2)", "ten_god": q.at(V.TEN_GODS, r), "kin": q.at(V.SIX_KIN, r), "body_use": q.at(V.BODY_USE, r), "lesson_kin": q.at(V.LESSON_KIN, r),
        "helper": q.at(V.ELEMENTS, q.mod("(a - 1)", 5)), "obstacle": q.at(V.ELEMENTS, q.mod("(a + 3)", 5)), "answer": q.at(V.RELATION_TEXTS, r), "strength": strength(q, "a", "b", q.mod("(a + b)", 5)),
    }
    return "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {src}"


def short_name(q: Dialect, upper: str, lower: str) -> str:
    """Both trigrams' names; of a doubled one its name and element."""
    return f"CASE WHEN {upper} = {lower} THEN {q.at(V.TRIGRAMS, upper)} || '为' || {q.at(V.TRIGRAM_ELEMENTS, upper)} ELSE {q.at(V.TRIGRAMS, upper)} || {q.at(V.TRIGRAMS, lower)} END"


def line_symbol(q: Dialect, solid: str, moving: str) -> str:
    """How a line is drawn; solid and moving are conditions."""
    return q.at(V.LINE_SYMBOLS, f"(CASE WHEN {solid} THEN 1 ELSE 0 END + CASE WHEN {moving} THEN 2 ELSE 0 END)")


def likeness(q: Dialect, src: str) -> str:
    """id, trigram, category, stands_for: what trigram u stands for in a category, of which p is the number (from 1); empty for an unknown one."""
    names = list(V.LIKENESS)
    every = [x for n in names for x in V.LIKENESS[n]]
    return f"SELECT id, {q.at(V.TRIGRAMS, 'u')} AS trigram, coalesce({q.at(names, 'p - 1')}, 'other') AS category, coalesce({q.at(every, '(p - 1) * 8 + u')}, '') AS stands_for FROM {src}"


def stems_and_branches(q: Dialect, src: str) -> str:
    """id and the attributes of stem s and branch b."""
    columns = {"stem": q.at(V.STEMS, "s"), "stem_element": q.at(V.ELEMENTS, stem_element(q, "s")), "polarity": q.at(V.STEM_POLARITY, "s"), "branch": q.at(V.BRANCHES, "b"), "branch_element": q.at(V.BRANCH_ELEMENTS, "b"), "hidden": q.at(V.HIDDEN_STEMS, "b"), "animal": q.at(V.ANIMALS, "b")}
    return "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {src}"


def hexagrams(q: Dialect, src: str) -> str:
    """id and the hexagram of trigrams u over l, its palace, its lines, and itself with line p (1 to 6) turned."""
    lower_changes = "p <= 3"
    cu, cl = f"CASE WHEN {lower_changes} THEN u ELSE {flip(q, 'u', 'greatest(p - 3, 1)')} END", f"CASE WHEN {lower_changes} THEN {flip(q, 'l', 'least(p, 3)')} ELSE l END"
    lines = " || ".join(f"CAST({line(q, t, str(k))} AS STRING)" for t in "lu" for k in (1, 2, 3))
    return f"SELECT id, {hexagram(q, 'u', 'l')} AS name, {q.at(V.TRIGRAMS, palace(q, 'u', 'l'))} AS palace, {lines} AS lines, {hexagram(q, cu, cl)} AS changed, {short_name(q, 'u', 'l')} AS short_name FROM {src}"
