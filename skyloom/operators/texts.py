"""Keyword dictionaries over texts, and searches of catalogs."""

from __future__ import annotations

from ..functions.dialect import Dialect, chain, integer, text
from ..sources import fixed as V


#: What counts as blank at a text's ends: a text of nothing else has no reading.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def dream_terms() -> list[tuple[int, str]]:
    """(ord, word) of every word of the dictionary."""
    return [(k, w) for k, (word, _, _, others) in enumerate(V.DREAMS) for w in (word, *others.split())]


def dream_dictionary(q: Dialect) -> str:
    return q.rows([(k, w, kind, good) for k, (w, kind, good, _) in enumerate(V.DREAMS)], "ord, keyword, kind, good")


def dreams_by_kind(q: Dialect, words: str) -> str:
    """word, keyword: the entries of the kind that a word names; words: a source of (word)."""
    return f"SELECT word, keyword, good FROM {words} __w JOIN {dream_dictionary(q)} __d ON kind = word"


def books(q: Dialect) -> str:
    rows = [(k, *b, *n) for k, (b, n) in enumerate(zip(V.BOOKS, V.BOOK_NOTES, strict=True))]
    return q.rows(rows, "ord, book, title, author, category, core, keywords, dynasty, file_name, description")


def search_books(q: Dialect, words: str) -> str:
    """word, book: the books whose title, author, description or keywords have the word, literally and whatever its case; a blank word finds none.  words: a source of (word)."""
    hay = "lower(concat_ws(' ', title, author, description, keywords))"
    return f"SELECT word, book, title FROM {words} __w JOIN {books(q)} __b ON {q.contains(hay, 'lower(word)')} AND length(trim(word)) > 0"


def books_of(q: Dialect, words: str) -> str:
    """The books of the category that a word names, in order, with all they have; words: a source of (word)."""
    return f"SELECT word, {integer('ord')} AS ord, book, title, author, dynasty, file_name, description, core, {q.first_parts('keywords', ' ', 3)} AS keywords FROM {words} __w JOIN {books(q)} __b ON category = word"


def signs_by_kind(q: Dialect, words: str) -> str:
    """word, sign (1 to 20): the signs of the kind that a word names, and, for a number, the sign of that number; words: a source of (word)."""
    signs = q.rows([(k + 1, t) for k, t in enumerate(V.SIGN_TYPES)], "sign, kind")
    return f"SELECT word, {integer('sign')} AS sign, kind FROM {words} __w JOIN {signs} __s ON kind = word OR CAST(sign AS STRING) = word"


def classic_drawn(q: Dialect, src: str) -> str:
    """id, number, name of the hexagram that each id draws, by a keyed hash."""
    k = q.pick("classic", "CAST(id AS STRING)", len(V.CLASSIC_HEXAGRAMS))
    return f"SELECT id, {integer(k + ' + 1')} AS number, {q.at([h[1] for h in V.CLASSIC_HEXAGRAMS], k)} AS name FROM {src}"


def daily_sign(q: Dialect, src: str) -> str:
    """id, sign (1 to 20) and kind of the day of ts, and the sign of its millisecond."""
    day = q.mod("(year(ts) * 10000 + month(ts) * 100 + day(ts))", len(V.SIGN_TYPES))
    millis = "unix_millis(CAST(ts AS TIMESTAMP))" if q.spark else "(epoch_us(ts) // 1000)"
    return f"SELECT id, {integer(day + ' + 1')} AS sign, {q.at(V.SIGN_TYPES, day)} AS kind, {integer(q.mod(millis, 20) + ' + 1')} AS moment_sign FROM {src}"
