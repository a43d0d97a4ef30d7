"""Scalar expressions as SQL text: the same formula for Spark and, as its check, for DuckDB."""

from __future__ import annotations


def text(value) -> str:
    """A literal."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


class Dialect:
    """What differs between the two engines."""

    def __init__(self, spark: bool):
        self.spark = spark
        self.stamp = "TIMESTAMP_NTZ" if spark else "TIMESTAMP"

    def at(self, values, index: str) -> str:
        """values[index], counted from 0."""
        items = ", ".join(map(text, values))
        return f"get(array({items}), CAST({index} AS INT))" if self.spark else f"([{items}])[CAST({index} AS INT) + 1]"

    def div(self, a: str, b) -> str:
        """Division of integers, towards zero."""
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def mod(self, a: str, n) -> str:
        """The residue in [0, n)."""
        return f"pmod({a}, {n})" if self.spark else f"((({a}) % {n} + {n}) % {n})"

    def day_count(self, anchor: str, ts: str) -> str:
        """Whole days from the anchor's midnight to ts, towards zero."""
        diff = f"datediff(CAST({ts} AS DATE), DATE'{anchor}')" if self.spark else f"date_diff('day', DATE'{anchor}', CAST({ts} AS DATE))"
        return f"({diff} + CASE WHEN {ts} < {self.stamp}'{anchor} 00:00:00' AND {ts} <> CAST(CAST({ts} AS DATE) AS {self.stamp}) THEN 1 ELSE 0 END)"

    def first_of(self, y: str, m: str = "1") -> str:
        return f"CAST(make_date({y}, {m}, 1) AS {self.stamp})"

    def weekday(self, ts: str) -> str:
        """Monday 1 to Sunday 7."""
        return f"(weekday({ts}) + 1)" if self.spark else f"isodow({ts})"

    def contains(self, s: str, part: str) -> str:
        return f"contains({s}, {part})"

    def pick(self, salt: str, key: str, n) -> str:
        """A number in [0, n) that depends on salt and key alone."""
        return self.mod(self.hashed(salt, key), n)

    def hashed(self, salt: str, key: str) -> str:
        digest = f"substr(md5(concat_ws('|', {text(salt)}, {key})), 1, 8)"
        return f"CAST(conv({digest}, 16, 10) AS BIGINT)" if self.spark else f"CAST('0x' || {digest} AS BIGINT)"

    def day_text(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')" if self.spark else f"strftime({ts}, '%Y-%m-%d')"

    def clock(self, ts: str) -> str:
        return f"date_format({ts}, 'HH:mm')" if self.spark else f"strftime({ts}, '%H:%M')"

    def each(self, first: int, last: int, name: str) -> str:
        """Joins every row with the numbers first to last."""
        if self.spark:
            return f"LATERAL VIEW explode(sequence({first}, {last})) __{name} AS {name}"
        return f"CROSS JOIN (SELECT unnest(range({first}, {last + 1})) AS {name}) __{name}"

    def joined(self, rank: str, item: str, sep: str) -> str:
        """Aggregates items in the order of rank."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({rank} AS r, {item} AS x))), y -> y.x), {text(sep)})"
        return f"string_agg({item}, {text(sep)} ORDER BY {rank})"

    def first_parts(self, s: str, sep: str, n: int) -> str:
        """The first n of the parts of s that sep parts."""
        return f"substring_index({s}, {text(sep)}, {n})" if self.spark else f"array_to_string(string_split({s}, {text(sep)})[1:{n}], {text(sep)})"

    def rows(self, rows, names: str) -> str:
        """A constant table."""
        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS __v({names}))"

    def units(self, s: str) -> str:
        """The number of UTF-16 units."""
        return f"(length(encode({s}, 'UTF-16BE')) div 2)" if self.spark else f"length(regexp_replace({s}, '[\\x{{10000}}-\\x{{10FFFF}}]', 'xx', 'g'))"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {text(pattern)})" if self.spark else f"regexp_matches({s}, {text(pattern)})"


SPARK, DUCKDB = Dialect(True), Dialect(False)


def integer(x: str) -> str:
    return f"CAST({x} AS INT)"


def chain(value_by_condition: list[tuple[str, str]], otherwise: str) -> str:
    """The value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in value_by_condition) + f" ELSE {otherwise} END"
