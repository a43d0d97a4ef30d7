"""Fill-in-middle: lines of a text are cut at two hashed places and put in another order, by DuckDB SQL over Arrow slices.

Each slice of a batch is registered in an in-memory DuckDB of the worker; its SQL splits, hashes, joins and rebuilds
the texts, and the result goes back as Arrow: no row is touched by Python.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: The three marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The unit of a cut, as RE2 reads it: a line with its line feed, or what is left behind the last one.
LINE = r"[^\n]*\n|[^\n]+"
#: A text of at least a mark's length has one of the marks.
MARKED = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
#: What one DuckDB of a worker may hold; a slice has 4 MB of text, or one longer text.
MEMORY = "600MB"


def cut_sql(source: str, id_col: str = "id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINE) -> str:
    """DuckDB SQL over source: id, n (units), form, prefix, middle, suffix and text of each row; null text is empty, a null id is hashed as an empty number."""
    group = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT {id_col} AS id, coalesce({text_col}, '') AS text, sha256('{seed}:' || coalesce(CAST({id_col} AS VARCHAR), '')) AS h FROM {source}),
u AS (SELECT id, text, h, regexp_extract_all(text, '{unit}') AS units FROM d),
c AS (SELECT id, text, units, CAST(len(units) AS BIGINT) AS n, {group(0)} % (len(units) + 1) AS x, {group(1)} % (len(units) + 1) AS y,
  CASE WHEN text = '' OR {MARKED} OR {group(2)} % 100 >= {percent} THEN 'plain' WHEN {group(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT id, text, n, form, array_to_string(list_slice(units, 1, least(x, y)), '') AS prefix, array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') AS middle, array_to_string(list_slice(units, greatest(x, y) + 1, n), '') AS suffix FROM c)
SELECT id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM s
"""


def restore_sql(source: str) -> str:
    """DuckDB SQL over source (with form and output): all of it, and restored, the text that was cut.  The first mark and the last two are found in the output alone; a text that has a mark is plain, so none is found inside it."""
    part = lambda after, before: f"substr(output, strpos(output, '{after}') + 3, strpos(output, '{before}') - strpos(output, '{after}') - 3)"
    last = f"substr(output, strpos(output, '{MIDDLE}') + 3)"
    return f"SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {part(PREFIX, SUFFIX)} || {last} || {part(SUFFIX, MIDDLE)} ELSE {part(PREFIX, MIDDLE)} || {last} || {part(SUFFIX, PREFIX)} END AS restored FROM ({source})"


@functools.cache
def engine():
    """The worker's own DuckDB: one thread, no files."""
    import duckdb

    return duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": "true"})


def through_sql(frame: DataFrame, sql: str, schema: T.StructType, text_at: int) -> DataFrame:
    """sql, which reads the table `slice`, over every slice of frame's Arrow batches; text_at: the column whose bytes bound a slice."""
    ship(frame.sparkSession)

    def run(batches):
        from .arrow import slices
        from .fill_in_middle import engine

        con = engine()
        names = [f.name for f in schema.fields]
        for batch in batches:
            for first, end, _, _ in slices(batch.column(text_at)):
                con.register("slice", pa.Table.from_batches([batch.slice(first, end - first)]))
                yield from con.sql(sql).to_arrow_table().select(names).to_batches()
                con.unregister("slice")

    return frame.mapInArrow(run, schema)


def clean(text: Column) -> Column:
    """A string whose bytes that aren't UTF-8 are U+FFFD; null stays."""
    return F.make_valid_utf8(text)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output and restored of every row of docs.

    Cuts are at two places that the id's hash with `seed` names; `percent` of the texts are cut, and of these
    `spm_percent` begin with the suffix.  A null text is empty; an empty text, and one with a mark in it, is plain, with
    null lengths.  Rows of one id are cut by the same numbers, each by its own lines; null ids hash as an empty number.
    Bytes that aren't UTF-8 count as U+FFFD.  Other columns aren't read, so their names don't matter.  One narrow pass;
    a slice of 4 MB, or one longer text, is in memory at a time.
    """
    source = docs.select(F.col(id_col).alias("id"), clean(F.col(text_col)).alias("text"))
    fields = [T.StructField("id", source.schema["id"].dataType)] + [T.StructField(n, k) for n, k in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()), ("restored", T.StringType()))]
    return through_sql(source, restore_sql(cut_sql("slice", seed=seed, percent=percent, spm_percent=spm_percent)), T.StructType(fields), 1)
