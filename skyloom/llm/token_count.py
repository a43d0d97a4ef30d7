"""Token counts by the compiled transducer, without building the tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import releasing
from .common import ship


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row of docs; path: the tokenizer's file on every node.

    A null or empty text has no bytes and no tokens.  Rows are counted one by one, whatever their ids; other columns
    are not read.  One narrow pass: no shuffle, and slices of a few MB in memory (a longer text alone).
    """
    ship(docs.sparkSession)

    def run(batches):
        from .arrow import slices
        from .bpe import transducer

        machine = transducer(path)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                counts = machine.counts(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(offsets[1:] - offsets[:-1]), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(releasing(run, tokens=True), schema)
