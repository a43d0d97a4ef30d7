"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all
but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontamination, jaccard, packing, quality, secrets
from skyloom.llm.common import discard, tables_written, without, written
from skyloom.llm.registry import tokenizer_path


#: The intermediate tables of the stage that ran last, until its successor begins.
_LEFT: list[str] = []


def follows(stage):
    """stage, which first deletes the intermediate tables of the stage that ran before it, as docs is reread from that one's rows; tables that docs itself reads stay."""

    @functools.wraps(stage)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, list(_LEFT), docs)
        _LEFT.clear()
        return stage(spark, docs, sf_dir)

    return cleared


def leaves(stage):
    """stage, whose intermediate tables its successor deletes.  The last stage isn't so marked: a run's result reads its tables."""

    @functools.wraps(stage)
    def noted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = tables_written()
        rows = stage(spark, docs, sf_dir)
        _LEFT[:] = [x for x in tables_written() if x not in before]
        return rows

    return noted


def row_key() -> Column:
    """What a row is dropped by: its id and its text's hash, never null, so rows of one id with different texts are told apart; text that sorts as the id (long) does, null last."""
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    by_id = F.when(F.col("doc_id").isNull(), "null").otherwise(sixteen(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))))
    return F.concat_ws(":", by_id, F.when(F.col("text").isNull(), "").otherwise(sixteen(F.xxhash64("text"))))


@leaves
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents, and those of rejected hosts, go; so do null and empty texts, which have too few words.  Rows are judged one by one, whatever their ids; a null source is a host of its own; an empty table gives none."""
    return quality.accepted(docs)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, with the row's key as doc_id."""
    return docs.select(row_key().alias("doc_id"), "text")


@follows
@leaves
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, and of rows with one id and text, the row with the least id stays; of rows that share the least id, the one with the least text hash.  A null id is the greatest."""
    found = written(jaccard.near_duplicates(keyed(docs)).select("id", (F.col("id") != F.col("component")).alias("dropped")), "components")
    dropped = written(found.where("dropped").select("id"), "dropped")
    kept = without(docs, dropped, row_key(), dropped["id"])
    repeats = not found.groupBy("id").count().where("count > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


@follows
@leaves
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, each judged by its own text, also where rows share an id; a null text has no hits.  An empty table gives none."""
    found = decontamination.contamination(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dropped = written(found.where("contaminated").select("id").distinct(), "dropped")
    return without(docs, dropped, row_key(), dropped["id"])


@follows
@leaves
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is masked; no document goes.  Null texts stay null (n_chars, too), repeated rows and ids are masked each for itself, an empty table gives none."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


@follows
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences; a null text is empty and has the one id that ends a document.  Rows that share an id are packed each for itself; an empty table gives none."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", sequence_packing),
]
#: Tokenization by a byte-pair vocabulary has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
