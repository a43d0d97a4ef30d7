"""Searches of catalogs that are read from files: flat ones, and nested ones of categories with lessons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import hashed, pick
from ..sources import fixed as V
from . import nested

LESSON = "struct<id:string,title:string,description:string,content:string,difficulty:int,key_points:array<string>,examples:array<struct<title:string,content:string,explanation:string>>>"
STUDY = f"ord int, id string, name string, description string, icon string, lessons array<{LESSON}>"
BOOK = "ord int, id string, title string, author string, dynasty string, category string, file_name string, description string, is_core boolean, keywords array<string>"
SIGN = "id int, content string, interpretation string, source string, type string, keywords array<string>"
HEXAGRAM_TEXT = "ord int, name string, number int, meaning string, interpretation string, career string, wealth string, marriage string, health string"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a row."""
    return spark.read.schema(schema).json(path)


def has_word(word: str, texts: list[str], lists: list[str] = ()) -> Column:
    """Whether a column, or an entry of a list column, has the word: literally, whatever its case.  A blank word is in nothing."""
    if not word.strip():
        return F.lit(False)
    low = F.lit(word.lower())
    found = [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in texts]
    found += [F.coalesce(F.exists(c, lambda x: F.lower(x).contains(low)), F.lit(False)) for c in lists]
    return reduce(lambda a, b: a | b, found)


def search_books(books: DataFrame, word: str) -> DataFrame:
    return books.where(has_word(word, ["title", "author", "description"], ["keywords"])).orderBy("ord")


def lessons(study: DataFrame) -> DataFrame:
    """One row a lesson, in order: category, category_ord, place and the lesson's fields."""
    flat = study.select(F.col("id").alias("category"), F.col("ord").alias("category_ord"), F.posexplode("lessons").alias("place", "lesson"))
    return flat.select("category", "category_ord", "place", "lesson.*").orderBy("category_ord", "place")


def search_lessons(study: DataFrame, word: str) -> DataFrame:
    return lessons(study).where(has_word(word, ["title", "description", "content"], ["key_points"]))


def category(study: DataFrame, name: str) -> DataFrame:
    """The first category of that id; an error if there is none."""
    return nested.by_id(study, "id", name, "ord")


def sign(signs: DataFrame, number: int) -> DataFrame:
    """The sign of that number, with its texts; an error if there is none."""
    return nested.by_id(signs, "id", number)


def sign_of_day(moments: DataFrame, signs: DataFrame) -> DataFrame:
    """moments (id, ts) with the whole row of the day's sign from a catalog of signs numbered from 1, which is broadcast: a catalog has a row a sign."""
    n = signs.count()
    day = F.pmod(F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts"), F.lit(n)) + 1
    named = signs.select(F.col("id").alias("sign"), *(F.col(c).alias(f"sign_{c}") for c in signs.columns if c != "id"))
    return moments.withColumn("sign", day.cast("int")).join(F.broadcast(named), "sign", "left")


def lesson_counts(study: DataFrame) -> DataFrame:
    return study.select("id", F.size("lessons").alias("n_lessons"), F.aggregate("lessons", F.lit(0), lambda a, x: a + F.size(x["key_points"])).alias("n_points")).orderBy("id")


def preview(df: DataFrame, column: str, most: int = 3) -> DataFrame:
    """df with a list column cut to its first entries."""
    return df.withColumn(column, F.slice(column, 1, most))


def with_default(df: DataFrame, texts: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """df joined with a small table of texts by key; what it lacks gets a default."""
    found = df.join(F.broadcast(texts.select(key, *defaults)), key, "left")
    return found.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in defaults.items()})


def upsert_memo(memos: DataFrame, new: DataFrame) -> DataFrame:
    """The day's picks by user: a later row of a user replaces earlier ones (columns user, day, sign)."""
    last = F.row_number().over(Window.partitionBy("user").orderBy(F.col("day").desc(), F.col("sign").desc()))
    return memos.unionByName(new).withColumn("__r", last).where("__r = 1").drop("__r")


def memo_of(memos: DataFrame, day: Column) -> DataFrame:
    return memos.where(F.col("day") == day)


def dream_entries(spark: SparkSession) -> DataFrame:
    """The dream dictionary: ord, keyword, kind, good, others, suggestion."""
    rows = [(k, w, kind, good, others.split(), advice) for k, ((w, kind, good, others), advice) in enumerate(zip(V.DREAMS, V.DREAM_SUGGESTIONS, strict=True))]
    return spark.createDataFrame(rows, "ord int, keyword string, kind string, good boolean, others array<string>, suggestion string")


def recommended(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """key, r, keyword, kind: `most` of the good entries for each row, in an order drawn by hashes of key and keyword, in the row."""
    good = [d[0] for d in V.DREAMS if d[2]]
    drawn = F.slice(F.array_sort(F.transform(F.array(*map(F.lit, good)), lambda w: F.struct(hashed("keywords", F.concat(F.col(key).cast("string"), w)).alias("h"), w.alias("w")))), 1, most)
    kinds = F.create_map(*(F.lit(x) for d in V.DREAMS for x in (d[0], d[1])))
    each = rows.select(key, F.posexplode(drawn).alias("place", "x"))
    return each.select(key, (F.col("place") + 1).alias("r"), F.col("x.w").alias("keyword"), F.element_at(kinds, F.col("x.w")).alias("kind"))


def shipped_books(spark: SparkSession) -> DataFrame:
    """ord, book, title, category, core of the shipped catalog."""
    return spark.createDataFrame([(k, b[0], b[1], b[3], b[4]) for k, b in enumerate(V.BOOKS)], "ord int, book string, title string, category string, core boolean")


def read_books(readers: DataFrame, key: str) -> DataFrame:
    """ord, n: how many readers each book of the shipped catalog has, each reader having drawn one by a hash of the key."""
    return readers.groupBy(pick("book", F.col(key).cast("string"), len(V.BOOKS)).alias("ord")).agg(F.count("*").alias("n"))
