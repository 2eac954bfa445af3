"""Pairs of capitalised words of which one at least is a listed name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.words import NON_NAMES

PAIR = r"(?U)\b[A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20}\b"


def pairs(text: Column) -> Column:
    """All pairs, names or not: each takes its two words, so what follows begins after it."""
    return F.regexp_extract_all(text, F.lit(PAIR), F.lit(0))


def fragments(text: Column) -> Column:
    return F.split(text, PAIR, -1)


def is_name(pair: Column, words: list[str]) -> Column:
    """Whether a pair holds a listed word and no word that no name holds; its words are ASCII, one capital first, so they are compared as they are."""
    both = F.split(pair, r"(?U)\s+")
    cased = [w.capitalize() for w in words if w.isascii() and w == w.lower()]
    return F.exists(both, lambda w: w.isin(*cased)) & ~F.exists(both, lambda w: w.isin(*(n.capitalize() for n in NON_NAMES)))


def vocabulary(first: DataFrame, last: DataFrame) -> DataFrame:
    """word: the distinct words of both lists, in lower case."""
    return first.select(F.lower("word").alias("word")).union(last.select(F.lower("word"))).distinct()


def spans(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, start, end, value of every name (code points, end exclusive).

    Word lists of any size: the listed words are joined to the words of the pairs.
    """
    cut = docs.select("doc_id", F.struct(pairs(F.col("text")).alias("p"), fragments(F.col("text")).alias("f")).alias("c"))
    # Lengths up to a pair: of the fragments before it, and of the pairs before it.
    lengths = F.arrays_zip(F.transform("c.f", F.length).alias("f"), F.transform("c.p", F.length).alias("p"))
    steps = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda a, x: F.struct((a["at"] + x["f"] + F.coalesce(x["p"], F.lit(0))).alias("at"), F.array_append(a["starts"], a["at"] + x["f"]).alias("starts")))
    rows = cut.select("doc_id", F.explode(F.arrays_zip(steps["starts"].alias("start"), F.col("c.p").alias("value"))).alias("x")).select("doc_id", "x.start", "x.value").filter("value is not null")
    rows = rows.withColumn("pair", F.split(F.lower("value"), r"(?U)\s+")).filter(~F.exists("pair", lambda w: w.isin(*NON_NAMES)))
    listed = words.select(F.lower("word").alias("word")).distinct()
    named = rows.select("doc_id", "start", "value", F.explode("pair").alias("word")).join(listed, "word", "left_semi").select("doc_id", "start", "value").distinct()
    return named.select("doc_id", "start", (F.col("start") + F.length("value")).alias("end"), "value")
