"""Pseudonyms for research mode: one token for each value of a type over the whole job.

Tokens are numbered by first encounter: known names first, by code points; then files in order,
and in each the rules, known names, learned fields and gazetteer, each from left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.text import strip
from cloakwork.storage import materialise

#: Marks are characters that Unicode keeps out of text interchange; where a text holds one, it becomes U+FFFD.
MARKS = [chr(0xFDD0 + i) for i in range(32)]
KNOWN, FIELD, GAZETTEER = 11, 12, 31


def key(value: Column) -> Column:
    return F.sha2(F.lower(strip(value)), 256)


def token(pii_type: Column, n: Column) -> Column:
    return F.format_string("[%s-R%03d]", F.upper(pii_type), n)


def numbered(first: DataFrame) -> DataFrame:
    """first (pii_type, key, first) with n: the rank of `first` in its type, from 1.

    The rows are dealt out in order; each part is ranked by itself and moved up by what
    the parts before it hold, so no type has to fit one task.
    """
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.repartitionByRange(parts, "pii_type", "first").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "vault")
    sizes = dealt.groupBy("pii_type", "part").agg(F.count("*").alias("rows"))
    # One row for each part and type.
    before = sizes.select("pii_type", "part", (F.sum("rows").over(Window.partitionBy("pii_type").orderBy("part")) - F.col("rows")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("pii_type", "part").orderBy("first")))
    return ranked.join(F.broadcast(before), ["pii_type", "part"]).select("pii_type", "key", "first", (F.col("rank") + F.col("before")).alias("n"))


def assign(found: DataFrame) -> DataFrame:
    """pii_type, key, n, token for hits (pii_type, value, ord): `ord` is anything that orders encounters."""
    first = found.select("pii_type", key(F.col("value")).alias("key"), "ord").groupBy("pii_type", "key").agg(F.min("ord").alias("first"))
    return numbered(first).select("pii_type", "key", "n", token(F.col("pii_type"), F.col("n")).alias("token"))


def summary(tokens: DataFrame) -> DataFrame:
    """pii_type, n: how many distinct values each type has."""
    return tokens.groupBy("pii_type").agg(F.count_distinct("key").alias("n"))


def research(df: DataFrame, names: list[str], schema: dict, words: list[str] | None) -> DataFrame:
    """df (doc_id, text and others) redacted with tokens; adds the hits columns of redact.py.

    Files are taken in the order of file_ord where there is one, else of doc_id.
    """
    from cloakwork.operators import redact, rules

    spark = df.sparkSession
    fields = redact.personal_fields(schema, "research")
    if len(fields) > GAZETTEER - FIELD:
        raise ValueError(f"research mode takes {GAZETTEER - FIELD} learned fields at most")
    order = "file_ord" if "file_ord" in df.columns else "doc_id"
    df = df.withColumn("text", F.regexp_replace("text", f"[{MARKS[0]}-{MARKS[-1]}]", "�"))
    mark = {r.name: MARKS[i] for i, r in enumerate(rules.RULES)}
    df = redact.apply_rules(df, "research", mark.get)
    df = redact.apply_known_names(df, names, MARKS[KNOWN])
    df = redact.apply_fields(df, schema, "research", lambda i: MARKS[FIELD + i])
    df = redact.apply_gazetteer(df, words, MARKS[GAZETTEER])
    df = materialise(df, "marked")
    kinds = [(i, r.name, f"hits_{r.name}") for i, r in enumerate(rules.RULES) if "research" in r.modes] + [(KNOWN, "name", "hits_known")]
    kinds += [(FIELD + i, "generic", f"hits_field_{i}") for i in range(len(fields))] + [(GAZETTEER, "name", "hits_gazetteer")]
    lists = redact.those_of([(F.size(c) > 0, F.struct(F.lit(k).alias("kind"), F.lit(t).alias("pii_type"), F.col(c).alias("hits"))) for k, t, c in kinds], "struct<kind:int,pii_type:string,hits:array<string>>")
    found = df.select("doc_id", F.col(order).cast("long").alias("file"), F.explode(lists).alias("l"))
    found = found.select("doc_id", "file", "l.kind", "l.pii_type", F.posexplode("l.hits").alias("pos", "value"))
    ord_ = lambda phase: F.struct(F.lit(phase).alias("phase"), *(F.col(c).cast("long").alias(c) for c in ("file", "kind", "pos")))
    every = found.select("pii_type", "value", ord_(1).alias("ord"))
    if names:
        seeds = spark.createDataFrame([("name", n, i) for i, n in enumerate(sorted(set(names)))], "pii_type string, value string, pos long")
        every = every.union(seeds.select("pii_type", "value", F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("kind"), "pos").alias("ord")))
    tokens = assign(every).select(F.col("pii_type").alias("t"), "key", "token")
    # A column of its own: as a condition the digest would be taken again at each comparison of the join's sort.
    keyed = found.select("doc_id", "kind", "pii_type", "pos", F.coalesce(key(F.col("value")), F.lit("")).alias("_key"))
    told = keyed.join(tokens, [F.col("pii_type") == F.col("t"), F.col("_key") == F.col("key")])
    lists = told.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("kind", "pos", "token"))).alias("_tokens"))
    out = df.join(lists.withColumnRenamed("doc_id", "_doc"), df["doc_id"].eqNullSafe(F.col("_doc")), "left").drop("_doc")
    for k, _, c in kinds:
        put = redact.interleaved(F.split("text", MARKS[k], -1), F.transform(F.filter("_tokens", lambda x: x["kind"] == k), lambda x: x["token"]))
        out = out.withColumn("text", F.when(F.size(c) > 0, put).otherwise(F.col("text")))
    return out.drop("_tokens")
