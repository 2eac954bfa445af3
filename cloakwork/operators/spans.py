"""Spans in texts: dropping overlaps and putting replacements in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entity: where, what, its label, which detector found it (in `prio` order), what replaces it.
SPAN = "struct<start:int,end:int,value:string,label:string,source:string,prio:int,replacement:string>"


def without_overlaps(spans: Column) -> Column:
    """Spans by start, longer first, then by prio; each is kept if it begins where the last kept one has ended."""
    rank = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["prio"].alias("c"), s.alias("span")))
    ordered = F.transform(F.array_sort(rank, lambda x, y: _by(x, y)), lambda r: r["span"])
    none = F.filter(spans, lambda s: F.lit(False))
    kept = F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("last"), none.alias("kept")),
        lambda a, s: F.when(s["start"] >= a["last"], F.struct(s["end"].alias("last"), F.array_append(a["kept"], s).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    return kept


def _by(x: Column, y: Column) -> Column:
    out = F.lit(0)
    for c in ("c", "b", "a"):
        out = F.when(x[c] < y[c], -1).when(x[c] > y[c], 1).otherwise(out)
    return out


def apply(text: Column, spans: Column) -> Column:
    """The text with each of the spans (ordered, none over another) replaced."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["replacement"])).alias("parts")),
    )
    return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def category(source: Column) -> Column:
    """The statistics key of a detector's hit."""
    return F.when(source.isin("Gazetteer", "PERSON"), "Name").otherwise(F.substring_index(source, "-", 1))


def category_counts(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """doc_id, category, n over kept spans."""
    each = rows.select("doc_id", F.explode(spans).alias("s"))
    return each.groupBy("doc_id", category(F.col("s.source")).alias("category")).agg(F.count("*").alias("n"))
