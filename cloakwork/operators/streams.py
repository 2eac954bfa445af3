"""Blanking personal data in the string literals of page content streams (decoded as latin-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import quoted
from cloakwork.operators.redact import interleaved, ordered_names

#: Patterns in their order.
PATTERNS = (
    r"[A-Z]{5}\d{4}[A-Z]",
    r"\d{3}-\d{2}-\d{4}",
    r"(?:\d{4}[- ]){3}\d{4}",
    r"(?:\d{1,3}\.){3}\d{1,3}",
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"(?:\+91[-. ]?)?\d{5}[ ]?\d{6}|\+91[-. ]?\d{10}",
    r"\d{4} \d{4} \d{4}",
    r"(?<=Aadhaar )\d{4} \d{4}",
    r"(?i)(?<=aadhaar )\d{4} \d{4}",
)
LITERAL = r"\([^)]*\)"
ORPHAN = r"(?U)\(\s*\d{4}[.,]?\s*\)"


def blanked(text: Column, pattern: str) -> Column:
    """Every match becomes as many spaces."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    put = interleaved(F.split(text, pattern, -1), F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m))))
    return F.when(F.size(found) > 0, put).otherwise(text)


def blank_literals(stream: Column, names: list[str] = ()) -> Column:
    """The stream with personal data inside ( … ) blanked: patterns first, then known names."""
    patterns = [*PATTERNS, *(f"(?iu){quoted(n)}" for n in ordered_names(list(names)))]
    inner = F.transform(F.regexp_extract_all(stream, F.lit(LITERAL), F.lit(0)), lambda x: F.substring(x, 2, F.length(x) - 2))
    # One pass over the literals for each pattern: nested in one expression, the passes would multiply.
    for p in patterns:
        inner = F.transform(inner, _blanking(p))
    return interleaved(F.split(stream, LITERAL, -1), F.transform(inner, lambda x: F.concat(F.lit("("), x, F.lit(")"))))


def _blanking(pattern: str):
    return lambda x: blanked(x, pattern)


def blank_orphans(stream: Column) -> Column:
    """Literals of four digits alone become twice their length in spaces."""
    found = F.regexp_extract_all(stream, F.lit(ORPHAN), F.lit(0))
    wide = lambda x: F.concat(F.lit("("), F.repeat(F.lit("  "), F.length(x) - 2), F.lit(")"))
    return interleaved(F.split(stream, ORPHAN, -1), F.transform(found, wide))


def blank_streams(streams: DataFrame, names: list[str] = ()) -> DataFrame:
    """streams (doc_id, page, stream_idx, content) with blanked content; each stream by itself."""
    text = F.decode("content", "ISO-8859-1")
    return streams.withColumn("_t", text).withColumn("_t", blank_literals(F.col("_t"), names)).withColumn("content", F.encode(blank_orphans(F.col("_t")), "ISO-8859-1")).drop("_t")
