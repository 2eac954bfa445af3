"""Rewriting texts: rules, known names, learned fields and the gazetteer, in that order.

Public and audit mode are a chain of projections, without a shuffle. Research mode replaces hits
by marks first, numbers their values over the whole job, and puts the tokens in afterwards; marks
match nothing, as tokens do, so where rules match does not depend on the numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import quoted, visible, within_guard
from cloakwork.operators import gazetteer, rules, vault

EMPTY = "array<string>"


def _collected(df: DataFrame, name: str, found: Column, put: Column) -> DataFrame:
    """Adds hits_<name>; `put` is the text after replacement, where there are hits."""
    df = df.withColumn(f"hits_{name}", found)
    return df.withColumn("text", F.when(F.size(f"hits_{name}") > 0, put).otherwise(F.col("text")))


def apply_rules(df: DataFrame, mode: str, fill=None, ascii: bool = False) -> DataFrame:
    """Adds hits_<type> for each active rule; `fill` gives a type's replacement (default: the mode's).

    ascii: only ASCII letters make words, as in SQL engines with RE2; without it, letters of any script do.
    """
    fill = fill or (lambda t: rules.replacement(t, mode))
    # One look for digits serves all rules: what they put in holds none.
    df = df.withColumn("_digit", F.col("text").rlike(f"(?iU){rules.DIGIT}"))
    for r in rules.active(mode):
        passes = F.col("_digit") if r.gate == rules.DIGIT else None
        df = _collected(df, r.name, rules.hits(F.col("text"), r, ascii, passes), F.regexp_replace("text", r.compiled(ascii), fill(r.name)))
    return df.drop("_digit")


def ordered_names(names: list[str]) -> list[str]:
    """Longer names first, then by code points: a longer name is not cut by a shorter one in it."""
    return sorted(set(names), key=lambda n: (-len(n), n))


def _folded(c: str) -> str:
    """The letter that stands for all cases of one, where each case is one letter."""
    return low if len(up := c.upper()) == 1 and len(low := up.lower()) == 1 else c


def names_pattern(names: list[str]) -> str:
    """One pattern for all names, which takes the longest that begins at a place.

    Names share their beginnings as in a tree, so at most places a text is looked at for one letter only, however many
    names there are.
    """
    root: dict = {}
    for name in names:
        node = root
        for c in name:
            node = node.setdefault(_folded(c), {})
        node[""] = {}
    # From the leaves up, without recursion: names have any length.
    order, seen = [root], 0
    while seen < len(order):
        order += [n for c, n in order[seen].items() if c]
        seen += 1
    written: dict[int, str] = {}
    for node in reversed(order):
        ways = [quoted(c) + written[id(n)] for c, n in sorted(node.items()) if c]
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        written[id(node)] = f"(?:{body})?" if ways and "" in node else body
    return "(?iu)" + written[id(root)]


def apply_known_names(df: DataFrame, names: list[str], fill: str) -> DataFrame:
    """Replaces every occurrence of a known name, inside words too; adds hits_known.

    One pass over a text whatever the number of names.
    """
    names = [n for n in names if n]
    if not names:
        return df.withColumn("hits_known", F.array().cast(EMPTY))
    pattern = names_pattern(names)
    return _collected(df, "known", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.regexp_replace("text", pattern, fill))


def field_pattern(field: str) -> str:
    return f"(?iU)({quoted(field)}[:\\s#]+)([A-Z0-9\\-]+)"


def apply_fields(df: DataFrame, schema: dict, mode: str, fill=None) -> DataFrame:
    """Replaces the values of learned fields that are personal in this mode; adds hits_field_<i>.

    A value that also occurs in its own field's word is replaced at the value only.
    """
    for i, field in enumerate(personal_fields(schema, mode)):
        put = F.regexp_replace("text", field_pattern(field), "$1" + (fill(i) if fill else rules.replacement("generic", mode)))
        df = _collected(df, f"field_{i}", F.regexp_extract_all("text", F.lit(field_pattern(field)), F.lit(2)), put)
    return df


def personal_fields(schema: dict, mode: str) -> list[str]:
    return [f for f, info in schema.items() if info.get("is_pii") and mode in info.get("modes", [])]


def apply_gazetteer(df: DataFrame, words: list[str] | None, fill: str) -> DataFrame:
    """Replaces gazetteer name pairs; adds hits_gazetteer. Texts beyond the size guard stay."""
    if not words:
        return df.withColumn("hits_gazetteer", F.array().cast(EMPTY))
    pairs = F.when(within_guard(F.col("text")), gazetteer.pairs(F.col("text"))).otherwise(F.array().cast(EMPTY))
    named = lambda p: gazetteer.is_name(p, words)
    df = df.withColumn("_pairs", pairs).withColumn("hits_gazetteer", F.filter("_pairs", named))
    put = interleaved(gazetteer.fragments(F.col("text")), F.transform("_pairs", lambda p: F.when(named(p), F.lit(fill)).otherwise(p)))
    return df.withColumn("text", F.when(F.size("hits_gazetteer") > 0, put).otherwise(F.col("text"))).drop("_pairs")


def interleaved(fragments: Column, between: Column) -> Column:
    """n + 1 fragments with n strings between them; a null string is kept visible as U+FFFD."""
    return F.concat_ws("", F.flatten(F.zip_with(fragments, between, lambda a, b: F.array(a, F.coalesce(b, F.when(a.isNull(), "�").otherwise(""))))))


def stat_columns(mode: str, schema: dict) -> list[tuple[str, str]]:
    """(statistics key, hits column) pairs; a key may come twice (titled and known names)."""
    out = [(r.name, f"hits_{r.name}") for r in rules.active(mode)] + [("name", "hits_known")]
    out += [(f, f"hits_field_{i}") for i, f in enumerate(personal_fields(schema, mode))]
    return [*out, ("NER-Name", "hits_gazetteer")]


def those_of(ways: list[tuple[Column, Column]], kind: str) -> Column:
    """The array of the values whose condition holds. A filter on an array of all of them would run without generated code."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*(F.when(condition, F.array(value)).otherwise(none) for condition, value in ways))


def stats_map(mode: str, schema: dict) -> Column:
    """map of statistics key to count, without zeros."""
    totals: dict[str, list[Column]] = {}
    for key, column in stat_columns(mode, schema):
        totals.setdefault(key, []).append(F.size(column))
    entries = F.array(*(F.struct(F.lit(k).alias("k"), reduce(lambda a, b: a + b, v).cast("long").alias("v")) for k, v in totals.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0))


def redact(docs: DataFrame, mode: str, names: list[str] = (), schema: dict | None = None, words: list[str] | None = None, ner=None, ascii: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with redacted, stats and total; text is left as it came.

    names: known names; schema: learned fields; words: the gazetteer, lower case; ner: a function
    of (DataFrame with text, mode) that replaces model entities and adds ner_stats (see ner.py);
    ascii: see apply_rules (public and audit mode).
    """
    schema = schema or {}
    if ascii and mode == "research":
        raise ValueError("research mode takes letters of any script")
    df = docs.withColumn("_given", F.col("text")).withColumn("text", visible(F.coalesce("text", F.lit(""))))
    if mode == "research":
        df = vault.research(df, list(names), schema, words)
    else:
        df = apply_rules(df, mode, ascii=ascii)
        df = apply_known_names(df, list(names), rules.replacement("name", mode))
        df = apply_fields(df, schema, mode)
        df = apply_gazetteer(df, words, rules.replacement("name", mode))
    df = df.withColumn("stats", stats_map(mode, schema))
    if ner is not None:
        df = ner(df, mode).withColumn("stats", F.map_concat("stats", "ner_stats")).drop("ner_stats")
    df = df.withColumn("total", F.aggregate(F.map_values("stats"), F.lit(0).cast("long"), lambda a, n: a + n))
    others = [c for c in docs.columns if c != "text"]
    # Filters on results, also those that optimizers infer, must not be pushed through the chain: they would take a
    # copy of it for each time that a rule looks at the text. No filter on what a generator makes goes below it.
    made = F.inline(F.array(F.struct(F.col("text").alias("redacted"), "stats", "total")))
    return df.select(*others, F.col("_given").alias("text"), made)


def counts_by_type(docs: DataFrame, mode: str, **more) -> DataFrame:
    """doc_id, pii_type, n: statistics in long form."""
    return redact(docs, mode, **more).select("doc_id", F.explode("stats").alias("pii_type", "n"))
