"""Entities of language models: policy, replacements and the stage that runs them.

The models are pluggable and off by default. A detector is a function of a text that gives
(start, end, value, label) tuples; it is made once for each Python worker by its factory.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import SIZE_GUARD
from cloakwork.functions.words import NON_NAMES
from cloakwork.operators import gazetteer, spans

#: Entity labels replaced in each mode, and what replaces them.
POLICY = {"public": ("PERSON", "GPE", "LOC", "FAC", "ORG"), "research": ("GPE", "LOC", "FAC"), "audit": ("PERSON", "GPE", "LOC", "FAC")}
PUBLIC_WIDTHS = {"PERSON": 12, "GPE": 8, "LOC": 8, "FAC": 8, "ORG": 12}
AUDIT = {"PERSON": "[NAME]", "GPE": "[LOCATION]", "LOC": "[LOCATION]", "FAC": "[FACILITY]", "ORG": "[ORGANISATION]"}
SHORT = {"PERSON": "NAME", "GPE": "LOC"}
#: Characters that a model sees at once.
CHUNK = 100_000

_factories: dict = {}


def chosen(label: Column, table: dict[str, str], otherwise) -> Column:
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for k, v in table.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def replacement(label: Column, value: Column, mode: str) -> Column:
    """What stands for an entity; in research mode a token that the value alone decides."""
    if mode == "public":
        return chosen(label, {k: "█" * n for k, n in PUBLIC_WIDTHS.items()}, "█" * 12)
    if mode == "audit":
        return chosen(label, AUDIT, "[REDACTED]")
    digest = F.sha2(F.concat(label, F.lit(":"), F.trim(F.lower(value))), 256)
    return F.concat(F.lit("["), chosen(label, SHORT, label), F.lit("-R"), F.upper(F.substring(digest, 1, 6)), F.lit("]"))


def spacy_factory() -> Callable:
    """The largest English model that is installed; without one, a detector that finds nothing."""
    try:
        import spacy
    except ImportError:
        return lambda text: []
    for name in ("en_core_web_lg", "en_core_web_md", "en_core_web_sm"):
        try:
            model = spacy.load(name)
        except OSError:
            continue
        return lambda text: [(e.start_char, e.end_char, e.text, e.label_) for e in model(text).ents]
    return lambda text: []


def stanza_factory() -> Callable:
    """The Hindi pipeline; without it, a detector that finds nothing."""
    try:
        import stanza

        model = stanza.Pipeline(lang="hi", processors="tokenize,ner", use_gpu=False, verbose=False)
    except Exception:  # noqa: BLE001  a missing model is no failure of the job
        return lambda text: []
    return lambda text: [(e.start_char, e.end_char, e.text, e.type) for s in model(text).sentences for e in s.entities]


def chunked(detector: Callable, text: str, size: int = CHUNK) -> list[tuple]:
    return [(at + s, at + e, v, label) for at in range(0, len(text), size) for s, e, v, label in detector(text[at : at + size])]


def accepted(value: str) -> bool:
    word = value.lower().strip()
    return len(word) > 1 and word not in NON_NAMES


def entities(texts: Column, factory: Callable, mode: str, source: str = "", hindi: bool = False) -> Column:
    """The spans that a model finds and the mode replaces, as an array of spans without replacements."""
    labels = frozenset(POLICY[mode])

    @F.pandas_udf(f"array<{spans.SPAN}>")
    def run(column: pd.Series) -> pd.Series:
        if factory not in _factories:
            _factories[factory] = factory()
        detector = _factories[factory]

        def one(text):
            if text is None or len(text) > SIZE_GUARD or (hindi and not any("ऀ" <= c <= "ॿ" for c in text)):
                return []
            found = detector(text) if hindi else [x for x in chunked(detector, text) if accepted(x[2])]
            return [{"start": s, "end": e, "value": v, "label": k, "source": source + k, "prio": 2 if hindi else 1, "replacement": None} for s, e, v, k in found if k in labels]

        return column.map(one)

    return run(texts)


def stage(words: list[str], english: Callable | None = spacy_factory, hindi: Callable | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """The entity stage for redact(): gazetteer and models together, overlaps dropped.

    Give redact() this stage and no gazetteer, so that both are weighed against each other.
    """

    def run(df: DataFrame, mode: str) -> DataFrame:
        text = F.col("text")
        none = F.array().cast(f"array<{spans.SPAN}>")
        listed = F.when(F.length(text) <= SIZE_GUARD, gazetteer_spans(text, words)).otherwise(none)
        found = [listed]
        if english is not None:
            found.append(entities(text, english, mode))
        if hindi is not None:
            found.append(entities(text, hindi, mode, "Hindi-", True))
        every = F.transform(F.concat(*found), lambda s: s.withField("replacement", replacement(s["label"], s["value"], mode)))
        df = df.withColumn("_spans", every).withColumn("_spans", spans.without_overlaps(F.col("_spans")))
        df = df.withColumn("text", spans.apply(F.col("text"), F.col("_spans")))
        keys = F.transform("_spans", lambda s: F.concat(F.lit("NER-"), spans.category(s["source"])))
        counts = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.size(F.filter(keys, lambda x: x == k)).cast("long").alias("v")))
        return df.withColumn("ner_stats", F.map_from_entries(counts)).drop("_spans")

    return run


def gazetteer_spans(text: Column, words: list[str]) -> Column:
    """Gazetteer names as spans."""
    fragments, pairs = gazetteer.fragments(text), gazetteer.pairs(text)
    steps = F.aggregate(
        F.arrays_zip(fragments.alias("f"), pairs.alias("p")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans.SPAN}>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["f"]) + F.coalesce(F.length(x["p"]), F.lit(0))).alias("at"),
            F.when(
                x["p"].isNotNull(),
                F.array_append(
                    a["out"],
                    F.struct(
                        (a["at"] + F.length(x["f"])).alias("start"), (a["at"] + F.length(x["f"]) + F.length(x["p"])).alias("end"), x["p"].alias("value"),
                        F.lit("PERSON").alias("label"), F.lit("Gazetteer").alias("source"), F.lit(0).alias("prio"), F.lit(None).cast("string").alias("replacement"),
                    ),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.filter(steps["out"], lambda s: gazetteer.is_name(s["value"], words))
