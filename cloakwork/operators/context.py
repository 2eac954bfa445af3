"""The corpus scan: names that a role introduces, gazetteer names, and fields nobody has judged yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.words import FIELD_HINTS, FOLLOWERS, NON_NAMES, ROLES
from cloakwork.operators import gazetteer



def _by_first_letter(patterns: tuple[str, ...]) -> str:
    """An alternation of patterns of which no two fit at one place, tried by their first letters."""
    ways: dict[str, list[str]] = {}
    for p in patterns:
        ways.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in ways.items())


#: Two words after a role; what follows must be closing punctuation, a line's end or one of the followers.
NAME = rf"(?iU)(?:{_by_first_letter(ROLES)})[,:\s]+([A-Z][a-z]{{1,20}}\s+[A-Z][a-z]{{1,20}})(?=\s*[(,.\n\r]|\s+(?:{'|'.join(FOLLOWERS)})\b)"
FIELD = rf"(?iU)(?:{'|'.join(FIELD_HINTS)})[:\s#]+([A-Z0-9\-]+)"
#: Bytes of a job above which a web service may skip the scan (see `scan`), and the most names a job may know.
SCAN_LIMIT, MOST_NAMES = 1_000_000, 100_000


def _may_be_name(name: Column) -> Column:
    return ~F.exists(F.split(F.lower(name), r"(?U)\s+"), lambda w: w.isin(*NON_NAMES))


def introduced(docs: DataFrame) -> DataFrame:
    """name: distinct names that a role introduces, over all documents."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("name"))
    return found.filter(_may_be_name(F.col("name"))).distinct()


def listed(docs: DataFrame, words: list[str]) -> DataFrame:
    """name: distinct gazetteer names."""
    return docs.select(F.explode(gazetteer.pairs(F.col("text"))).alias("name")).filter(gazetteer.is_name(F.col("name"), words)).distinct()


def known_names(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """name: what either detector finds in any document; the documents are read once."""
    if not words:
        return introduced(docs)
    found = F.filter(F.regexp_extract_all("text", F.lit(NAME), F.lit(1)), _may_be_name)
    named = F.filter(gazetteer.pairs(F.col("text")), lambda p: gazetteer.is_name(p, words))
    return docs.select(F.explode(F.concat(found, named)).alias("name")).distinct()


def fields(docs: DataFrame) -> DataFrame:
    """field: distinct field words of the documents, upper case."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(FIELD), F.lit(0))).alias("hit"))
    return found.select(F.regexp_replace(F.upper(F.element_at(F.split("hit", r"(?U)\s+"), 1)), r"[:#]+\z", "").alias("field")).distinct()


def unknown_fields(docs: DataFrame, schema: DataFrame) -> DataFrame:
    """field: those that schema(field, …) does not hold."""
    return fields(docs).join(schema.select("field"), "field", "left_anti")


def scan(docs: DataFrame, words: list[str] | None = None, limit: int | None = None) -> list[str]:
    """The job's known names, sorted, over all documents; with a limit, none if the job's bytes pass it.

    The names become part of the plan, so their number is checked.
    """
    if limit is not None and (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > limit:
        return []
    names = [r[0] for r in known_names(docs, words).limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names: cut the job up")
    return sorted(names)


def classified(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """field, is_pii, modes: unknown fields with the answers (field, is_pii, modes); without one, not personal."""
    return fields.join(answers, "field", "left").select("field", F.coalesce("is_pii", F.lit(False)).alias("is_pii"), F.coalesce(F.when(F.col("is_pii"), F.col("modes")), F.array().cast("array<string>")).alias("modes"))


def schema_map(rows: DataFrame) -> dict:
    """rows (field, is_pii, modes) as the mapping that redact() takes, in the order of fields."""
    return {r["field"]: {"is_pii": r["is_pii"], "modes": list(r["modes"] or [])} for r in rows.orderBy("field").collect()}
