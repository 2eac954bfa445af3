"""Secret scans: patterns in each text, then how widely each candidate is owned over the corpus.

Base spans are what the patterns find. Then each candidate value is hashed and counted by
distinct repositories (source and language) and owners (source) over all documents. A value that WIDE_OWNERS owners or
WIDE_REPOS repositories hold has been copied widely: its span is added under kind "example". Any other looks like
its owner's live credential: its span is added under kind "live". Counting is by partial sums of (value,
repository, owner), so a value that every document holds moves as one row for each task.

Defined results: null texts are empty; empty texts have no spans; a null source is an owner of
its own, as is a null language; repeated rows each get their row and count once; no rows give no rows; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import LOWER, batch, matched, materialise, sub_batches, texts

#: Kinds in their order; the first three are base.
KINDS = ("assign", "access", "hex", "live", "example")
#: Owners, and repositories, from which a value counts as copied widely.
WIDE_OWNERS, WIDE_REPOS = 3, 4
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: For maximal runs a least length in the pattern equals a filter after it.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEXED = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 46 for b in range(256))
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("value", pa.string())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("found", _SPANS)])


def find(text: str) -> list[tuple[int, int, int, int]]:
    """The base spans of a text: kind's number, start, end, start of the secret itself; by start, then kind."""
    data, out = text.encode("utf-8", "surrogatepass"), []
    low = data.translate(LOWER)
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    if b"h" * 32 in data.translate(_HEXED):
        out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _scan(batches):
    for b in sub_batches(batches):
        found = [[{"kind": k, "start": s, "end": e, "from": v, "value": hashlib.sha256(t[v:e].encode()).hexdigest()} for k, s, e, v in find(t)] for t in b.column("text").to_pylist()]
        yield batch(_SCHEMA, [b.column("doc_id").cast(pa.int64()), b.column("source").cast(pa.string()), b.column("lang").cast(pa.string()), found])


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, found: base spans with the hashes of their values, ordered; written to the shared folder."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return materialise(df.mapInArrow(_scan, "doc_id long, source string, lang string, found array<struct<kind:int,start:int,end:int,from:int,value:string>>"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners, n_found: over all rows of scan()."""
    held = found.select(F.explode("found.value").alias("value"), "source", "lang").groupBy("value", "source", "lang").agg(F.count("*").alias("n_found"))
    owned = held.groupBy("value", "source").agg(F.count("*").alias("n_repos"), F.sum("n_found").alias("n_found"))
    return owned.groupBy("value").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n_found").alias("n_found"))


def secret_spans(docs: DataFrame, owners: int = WIDE_OWNERS, repos: int = WIDE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example: one row for each row of docs."""
    rows = scan(docs)
    some = rows.filter(F.size("found") > 0)
    widths = materialise(ownership(some), "secret-owners")
    # Rows that repeat a doc_id with equal findings are classified once, so the join below keeps every row.
    keyed = some.select("doc_id", "found", F.explode("found").alias("s")).distinct()
    told = matched(materialise(keyed.withColumn("value", F.col("s.value")), "secret-values"), widths, ["value"], "n_found")
    live = F.when((F.col("n_owners") < owners) & (F.col("n_repos") < repos), F.lit(KINDS.index("live"))).otherwise(F.lit(KINDS.index("example")))
    added = told.groupBy("doc_id", "found").agg(F.collect_set(F.struct(F.col("s.from").alias("start"), live.alias("kind"), F.col("s.end").alias("end"))).alias("added"))
    left, right = rows.alias("l"), added.alias("r")
    both = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.found") == F.col("r.found")), "left")
    base = F.transform("l.found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = F.coalesce("r.added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    both = both.select("l.doc_id", base.alias("base"), F.array_sort(F.concat(base, more)).alias("every"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return both.select("doc_id", *(count("base", k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), *(count("every", k).alias(f"n_{k}") for k in KINDS[3:]))
