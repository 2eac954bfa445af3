"""Exact deduplication by content-defined chunk recipes.

Long texts are cut where their content says so. Chunks are first deduplicated to identifiers
whose bytes were compared; documents are then compared by their ordered identifier lists, so a
long text moves at most once however often it occurs.

Defined results: a null text is an empty one; empty texts are copies of each other; no rows give
no rows; columns other than doc_id and text are not looked at; of rows that repeat a doc_id with
the same text each gets a row and counts in group_size, and all of those with the largest doc_id
of a group have kept = true.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import BYTE_WORDS, batch, matched, materialise, rolling, sub_batches, text_bytes, texts

#: Chunk sizes in bytes: least, about the mean above the least (a power of two), most.
LEAST, MEAN, MOST = 4096, 8192, 65536
#: A cut is decided by so many bytes before it.
WINDOW = 32
#: More digests than this with differing contents mean a broken digest.
MOST_CLASHES = 10_000

_CHUNKS = pa.schema([("digest", pa.binary()), ("body", pa.binary())])
_RECIPES = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary())])


def chunks(data: bytes) -> list[bytes]:
    """The content-defined chunks of data, in order; none for empty data."""
    n = len(data)
    if n <= LEAST:
        return [data] if n else []
    out, start = [], 0
    for begin in range(0, n, 1 << 22):  # the hashes of a very long text are made piece by piece
        piece = np.frombuffer(data, np.uint8, min(n, begin + (1 << 22) + WINDOW) - begin, begin)
        if len(piece) < WINDOW:
            break
        h = rolling(BYTE_WORDS[piece], [WINDOW])[WINDOW]
        cuts = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + begin + WINDOW
        for cut in cuts.tolist():
            while cut - start > MOST:
                out.append(data[start : start + MOST])
                start += MOST
            if cut - start >= LEAST:
                out.append(data[start:cut])
                start = cut
    while n - start > MOST:
        out.append(data[start : start + MOST])
        start += MOST
    if n > start:
        out.append(data[start:])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _cut(batches):
    for b in sub_batches(batches):
        bodies = {c: None for t in text_bytes(b.column("text")) for c in chunks(t)}
        yield batch(_CHUNKS, [[digest(c) for c in bodies], list(bodies)])


def _recipes(clashes: frozenset):
    def run(batches):
        for b in sub_batches(batches):
            ids, sums, recipes = b.column("doc_id"), [], []
            for t in text_bytes(b.column("text")):
                sums.append(hashlib.sha256(t).hexdigest())
                marks = [(digest(c), c) for c in chunks(t)]
                recipes.append(b"".join(b"\1" + len(c).to_bytes(8, "big") + c if d in clashes else b"\0" + d for d, c in marks))
            yield batch(_RECIPES, [ids.cast(pa.int64()), sums, recipes])

    return run


def chunk_clashes(docs: DataFrame) -> frozenset:
    """The digests under which differing chunks are found: every chunk's bytes are compared. None is expected."""
    bodies = texts(docs).select("text").mapInArrow(_cut, "digest binary, body binary").distinct()
    found = bodies.groupBy("digest").count().filter("count > 1").select("digest").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise ValueError("chunk digests clash too often to be identifiers")
    return frozenset(bytes(r[0]) for r in found)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    rows = texts(docs).mapInArrow(_recipes(chunk_clashes(docs)), "doc_id long, text_sha256 string, recipe binary")
    rows = materialise(rows, "recipes")
    groups = materialise(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    return matched(rows, groups, ["recipe"], "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
