"""Near-duplicates by SimHash fingerprints: pigeonhole blocks, then the Hamming distance.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other; a text of fewer words than a shingle has one shingle, all its words; no
rows give no rows; repeated rows each get their row; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import LOWER, batch, matched, materialise, sub_batches, text_bytes, texts
from cloakwork.llm.graph import connected_components

#: Words in a shingle, the hash's seed, the bits in which linked fingerprints may differ.
WORDS, SEED, DISTANCE = 3, 42, 2
#: Four blocks of 16 bits: fingerprints within two bits have two whole blocks in common.
BLOCKS = 4
#: In a bucket of up to so many fingerprints all pairs are compared; a larger one is linked through one-bit neighbours.
PAIRS = 64
#: Shingles whose hashes are held at once.
_RUN = 1 << 19

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    first = ends - sizes
    last = ends[min(words, len(parts)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, _RUN):
        spans = zip(first[at : min(n, at + _RUN)].tolist(), last[at : at + _RUN].tolist())
        hashes = b"".join([digest(line[a:b], seed) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches):
    for b in sub_batches(batches):
        fps = np.array([fingerprint(t) for t in text_bytes(b.column("text"))], np.uint64).view(np.int64)
        yield batch(_FINGERPRINTS, [b.column("doc_id").cast(pa.int64()), pa.array(fps)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """src, dst: links that connect exactly the fingerprints (fps: distinct fp) within two bits.

    The pairs of a bucket are compared while it has at most PAIRS members. Two fingerprints are
    within two bits if and only if they share a neighbour at one bit or less, so the members of
    larger buckets are hung on such neighbours: 65 rows a member instead of all pairs, and the
    same components.
    """
    size = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", size * i).bitwiseAND((1 << size) - 1) for i in range(BLOCKS)]
    keys = [F.lit(k << 2 * size).bitwiseOR(F.shiftleft(block[i], size)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = materialise(keyed.join(counts, "key"), "blocks")
    few = keyed.filter(F.col("n") <= PAIRS)
    pairs = few.select("key", F.col("fp").alias("src")).join(few.select("key", F.col("fp").alias("dst")), "key")
    pairs = pairs.filter((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE)).select("src", "dst")
    many = keyed.filter(F.col("n") > PAIRS).select("fp").distinct()
    flips = [F.lit(0).cast("long")] + [F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)]
    near = many.select("fp", F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    roots = near.groupBy("near").agg(F.min("fp").alias("src"), F.count("*").alias("n")).filter("n > 1").select("near", "src")
    hung = near.join(roots, "near").select("src", F.col("fp").alias("dst")).filter("src <> dst")
    return pairs.union(hung).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), group_size."""
    rows = materialise(fingerprints(docs), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    nodes = materialise(connected_components(links(fps.select("fp"))), "components")
    # A component may hold any number of fingerprints, so what it comes to goes back to them as to rows of a hot key.
    linked = materialise(fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "linked-fingerprints")
    named = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("n_fps"))
    named = materialise(named, "fingerprint-components")
    classes = matched(linked.select("fp", "n", "component"), named, ["component"], "n_fps").select("fp", "n", "component_id", "group_size")
    out = matched(rows, materialise(classes, "fingerprint-classes"), ["fp"], "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("group_size").cast("long").alias("group_size"))
