"""What the operators of this subpackage share: reading, tables between steps, Arrow helpers."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.storage import discard, materialise, shared_dir

__all__ = ["discard", "materialise", "shared_dir"]

#: A-Z to a-z, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets go of what finished steps have shuffled, without waiting for the driver to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns; other columns are dropped here."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: A key with more than this share of all rows is hot; there are at most 1 / HOT such keys.
HOT = 0.001


def matched(rows: DataFrame, groups: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined to groups, which has one row for each key and in n how many of the rows have it.

    The rows of hot keys stay where they are: their groups, 1 / HOT at most, are broadcast. So no key's rows are all
    dealt to one task. rows and groups are read twice, and should be tables.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col(n) > HOT * total))
    rest = rows.join(hot.select(*on), on, "left_anti").join(groups.filter(F.col(n) <= HOT * total), on, how)
    return rest.unionByName(rows.join(hot, on).select(*rest.columns))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sub_batches(batches, column: str = "text", most: int = 4 << 20):
    """Cuts Arrow batches into runs of rows that hold about `most` bytes of text; a longer row stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(b.column(column)).fill_null(0)).astype(np.int64)
        at, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        yield b.slice(at)


class Memory:
    """What a worker has met before: at most about `most` keys, of which those not asked for lately go first."""

    def __init__(self, most: int):
        self.young, self.old, self.most = {}, {}, most

    def missing(self, keys: set) -> list:
        """The keys that it doesn't have; the others are in `young` then."""
        if 2 * len(self.young) > self.most:
            self.young, self.old = {}, self.young
        out, young, old = [], self.young, self.old
        for k in keys.difference(young):
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                young[k] = v
        return out


def mixer(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: A random word for each byte value, and the odd multiplier of the rolling hashes.
BYTE_WORDS, MULTIPLIER = mixer(7, 256), 0xD6E8FEB86659FD93


def rolling(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes (modulo 2**64) of all substrings of the given lengths; entry i is for the one at i.

    Built by doubling: a hash of a + b symbols is hash_a * M**b + hash_b, so a length costs
    one pass for each of its binary digits.
    """
    most, powers, out = max(lengths), {1: words}, {}
    mult = lambda n: np.uint64(pow(MULTIPLIER, n, 1 << 64))
    join = lambda a, na, b, nb: a[: max(0, len(words) - na - nb + 1)] * mult(nb) + b[na : na + max(0, len(words) - na - nb + 1)]
    n = 1
    while 2 * n <= most:
        powers[2 * n] = join(powers[n], n, powers[n], n)
        n *= 2
    for length in lengths:
        done, have = None, 0
        for n in sorted(powers, reverse=True):
            if have + n <= length:
                done, have = (powers[n] if done is None else join(done, have, powers[n], n)), have + n
        out[length] = done[: max(0, len(words) - length + 1)]
    return out
