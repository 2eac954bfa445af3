"""Token ids in directly addressable codes.

A segment holds the ids of whole documents. Ids are split into 8-bit chunks by level: level 0 has
the low chunk of every id, level k the next chunk of those that go on, and a bitmap for each
level says which do. A rank directory counts the set bits before every block of 512, so the place
of an id's next chunk is one count away: any token is read without decoding those before it.

Segments are rows of a table in the shared folder, in ascending doc_id order: `part` is the range
of doc_ids, `seq` the segment in it, `before` the ids of the part before the segment, `payload`
the bytes described at `pack`.

Tokenizing: a text is cut before each single space that a visible character follows. The byte-level
pre-tokenizer always cuts there, so the library's ids of such pieces, one after the other,
are its ids of the whole text; pieces that were met before are not tokenized again. Texts for
which this would not hold go to the library whole.

Defined results: a null or empty text has the end id only; no rows give no rows; repeated
doc_ids each keep their row, in an order of their texts; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import Memory, batch, materialise, sub_batches, texts

#: The id after each document.
END_ID = 2
#: Ids in a segment, but for one document's.
SEGMENT = 1 << 18
#: Pieces of text whose ids a worker keeps.
MOST_KEPT = 1_200_000
#: Bits of one entry of a rank directory.
BLOCK = 512
_MAGIC = b"DAC1"

_SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, bitmap, rank directory) of each level; the last level has no bitmap set."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(sums) - sums).astype("<u4")
        out.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            return out
        rest = rest[more] >> 8


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: magic, number of documents, ids and levels; doc_ids; sizes; lengths of the levels; the levels."""
    levels = encode_levels(ids)
    head = _MAGIC + np.array([len(doc_ids), len(ids), len(levels)], "<u4").tobytes()
    lengths = np.array([len(x) for x, _, _ in levels], "<u4").tobytes()
    return head + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + lengths + b"".join(b"".join(x) for x in levels)


class Segment:
    """Random access to a packed segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != _MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_docs, self.n_ids, n_levels = np.frombuffer(payload, "<u4", 3, 4).tolist()
        at = 16
        self.doc_ids, at = np.frombuffer(payload, "<i8", n_docs, at), at + 8 * n_docs
        self.sizes, at = np.frombuffer(payload, "<u4", n_docs, at).astype(np.int64), at + 4 * n_docs
        lengths, at = np.frombuffer(payload, "<u4", n_levels, at).tolist(), at + 4 * n_levels
        self.levels = []
        for n in lengths:
            chunks, at = np.frombuffer(payload, np.uint8, n, at), at + n
            bits, at = np.frombuffer(payload, np.uint8, (n + 7) // 8, at), at + (n + 7) // 8
            ranks, at = np.frombuffer(payload, "<u4", (n + BLOCK - 1) // BLOCK, at), at + 4 * ((n + BLOCK - 1) // BLOCK)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """The i-th id: at each level one chunk, one bit, and one count within a block."""
        out, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            block = i // BLOCK
            part = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(ranks[block]) + int(part.sum()), shift + 8
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, which = np.zeros(self.n_ids, np.uint32), np.arange(self.n_ids)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[which] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            which = which[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


_HARD = re.compile(r" (?:\s|$)|<\|")
_loaded: dict = {}


class Tokens:
    """The tokenizers library behind a memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_file(path), Memory(MOST_KEPT)
        # Ids whose token begins with a space, which the byte-level alphabet writes as this letter.
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Tokenizes pieces, each after a space, as one text; the tokens that begin with a space part them again."""
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            starts = (4 * np.flatnonzero(self.spaced[ids])).tolist()
            if len(starts) != len(part):
                self.known.young.update((p, self.whole(" " + p)) for p in part)
                continue
            data = ids.tobytes()
            self.known.young.update((p, data[s:e]) for p, s, e in zip(part, starts, [*starts[1:], len(data)]))

    def encode(self, some: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [None if _HARD.search(text) else text.split(" ") for text in some]
        self.learn(self.known.missing(set().union(*(pieces[1:] for pieces in cut if pieces))))
        get, out = self.known.young.__getitem__, []
        firsts = iter(self.library.encode_batch_fast([pieces[0] for pieces in cut if pieces], add_special_tokens=False))
        for text, pieces in zip(some, cut):
            if pieces:
                out.append(np.array(next(firsts).ids, "<u4").tobytes() + b"".join(map(get, pieces[1:])))
            else:
                out.append(self.whole(text))
        return out


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def _store(path: str):
    def run(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts, held, end = [], [], [], 0, np.array([END_ID], "<u4").tobytes()

        def segment():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return batch(_SEGMENTS, [[part], [seq], [before], [len(ids)], [pack(np.array(docs, np.int64), np.array(sizes), ids)]])

        for b in sub_batches(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), tokens(path).encode(b.column("text").to_pylist())):
                n = len(ids) // 4 + 1
                if held and held + n > SEGMENT:
                    yield segment()
                    docs, sizes, parts, held, seq, before = [], [], [], 0, seq + 1, before + held
                docs.append(doc)
                sizes.append(n)
                parts += [ids, end]
                held += n
        if docs:
            yield segment()

    return run


def write(docs: DataFrame, path: str) -> DataFrame:
    """The segment table of the documents, in ascending doc_id order over parts; tokenizer file at path."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc_id"), "text")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return materialise(rows.mapInArrow(_store(path), "part int, seq long, before long, n_ids long, payload binary"), "token-segments")


def _read(batches):
    for b in batches:
        for part, before, payload in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("payload").to_pylist()):
            s = Segment(payload)
            ids, ends = s.ids().astype("<u4"), np.cumsum(s.sizes)
            sums = [zlib.crc32(ids[e - n : e]) for n, e in zip(s.sizes.tolist(), ends.tolist())]
            docs = pa.array(s.doc_ids, mask=s.doc_ids == -(1 << 63))
            yield batch(_DOCS, [docs, np.full(len(ends), part, np.int32), before + ends - s.sizes, s.sizes, np.array(sums, np.int64)])


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a segment table, from its payloads."""
    docs = segments.select("part", "before", "payload").mapInArrow(_read, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    # One row for each part, of which there are as many as tasks.
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
