"""SentencePiece encoding and decoding, with giant documents as a max-plus parallel scan.

The model is a byte-pair model: the pieces of a text are the one path through the lattice of all
pieces on which every two neighbours are compatible, that is, the model leaves just these two
when it is given their text alone. With weight 0 for compatible neighbours and minus infinity for
others, the best path is a max-plus product, so a giant text can be cut anywhere:

1. each chunk gives a transfer matrix: rows are the pieces that may lie across its left edge,
   columns those across its right edge, entries the weight of the best path between them;
2. the matrices are combined associatively, which fixes the piece across every edge;
3. each chunk is then traced back on its own, between its two edge pieces.

No piece of the model goes on past a space (the codec checks this when it loads a model), so an
edge before a space that follows a visible character can only lie between two pieces. Such an
edge has a single state, its matrix is the one entry 0, and nothing has to be combined. Edges are
put there wherever a chunk has such a place; only text without spaces needs larger matrices.

Texts of ordinary length, and the stretches between single-state edges, go through the library,
word by word, and a word met before is not encoded again.

Defined results: a null or empty text has no ids and decodes to the empty text; no rows give no
rows; repeated rows each get their row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import Memory, batch, materialise, sub_batches, texts

#: A text of more characters is giant; characters in a chunk of it.
GIANT, CHUNK = 65_536, 32_768
#: Words whose ids a worker keeps.
MOST_KEPT = 1_200_000
SPACE = "▁"

_IDS = pa.list_(pa.int32())
_CODED = pa.schema([("doc_id", pa.int64()), ("ids", _IDS), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
_HARD = re.compile(f"^ |  | $|{SPACE}")
_EDGE = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")


class Codec:
    """A SentencePiece model behind a memory of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), Memory(MOST_KEPT)
        n = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(n)]
        self.pieces = {self.model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: self.model.get_score(i) for p, i in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this model goes on past a space")
        self.bytes = {b: self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self._pairs: dict = {}

    # Ordinary texts and stretches

    def encode(self, some: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian 32-bit integers."""
        words = [text.split(" ") if text and not _HARD.search(text) else None for text in some]
        asked = self.known.missing(set().union(*filter(None, words)))
        known = self.known.young
        for at in range(0, len(asked), 4096):
            part = asked[at : at + 4096]
            known.update((w, np.array(i, "<i4").tobytes()) for w, i in zip(part, self.model.encode(part, num_threads=1)))
        get = known.__getitem__
        return [b"".join(map(get, parts)) if parts else np.array(self.model.encode(text, num_threads=1) if text else [], "<i4").tobytes() for text, parts in zip(some, words)]

    # Max-plus scan

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of adjacent symbols: best score first, leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = max((self.scores.get(a + b, -1e30), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best[0] == -1e30:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def compatible(self, a: str, b: str) -> bool:
        """Whether the model leaves pieces a and b when it is given their text."""
        if (got := self._pairs.get((a, b))) is None:
            if len(self._pairs) > MOST_KEPT // 2:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merged(list(a + b)) == [a, b]
        return got

    def candidates(self, text: str, end: int) -> list[str]:
        """The pieces that end at a place of the normal text; a character without a piece stands for itself."""
        found = [p for n in range(1, min(self.longest, end) + 1) if (p := text[end - n : end]) in self.pieces and (n == 1 or self.own(p))]
        return found if found and len(found[0]) == 1 else [text[end - 1 : end], *found]

    def own(self, piece: str) -> bool:
        """Whether the model makes this piece from its characters."""
        if (got := self._pairs.get(piece)) is None:
            got = self._pairs[piece] = self.merged(list(piece)) == [piece]
        return got

    def states(self, text: str, edge: int) -> list[tuple[int, int]]:
        """The pieces, as (start, end), that may hold the last character before an edge."""
        if edge == 0:
            return [(0, 0)]
        return [(end - len(p), end) for end in range(edge, min(len(text), edge + self.longest - 1) + 1) for p in self.candidates(text, end) if end - len(p) < edge]

    def _lattice(self, text: str, left: list[tuple[int, int]], to: int) -> dict:
        """For each piece that ends after the left edge and begins before `to`: which left states reach it, as bits.

        Paths that begin at the left states only are followed, so all weights are 0 or minus infinity.
        """
        reach: dict = {}
        ending: dict = {}
        for bit, s in enumerate(left):
            reach[s] = reach.get(s, 0) | 1 << bit
            ending.setdefault(s[1], []).append(s)
        low = min(s[1] for s in left)
        for end in range(low + 1, min(len(text), to + self.longest - 1) + 1):
            for p in self.candidates(text, end):
                start = end - len(p)
                if start < low or start >= to or (start, end) in reach:
                    continue
                bits = 0
                for before in ending.get(start, ()):
                    if before[0] == before[1] or self.compatible(text[before[0] : before[1]], p):
                        bits |= reach[before]
                if bits:
                    reach[start, end] = bits
                    ending.setdefault(end, []).append((start, end))
        return reach

    def transfer(self, text: str, edge: int, to: int) -> np.ndarray:
        """The max-plus matrix from the states at one edge of the text to those at the next."""
        left, right = self.states(text, edge), self.states(text, to)
        reach = self._lattice(text, left, to)
        return np.array([[0.0 if reach.get(r, 0) >> i & 1 else -np.inf for r in right] for i in range(len(left))])

    def trace(self, text: str, left: tuple[int, int], right: tuple[int, int]) -> list[str]:
        """The pieces after the left edge's piece, up to and with the right edge's."""
        if left == right:
            return []
        reach = self._lattice(text, [left], right[1])
        starts: dict = {}
        for s, e in reach:
            starts.setdefault(e, []).append((s, e))
        out, at = [], right
        while at != left:
            out.append(text[at[0] : at[1]])
            at = next(x for x in starts[at[0]] if x[0] == x[1] or self.compatible(text[x[0] : x[1]], text[at[0] : at[1]]))
        return out[::-1]

    def choose(self, matrices: list[np.ndarray]) -> list[int]:
        """The state at each edge on the best path over all chunks: products from the left and from the right."""
        before, after = [np.zeros((1, 1))], [np.zeros((matrices[-1].shape[1], 1))]
        for m in matrices:
            before.append(times(before[-1], m))
        for m in reversed(matrices):
            after.append(times(m, after[-1]))
        return [int(np.argmax(b[0] + a[:, 0])) for b, a in zip(before, reversed(after))]

    def traced(self, chunk: dict, left: int, right: int) -> list[int]:
        """The ids of one chunk between the chosen states of its edges."""
        text, a, b = chunk["body"], chunk["a"], chunk["b"]
        return self.ids(self.trace(text, self.states(text, a)[left], self.states(text, b)[right]))

    def scan(self, text: str, size: int = CHUNK) -> list[int]:
        """The ids of a text by the transfer matrices of its chunks, all in this process."""
        parts = list(chunks(text, size, self.longest))
        states = self.choose([self.transfer(c["body"], c["a"], c["b"]) for c in parts])
        return [i for c, l, r in zip(parts, states, states[1:]) for i in self.traced(c, l, r)]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += [self.pieces[p]] if p in self.pieces else [self.bytes[b] for b in p.encode()]
        return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; it is associative, so chunks may be combined in any grouping."""
    return (a[:, :, None] + b[None, :, :]).max(1)


_loaded: dict = {}


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def stretches(text: str, size: int = CHUNK) -> list[str]:
    """The text cut at single-state edges about every `size` characters; the space at an edge goes.

    A stretch is as long as it must be where no such edge comes.
    """
    out, at = [], 0
    while len(text) - at > size:
        m = _EDGE.search(text, at + size - 1)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def chunks(text: str, size: int, longest: int):
    """The chunks of a text in normal form: body, with the model's longest piece around, the edges in it, and its own characters."""
    normal = SPACE + text.replace(" ", SPACE)
    edges = [0, *range(size, len(normal), size), len(normal)]
    for a, b in zip(edges, edges[1:]):
        low = max(0, a - longest)
        yield {"body": normal[low : b + longest], "a": a - low, "b": b - low, "own": text[max(0, a - 1) : b - 1]}


def _coded(model: Codec, ids: list[bytes], some: list[bytes], docs) -> pa.RecordBatch:
    decoded = [t.encode() for t in model.model.decode([np.frombuffer(i, "<i4").tolist() for i in ids], num_threads=1)] if ids else []
    sizes = [len(i) // 4 for i in ids]
    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return batch(_CODED, [docs, column, sizes, [zlib.crc32(i) for i in ids], [hashlib.sha256(d).hexdigest() for d in decoded], [d == t for d, t in zip(decoded, some)]])


def _encode(path: str):
    def run(batches):
        model = codec(path)
        for b in sub_batches(batches):
            some = b.column("text").to_pylist()
            yield _coded(model, model.encode(some), [t.encode() for t in some], b.column("doc_id").cast(pa.int64()))

    return run


_ROWS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("body", pa.string()), ("own", pa.string())])
_PARTS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("k", pa.int64()), ("part", pa.binary())])
_MATRICES = pa.schema([("key", pa.binary()), ("seq", pa.int64()), ("k", pa.int64()), ("rows", pa.int64()), ("cols", pa.int64()), ("bits", pa.binary())])
_CHOSEN = pa.schema([("key", pa.binary()), ("seq", pa.int64()), ("k", pa.int64()), ("left", pa.int64()), ("right", pa.int64())])
_ddl = lambda schema: ", ".join(f"{f.name} {({'int64': 'long', 'binary': 'binary', 'string': 'string'})[str(f.type)]}" for f in schema)


def _cut(path: str):
    """Each giant row's stretches (k null), and chunks of those that stay long; the key tells apart rows with one doc_id."""

    def run(batches):
        longest = codec(path).longest
        for b in sub_batches(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                key = uuid.uuid4().bytes
                for seq, part in enumerate(stretches(text)):
                    rows = [{"body": part}] if len(part) <= 2 * CHUNK else chunks(part, CHUNK, longest)
                    for k, c in enumerate(rows):
                        yield batch(_ROWS, [[key], [doc], [seq], [k if "a" in c else None], [c.get("a")], [c.get("b")], [c["body"]], [c.get("own", c["body"])]])

    return run


def _encode_stretches(path: str):
    def run(batches):
        model = codec(path)
        for b in sub_batches(batches, "body"):
            yield batch(_PARTS, [b.column("key"), b.column("doc_id"), b.column("seq"), b.column("k"), model.encode(b.column("body").to_pylist())])

    return run


def _transfers(path: str):
    def run(batches):
        model = codec(path)
        for b in batches:
            for r in b.to_pylist():
                m = model.transfer(r["body"], r["a"], r["b"])
                yield batch(_MATRICES, [[r["key"]], [r["seq"]], [r["k"]], [m.shape[0]], [m.shape[1]], [np.packbits(m == 0).tobytes()]])

    return run


def _choose(path: str):
    def run(batches):
        model = codec(path)
        for b in batches:
            for r in b.to_pylist():
                bits = [(m["rows"], m["cols"], np.frombuffer(m["bits"], np.uint8)) for m in r["matrices"]]
                states = model.choose([np.where(np.unpackbits(x, count=n * c).reshape(n, c), 0.0, -np.inf) for n, c, x in bits])
                n = len(bits)
                yield batch(_CHOSEN, [[r["key"]] * n, [r["seq"]] * n, list(range(n)), states[:-1], states[1:]])

    return run


def _trace(path: str):
    def run(batches):
        model = codec(path)
        for b in batches:
            for r in b.to_pylist():
                ids = np.array(model.traced(r, r["left"], r["right"]), "<i4").tobytes()
                yield batch(_PARTS, [[r["key"]], [r["doc_id"]], [r["seq"]], [r["k"]], [ids]])

    return run


def _join(path: str):
    def run(batches):
        model = codec(path)
        for b in batches:
            for doc, text, parts in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("parts").to_pylist()):
                yield _coded(model, [b"".join(p["part"] for p in parts)], [text.encode()], [doc])

    return run


_RESULT = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, round_trip.

    round_trip: the ids decode to the whole text again. Giant texts are dealt out as stretches and chunks.
    """
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usual = rows.filter(F.length("text") <= GIANT).mapInArrow(_encode(path), _RESULT)
    giant = materialise(rows.filter(F.length("text") > GIANT).mapInArrow(_cut(path), _ddl(_ROWS)), "stretches")
    coded = giant.filter("k is null").repartition("key", "seq").mapInArrow(_encode_stretches(path), _ddl(_PARTS))
    long = giant.filter("k is not null")
    matrices = long.repartition("key", "seq", "k").mapInArrow(_transfers(path), _ddl(_MATRICES))
    matrices = matrices.groupBy("key", "seq").agg(F.array_sort(F.collect_list(F.struct("k", "rows", "cols", "bits"))).alias("matrices"))
    chosen = matrices.mapInArrow(_choose(path), _ddl(_CHOSEN))
    traced = long.join(chosen, ["key", "seq", "k"]).select("key", "doc_id", "seq", "k", "a", "b", "body", "left", "right").mapInArrow(_trace(path), _ddl(_PARTS))
    parts = coded.union(traced).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "k", "part"))).alias("parts"))
    # The text again, to hold the decoding against; the space at an edge went.
    whole = giant.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "k", "own"))).alias("owns"))
    space = lambda x: F.when((x["seq"] > 0) & (F.coalesce(x["k"], F.lit(0)) == 0), " ").otherwise("")
    text = F.array_join(F.transform("owns", lambda x: F.concat(space(x), x["own"])), "")
    return usual.union(parts.join(whole, "key").select("doc_id", text.alias("text"), "parts").mapInArrow(_join(path), _RESULT))
