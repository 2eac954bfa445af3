"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark items.

Its letters are words: each word of the benchmark has a number, every other word is 0, so a text is scanned once, word by
word, and the places of the hit words lead back to the characters of the original text. A number is written in two
letters of about the root of all numbers, of which the first differ from the second, since nodes look through their letters one by one.

The benchmark is broadcast, so its size is checked: more than MOST_BYTES of item texts are refused (scan in
parts of the items then, and join spans and items by document). Each worker builds an automaton for every MOST_WINDOWS windows;
where there are several, one is in memory at a time, and each takes a run of texts before the next is built.

Defined results: null or empty texts have no words and are clean; items without words, or
without an id, match nothing; repeated item ids count as one item; an empty benchmark leaves all
documents clean; repeated rows each get their row, null doc_ids too; a text of any length is scanned whole; items of
one text each count; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import batch, sub_batches, text_bytes, texts

#: Consecutive words in a window; items from which a document is contaminated.
WINDOW, ITEMS = 8, 2
#: Windows in one automaton (each takes some hundred bytes); bytes of all item texts.
MOST_WINDOWS, MOST_BYTES = 500_000, 256 << 20
#: Bytes of texts that one of several automata takes in a run.
SEVERAL = 64 << 20

#: Bytes that end words become a space, A-Z become a-z; all bytes of other characters belong to words.
NORMAL = bytes((b | 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def cut(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """The windows of items (id, text): the words' numbers, and blocks of windows with the items that hold them."""

    def __init__(self, items, size: int = WINDOW, most: int = MOST_WINDOWS):
        self.key = uuid.uuid4().hex
        numbers: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in cut((text or "").encode())) if item is not None else ()
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(ids[i : i + n], set()).add(str(item))
        base = math.isqrt(len(numbers)) + 1
        letters = [(base + i // base, i % base) for i in range(len(numbers) + 1)]
        self.words, self.other = {w: letters[i] for w, i in numbers.items()}, letters[0]
        every = [(tuple(chain.from_iterable(letters[i] for i in k)), sorted(v)) for k, v in found.items()]
        self.blocks = [every[i : i + most] for i in range(0, len(every), most)]

    def line(self, words: list[bytes]) -> tuple:
        """The letters of a text."""
        get, other = self.words.get, self.other
        return tuple(chain.from_iterable([get(w, other) for w in words]))


def automaton(block: list[tuple[tuple, list[str]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in block:
        a.add_word(key, (len(key) // 2, ids))
    a.make_automaton()
    return a


_built: dict = {}


def _machine(shared, i: int) -> ahocorasick.Automaton:
    """The i-th automaton; a worker keeps one at a time."""
    if (key := (shared.value.key, i)) not in _built:
        _built.clear()
        _built[key] = automaton(shared.value.blocks[i])
    return _built[key]


def _chars(data: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before each byte offset."""
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(starts)])[at]


def _spans(data: bytes, hit: np.ndarray) -> list[dict]:
    """The runs of hit words in code points of the text."""
    inside = np.frombuffer(b" " + data.translate(NORMAL) + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # starts and ends of words by turns
    first, last = _chars(data, edges[0::2]), _chars(data, edges[1::2])
    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(first[i]), "end": int(last[j - 1])} for i, j in zip(turns[0::2], turns[1::2])]


def _scan(shared, least: int):
    def run(batches):
        windows, n_blocks = shared.value, len(shared.value.blocks)
        for b in sub_batches(batches, most=4 << 20 if n_blocks < 2 else SEVERAL):
            some = text_bytes(b.column("text"))
            lines = [windows.line(cut(data)) for data in some]
            found: list[list] = [[] for _ in some]
            for i in range(n_blocks):
                machine = _machine(shared, i)
                for row, line in enumerate(lines):
                    if line:
                        found[row] += machine.iter(line)
            rows = []
            for data, line, got in zip(some, lines, found):
                n_words = len(line) // 2
                marks, items = np.zeros(n_words + 1, np.int64), set()
                for end, (n, ids) in got:
                    marks[(end + 1) // 2 - n] += 1
                    marks[(end + 1) // 2] -= 1
                    items.update(ids)
                hit = np.cumsum(marks)[:-1] > 0
                rows.append((n_words, int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= least, _spans(data, hit) if items else []))
            yield batch(_SCHEMA, [b.column("doc_id").cast(pa.int64()), *map(list, zip(*rows))])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least: int = ITEMS, most: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit runs, code points of the original text)."""
    held = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > MOST_BYTES:
        raise ValueError(f"{held} bytes of items are too many to be broadcast: scan in parts")
    items = ((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, size, most))
    return texts(docs).mapInArrow(_scan(shared, least), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>")
