"""Repeated passages, found with suffix arrays and longest-previous-factor arrays.

A 200-byte string belongs to its anchor: the 32-byte substring in it whose hash is least. Equal
strings have equal anchors at equal places, so only places that share an anchor need comparing:

1. each text gives its anchors, each with the run of 200-byte strings that belong to it;
2. anchors found once cannot repeat and go; runs that are equal as a whole repeat as a whole;
3. the other runs of a shared anchor (one of each kind) are fetched as bytes and cut down to what
   they share with a neighbour on either side of the anchor; cut runs that are equal repeat;
4. where cut runs of an anchor still differ, a suffix array of them gives each string's longest previous
   factor, from the previous and the next smaller position in suffix order: a factor of 200 bytes
   marks a later copy, its source the first one;
5. each document's marked bytes are joined to its text.

An anchor with more kinds of runs than MOST_RUNS (a passage between ever new neighbours) is not
put into one suffix array: the digests of its 200-byte strings are counted instead, which gives
the same marks by sums that spread over all tasks.

Defined results: a null text is empty; texts under 200 bytes have nothing to repeat unless they
hold one whole; matches never cross documents; repeated rows are copies of each other and each
get their row; rows without a doc_id, or with the same one, are told apart by their texts; no rows give no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import BYTE_WORDS, batch, discard, matched, materialise, release, rolling, sub_batches, texts

#: Bytes of a passage and of an anchor.
WIDTH, ANCHOR = 200, 32
#: Kinds of runs of one anchor that are compared in one task (each has 368 bytes at most).
MOST_RUNS = 20_000
#: Bytes of runs in one suffix array, but for one anchor's; bytes of a text hashed at once.
PACK, PIECE = 2 << 20, 4 << 20

_ANCHORS = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])
_RUNS = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("alone", pa.bool_()), ("doc", pa.int64()), ("at", pa.int64()), ("body", pa.binary())])
_MARKS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_STRINGS = pa.schema([("w", pa.binary()), ("alone", pa.bool_()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

_LOW = np.uint64((1 << 24) - 1)


def least_in_window(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive keys."""
    size, out = 1, keys
    while 2 * size <= n:
        out, size = np.minimum(out[: len(out) - size], out[size:]), 2 * size
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def scattered(h: np.ndarray) -> np.ndarray:
    """Hashes whose order says nothing about the bytes."""
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(buffer: np.ndarray, ends: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR):
    """Of texts one after the other in a buffer: anchor hash, run digest, first and last string of each run."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(buffer) < width:
        return none
    hashes = rolling(BYTE_WORDS[buffer], [anchor, width])
    h = scattered(hashes[anchor])
    # The leftmost of equal hashes: their places stand in the low bits.
    owner = (least_in_window((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - anchor + 1) & _LOW).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    fits = np.zeros(len(buffer) + 1, np.int32)
    counts = np.maximum(0, ends - begins - width + 1)
    np.add.at(fits, begins[counts > 0], 1)
    np.add.at(fits, (begins + counts)[counts > 0], -1)
    starts = np.flatnonzero(np.cumsum(fits)[: len(owner)] > 0)
    if not len(starts):
        return none
    owner = owner[starts]
    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])]
    strings = hashes[width]
    d = strings[first] * np.uint64(0x9E3779B97F4A7C15)
    d ^= d >> np.uint64(31)
    d = (d + strings[last]) * np.uint64(0x94D049BB133111EB) + (last - first).astype(np.uint64)
    d ^= d >> np.uint64(30)
    return h[owner[np.concatenate([[0], new])]], d * np.uint64(0xD6E8FEB86659FD93), first, last


def _pack(tag, first, last):
    """24 bits of a text's checksum, the place of a run's first string, and how many more it has, in one word."""
    return (np.asarray(tag, np.int64) << 39) | (first << 8) | (last - first)


def _anchors(batches):
    for b in sub_batches(batches, most=PIECE):
        docs, col = np.asarray(b.column("doc")).astype(np.int64), b.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        tags = np.array([zlib.crc32(data[s:e]) & 0xFFFFFF for s, e in zip(offsets, offsets[1:])], np.int64)
        for at in range(0, max(1, len(data)), PIECE if len(docs) == 1 else max(1, len(data))):
            part = data[at : at + PIECE + WIDTH - 1] if len(docs) == 1 else data
            ends = np.array([len(part)]) if len(docs) == 1 else offsets[1:]
            h, d, first, last = runs(part, ends)
            row = np.searchsorted(ends, first, side="right")
            inside = first + at - offsets[row]
            yield batch(_ANCHORS, [h.view(np.int64), d.view(np.int64), docs[row], _pack(tags[row], inside, inside + last - first)])


def _fetch(batches):
    for b in sub_batches(batches):
        out = [[] for _ in _RUNS]
        for doc, text, wanted in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist()):
            for w in wanted:
                first, more = (w["at"] >> 8) & 0x7FFFFFFF, w["at"] & 0xFF
                for column, v in zip(out, (w["h"], w["hot"], w["alone"], doc, w["at"], text[first : first + more + WIDTH])):
                    column.append(v)
        yield batch(_RUNS, out)


def repeats(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the width-byte strings in the bodies: body, place in it, is a later copy, is copied later.

    Ranks of prefixes are doubled up to the width. The suffix order of the strings' places then
    gives, for each, the nearest smaller place on either side; the longer of the common prefixes
    with these two is the longest previous factor.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for i, (b, at) in enumerate(zip(bodies, begins.tolist())):
        text[at : at + len(b)] = np.frombuffer(b, np.uint8)
        text[at + len(b)] = 256 + i  # an end that equals nothing else
    levels, step = [np.unique(text, return_inverse=True)[1].astype(np.int32)], 1
    while 2 * step <= width:
        rank = levels[-1].astype(np.int64)
        after = np.zeros_like(rank)
        after[: len(rank) - step] = rank[step:] + 1
        levels.append(np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int32))
        step *= 2
    counts = np.maximum(0, sizes - width + 1)
    body = np.repeat(np.arange(len(bodies)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    where = begins[body] + place
    if not len(where):
        return body, place, np.zeros(0, bool), np.zeros(0, bool)
    # Prefixes of step bytes at the start and at width - step cover the string, so two ranks order it.
    order = np.lexsort((levels[-1][where + width - step], levels[-1][where]))
    n = len(order)
    up, down, stack = [-1] * n, [-1] * n, []
    for i, at in enumerate(order.tolist()):  # places rise with their numbers
        while stack and stack[-1][1] > at:
            down[stack.pop()[0]] = i
        up[i] = stack[-1][0] if stack else -1
        stack.append((i, at))
    places = where[order]

    def factor(other: np.ndarray) -> np.ndarray:
        """The common prefix, up to the width, with the string at the given place in suffix order."""
        there, got = np.flatnonzero(other >= 0), np.zeros(n, np.int64)
        a, b, m = places[there], places[other[there]], np.zeros(len(there), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            for _ in range(2 if k == len(levels) - 1 else 1):
                ok = m + (1 << k) <= width
                i, j = np.where(ok, a + m, a), np.where(ok, b + m, b)
                m += np.where(ok & (levels[k][i] == levels[k][j]), 1 << k, 0)
        got[there] = m
        return got

    up, down = np.array(up), np.array(down)
    by_up, by_down = factor(up), factor(down)
    longest = np.maximum(by_up, by_down)
    source = np.where(by_up >= by_down, up, down)
    later, copied = np.zeros(n, bool), np.zeros(n, bool)
    later[order] = longest >= width
    copied[order[source[longest >= width]]] = True
    return body, place, later, copied


def mixed(words: np.ndarray) -> np.ndarray:
    """The hashes of all anchors in a buffer of byte words."""
    return scattered(rolling(words, [ANCHOR])[ANCHOR])


def _shared(sides: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How long a prefix each row has in common with another row of its group; sizes are the rows' own lengths."""
    # Symbols from 1 in two bytes each, so the filling after a row equals nothing in it.
    text = np.where(np.arange(sides.shape[1]) < sizes[:, None], sides.astype(">u2") + 1, 0).astype(">u2")
    order = np.lexsort((text.view(f"S{2 * text.shape[1]}")[:, 0], group))
    text, g, n = text[order], group[order], sizes[order]
    same = text[1:] == text[:-1]
    length = np.where(same.all(1), text.shape[1], same.argmin(1))
    length = np.where(g[1:] == g[:-1], np.minimum(length, np.minimum(n[1:], n[:-1])), 0)
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(np.concatenate([[0], length]), np.concatenate([length, [0]]))
    return out


def shared_parts(bodies: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run: from where to where it is shared with others of its anchor, on each side of the anchor.

    The others on the two sides need not be the same, so a part may be wider than any string that
    repeats, but no string outside it does.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(bodies), np.uint8)
    row = np.repeat(np.arange(len(bodies)), sizes)
    hashes = mixed(BYTE_WORDS[text])
    at = np.flatnonzero(hashes == anchors[row[: len(hashes)]])
    at = at[at + ANCHOR <= (begins + sizes)[row[at]]]
    found, first = np.unique(row[at], return_index=True)
    place = np.zeros(len(bodies), np.int64)
    place[found] = at[first] - begins[found]
    group = np.unique(anchors, return_inverse=True)[1]
    width, last = int(sizes.max()), max(0, len(text) - 1)
    right = text[np.clip((begins + place)[:, None] + np.arange(width), 0, last)]
    left = text[np.clip((begins + place)[:, None] - 1 - np.arange(width), 0, last)]
    return place - _shared(left, place, group), place + _shared(right, sizes - place, group)


def _mark_pack(rows: list[tuple]):
    """rows: doc, at, body, alone, anchor. The marks of the strings of `alone` runs that repeat, as spans."""
    if len(rows) < 2:
        return None
    low, high = shared_parts([r[2] for r in rows], np.array([r[4] for r in rows], np.int64).view(np.uint64))
    spans: list[tuple] = []  # row, first string, last string
    kinds: dict = {}
    for i in np.flatnonzero(high - low >= WIDTH).tolist():
        kinds.setdefault(rows[i][4], {}).setdefault(rows[i][2][low[i] : high[i]], []).append(i)
    several: list[tuple[bytes, list[int]]] = []
    for parts in kinds.values():
        for part, own in parts.items():
            if len(own) > 1:
                spans += [(i, low[i], high[i] - WIDTH) for i in own]
        if len(parts) > 1 and any(len(own) == 1 for own in parts.values()):
            several += parts.items()
    held, pack = 0, []
    for part, own in [*several, (None, [])]:
        if part is None or held > PACK and rows[own[0]][4] != rows[pack[-1][1][0]][4]:
            if pack:
                body, place, later, copied = repeats([x for x, _ in pack], WIDTH)
                hit = np.flatnonzero(later | copied)
                cuts = np.flatnonzero((np.diff(body[hit]) != 0) | (np.diff(place[hit]) != 1)) + 1
                for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(hit)]])) if len(hit) else ():
                    spans += [(i, low[i] + place[hit[a]], low[i] + place[hit[b - 1]]) for i in pack[body[hit[a]]][1]]
            held, pack = 0, []
        if part is not None:
            pack.append((part, own))
            held += len(part)
    spans = [x for x in spans if rows[x[0]][3]]
    if not spans:
        return None
    which, first, last = (np.array(x, np.int64) for x in zip(*spans))
    at = np.array([r[1] for r in rows], np.int64)[which]
    start = (at >> 8) & 0x7FFFFFFF
    return batch(_MARKS, [np.array([r[0] for r in rows], np.int64)[which], at >> 39, start + first, start + last + WIDTH])


def _mark(batches):
    """The marks of packs of anchors; the rows come ordered by anchor."""
    rows, held, key = [], 0, None
    for b in batches:
        for h, doc, at, body, alone in zip(*(b.column(c).to_pylist() for c in ("h", "doc", "at", "body", "alone"))):
            if h != key and held > PACK:
                if (out := _mark_pack(rows)) is not None:
                    yield out
                rows, held = [], 0
            rows.append((doc, at, body, alone, h))
            held, key = held + len(body), h
    if rows and (out := _mark_pack(rows)) is not None:
        yield out


def _strings(batches):
    for b in batches:
        for doc, at, body, alone in zip(*(b.column(c).to_pylist() for c in ("doc", "at", "body", "alone"))):
            n, first = len(body) - WIDTH + 1, (at >> 8) & 0x7FFFFFFF
            yield batch(_STRINGS, [[hashlib.blake2b(body[i : i + WIDTH], digest_size=16).digest() for i in range(n)], [alone] * n, [doc] * n, [at >> 39] * n, list(range(first, first + n))])


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the marked bytes, how many went, and in how many runs."""
    if not len(starts):
        return text, 0, 0
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(starts[1:] > far[:-1]) + 1
    first, last = starts[np.concatenate([[0], new])].tolist(), far[np.concatenate([new - 1, [len(far) - 1]])].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *last], [*first, len(text)]))
    return kept, len(text) - len(kept), len(first)


def _finish(batches):
    for b in sub_batches(batches):
        rows, marks = [], b.column("marks")
        offsets = np.asarray(marks.offsets)
        starts, ends = (np.asarray(marks.values.field(k)).astype(np.int64) for k in (0, 1))
        none = np.asarray(marks.is_null())
        for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            at, to = (0, 0) if none[i] else (offsets[i], offsets[i + 1])
            kept, removed, spans = cut(text, starts[at:to], ends[at:to])
            rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
        yield batch(_KEPT, [b.column("doc_id").cast(pa.int64()), *map(list, zip(*rows))])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and tag: which row's text a place is in, by 88 bits of doc_id and text; rows alike in both are one, and copies of each other."""
    return texts(docs).select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("doc"), F.crc32(F.col("text").cast("binary")).bitwiseAND(0xFFFFFF).alias("tag"), "text")


def repeated_marks(docs: DataFrame) -> DataFrame:
    """doc, tag, start, end: byte spans that cover exactly the repeated WIDTH-byte strings; they may overlap."""
    keyed, tag = _keyed(docs), F.shiftrightunsigned("at", 39)
    spark = docs.sparkSession
    every = materialise(keyed.select("doc", "text").mapInArrow(_anchors, "h long, d long, doc long, at long"), "anchors")
    shared = materialise(every.groupBy("h").agg(F.count("*").alias("n_h")).filter("n_h > 1"), "anchor-counts")
    release(spark)
    found = materialise(matched(every, shared, ["h"], "n_h").drop("n_h"), "shared-anchors")
    discard(every)
    discard(shared)
    release(spark)
    kinds = found.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("one"))
    kinds = materialise(kinds, "run-kinds")
    first = F.shiftrightunsigned("at", 8).bitwiseAND(0x7FFFFFFF)
    whole = matched(found, kinds.filter("n > 1").select("h", "d", "n"), ["h", "d"], "n").select("doc", tag.alias("tag"), first.alias("start"), (first + F.col("at").bitwiseAND(0xFF) + WIDTH).alias("end"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).filter("kinds > 1 and singles > 0")
    wanted = kinds.join(mixed, "h").select("h", (F.col("kinds") > MOST_RUNS).alias("hot"), (F.col("n") == 1).alias("alone"), "one.doc", "one.at")
    wanted = wanted.groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct("h", "hot", "alone", "at")).alias("wanted"))
    fetched = keyed.select("doc", "tag", "text").join(wanted.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "text", "wanted")
    fetched = materialise(fetched.mapInArrow(_fetch, "h long, hot boolean, alone boolean, doc long, at long, body binary"), "runs")
    usual = fetched.filter("not hot").repartition("h").sortWithinPartitions("h")
    usual = usual.mapInArrow(_mark, "doc long, tag long, start long, end long")
    strings = fetched.filter("hot").mapInArrow(_strings, "w binary, alone boolean, doc long, tag long, start long")
    again = strings.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    hot = strings.join(again, "w").filter("alone").select("doc", "tag", "start", (F.col("start") + WIDTH).alias("end"))
    return whole.union(usual).union(hot)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: every byte of a repeated passage goes, first copies too."""
    marks = repeated_marks(docs).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    rows = _keyed(docs).join(marks.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
