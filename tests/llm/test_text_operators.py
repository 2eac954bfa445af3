"""Decontamination, secrets, tokens, pieces, quality and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest_llm import frame, words

from cloakwork.llm import decontaminate, piece_codec, quality, secrets, token_store, toxicity


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_windows(rows, items):
    out = []
    for doc, text, _ in rows:
        w, hit, found = cut(text), set(), set()
        for item, t in items:
            q = cut(t)
            n = min(8, len(q))
            for i in range(len(q) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == q[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return Counter(out)


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_decontamination(spark, small, most):
    rows = [r for r in small if r[0] < 40 or r[0] > 49]
    text = dict((i, t) for i, t, _ in rows)
    items = [(1, " ".join(text[2].split()[3:20])), (10, " ".join(text[2].split()[15:40]).upper()), (2, "one two"), (3, None), (4, " ...!"), (5, " ".join(text[7].split()[:9])), (5, "repeated item id"), (7, "é" * 300)]
    rows += [(90, "Prefix, é! " + text[2].replace(" ", "--") + " suffix", "s")]
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_windows(rows, items)
    for r in got.filter("doc_id = 90").collect():
        original = rows[-1][1]
        hit = sum(len(cut(original[s["start"] : s["end"]])) for s in r["spans"])
        assert hit == r["n_hit"] and all(cut(original[s["start"] : s["end"]])[0] == cut(original)[len(cut(original[: s["start"]]))] for s in r["spans"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, rows), none).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), m.start(2)))
    out += [(m.start(), 1, m.end(), m.start()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, small):
    shared, own = "deadbeef" * 5, "0123456789abcdef" * 3
    rows = [
        *small, (60, f"ü password = '{shared}' and token:short, token=secret:abcdefgh12", "s1"), (61, f"API_KEY=\"{shared}\"", "s2"), (62, f"see {own}", "s3"), (62, f"see {own}", "s3"),
        (63, "AKIA" + "Z" * 12 + " AKIAAKIA AKIAshort " + "AKIA" + "9" * 30, None), (64, "Apikey: abcdefgh passwd=\"ABCDEFGHIJ\" ſecret=abcdefgh1 toKen=12345678", "s1"), (65, "AKIA" + "Z" * 12, None),
    ]
    copied = "facade01" * 4  # by one owner, in as many repositories as make it an example
    rows += [(80 + i, f"é {copied}", "s1") for i in range(4)]
    wide = spark.createDataFrame([(i, t, f"l{i % 5}", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, key int")
    owners, repos = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        for a, _, e, v in brute_secrets(t):
            owners[t[v:e]].add(s)
            repos[t[v:e]].add((s, f"l{i % 5}"))
    assert len(owners[copied]) == 1 and len(repos[copied]) == 4 and len(owners[shared]) == 2
    got, want = secrets.secret_spans(wide).collect(), []
    for doc, t, _ in rows:
        base = brute_secrets(t)
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e, _ in base)
        extra = {(v, 3 if len(owners[t[v:e]]) < 3 and len(repos[t[v:e]]) < 4 else 4, e) for _, _, e, v in base}
        every = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted([(a, k, e) for a, k, e, _ in base] + list(extra)))
        n = Counter(k for _, k, _, _ in base)
        want.append((doc, n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest(), every))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert secrets.secret_spans(frame(spark, [])).count() == 0


def test_token_ids(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*small, (70, "a  b\n c <|endoftext|> d ", "s"), (71, " x\t y é z 日本 語1 2's", "s"), (72, "  a\x1c b \x85c", "s")]
    segments = token_store.write(frame(spark, rows), P.path("byte_bpe_50k.json"))
    got = token_store.read(segments).collect()
    ids = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: r[0])
    want, start = [], 0
    for doc, t in ids:
        e = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((doc, start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        start += len(e)
    assert sorted(tuple(r) for r in got) == sorted(want)
    payload = segments.filter("n_ids > 1000").first()["payload"]
    s = token_store.Segment(bytes(payload))
    every = s.ids()
    for i in random.Random(1).sample(range(len(every)), 200):
        assert s.token(i) == every[i]
    assert token_store.read(token_store.write(frame(spark, []), P.path("byte_bpe_50k.json"))).count() == 0


def test_codes_of_wide_ids():
    ids = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7] * 700, np.uint32)
    s = token_store.Segment(token_store.pack(np.array([1]), np.array([len(ids)]), ids))
    assert (s.ids() == ids).all() and all(s.token(i) == ids[i] for i in range(0, len(ids), 37))


def test_pieces(spark, small):
    path = P.path("piece_bpe_32k.model")
    model = piece_codec.codec(path)
    long = " ".join(words(5, 20000))
    rows = [*small, (80, long, "s"), (81, "日本語ü😀ñ" * 9000 + long[:9000] + " ▁ " + "abcdefghij" * 8000, "s"), (82, "  lead  double ", "s"), (82, "  lead  double ", "s"), (83, "a▁b", "s")]
    got = piece_codec.encode_decode(frame(spark, rows), path).collect()
    want = Counter((i, tuple(model.model.encode(t or ""))) for i, t, _ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] for r in got if r["doc_id"] not in (81, 83)) and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert piece_codec.encode_decode(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("size", [37, 64, 500])
def test_scan_equals_the_library(size):
    model = piece_codec.codec(P.path("piece_bpe_32k.model"))
    r = random.Random(size)
    for text in ("internationalization" * 30, "".join(r.choice("abcdefgthein日ü") for _ in range(900)), "a  b   c    d " * 40, "x" * 700, "   "):
        assert model.scan(text, size) == model.model.encode(text)


def test_max_plus_product_is_associative():
    r = np.random.default_rng(3)
    a, b, c = (r.integers(-5, 5, s).astype(float) for s in ((3, 4), (4, 2), (2, 5)))
    assert (piece_codec.times(piece_codec.times(a, b), c) == piece_codec.times(a, piece_codec.times(b, c))).all()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    train = labels.filter("doc_id % 2 = 0")
    got = {r["doc_id"]: r["accepted"] for r in quality.quality(docs, train).collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 2 = 1").collect()}
    good = [got[i] for i, q in held.items() if q == 1]
    bad = [not got[i] for i, q in held.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.85 and len(got) == 1000


def test_quality_of_hard_rows(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(frame(spark, small), none).collect()
    assert len(got) == len(small)
    text = {i: t for i, t, _ in small}
    assert all(r["accepted"] == bool((text[r["doc_id"]] or "").split()) for r in got)
    assert quality.quality(frame(spark, []), none).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality(frame(spark, small), odd).count() == len(small)


def test_shrinkage(spark):
    """A path with few documents is near its host's share, one with many keeps its own."""
    rows = [(i, ("good words in a row " if i % 10 else "BAD!! WORDS!! ") * 5, "many") for i in range(400)] + [(1000 + i, "BAD!! WORDS!! " * 5, "few") for i in range(2)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    got = quality.quality(frame(spark, rows), labels).groupBy().agg({"path_share": "max"}).first()[0]
    few = {r["path_share"] for r in quality.quality(frame(spark, rows), labels).filter("doc_id >= 1000").collect()}
    assert 0.8 < got < 1 and all(0.0 < s < got for s in few)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    few = labels.filter("doc_id % 2 = 0")
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), few).collect()}
    held = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 2 = 1").collect()}
    right = np.mean([got[i] == bool(t) for i, t in held.items()])
    clean = np.mean([not got[i] for i, t in held.items() if not t])
    assert right > 0.95 and clean > 0.995


def test_toxicity_of_hard_rows(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(not r["is_toxic"] for r in toxicity.toxicity(frame(spark, small), none).collect())
    some = spark.createDataFrame([(i, 1, int(i < 5)) for i in range(12)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, small), some).collect()
    assert len(got) == len(small) and not any(r["is_toxic"] for r in got if r["doc_id"] in (20, 21, 22))
    assert toxicity.toxicity(frame(spark, []), some).count() == 0
