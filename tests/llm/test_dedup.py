"""Exact, near, passage and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from conftest_llm import frame

from cloakwork.llm import exact_dedup, line_dedup, simhash_dedup, suffix_dedup
from cloakwork.llm.graph import connected_components


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 150), (150, 151)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    assert got == components(nodes, edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_exact_dedup(spark, small):
    got = exact_dedup.exact_dedup(frame(spark, small)).collect()
    groups = defaultdict(list)
    for i, t, _ in small:
        groups[t or ""].append(i)
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in small]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert Counter((r[0], r[1], r[3]) for r in exact_dedup.exact_dedup(rows).collect()) == Counter([(None, 1, False), (1, 1, True), (None, None, True)])


def test_chunks_are_defined_by_content():
    data = np.random.default_rng(1).bytes(300_000)
    one, two = exact_dedup.chunks(data), exact_dedup.chunks(b"shift" + data)
    assert b"".join(one) == data and max(map(len, one)) <= exact_dedup.MOST
    assert len(set(one) & set(two)) > 0.8 * len(one)
    assert exact_dedup.chunks(b"") == [] and b"".join(exact_dedup.chunks(b"a" * 200_000)) == b"a" * 200_000


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_near(spark, rows):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect())
    fps = [simhash(t) for _, t, _ in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    group = components(range(len(rows)), edges)
    least = defaultdict(lambda: 1 << 62)
    for i, g in group.items():
        least[g] = min(least[g], rows[i][0])
    assert got == Counter((rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows)))


def test_near_duplicates(spark, small):
    check_near(spark, small)
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_large_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PAIRS", 1)
    check_near(spark, small)


def test_links_of_a_ball(spark):
    """All fingerprints within two bits of one, far more than a bucket compares pair by pair."""
    base = 0x0123456789ABCDEF
    ball = {base} | {base ^ 1 << i for i in range(63)} | {base ^ 1 << i ^ 1 << j for i in range(63) for j in range(i)}
    far = {base ^ 0b11111, base ^ (0b1111 << 40)}
    df = spark.createDataFrame([(x,) for x in sorted(ball | far)], "fp long")
    pairs = {(r[0], r[1]) for r in simhash_dedup.links(df).collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
    assert len(pairs) < 70 * len(ball)
    group = components(ball | far, pairs)
    assert len({group[x] for x in ball}) == 1


def removed(rows, width=200):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (doc, _, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        mask = np.cumsum(gone)[:-1] > 0 if len(d) else np.zeros(0, bool)
        edges = np.diff(np.concatenate([[0], mask.astype(int)]))
        kept = bytes(np.frombuffer(d, np.uint8)[~mask]) if len(d) else b""
        out.append((doc, len(d), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_passages(spark, small, monkeypatch):
    want = removed(small)
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, small)).collect())
    assert got == want
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", 2)  # the way of hot anchors
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, small)).collect()) == want
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_passages_without_ids(spark):
    """Rows without ids, and of one id, are told apart by their texts."""
    text = lambda k, n=310: "".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(9))[:n]
    rows = [(None, text(1), "s"), (None, text(2), "s"), (7, text(2)[:300], "s"), (None, None, "s"), (8, text(3), "s"), (8, text(4), "s"), (9, text(4), "s")]
    want = removed(rows)
    assert Counter(tuple(x) for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect()) == want
    assert sum(x[2] for x in want) == 300 * 2 + 310 * 2


def test_hot_keys(spark, monkeypatch):
    """What stays where it is and what is dealt by key come to the same as one join."""
    from cloakwork.llm import common

    rows = spark.createDataFrame([(k, i) for k in range(9) for i in range(10**(k % 3))], "k int, i int")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    want = Counter(tuple(r) for r in rows.join(groups, "k").collect())
    for share in (0.001, 0.1, 0.9):
        monkeypatch.setattr(common, "HOT", share)
        assert Counter(tuple(r) for r in common.matched(rows, groups, ["k"], "n").collect()) == want


def test_parts_from_different_neighbours(spark):
    """A run whose two sides are shared with different documents repeats only where one document has both."""
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    a, b, c, anchor = word(150), word(150), word(150), word(60)
    rows = [(1, a + anchor + b, "s"), (2, a + anchor + word(150), "s"), (3, word(150) + anchor + b, "s"), (4, word(90) + c + anchor[:20], "s"), (5, c + anchor + b[:100] + word(99), "s"), (6, word(30) + c + anchor + b, "s")]
    want = removed(rows)
    assert Counter(tuple(x) for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect()) == want
    assert any(x[2] for x in want)


def test_longest_previous_factors():
    bodies = [b"xxabcabcdyy", b"zabcabcdq", b"abcabc", b""]
    body, place, later, copied = suffix_dedup.repeats(bodies, 4)
    strings = [bodies[b][p : p + 4] for b, p in zip(body, place)]
    for i, s in enumerate(strings):
        assert later[i] == (s in strings[:i])
        if s in strings[:i] or s in strings[i + 1 :]:
            assert later[i] or copied[i]


def test_pieces_of_a_giant_text(small):
    """A text that is hashed piece by piece has the same passages."""
    import pyarrow as pa

    text = " ".join(t for _, t, _ in small if t)[:60_000]
    whole = pa.RecordBatch.from_pydict({"doc": pa.array([1], pa.int64()), "text": [text]})
    strings = {}
    for piece in (1 << 22, 5000):
        suffix_dedup.PIECE = piece
        starts = []
        for b in suffix_dedup._anchors([whole]):
            for at in b.column("at").to_pylist():
                first = (at >> 8) & 0x7FFFFFFF
                starts += range(first, first + (at & 0xFF) + 1)
        strings[piece] = sorted(starts)
    suffix_dedup.PIECE = 4 << 20
    assert strings[5000] == strings[1 << 22] == list(range(len(text.encode()) - 199))


def similarity(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return 1 - prev[-1] / max(len(a), len(b), 1)


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the barking hounds of the old county every single morning"
    near = base.replace("hounds", "hound")
    other = "nothing like the others at all, just some words in a row that stand alone"
    rows = [(1, f"{base}\n{other}\n\n", "s"), (2, f"  {base.upper()} \nfine line of its own here", "s"), (3, f"{near}\n{base}\n", "s"), (4, None, None), (5, "", "s"), (6, f"{other}\n{other}", "s")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[1] == (4, 0, []) and got[2] == (2, 1, [0]) and got[4] == (1, 0, []) and got[5] == (1, 0, []) and got[6] == (2, 2, [0, 1])
    assert 1 in got[3][2] and got[3][0] == 3
    assert similarity(base, near) > 0.8
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(frame(spark, rows), line_dedup.line_dedup(frame(spark, rows))).collect()}
    assert kept[1] == rows[0][1] and kept[2] == "fine line of its own here" and kept[4] is None
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_lines_of_hard_rows(spark):
    """Null and repeated ids, ties, repeated rows, and a very long line with words changed and put in."""
    r = np.random.default_rng(8)
    long = random_line(r, 30_000)
    w = long.split()
    for i in range(40, len(w), 40):
        w[i] = "changed"
    w[1000:1000] = ["some", "words", "put", "in"]
    twins = "a twin of another line\nA twin, of another line!"
    rows = [(None, "only here and nowhere else in these rows", "s"), (None, None, "s"), (5, long, "s"), (6, " ".join(w), "s"), (7, long[:20_000], "s"), (8, twins, "s"), (8, twins, "s")]
    got = Counter((x["doc_id"], x["n_lines"], x["n_removed"]) for x in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == Counter([(None, 1, 0), (None, 1, 0), (5, 1, 0), (6, 1, 1), (7, 1, 0), (8, 2, 1), (8, 2, 1)])


def test_line_simhash(spark):
    """The packed sums give the plain SimHash of the words' hashes."""
    texts = ["three a four bc fives", "once twice three four five", " ".join(f"word{i % 37} {i % 7}" for i in range(1000)), "long", *(" ".join(f"word{i}" for i in range(n)) for n in (127, 128, 255))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    got = {r["id"]: r["simhash"] & (1 << 64) - 1 for r in line_dedup.simhashes(df).collect()}
    hashed = {r[0]: r[1] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for t in texts for w in set(t.split())], "w string").selectExpr("w", "xxhash64(w)").distinct().collect()}
    for i, t in enumerate(texts):
        hs = [hashed[w] for w in t.split() if len(w) > 3]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_lines_are_shuffled_once(spark):
    """Distinct lines and their features take one shuffle of the texts, and no generator carries a line's words."""
    every = line_dedup.lines(frame(spark, [(1, "some words of a line\nand of one more", "s"), (2, "some words of a line", "s")]))
    plan = line_dedup.distinct_lines(every)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    exploded = [x for x in plan.split("\n") if "Generate posexplode" in x and "tokens" in x]
    assert len(exploded) == 1 and "tokens" not in exploded[0].split("], true, [")[0].split(", [")[-1]


def test_equal_bytes(spark):
    r = np.random.default_rng(5)
    rows = [tuple(int.from_bytes(bytes(int(x) for x in r.choice([0, 1, 127, 128, 255], 8)), "big", signed=True) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = [tuple(x) for x in df.select("a", "b", line_dedup._equal(df["a"], df["b"])).collect()]
    raw = lambda n: n.to_bytes(8, "big", signed=True)
    assert got == [(a, b, sum(x == y != 0 for x, y in zip(raw(a), raw(b)))) for a, b in rows]


def test_large_line_buckets(spark, monkeypatch):
    """With leaders, every line of a tight cluster still falls into one group."""
    monkeypatch.setattr(line_dedup, "PAIRS", 2)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for k in range(25):
        w = list(base)
        w[60] = f"word{60 + k}x"
        rows.append((k, " ".join(w), "s"))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[0] == 0 and sum(got.values()) >= 15


def line_keeps(spark, texts):
    """The text that each text's group keeps, by the operator."""
    got = line_dedup.line_groups(line_dedup.lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))).select("first.doc_id", "keep.doc_id").collect()
    return {r[0]: r[1] for r in got}


def brute_keeps(texts):
    near = [(i, j) for i in range(len(texts)) for j in range(i) if min(len(texts[i]), len(texts[j])) >= 0.8 * max(len(texts[i]), len(texts[j])) and similarity(texts[i], texts[j]) >= 0.8 - 1e-9]
    return components(range(len(texts)), near)


def test_hot_line_buckets_against_brute_force(spark, monkeypatch):
    """Lines of the same words in other orders have one SimHash: chains of near ones, far ones, and several leaders."""
    r = np.random.default_rng(3)
    texts = []
    for chain in range(5):
        w = [f"{'abcdefgh'[int(x)]}{x}{'qrstuv'[int(x) % 6] * (1 + int(x) % 3)}" for x in r.permutation(24) % 8]
        for _ in range(12):
            texts.append(" ".join(w))
            i, j = r.choice(24, 2, replace=False)
            w[i], w[j] = w[j], w[i]
    texts = list(dict.fromkeys(texts))
    want = brute_keeps(texts)
    direct = {i: {j for j in range(len(texts)) if similarity(texts[i], texts[j]) >= 0.8} for i in range(len(texts))}
    assert any(want[i] != i and want[i] not in direct[i] for i in want)  # groups that only chains hold together
    monkeypatch.setattr(line_dedup, "PAIRS", 2)
    assert line_keeps(spark, texts) == want


def test_hot_line_keys_by_length_bands(spark, monkeypatch):
    """Hot keys up to CELL lines in a band take no finer keys, which hold each line many times; larger ones do, with the same groups."""
    r = np.random.default_rng(4)
    texts = []
    for chain in range(3):
        w = [f"{'abcdefgh'[int(x)]}{x}{'qrstuv'[int(x) % 6] * (1 + int(x) % 3)}" for x in r.permutation(24) % 8]
        for _ in range(8):
            texts.append(" ".join(w))
            i, j = r.choice(24, 2, replace=False)
            w[i], w[j] = w[j], w[i]
    texts = list(dict.fromkeys(texts))
    want, tags = brute_keeps(texts), []
    write = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, tag: tags.append(tag) or write(df, tag))
    monkeypatch.setattr(line_dedup, "PAIRS", 2)
    assert line_keeps(spark, texts) == want and "line-hot" in tags and "line-fine" not in tags
    monkeypatch.setattr(line_dedup, "CELL", 2)
    assert line_keeps(spark, texts) == want and "line-fine" in tags


def test_line_candidates_are_compiled(spark):
    """The JVM compiles no method of over 8,000 bytes; one that compares all pairs must not be left to its interpreter."""
    members = spark.createDataFrame([], "key long, id long, len int, simhash long, s0 long, s1 long, in_key long, lead long, grp long")
    pairs = [line_dedup._small(members).groupBy("a", "b").agg({"star": "max"}), line_dedup._led(members.withColumn("fine", members["key"]), 8, True)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation")
    try:
        for df in pairs:
            stages = df._jdf.queryExecution().debug().codegenToSeq()
            longest = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert longest and max(longest) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.optimizer.excludedRules")


def edited(r, text, share):
    """text with so many characters replaced, removed or put in at random places."""
    t = list(text)
    for _ in range(int(share * len(text))):
        i = int(r.integers(len(t)))
        t[i : i + 1] = [[], [str(r.choice(list("aeinrst")))], [t[i], str(r.choice(list("aeinrst")))]][int(r.integers(3))]
    return " ".join("".join(t).split())


def random_line(r, n):
    out = ""
    while len(out) < n:
        out += "".join(r.choice(list("aeioulnrstdm"), int(r.integers(2, 8)))) + " "
    return out[:n].strip()


def test_short_lines_against_brute_force(spark):
    """Of lines up to SHORT characters no similar pair is lost."""
    r = np.random.default_rng(11)
    texts = []
    for _ in range(45):
        base = random_line(r, int(r.integers(5, 33)))
        texts += [base, *(edited(r, base, 0.2) for _ in range(3))]
    texts = [t for t in dict.fromkeys(texts) if t and len(t) <= line_dedup.SHORT]
    want = brute_keeps(texts)
    assert sum(k != i for i, k in want.items()) > 40
    assert line_keeps(spark, texts) == want


def test_recall_by_length(spark):
    """Pairs found of pairs that are similar, by length and share of edited characters."""
    r = np.random.default_rng(12)
    texts, pairs = [], []
    for n in (50, 90, 150, 300):
        for share in (0.02, 0.05, 0.1, 0.15):
            for _ in range(30):
                base = random_line(r, n)
                pairs.append((n, share, len(texts)))
                texts += [base, edited(r, base, share)]
    keeps = line_keeps(spark, texts)
    found, every = Counter(), Counter()
    for n, share, i in pairs:
        if texts[i] != texts[i + 1] and similarity(texts[i], texts[i + 1]) >= 0.8:
            every[n, share] += 1
            found[n, share] += keeps[i] == keeps[i + 1]
    recall = {k: found[k] / every[k] for k in every}
    print({k: f"{found[k]} of {every[k]}" for k in every})
    assert all(recall[n, 0.02] >= 0.95 and recall[n, 0.05] >= 0.85 for n in (50, 90, 150, 300))


def distance(a, b):
    """Edit distance by bit vectors, one bit for each character of a."""
    places, full = defaultdict(int), (1 << len(a)) - 1
    for i, x in enumerate(a):
        places[x] |= 1 << i
    more, less, out = full, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        d = (((eq & more) + more) ^ more) | eq | less
        up, down = less | ~(d | more) & full, d & more
        out += (up >> len(a) - 1 & 1) - (down >> len(a) - 1 & 1)
        up, down = up << 1 | 1, down << 1
        more, less = (down | ~(d | up)) & full, up & d & full
    return out


def test_recall_on_the_tables(spark):
    """All pairs of the distinct lines of up to 250 characters of the smallest table, held against the groups."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), int(rng.integers(1, 12)))) for _ in range(2))
        assert abs(1 - distance(a, b) / max(len(a), len(b)) - similarity(a, b)) < 1e-9
    every = line_dedup.lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = sorted((r[0] for r in every.select("norm").distinct().filter("length(norm) <= 250").collect()), key=len)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(texts[j]) >= 0.8 * len(texts[i]) and distance(texts[j], texts[i]) <= int(0.2 * len(texts[i]) + 1e-9)]
    keeps = line_keeps(spark, texts)
    found = sum(keeps[i] == keeps[j] for i, j in near)
    print(f"{found} of {len(near)} pairs of {len(texts)} lines")
    assert near and found >= 0.9 * len(near)
