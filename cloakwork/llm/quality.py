"""Quality of documents by hierarchical empirical Bayes.

A logistic model gives the document's own evidence, from the text's content (how much likelier its pairs of bytes are in
good texts than in bad ones) and its shape. Sites give the rest: hosts (source) and paths below them (source and
language). The share of good documents of a host is shrunk towards the global share, that of a path towards its host's,
by as much as the spread between groups calls for; a site with few documents so gets almost its parent's share. What a
site says of a document is counted without that document. The posterior adds the document's evidence to the odds of its path.

The model is fitted on at most SAMPLE labelled rows, taken in the order of a hash of doc_id; of these, the content of each
half is judged by byte pairs of the other half, so no row is judged by its own. Scores, group sums and posteriors cover
all documents. Groups are summed in partial aggregates and joined back, so a host with a third of all rows moves as
one row for each task.

Defined results: null and empty texts have no evidence of quality and are rejected (posterior 0);
a null source or language is a group of its own; labels that are null, or of which all are equal
or none there, give a model that knows nothing: every document with text is accepted; repeated rows each get
their row; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import batch, matched, materialise, sub_batches

#: Labelled rows for fitting; the posterior from which a document is accepted.
SAMPLE, ACCEPT = 20_000, 0.5
#: Most and least weight of a prior, in documents.
MOST_PRIOR, LEAST_PRIOR = 10_000.0, 1.0
#: Pairs of bytes that are looked up at once.
_RUN = 1 << 20
#: Bounds of a group's log-odds against its parent's, so that a site alone does not decide.
SITE_BOUND = 2.0

_SCORES = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("logit", pa.float64())])
_UPPER, _MARK = bytes(range(65, 91)), b"|!#$%&*<>=~^@{}[]\\_+/"


def features(data: bytes) -> list[float]:
    """Shape features of a text's bytes, each a share or a bounded size."""
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    kinds = Counter(words)
    marks = size - len(data.translate(None, _MARK))
    upper = size - len(data.translate(None, _UPPER))
    lower = size - len(data.translate(None, bytes(range(97, 123))))
    digits = size - len(data.translate(None, b"0123456789"))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        min(1.0, 20 * marks / size),
        min(1.0, 20 * data.count(b"|") / n),
        min(1.0, 20 * data.count(b"!!") / n),
        min(1.0, 20 * (data.count(b"***") + data.count(b"$$$") + data.count(b"&&&") + data.count(b"%%%") + data.count(b"###")) / n),
        upper / max(1, upper + lower),
        same / n,
        max(kinds.values(), default=0) / n if n > 20 else 0.0,
        len(kinds) / n if n > 20 else 1.0,
        digits / size,
        min(20, size / n) / 20,
        min(1.0, np.log1p(n) / 10),
        float(marks / size > 0.02),
        float(upper / max(1, upper + lower) > 0.4),
        float(same / n > 0.3),
    ]


def pairs(data: bytes) -> np.ndarray:
    """How often each pair of neighbouring bytes occurs in a text."""
    b = np.frombuffer(data, np.uint8)
    return np.bincount(b[:-1].astype(np.int32) << 8 | b[1:], minlength=1 << 16)


def table(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-odds of each pair of bytes after its first, good texts against bad ones; 0 without either."""
    if not good.sum() or not bad.sum():
        return np.zeros(1 << 16, np.float32)
    given = lambda n: np.log(n + 0.5) - np.log(n.reshape(256, 256).sum(1).repeat(256) + 128)
    return np.clip(given(good) - given(bad), -3, 3).astype(np.float32)


def content(data: bytes, odds: np.ndarray) -> float:
    """The mean log-odds of a text's pairs of bytes."""
    b, total = np.frombuffer(data, np.uint8), 0.0
    for at in range(0, len(b) - 1, _RUN):  # a very long text piece by piece
        part = b[at : at + _RUN + 1]
        total += float(odds[part[:-1].astype(np.int32) << 8 | part[1:]].sum(dtype=np.float64))
    return total / max(1, len(b) - 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60, close: float = 1e-8) -> np.ndarray:
    """Weights of a logistic model, the intercept first, by Newton's steps, up to a step below `close`."""
    if not len(y) or y.min() == y.max():
        return np.zeros(1)
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(y))
    keep[0] = 1e-6 * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < close:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, label and half of at most `most` labelled documents, in the order of a hash of doc_id; written to the shared folder."""
    named = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    named = named.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # The sample is bounded by `most` pairs of numbers.
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(named), "doc_id")
    return materialise(rows.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "quality-sample")


def _counted(batches):
    """One row for each task, label and half: the summed pair counts."""
    schema, sums = pa.schema([("label", pa.int32()), ("half", pa.int32()), ("counts", pa.binary())]), {}
    for b in sub_batches(batches):
        for key in zip(b.column("label").to_pylist(), b.column("half").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            sums[key[:2]] = sums.get(key[:2], 0) + pairs(key[2])
    for (label, half), n in sums.items():
        yield batch(schema, [[label], [half], [n.astype("<i8").tobytes()]])


def _summed(batches):
    """One row of summed counts for the rows of a task."""
    total, schema = None, pa.schema([("label", pa.int32()), ("half", pa.int32()), ("counts", pa.binary())])
    for b in batches:
        for label, half, n in zip(*(b.column(c).to_pylist() for c in ("label", "half", "counts"))):
            total = total or {}
            total[label, half] = total.get((label, half), 0) + np.frombuffer(n, "<i8")
    for (label, half), n in (total or {}).items():
        yield batch(schema, [[label], [half], [n.tobytes()]])


def _sampled(shared):
    def run(batches):
        for b in sub_batches(batches):
            some = b.column("text").cast(pa.binary()).to_pylist()
            x = [[*features(t), content(t, shared.value[half])] for t, half in zip(some, b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("label")], names=["x", "label"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the model and the log-odds of pairs of bytes."""
    rows, ddl = sample(docs, labels, most), "label int, half int, counts binary"
    # Half a megabyte for each label and half; sums go up a level before the driver gets them.
    sums = rows.mapInArrow(_counted, ddl).repartition(4, "label", "half").mapInArrow(_summed, ddl).collect()
    counts = {(y, h): np.zeros(1 << 16, np.int64) for y in (0, 1) for h in (0, 1)} | {(r[0], r[1]): np.frombuffer(bytes(r[2]), "<i8") for r in sums}
    of = lambda hs: table(sum(counts[1, h] for h in hs), sum(counts[0, h] for h in hs))
    shared = docs.sparkSession.sparkContext.broadcast([of([1]), of([0])])
    found = sorted(rows.mapInArrow(_sampled(shared), "x array<double>, label int").collect())
    return (fit(np.array([r[0] for r in found]), np.array([r[1] for r in found], float)) if found else np.zeros(1)), of([0, 1])


def _score(shared):
    def run(batches):
        weights, odds = shared.value
        for b in sub_batches(batches):
            out = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                if t is None or not t.split():
                    out.append(None)
                else:
                    out.append(float(np.clip(weights[0] + np.dot([*features(t), content(t, odds)], weights[1:]), -30, 30)) if len(weights) > 1 else 30.0)
            yield batch(_SCORES, [b.column("doc_id").cast(pa.int64()), b.column("host").cast(pa.string()), b.column("path").cast(pa.string()), out])

    return run


def _weight(groups: DataFrame, mean: float) -> float:
    """How many documents a parent's share counts for, by moments: within-group over between-group variance."""
    n, k, between = groups.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))).first()
    if not n or k < 2 or not 0 < mean < 1:
        return MOST_PRIOR
    within = mean * (1 - mean)
    spread = max(0.0, between - (k - 1) * within) / n
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, within / spread if spread else MOST_PRIOR)))


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """doc_id, document_probability, host_share, path_share, posterior, accepted: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    rows = docs.select("doc_id", F.col("text"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("path"))
    rows = materialise(rows.mapInArrow(_score(shared), "doc_id long, host string, path string, logit double"), "quality")
    p = F.when(F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.col("logit"))))
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = min(1 - 1e-6, max(1e-6, s / n)) if n else 0.5
    of_host, of_path = _weight(hosts, mean), _weight(paths, mean)
    sums = paths.join(hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host")), "host")
    # Each document's shares are those of the other documents of its host and path.
    own = F.col("document_probability")
    out = matched(rows.withColumn("document_probability", p), materialise(sums, "site-sums"), ["host", "path"], "n")
    out = out.withColumn("host_share", (F.col("s_host") - own + of_host * mean) / (F.col("n_host") - 1 + of_host))
    out = out.withColumn("path_share", (F.col("s") - own + of_path * F.col("host_share")) / (F.col("n") - 1 + of_path))
    odds = lambda x: F.log(x / (1 - x))
    bounded = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("path_share")))
    site = F.least(F.lit(SITE_BOUND), F.greatest(F.lit(-SITE_BOUND), odds(bounded) - float(np.log(mean / (1 - mean)))))
    posterior = F.when(F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.col("logit") + site))))
    out = out.select("doc_id", "document_probability", "host_share", "path_share", posterior.alias("posterior"))
    return out.withColumn("accepted", F.col("posterior") >= accept)
