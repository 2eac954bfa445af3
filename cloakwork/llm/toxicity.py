"""Toxicity by a chain of classifiers.

Categories are predicted one after the other, in the order of the label columns; each linear model sees the words of a
text and the probabilities of the categories before it. While fitting, those probabilities are out of fold: for each
fold, words are chosen and models fitted on the other folds alone, so a later model never learns from predictions on
rows that an earlier one, or its words, has seen. Copies of a text are in one fold.

The labels at hold have one category of toxicity, `toxic`, and a mark of quality; the query's chain is low quality, then
toxic. With label columns for insults, threats and so on the chain is as long as they are.

Words and models are fitted on at most SAMPLE labelled rows, in the order of a hash of doc_id. Texts stay on the
executors: the driver gets counts of MOST_MARKS features, and for each row the numbers of the features it has.

Defined results: null and empty texts have no words and are not toxic; without labels, or with
labels of one class only, a category's model knows nothing and its probabilities are those labels' share
(0 without any); a null label leaves its row out of that category; repeated rows each get their row; no rows give no
rows; of rows that repeat a doc_id in the labels the greatest label counts; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import batch, materialise, sub_batches
from cloakwork.llm.quality import fit

#: Labelled rows for fitting, features of a model, folds, and the probability of a toxic text.
SAMPLE, VOCABULARY, FOLDS, TOXIC = 8_000, 256, 5, 0.5
#: The label columns, in the order of the chain, and the values that count as 1.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
#: Share of slur words from which a text is full of them.
DENSE = 0.02
#: A word's features are the word and its beginnings of these lengths: compounds share them.
BEGINNINGS = (4, 5, 6, 7)
#: Toxic texts that a feature must be in; features that words are chosen from; words whose features a worker keeps.
LEAST, MOST_MARKS, MOST_KEPT = 5, 20_000, 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def marks(word: str) -> list[str]:
    """The features of a word."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


class Lexicon:
    """The features that tell toxic texts from others, by their counts in both."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int):
        counts = {m: c for m, c in counts.items() if c[0] >= LEAST}
        odds = {m: float(np.log((a + 0.1) / n_toxic) - np.log((b + 0.1) / max(1, n_clean))) for m, (a, b) in counts.items()}
        chosen = sorted(odds, key=lambda m: (-odds[m] * np.sqrt(counts[m][0]), m))[:VOCABULARY]
        self.places = {m: i for i, m in enumerate(sorted(chosen))}
        # Slurs are features of many toxic texts: one in a hundred at least, and thirty times as often as in clean ones.
        self.slurs = frozenset(m for m in chosen if counts[m][0] >= 0.01 * n_toxic and odds[m] > np.log(30))
        self.known: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def features(self, word: str) -> tuple:
        """The places of a word's features, and whether one of them is a slur."""
        found = [m for m in marks(word) if m in self.places]
        return [self.places[m] for m in found], any(m in self.slurs for m in found)

    def found(self, counts: Counter) -> tuple[list[int], float, float]:
        """Of a text's words: the places of its features, how many slurs, bounded, and their share."""
        at, hits, known = set(), 0, self.known
        if len(known) > MOST_KEPT:
            known.clear()
        for w, n in counts.items():
            if (got := known.get(w)) is None:
                got = known[w] = self.features(w)
            if got[0]:
                at.update(got[0])
                hits += n * got[1]
        return sorted(at), min(1.0, hits / 5), min(1.0, hits / max(1, counts.total()) / DENSE / 2)

    def row(self, found: tuple[list[int], float, float]) -> np.ndarray:
        x = np.zeros(VOCABULARY + 2)
        x[found[0]] = 1.0
        x[-2:] = found[1:]
        return x


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def _model(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights from the rows with a label; a constant where all labels are equal."""
    x, y = x[~np.isnan(y)], y[~np.isnan(y)]
    if len(y) and y.min() < y.max():
        return fit(x, y, ridge=1e-4, rounds=25, close=1e-3)
    return np.concatenate([[-30.0 if not len(y) or y[0] == 0 else 30.0], np.zeros(x.shape[1])])


class Chain:
    """A lexicon and one linear model for each category."""

    def __init__(self, names: list[str], lexicons: list[Lexicon], found: list[list], y: np.ndarray, fold: np.ndarray):
        """lexicons: of each fold's other rows, then of all; found: for each lexicon what each row has; y: rows by categories, nan without label."""
        self.names, self.models, self.lexicon = names, [], lexicons[-1] if lexicons else None
        self.shares = [float(np.nanmean(y[:, c])) if len(y) and not np.isnan(y[:, c]).all() else 0.0 for c in range(len(names))]
        if not lexicons:
            return
        x = [np.array([lexicon.row(f) for f in rows]) for lexicon, rows in zip(lexicons, found)]
        for c in range(len(names)):
            out = np.zeros(len(y))
            for k in range(FOLDS):
                # The columns before hold, in a fold's own table, what this fold's models say of every row.
                w = _model(x[k][fold != k], y[fold != k, c])
                p = probability(x[k], w)
                out[fold == k] = p[fold == k]
                x[k] = np.column_stack([x[k], p])
            self.models.append(_model(x[-1], y[:, c]))
            x[-1] = np.column_stack([x[-1], out])

    def predict(self, texts: list) -> np.ndarray:
        """One column of probabilities for each category."""
        if not self.models:
            return np.tile(self.shares, (len(texts), 1))
        counts = [Counter(words(t)) for t in texts]
        x = np.array([self.lexicon.row(self.lexicon.found(c)) for c in counts]).reshape(len(texts), -1)
        for w in self.models:
            x = np.column_stack([x, probability(x, w)])
        out = x[:, -len(self.models) :]
        out[[not c for c in counts]] = 0.0
        return out


_FOUND = pa.struct([("at", pa.list_(pa.int32())), ("hits", pa.float64()), ("share", pa.float64())])


def _marks(batches):
    schema = pa.schema([("mark", pa.string()), ("fold", pa.int32()), ("label", pa.int32())])
    for b in sub_batches(batches):
        for text, fold, label in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), b.column("label").to_pylist()):
            found = list({m for w in set(words(text)) for m in marks(w)})
            yield batch(schema, [found, [fold] * len(found), [label] * len(found)])


def _found(shared):
    schema = pa.schema([("fold", pa.int32()), ("labels", pa.list_(pa.int32())), ("found", pa.list_(_FOUND))])

    def run(batches):
        for b in sub_batches(batches):
            rows = [[dict(zip(("at", "hits", "share"), lexicon.found(counts))) for lexicon in shared.value] for counts in (Counter(words(t)) for t in b.column("text").to_pylist())]
            yield batch(schema, [b.column("fold"), b.column("labels"), rows])

    return run


def sample(docs: DataFrame, labels: DataFrame, categories: dict, most: int) -> DataFrame:
    """text, fold and labels (an array, null where not known) of at most `most` labelled documents, in the order of a hash of doc_id; written to the shared folder."""
    of = [F.max((F.col(column).cast("int") == value).cast("int")).alias(f"l{i}") for i, (column, value) in enumerate(categories.values())]
    last = f"l{len(categories) - 1}"
    named = labels.filter("doc_id is not null").groupBy("doc_id").agg(*of).filter(f"{last} is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    named = named.select("doc_id", F.array(*(f"l{i}" for i in range(len(of)))).alias("labels"))
    # The sample is bounded by `most` rows of numbers.
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(named), "doc_id")
    return materialise(rows.select("text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "labels"), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, categories: dict = CATEGORIES, most: int = SAMPLE) -> Chain:
    """Words are chosen by the last category."""
    rows, names, last = sample(docs, labels, categories, most), list(categories), len(categories) - 1
    target = F.col("labels")[last].alias("label")
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", target).count().collect()}
    n = lambda label, but: sum(k for (f, y), k in sizes.items() if y == label and f != but)
    shares = np.array([[np.nan if v is None else v for v in r[0]] for r in rows.select("labels").collect()], float).reshape(-1, len(names))
    if not n(1, None) or not n(0, None):
        return Chain(names, [], [], shares, np.zeros(0))
    counts = rows.select("text", "fold", target).mapInArrow(_marks, "mark string, fold int, label int").groupBy("mark")
    parts = [F.count_if((F.col("fold") == k) & (F.col("label") == y)).alias(f"n{y}_{k}") for k in range(FOLDS) for y in (1, 0)]
    counts = counts.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"), *parts).filter(F.col("n1") >= LEAST)
    weight = (F.log((F.col("n1") + 0.1) / n(1, None)) - F.log((F.col("n0") + 0.1) / n(0, None))) * F.sqrt("n1")
    counts = counts.orderBy(weight.desc(), "mark").limit(MOST_MARKS).collect()
    but = lambda r, y, k: r[f"n{y}"] - (r[f"n{y}_{k}"] if k is not None else 0)
    lexicons = [Lexicon({r["mark"]: (but(r, 1, k), but(r, 0, k)) for r in counts}, max(1, n(1, k)), n(0, k)) for k in (*range(FOLDS), None)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    found = rows.mapInArrow(_found(shared), "fold int, labels array<int>, found array<struct<at:array<int>,hits:double,share:double>>").collect()
    found.sort(key=repr)  # the same rows in any order give the same models
    y = np.array([[np.nan if v is None else v for v in r["labels"]] for r in found], float)
    return Chain(names, lexicons, [[tuple(r["found"][i]) for r in found] for i in range(FOLDS + 1)], y, np.array([r["fold"] for r in found]))


def _predict(shared, threshold: float):
    def run(batches):
        chain = shared.value
        schema = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in chain.names), ("is_toxic", pa.bool_())])
        for b in sub_batches(batches):
            p = chain.predict(b.column("text").to_pylist())
            yield batch(schema, [b.column("doc_id").cast(pa.int64()), *p.T, p[:, -1] >= threshold])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict = CATEGORIES, most: int = SAMPLE, threshold: float = TOXIC) -> DataFrame:
    """doc_id, p_<category> of each, is_toxic (by the last category): one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, most))
    ddl = ", ".join(["doc_id long", *(f"p_{c} double" for c in categories), "is_toxic boolean"])
    return docs.select("doc_id", "text").mapInArrow(_predict(shared, threshold), ddl)
