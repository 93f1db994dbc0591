"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A document is a bag of sentences. A sentence is toxic with p = sigmoid(bias + sum of the weights of its words' features);
the document is toxic with 1 - prod(1 - p): one toxic sentence is enough, and no sentence is ever labelled.
A word's features are itself and its prefixes of 3 to 6 letters, so the forms of a stem share evidence; those that speak for the label
in the training documents are kept.
The sum of a word's weights is looked up once for each distinct word, which makes a pass over the corpus cheap.

The classifier is fitted on at most ``max_docs`` labelled documents (the first of each label by a hash of doc_id), a bound
that does not grow with the corpus; every document is scored over its whole text. Null and empty texts, and texts without a word, hold no
sentence and score 0. Rows with a null doc_id are scored, but never learned from and never held out. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded_sample, map_batches, slices, table

SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n")
EDGE = ".,;:!?…\"'()[]{}*#$%&|<>-_"
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Params:
    max_docs: int = 8000
    least_gain: float = 12.0  # log-likelihood ratio of a feature and the label, over documents
    least_docs: int = 3
    epochs: int = 300
    rate: float = 0.1
    l2: float = 1e-4
    seed: int = 7


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in lower case, without marks at their edges."""
    found = ([w for x in s.split() if (w := x.strip(EDGE))] for s in SENTENCE.split((text or "").lower()))
    return [s for s in found if s]


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    at: float  # the fitted probability from which a document counts as toxic
    known: dict[str, float] = field(default_factory=dict)  # weights of words seen, for as long as a worker lives

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def gain(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Log-likelihood ratio of presence and label; negative where a feature speaks against the label."""

    def term(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    share = (pos + neg) / (n_pos + n_neg)
    both = term(pos, n_pos * share) + term(neg, n_neg * share) + term(n_pos - pos, n_pos * (1 - share)) + term(n_neg - neg, n_neg * (1 - share))
    return 2 * both * np.sign(pos / n_pos - neg / n_neg)


def fit(texts: list[str | None], labels: list[int], p: Params = Params()) -> Model:
    """Features that speak for the label are chosen by their gain; their weights maximise the noisy-or likelihood, by Adam over all bags at once."""
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return Model({}, -20.0, 0.5)
    index: dict[str, int] = {}
    of_word: dict[str, np.ndarray] = {}
    bags = [sentences(x) for x in texts]
    for bag in bags:
        for s in bag:
            for w in s:
                if w not in of_word:
                    of_word[w] = np.array([index.setdefault(f, len(index)) for f in features(w)])
    count = np.zeros((2, len(index)))
    for bag, label in zip(bags, labels, strict=True):
        if bag:
            count[int(label), np.unique(np.concatenate([of_word[w] for w in {w for s in bag for w in s}]))] += 1
    good = (gain(count[1], count[0], y.sum(), len(y) - y.sum()) >= p.least_gain) & (count.sum(0) >= p.least_docs)
    place = np.cumsum(good) - 1
    kept = {w: place[f[good[f]]] for w, f in of_word.items() if good[f].any()}
    # Every sentence counts; only words with a chosen feature move it.
    feature, sentence_of, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for w in s:
                if w in kept:
                    feature.extend(kept[w])
                    sentence_of.extend([len(doc_of)] * len(kept[w]))
            doc_of.append(d)
    feature, sentence_of, doc_of = np.array(feature, np.int64), np.array(sentence_of, np.int64), np.array(doc_of, np.int64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    n = int(good.sum())
    theta, m, v = np.append(np.zeros(n), -5.0), np.zeros(n + 1), np.zeros(n + 1)

    def probabilities() -> tuple[np.ndarray, np.ndarray]:
        z = theta[n] + np.bincount(sentence_of, theta[feature], len(doc_of))
        prob = np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-9)
        return prob, np.exp(np.bincount(doc_of, np.log1p(-prob), len(y)))

    for step in range(1, p.epochs + 1):
        prob, none = probabilities()
        # d log-likelihood / dz: p * none / (1 - none) in a toxic bag, -p in another
        push = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0) * weight
        by_sentence = -prob * push[doc_of]
        grad = np.append(np.bincount(feature, by_sentence[sentence_of], n) + p.l2 * theta[:n], by_sentence.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - p.rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    names = [f for f, i in index.items() if good[i]]
    return Model(dict(zip(names, theta[:n].tolist(), strict=True)), float(theta[n]), threshold(1 - probabilities()[1], y))


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The score that splits the labels with the best F1, half way to its neighbour."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = score[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((score[order[k]] + low) / 2, 1e-6, 1 - 1e-6))


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """Labelled documents outside the held-out fold: at most half of max_docs of each label, chosen by hash of doc_id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = bounded_sample(known, "toxic", "doc_id", p.max_docs // 2, p.seed)
    # chosen has at most max_docs rows of two numbers: broadcast, so that no text is shuffled to find the few that are learned from.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    rows = training_rows(docs, labels, p).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), p)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, model.known

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            got = self.model.word(w)
            if len(self.known) < CACHE_WORDS:
                self.known[w] = got
        return got

    def sentences(self, text: str | None) -> np.ndarray:
        z = [sum(map(self.word, s)) for s in sentences(text)]
        return 1 / (1 + np.exp(-np.clip(self.model.bias + np.array(z), -30, 30)))

    def document(self, text: str | None) -> tuple[float, int, float]:
        """(score, place of the worst sentence or -1, its probability). The score is moved so that 0.5 is the fitted threshold."""
        p = self.sentences(text)
        if not len(p):
            return 0.0, -1, 0.0
        raw = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))
        at = self.model.at
        odds = np.log(max(raw, 1e-12)) - np.log(max(1 - raw, 1e-12)) - np.log(at) + np.log(1 - at)
        return float(1 / (1 + np.exp(-odds))), int(p.argmax()), float(p.max())


OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst_sentence", pa.int32()), ("worst_probability", pa.float64())])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and which sentence of the text is the most toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in slices(batches):
            found = [scorer.document(x) for x in b.column(1).to_pylist()]
            yield batch(OUT, b.column(0), *(list(c) for c in zip(*found, strict=True)))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, worst_sentence int, worst_probability double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_probability")
