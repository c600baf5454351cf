"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings. For every labelled sentence
with an identity term, counterfactuals are made by putting the other terms of the same kind
in its place. The loss adds the squared change of the score between a text and its
counterfactuals, so that the mere mention of a group does not move the score.

The fit reads a bounded sample of labelled rows (``Params.max_rows``); features are counted
by Spark, and only chosen features and their places in the sample reach the driver. Scoring
is a column expression over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of
from boxrates.llm.pieces import Remembered

# Identity terms; terms of one row may stand for each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender", "nonbinary"],
    ["gay", "lesbian", "bisexual", "straight", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "african", "european", "latino"],
    ["american", "chinese", "mexican", "russian", "indian", "turkish", "arab"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["disabled", "deaf", "blind"],
    ["old", "young", "elderly"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "atheisten"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "athées"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "ateos"],
]

_OTHERS = {t: [o for o in row if o != t] for row in IDENTITY_TERMS for t in row}
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Params:
    max_rows: int = 12_000
    """Bound of the labelled rows read by the fit (an even sample by hash beyond it)."""
    max_features: int = 1_000
    min_rows: int = 4
    """A feature must occur in so many sampled texts."""
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    l2: float = 2e-7
    swap_penalty: float = 1.0
    steps: int = 400
    rate: float = 0.1
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    params: Params = Params()


def features_of(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """A word itself, and its beginnings where it is longer."""
    return [word, *(f"{word[:k]}-" for k in prefixes if len(word) > k)]


def _memo(prefixes: tuple[int, ...], known=None) -> Remembered:
    """Chunk of text to its features, of the known ones if they are given."""

    def compute(chunk: str) -> tuple[str, ...]:
        found = [f for w in _WORDS.findall(chunk) for f in features_of(w, prefixes)]
        return tuple(found if known is None else [f for f in found if f in known])

    return Remembered(compute, 200_000)


def present(text: str, memo: Remembered) -> set[str]:
    return set().union(*map(memo.__getitem__, set(text.lower().split())))


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Each sentence that holds an identity term, with each other term in its place.

    Pairs of (sentence, swapped sentence), in lower case.
    """
    pairs = []
    for sentence in _SENTENCE.split(text.lower()):
        for term in dict.fromkeys(w for w in _WORDS.findall(sentence) if w in _OTHERS):
            place = re.compile(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])")
            pairs += [(sentence, place.sub(other, sentence)) for other in _OTHERS[term]]
    return pairs


def _sample(docs: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """``text, toxic`` of at most about ``max_rows`` labelled rows, one per text."""
    by_id = labels.filter("toxic is not null and doc_id is not null")
    by_id = by_id.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = by_id.count()
    # A hash of the id decides, so the sample is even and the same in every run.
    share = min(1.0, params.max_rows / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = by_id.filter(drawn)
    # The chosen labels are bounded by max_rows, so they are broadcast.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")


def _count_features(params: Params):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo(params.prefixes)
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic > 0)].update(present(text, memo))
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame(
                {
                    "feature": names,
                    "n": [seen[0][f] + seen[1][f] for f in names],
                    "n_toxic": [seen[1][f] for f in names],
                }
            )

    return count


def _vocabulary(sample: DataFrame, params: Params) -> list[str]:
    """The features that tell the classes apart best, and all identity terms."""
    sizes = sample.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("pos")).first()
    rate = min(max(sizes.pos / max(sizes.n, 1), 1e-6), 1 - 1e-6)
    counts = sample.mapInPandas(
        _count_features(params), "feature string, n bigint, n_toxic bigint"
    )
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t"))
    spread = F.sqrt(F.col("n") * rate * (1 - rate))
    best = (
        counts.filter(F.col("n") >= params.min_rows)
        .orderBy(F.desc(F.abs(F.col("t") - F.col("n") * rate) / spread), "feature")
        .limit(params.max_features)
    )
    chosen = {row.feature for row in best.select("feature").collect()}
    terms = {f for t in _OTHERS for f in features_of(t, params.prefixes)}
    return sorted(chosen | terms)


def _places(names: list[str], prefixes: tuple[int, ...]):
    """Per sampled text its features, and per counterfactual the features lost and won."""
    index = {name: i for i, name in enumerate(names)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo(prefixes, index)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                rows.append((int(toxic > 0), [index[f] for f in present(text, memo)], []))
                for sentence, swapped in counterfactuals(text):
                    was, now = present(sentence, memo), present(swapped, memo)
                    if was != now:
                        lost, won = was - now, now - was
                        rows.append((-1, [index[f] for f in lost], [index[f] for f in won]))
            yield pd.DataFrame(rows, columns=["label", "has", "won"])

    return place


class _Rows:
    """Sparse rows of plus and minus ones."""

    def __init__(self, plus: list, minus: list | None = None):
        minus = minus or [[]] * len(plus)
        sizes = [len(p) + len(m) for p, m in zip(plus, minus, strict=True)]
        self.n = len(plus)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.column = np.array(
            [c for p, m in zip(plus, minus, strict=True) for c in (*p, *m)], dtype=np.int64
        )
        self.sign = np.array(
            [s for p, m in zip(plus, minus, strict=True) for s in (*[1.0] * len(p), *[-1.0] * len(m))]
        )

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * weights[self.column], self.n)

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.sign * values[self.row], width)


def optimise(
    texts: _Rows, toxic: np.ndarray, swaps: _Rows, width: int, params: Params
) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, the mean squared score change of swaps, and L2.

    L2 is divided by a feature's share of the texts, so that a few copies of one text
    don't make its words telling.
    """
    w = np.zeros(width + 1)  # the last is the bias
    share = np.maximum(np.bincount(texts.column, minlength=width), 1) / max(texts.n, 1)
    l2 = params.l2 / share
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, params.steps + 1):
        score = 1 / (1 + np.exp(-np.clip(texts.times(w[:-1]) + w[-1], -30, 30)))
        error = (score - toxic) / max(texts.n, 1)
        grad = np.append(texts.back(error, width), error.sum())
        grad[:-1] += 2 * l2 * w[:-1]
        if swaps.n:
            change = swaps.times(w[:-1])
            grad[:-1] += swaps.back(2 * params.swap_penalty * change / swaps.n, width)
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """Learn from ``labels`` (``doc_id, toxic``) and the texts of ``docs`` (``doc_id, text``).

    Only the columns named are read. NULL texts are empty; labels with NULLs, and labels of
    no document, are passed over. An id labelled twice is toxic if any label says so, and so
    is a repeated text. Without rows of both classes the score is the share of toxic rows
    (0.5 if there are none).
    """
    params = params or Params()
    sample = _sample(docs, labels, params)
    names = _vocabulary(sample, params)
    # Bounded by max_rows and max_features; swaps by the identity terms in these rows.
    rows = sample.mapInPandas(
        _places(names, params.prefixes), "label int, has array<int>, won array<int>"
    ).toPandas()
    texts, swaps = rows[rows.label >= 0], rows[rows.label < 0]
    # The sample's order differs between runs; in one order the sums are the same.
    texts = texts.assign(has=[sorted(h) for h in texts.has])
    texts = texts.iloc[sorted(range(len(texts)), key=lambda i: (texts.label.iat[i], texts.has.iat[i]))]
    toxic = texts.label.to_numpy(dtype=float)
    if len(set(toxic)) < 2:
        share = toxic.mean() if len(toxic) else 0.5
        return Model({}, math.log((share + 1e-4) / (1 - share + 1e-4)), params)
    pairs = sorted((sorted(h), sorted(w)) for h, w in zip(swaps.has, swaps.won, strict=True))
    lost, won = [p[0] for p in pairs], [p[1] for p in pairs]
    weights, bias = optimise(
        _Rows(list(texts.has)), toxic, _Rows(won, lost), len(names), params
    )
    kept = {n: float(w) for n, w in zip(names, weights, strict=True) if abs(w) > 1e-3}
    return Model(kept, bias, params)


def score(model: Model, text: Column) -> Column:
    """Score of a text column between 0 and 1; NULL as the empty text."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model.weights
        memo = _memo(model.params.prefixes, weights)
        for batch in texts:
            sums = [model.bias + sum(map(weights.__getitem__, sorted(present(t, memo)))) for t in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def training_fold(doc_id: Column) -> Column:
    """False for the held-out third of ids, whose labels are never learnt from."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored_documents(
    docs: DataFrame, labels: DataFrame, params: Params | None = None
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    The model is fitted on the labels of the training fold. Scores depend on texts alone.
    NULL and empty texts get the score of no evidence. A NULL id is not held out. Repeated
    rows give repeated results, and an empty table gives an empty table.
    """
    params = params or Params()
    model = fit(docs, labels.filter(training_fold(F.col("doc_id"))), params)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their columns as they are."""
    params = params or Params()
    model = fit(docs, labels.filter(training_fold(F.col("doc_id"))), params)
    return docs.filter(score(model, F.col("text")) < params.threshold)
