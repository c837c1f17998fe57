"""Quality scores by positive-unlabelled learning.

The classifier sees trusted positives and unlabelled web text and minimises the non-negative unbiased risk
(Kiryo and others 2017) with an estimated class prior; labelled negatives, where there are any, only enter that
estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BLANKS, Words, fresh, merged, narrow_cut, pieces, text_bytes

#: Bounds of the samples that the model is fitted on, taken by a hash of the id from all rows that qualify.
POSITIVE_ROWS, UNLABELLED_ROWS = 8_000, 16_000
BINS, STEPS, RATE, PENALTY = 24, 250, 0.08, 2e-4

# classes of bytes whose shares are features
_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", ".", ",", ";:'\"", "!", "?", "%", "*", "#", "&", "$", "|", "@", "<>", "=+", "(){}[]", "-_", "/\\~^`"]
_CLASS = np.zeros(256, np.int64)  # 0: other control bytes
for _n, _group in enumerate(_GROUPS, 1):
    for _c in _group:
        _CLASS[ord(_c)] = _n
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
FEATURES = _CLASSES + 7


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, matrix): shares of byte classes, lengths, repetition; all zero for an empty text."""
    data, ends = text_bytes(column)
    for i, j in pieces(ends):
        part, local = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        size = np.diff(local)
        text = np.repeat(np.arange(j - i), size)
        shares = np.bincount(text * _CLASSES + _CLASS[part], minlength=(j - i) * _CLASSES).reshape(j - i, _CLASSES).astype(float)
        lines = shares[:, 5].copy() + (size > 0)
        shares /= np.maximum(size, 1)[:, None]
        words = Words(part, local, BLANKS)
        n = np.diff(words.of_text)
        length = (words.ends - words.starts).astype(float)
        total = np.concatenate([[0.0], np.cumsum(length)])
        long_words = np.concatenate([[0], np.cumsum(length > 20)])
        at, to = words.of_text[:-1], words.of_text[1:]
        some = np.maximum(n, 1)
        whole = part.tobytes()
        distinct, repeated = np.zeros(j - i), np.zeros(j - i)
        for k in np.flatnonzero(n):
            one = whole[local[k] : local[k + 1]]
            distinct[k] = len(set(one.split())) / n[k]
            own = [x for x in one.split(b"\n") if x]
            repeated[k] = 1 - len(set(own)) / len(own)
        extra = [np.log1p(n), np.log1p(size), (total[to] - total[at]) / some, (long_words[to] - long_words[at]) / some, distinct, repeated, np.log1p(n / np.maximum(lines, 1))]
        yield i, j, np.column_stack([shares, *extra])


@dataclass
class Model:
    """An additive model over binned features; edges and weights by feature."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), self.prior)
        g = self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise prior * R_p+ + max(0, R_u- - prior * R_p-) with the logistic loss.

    Where the estimate of the negatives' risk falls below zero, its gradient is followed back instead, as
    the non-negative correction asks. Without positives or unlabelled rows every score is the prior.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((0, BINS - 1)), np.zeros((0, BINS)), 0.0, prior)
    return _descend(positive, unlabelled, prior, _non_negative)


def _non_negative(g: np.ndarray, p: np.ndarray, is_positive: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk in each row's output g; p is its probability."""
    n_p = is_positive.sum()
    n_u = len(g) - n_p
    as_negative = np.logaddexp(0, g)  # loss of calling a row negative
    rest = as_negative[~is_positive].mean() - prior * as_negative[is_positive].mean()
    toward = np.where(is_positive, -prior * p / n_p, p / n_u)
    return np.where(is_positive, -prior * (1 - p) / n_p, 0.0) + toward if rest >= 0 else -toward


def _apart(g: np.ndarray, p: np.ndarray, is_positive: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the plain logistic loss that tells positives from unlabelled rows."""
    return np.where(is_positive, (p - 1) / is_positive.sum(), p / (~is_positive).sum()) / 2


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, gradient: Callable) -> Model:
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Model(edges, np.zeros((both.shape[1], BINS)), float(np.log(prior / (1 - prior))), prior)
    flat = model.bins(both) + np.arange(both.shape[1]) * BINS
    is_positive = np.arange(len(both)) < len(positive)
    theta = np.concatenate([model.weights.ravel(), [model.bias]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        g = theta[flat].sum(axis=1) + theta[-1]
        d = gradient(g, 1 / (1 + np.exp(-np.clip(g, -40, 40))), is_positive, prior)
        grad = np.bincount(flat.ravel(), np.repeat(d, flat.shape[1]), minlength=len(theta))
        grad[-1] = d.sum()
        grad[:-1] += PENALTY * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = theta[:-1].reshape(model.weights.shape), float(theta[-1])
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from both alone.

    A score that tells the two apart is fitted on half of the rows. Of the other half, the share of unlabelled
    rows above any score is at least the prior times that of positives, and where the score is best it is no
    more; so the least ratio over the scores that a tenth or more of the positives reach, each with its
    sampling error added, estimates the prior. It is 1 if either half is empty.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 1.0
    shuffle = np.random.default_rng(1).permutation  # rows may come in an order
    positive, unlabelled = shuffle(positive), shuffle(unlabelled)
    model = _descend(positive[::2], unlabelled[::2], 0.5, _apart)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    at = np.quantile(p, np.linspace(0, 0.9, 46), method="lower")
    above = lambda x: 1 - np.searchsorted(x, at, "left") / len(x)
    ratio = above(u) / above(p)
    error = np.sqrt(ratio / (len(u) * above(p)) + ratio**2 / (len(p) * above(p)))
    return float(np.clip(np.min(ratio + error), 0.0, 1.0))


def _matrix(rows: DataFrame, text_col: str) -> np.ndarray:
    """Features of a bounded sample, as one matrix on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], names=["x"])

    got = rows.select(text_col).mapInArrow(run, "x array<double>").toArrow().column("x")
    values = got.combine_chunks().flatten().to_numpy() if got.num_chunks else np.zeros(0)
    return values.reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on documents whose label is 1 and on documents whatever their label; labels has the rows to learn from.

    Null ids and null labels count as unlabelled, null texts as empty; of repeated ids one row is taken.
    Without positives or without documents every score is the prior.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = known.agg(F.count_if(F.col("y") == 1).alias("p"), F.count("*").alias("n")).first()
    order = F.xxhash64(F.col(id_col), F.lit(7))
    trusted = known.where("y = 1").orderBy(order).limit(POSITIVE_ROWS).select(F.col(id_col).alias("_id"), F.lit(1).alias("y"))
    web = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(11))).limit(UNLABELLED_ROWS).withColumn("y", F.lit(0))
    most = POSITIVE_ROWS + UNLABELLED_ROWS
    chosen = narrow_cut(trusted.unionByName(web).groupBy("_id").agg(F.collect_set("y").alias("y")), most)  # at most the two bounds of rows
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    sample = narrow_cut(found.groupBy("_id", "y").agg(F.min("text").alias("text")), most)  # one row an id, whatever docs repeats
    positive, unlabelled = (_matrix(sample.where(F.array_contains("y", y)), "text") for y in (1, 0))
    # labelled negatives tell the prior better than any estimate from positives and unlabelled rows
    prior = (share["p"] + 1) / (share["n"] + 2) if share["p"] < share["n"] or not share["n"] else estimate_prior(positive, unlabelled)
    return fit(positive, unlabelled, min(max(prior, 0.01), 0.99))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability of a positive. Null and empty texts are scored by their empty features.

    Very long texts are scored whole; repeated rows get equal scores; an empty table gives an empty result; an
    input column named like the result is replaced.
    """

    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    (text,) = fresh(docs, "_text")
    plain = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias(text))

    kinds = ", ".join(f"c{n} {kind}" for n, (_, kind) in enumerate(plain.dtypes[:-1])) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in features(batch.column(batch.num_columns - 1)):
                columns = [*batch.slice(i, j - i).columns[:-1], pa.array(model.score(x))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{n}" for n in range(len(columns) - 1)), "score"])

    out = merged(plain.mapInArrow(run, kinds), docs)
    return out.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(keep)], F.col("score").alias(score_col))
