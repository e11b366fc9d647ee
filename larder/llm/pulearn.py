"""Quality classifier learnt from positives and unlabelled text.

The non-negative unbiased risk  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))  of a
linear model under logistic loss is minimised by gradient steps. R_U is taken
over every document of the corpus, R_P over the trusted positives; each step is
one pass over a small feature table, and only sums of gradients reach the driver.
The class prior pi is estimated by best-bin comparison of the scores of a first,
positive-against-unlabelled model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, released, small_batches

#: Bytes counted together; each group gives one feature, its share of all bytes.
BYTE_GROUPS = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?",
    b"|", b"&", b"#", b"$", b"%", b"*", b"()[]{}<>", b"/\\", b":;", b"-_", b"'\"", b"=+@~^`",
]
_GROUP = np.full(256, len(BYTE_GROUPS), dtype=np.intp)  # the last group: all other bytes
for _i, _chars in enumerate(BYTE_GROUPS):
    _GROUP[list(_chars)] = _i
N_FEATURES = len(BYTE_GROUPS) + 1 + 12


def features(text: str | None) -> np.ndarray:
    """Feature vector of one whole text; null counts as empty."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    out = np.zeros(N_FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_GROUP, weights=counts, minlength=len(BYTE_GROUPS) + 1) / n
    out[: len(shares)] = np.sqrt(shares)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    kinds = Counter(words)
    loud = sum(c for x, c in kinds.items() if len(x) > 1 and x.isupper())
    odd = sum(c for x, c in kinds.items() if x[-1:] in b"!&#$%*|")
    same = sum(map(bytes.__eq__, words, words[1:]))
    line_kinds = Counter(lines)
    out[len(shares) :] = [
        math.log1p(len(raw)), math.log1p(len(words)), n / w / 10, len(kinds) / w, max(kinds.values(), default=0) / w,
        same / w, loud / w, odd / w, math.log1p(len(lines)), len(line_kinds) / len(lines),
        math.log1p(n / len(lines)), sum(c for x, c in line_kinds.items() if len(x) < 20) / len(lines),
    ]
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py()).astype("<f4").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with x the packed features of the whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(_feature_batches), f"doc_id {kind}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, N_FEATURES).astype(np.float64)


def _sums(table: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Adds part(X, positive) over all batches of table (x, positive); only the total reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"]
            )

    rows = table.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()
    return np.array([v for _, v in sorted(map(tuple, rows))])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    """A linear scorer over standardised features: weights (the last one is the bias), mean, scale and prior."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.mean, self.scale, self.prior = weights, mean, scale, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that the text is good, rounded to six digits."""
        return np.round(1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40))), 6)


def _newton(table: DataFrame, model: Model, prior: float | None, steps: int, ridge: float, beta: float) -> np.ndarray:
    """Weights after Newton steps: positive against unlabelled if prior is None, else the non-negative risk."""
    d = N_FEATURES + 1
    w = np.zeros(d)
    for _ in range(steps):
        at = Model(w, model.mean, model.scale, 0)

        def part(x: np.ndarray, positive: np.ndarray, at: Model = at) -> np.ndarray:
            g = at.margin(x)
            s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            z = np.c_[(x - at.mean) / at.scale, np.ones(len(x))]
            p = positive.astype(bool)
            h = s * (1 - s)
            return np.concatenate([
                [p.sum(), len(x), _softplus(g[p]).sum(), _softplus(g).sum()],
                z[p].sum(0), (z[p] * s[p, None]).sum(0), (z * s[:, None]).sum(0),
                ((z[p] * h[p, None]).T @ z[p]).ravel(), ((z * h[:, None]).T @ z).ravel(),
            ])

        t = _sums(table, part)
        n_p, n_u = max(t[0], 1), max(t[1], 1)
        loss_p, loss_u = t[2] / n_p, t[3] / n_u
        mean_p, push_p, push_u = t[4 : 4 + d] / n_p, t[4 + d : 4 + 2 * d] / n_p, t[4 + 2 * d : 4 + 3 * d] / n_u
        bend_p, bend_u = (t[4 + 3 * d :].reshape(2, d, d) / np.array([n_p, n_u])[:, None, None])
        if prior is None:
            grad, bend, rate = push_p - mean_p + push_u, bend_p + bend_u, 1.0
        elif loss_u - prior * loss_p >= -beta:
            grad, bend, rate = prior * (push_p - mean_p) + (push_u - prior * push_p), bend_u, 1.0
        else:  # the negative part fell below zero: step back along it alone
            grad, bend, rate = -(push_u - prior * push_p), bend_u, 0.5
        step = np.linalg.solve(bend + ridge * np.eye(d), grad + ridge * w)
        step *= min(1.0, 4.0 / max(1e-12, np.linalg.norm(step)))
        w = w - rate * step
        if np.linalg.norm(step) < 1e-3:
            break
    return w


def estimate_prior(table: DataFrame, first: Model, bins: int = 1000, delta: float = 0.1) -> float:
    """Share of positives among all rows: the smallest ratio of unlabelled to positive scores above a threshold.

    Best-bin estimation: the threshold minimises an upper confidence bound of the
    ratio; only a histogram of `bins` counts reaches the driver.
    """

    def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((first.score(x) * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(at[positive.astype(bool)], minlength=bins), np.bincount(at, minlength=bins)]).astype(float)

    p, u = _sums(table, part).reshape(2, bins)
    n_p, n_u = max(p.sum(), 1), max(u.sum(), 1)
    above_p, above_u = np.cumsum(p[::-1])[::-1] / n_p, np.cumsum(u[::-1])[::-1] / n_u
    slack = math.sqrt(math.log(4 / delta) / 2 / n_p) + math.sqrt(math.log(4 / delta) / 2 / n_u)
    bound = np.where(above_p > 0, (above_u + slack) / np.maximum(above_p, 1e-12), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-12), 0.01, 0.99))


def fit(table: DataFrame, steps: int = 10, ridge: float = 1e-3, beta: float = 0.0) -> Model:
    """Learns from table (x, positive), every row of which is an unlabelled example and some trusted positives.

    Without a trusted positive or without rows the model scores everything 0.5.
    """
    nothing = Model(np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    t = _sums(table, lambda x, p: np.concatenate([[p.sum(), len(x)], x.sum(0), (x * x).sum(0)]))
    if not len(t) or not t[0]:
        return nothing
    mean = t[2 : 2 + N_FEATURES] / t[1]
    scale = np.sqrt(np.maximum(t[2 + N_FEATURES :] / t[1] - mean**2, 0))
    scale[scale < 1e-4] = 1.0
    base = Model(nothing.weights, mean, scale, 0.5)
    first = Model(_newton(table, base, None, steps, ridge + 10 / t[0], beta), mean, scale, 0.5)
    prior = estimate_prior(table, first)
    return Model(_newton(table, base, prior, steps, ridge + 1 / t[0], beta), mean, scale, prior)


def training_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, positive, held_out), checkpointed.

    held_out: crc32 of the id as text is divisible by 5 (never for a null id).
    positive: a row not held out whose labels all say quality 1.
    """
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    with small_batches(docs.sparkSession):
        return cut(
            feature_table(docs).join(trusted, "doc_id", "left")
            .select("doc_id", "x", (F.coalesce(F.col("quality") == 1, F.lit(False)) & ~held_out).alias("positive"), held_out.alias("held_out"))
        )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    docs: doc_id and text; labels: doc_id and quality; other columns are ignored.
    Inputs of a score are features of the text alone. Null and empty texts get the
    score of the empty text; repeated rows are scored alike; empty tables give an
    empty result, missing labels the score 0.5.
    """
    table = training_table(docs, labels)
    model = fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", "held_out", "x").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents scored at `threshold` or more, with all their columns; texts are scored where they lie, 256 at a time.

    Empty and null texts get the score of the empty text, repeated rows the same score; an empty table stays empty.
    """
    model = fit(training_table(docs, labels))

    @F.pandas_udf("boolean")
    def good(texts):
        found = [model.score(np.stack([features(t) for t in texts.iloc[lo : lo + 256]])) >= threshold for lo in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(good("text"))
