"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled good) and unlabelled documents of the corpus train a
linear model that minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; labels of bad documents aren't used.
The class prior is estimated by the best bin of a positives-against-unlabelled score. All
documents are then scored where they are, whole texts, in Arrow batches.

The unlabelled documents are the whole corpus: one pass turns texts into features, which are
written as a small table, and every step of the training sums over all of it. Of labelled
documents at most ``POSITIVES`` are used, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..partitions import spread
from .common import forget, fresh, name, release, releasing, written

POSITIVES = 10_000
SEED = 11
STEPS = 15
#: Strength of the prior on weights, in documents.
RIDGE = 20.0
#: Weight of one failed bound on the risk of unlabelled documents, as in the published method.
GAMMA = 1.0
BETA = 0.0

_CLASS = np.full(256, 15, np.uint8)
for _i, _chars in enumerate((b" \t", b"\r\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"'\"", b"()[]{}<>", b"|", b"&@#$%*", b"-_/\\", b"=+~^`")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _i
_CLASS[128:] = 14
N_FEATURES = 256 + 7


def features(raw: bytes) -> np.ndarray:
    """Square roots of the shares of byte-class pairs, and shares of repeated words and lines.

    An empty text has zeros only.
    """
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(raw) > 1:
        out[:256] = np.bincount(kinds[:-1].astype(np.intp) * 16 + kinds[1:], minlength=256)
        out[:256] = np.sqrt(out[:256] / (len(raw) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    out[256] = sum(map(eq, words, words[1:])) / n
    out[257] = len(set(words)) / n
    out[258] = 1 - len(set(lines)) / len(lines)
    out[259] = min(len(raw) / n, 50.0) / 10
    out[260] = np.log1p(len(raw)) / 10
    out[261] = np.log1p(n / len(lines)) / 5
    out[262] = float(np.count_nonzero(kinds == 3)) / len(raw)
    return out


@dataclass
class Model:
    """A linear score; above 0 means good."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Rows:
    """Feature vectors that sums run over: a matrix here, or a written table in Spark."""

    def __init__(self, of: np.ndarray | DataFrame):
        self.of = of

    def sum(self, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``part`` (of a matrix of rows, a vector of ``size``) over blocks of all rows."""
        if isinstance(self.of, np.ndarray):
            return part(self.of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    total += part(_matrix(b.column(0).slice(i, 4096)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["i", "v"])

        got = self.of.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float64)


_upper = lru_cache(np.triu_indices)


def _packed(m: np.ndarray) -> np.ndarray:
    return m[_upper(len(m))]


def _unpacked(v: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    m[_upper(n)] = v
    return m + np.triu(m, 1).T


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), _packed(x.T @ x)])


def estimate_prior(p: np.ndarray, u: _Rows, mean: np.ndarray, cov: np.ndarray, n: int, seed: int = SEED) -> float:
    """Share of positives among all unlabelled rows: the least ratio of tail shares, unlabelled to positive.

    The score is the linear discriminant of half of the positives against all unlabelled
    rows, by their mean and covariance; its tails are compared at quantiles of the other
    half. The threshold is the one with the least upper confidence bound.
    """
    p = p[np.random.default_rng(seed).permutation(len(p))]
    half = len(p) // 2 or len(p)
    ridge = (1e-3 + RIDGE / n) * np.trace(cov) / len(cov)
    w = np.linalg.solve(cov + ridge * np.eye(len(cov)), p[:half].mean(0) - mean)
    sp = np.sort((p[half:] if len(p) > half else p) @ w)
    at = np.quantile(sp, np.linspace(0, 0.99, 100))
    below = np.cumsum(u.sum(lambda x: np.bincount(np.searchsorted(at, x @ w, "right"), minlength=101).astype(float), 101))
    qp = 1 - np.searchsorted(sp, at, "left") / len(sp)
    qu = 1 - np.concatenate([[0], below])[1:101] / n
    slack = np.sqrt(np.log(40) / 2 / n) + np.sqrt(np.log(40) / 2 / len(sp))
    best = int(np.argmin(qu / qp + 1.01 * slack / qp))
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def risk(w: np.ndarray, p: np.ndarray, u: _Rows, n: int, pi: float, decay: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """The non-negative risk of weights (the last is the bias), its unlabelled part before it is
    clipped, the gradients of what is left and of that part, and the curvature, by all rows."""
    d = len(w)

    def part(x: np.ndarray) -> np.ndarray:
        x = np.hstack([x, np.ones((len(x), 1))])
        f = x @ w
        s = _sigmoid(f)
        return np.concatenate([[np.logaddexp(0, f).sum()], s @ x, _packed((x * (s * (1 - s))[:, None]).T @ x)])

    got = u.sum(part, 1 + d + d * (d + 1) // 2) / n
    x = np.hstack([p, np.ones((len(p), 1))])
    f = x @ w
    rest = got[0] - pi * np.logaddexp(0, f).mean()
    g_rest = got[1 : 1 + d] - pi * (_sigmoid(f) @ x) / len(x)
    g = pi * (-_sigmoid(-f) @ x) / len(x) + decay * w
    return pi * np.logaddexp(0, -f).mean() + max(0.0, rest) + 0.5 * float(decay @ (w * w)), rest, g, g_rest, _unpacked(got[1 + d :], d)


def train(p: np.ndarray, u: np.ndarray | DataFrame, prior: float | None = None, seed: int = SEED, steps: int = STEPS) -> Model:
    """Fit the linear model on features of positives and of all unlabelled documents.

    Every step is one sum over all unlabelled rows and a damped Newton step on the risk;
    where the unlabelled part is negative, the step raises it, as the published method does.
    """
    rows = _Rows(u)
    d = N_FEATURES if not isinstance(u, np.ndarray) else u.shape[1]
    m = rows.sum(_moments, 1 + d + d * (d + 1) // 2)
    n = int(m[0])
    mean, second = m[1 : 1 + d] / n, _unpacked(m[1 + d :], d) / n
    cov = second - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-4] = 1.0
    p = (p - mean) / scale
    if isinstance(u, np.ndarray):
        rows = _Rows((u - mean) / scale)
    else:
        rows.sum, whole = lambda part, size: whole(lambda x: part((x - mean) / scale), size), rows.sum
    cov = cov / np.outer(scale, scale)
    pi = estimate_prior(p, rows, np.zeros(d), cov, n, seed) if prior is None else prior
    decay = np.r_[np.full(d, 1e-3 + RIDGE / n), 1e-6]
    w, best, step, at = np.zeros(d + 1), None, 1.0, None
    for _ in range(steps):
        value, rest, g, g_rest, h = risk(w, p, rows, n, pi, decay)
        if best is None or value < best[0]:
            done = best is not None and best[0] - value < 1e-5 * abs(value)
            best, at, step = (value, w), (rest, g, g_rest, h), min(1.0, 2 * step)
            if done:
                break
        else:
            step /= 4  # back to the best weights, with a shorter step
            if step < 1e-2:
                break
        rest, g, g_rest, h = at
        way = g + g_rest if rest >= -BETA else -GAMMA * g_rest
        w = best[1] - step * np.linalg.solve(h + np.diag(decay), way)
    w = best[1]
    return Model(w[:-1], float(w[-1]), mean, scale, pi)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, seed: int = SEED) -> Model | None:
    """A model from documents and labels, None if no document is labelled good.

    ``label`` is 1 for a trusted positive; other labels are ignored and nulls too. At most
    ``positives`` rows with such a label are used, those with the least hash of their id;
    all documents with a text are the unlabelled ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(x.as_py()).astype(np.float16).tobytes() for x in b.column(1)], pa.binary())], names=["id", "x"])

    raws = docs.filter(name(text).isNotNull()).select(name(doc_id).alias("id"), name(text).cast("binary").alias("raw"))
    rows = written(spread(raws).mapInArrow(releasing(run), f"id {dict(raws.dtypes)['id']}, x binary"), "quality-features")
    good = labels.filter(name(label) == 1).select(name(doc_id).alias("id")).filter("id IS NOT NULL").distinct()
    chosen = rows.join(good, "id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "id"), F.xxhash64("x")).limit(positives).select("x").toArrow()
    model = train(_matrix(chosen.column("x").combine_chunks()), rows, seed=seed) if chosen.num_rows else None
    forget(rows)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a score column, above 0 for good documents; null for a null text or without a model."""
    [added] = fresh(docs, out)
    if model is None:
        return docs.withColumn(added, F.lit(None).cast("double"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(raws: pa.Array) -> pa.Array:
        texts = [x.as_py() for x in raws]
        x = np.stack([features(t or b"") for t in texts]) if texts else np.zeros((0, N_FEATURES))
        got = held.value.scores(x)
        release()
        return pa.array([None if t is None else float(s) for t, s in zip(texts, got)], pa.float64())

    run.__annotations__ = {"raws": pa.Array, "return": pa.Array}
    # called non-deterministic so that a filter on the score doesn't score the texts once more
    return spread(docs).withColumn(added, F.arrow_udf(run, "double").asNondeterministic()(name(text).cast("binary")))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", out: str | None = None) -> DataFrame:
    """The documents that the classifier accepts, with all their columns and ``out`` if named.

    Rows are judged by their text alone, so repeated rows share their fate. A score must be
    above 0; one of exactly 0 is rejected. Documents without a text are rejected; an empty
    text is scored like any other. Without any trusted
    positive nothing can be learnt, and all documents stay.
    """
    [added] = fresh(docs, out or "quality_score")
    model = fit(docs, labels, doc_id, text, label)
    scored = score(docs, model, text, added)
    kept = scored if model is None else scored.filter(F.col(added) > 0)
    return kept if out else kept.drop(added)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), out="quality_score").drop("text")
