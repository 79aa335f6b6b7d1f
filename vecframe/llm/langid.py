"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3), with document
frequencies counted over all documents. Weights are trained by follow-the-regularised-
leader with per-coordinate rates and elastic-net penalties, which leave most of them zero;
a temperature fitted on held-out documents then calibrates the probabilities.

Training uses about ``PER_LANGUAGE`` documents of each labelled language (all of them if there
are no more), by a hash of their id and text; a fifth of them is held out for the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..partitions import spread
from .common import fresh, name, releasing

BITS = 14
SIZE = 1 << BITS
PER_LANGUAGE = 1500
SEED = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.05
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_SHIFT = np.uint32(32 - BITS)


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the character n-grams of a text, and how often each occurs."""
    c = np.frombuffer(raw.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    one = (c + np.uint32(1)) * _A
    counts = np.bincount(one >> _SHIFT, minlength=SIZE)
    if len(c) > 1:
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _B + one[1:]
        two = (two ^ (two >> np.uint32(13))) * _C
        counts += np.bincount(two >> _SHIFT, minlength=SIZE)
    if len(c) > 2:
        three = (two[:-1] ^ (two[:-1] >> np.uint32(16))) * _B + one[2:]
        counts += np.bincount(((three ^ (three >> np.uint32(13))) * _A) >> _SHIFT, minlength=SIZE)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def weighted(raw: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and TF-IDF values of unit length."""
    at, n = grams(raw)
    x = (1 + np.log(n)) * idf[at]
    size = float(np.sqrt(x @ x))
    return at, x / size if size else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, raw: bytes) -> np.ndarray:
        at, x = weighted(raw, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each bin occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for x in b.column(0):
                df[grams(x.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["bin", "n"])

    rows = spread(docs.filter(name(text).isNotNull()).select(name(text).cast("binary"))).mapInArrow(releasing(run), "bin int, n long")
    got = rows.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SIZE + 1, np.int64)
    df[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return df[:SIZE], int(df[SIZE])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = SEED, epochs: int = EPOCHS, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over (bins, values, class) rows."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights_at(at: np.ndarray) -> np.ndarray:
        za = z[at]
        w = -(za - np.sign(za) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2)
        return np.where(np.abs(za) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = weights_at(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sq = g * g
            before = n[at]
            z[at] += g - (np.sqrt(before + sq) - np.sqrt(before)) / ALPHA * w
            n[at] += sq
    w = weights_at(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its log."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    if not len(y):
        return 1.0
    lo, hi, g = -2.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, seed: int = SEED) -> Model | None:
    """A model from the documents that have a language and a text, or None if none has.

    A document is used if a hash of its id and text is below a share of its language, so
    how many are used varies about ``per_language`` as in independent draws. Repeated rows
    are used once; rows without an id are told apart by their texts.
    """
    known = docs.filter(name(lang).isNotNull() & name(text).isNotNull() & (name(text) != ""))
    counts = {r[0]: r[1] for r in known.groupBy(name(lang)).count().collect()}
    if not counts:
        return None
    df, total = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + df)) + 1
    languages = sorted(counts)
    share = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(min(1.0, per_language / counts[c])))])
    unit = F.pmod(F.xxhash64(F.lit(seed), name(doc_id), name(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = known.filter(unit < F.element_at(share, name(lang))).select(name(doc_id).cast("string").alias("id"), name(lang).alias("lang"), F.xxhash64(F.lit(seed + 1), name(doc_id), name(text)).alias("h"), name(text).cast("binary").alias("raw"))
    floats = idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [weighted(x.as_py(), floats) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([a.tobytes() for a, _ in xs], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in xs], pa.binary())], names=["id", "lang", "h", "at", "x"])

    t = spread(got).mapInArrow(releasing(run), "id string, lang string, h long, at binary, x binary").dropDuplicates(["id", "lang", "h"]).toArrow().sort_by([("h", "ascending"), ("id", "ascending")]).to_pylist()
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(np.float64), languages.index(r["lang"])) for r in t]
    held = rows[::5] if len(rows) >= 50 else []
    learnt = [r for i, r in enumerate(rows) if i % 5] if held else rows
    w, b = train(learnt, len(languages), seed)
    logits = np.array([x @ w[at] + b for at, x, _ in held]) if held else np.zeros((0, len(languages)))
    return Model(languages, idf, w, b, temperature(logits, np.array([y for *_, y in held], int)))


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_pred", confidence: str = "lang_prob") -> DataFrame:
    """``docs`` with the most probable language and its calibrated probability.

    Of languages tied the alphabetically first is taken. A null or empty text, or no model,
    gives nulls. Every row is kept and judged by its whole text. A new column whose name is
    taken gets a leading underscore.
    """
    a, b, both = fresh(docs, out, confidence, "lang_found")
    if model is None:
        return docs.withColumns({a: F.lit(None).cast("string"), b: F.lit(None).cast("double")})
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(raws: pa.Array) -> pa.Array:
        m, names, probs = held.value, [], []
        for x in raws:
            raw = x.as_py()
            p = m.probabilities(raw) if raw else None
            names.append(None if p is None else m.languages[int(p.argmax())])
            probs.append(None if p is None else float(p.max()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(probs, pa.float64())], names=["l", "p"])

    run.__annotations__ = {"raws": pa.Array, "return": pa.Array}
    found = spread(docs).withColumn(both, F.arrow_udf(run, "l string, p double")(name(text).cast("binary")))
    return found.withColumns({a: F.col(f"{both}.l"), b: F.col(f"{both}.p")}).drop(both)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return identify(docs, fit(docs)).drop("text")
