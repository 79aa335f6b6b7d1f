"""Vector compression: scalar (sq8), product (pq) and rotated product (opq) quantization.

Codebooks are trained with numpy on a bounded sample and are deterministic; their parts are
fitted apart, by tasks where there is much to do. Codes are scored against a query with lookup
tables, without decoding them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QuantParams
from ..errors import ConfigError
from .search import _matrix, batch_knn

#: Rows times centroids of a part beyond which the parts are fitted by tasks, and that are compared at once.
TASK_CELLS = 1 << 18
TILE_CELLS = 1 << 16
#: Parts of at most so many columns are fitted with bounds, and centroids around a row's own that it is compared with then.
NARROW = 4
CLOSE = 12


def choose_pq_dim(dimension: int) -> int:
    """The largest divisor of the dimension that is at most an eighth of it, and 1 at least."""
    return next(d for d in range(max(1, dimension // 8), 0, -1) if dimension % d == 0)


def code_bytes(params: QuantParams, dimension: int) -> int:
    if params.codec == "none":
        return 4 * dimension
    return dimension if params.codec == "sq8" else params.pq_dim or choose_pq_dim(dimension)


def compression_ratio(params: QuantParams, dimension: int) -> float:
    return 4 * dimension / max(1, code_bytes(params, dimension))


def kmeans(x: np.ndarray, k: int, iterations: int = 20, spherical: bool = False) -> np.ndarray:
    """Lloyd's centroids from evenly spaced rows; an empty cluster takes a row far from its centroid."""
    x = np.asarray(x, np.float64)
    n = len(x)
    if not n:
        raise ConfigError("nothing to train on")
    c = x[np.linspace(0, n - 1, k).astype(int)].copy()
    bounds = Bounds(x) if not spherical and x.shape[1] <= NARROW and k > 2 * CLOSE and np.isfinite((x * x).sum()) else None
    columns = np.ascontiguousarray(x.T)
    for _ in range(iterations):
        at, d = nearest(x, c) if bounds is None else (bounds.nearest(c), None)
        sums = np.stack([np.bincount(at, column, k) for column in columns], 1)
        sizes = np.bincount(at, minlength=k)
        new = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            d = nearest(x, c)[1] if d is None else d
            new[empty] = x[np.argsort(-d, kind="stable")[np.arange(len(empty)) % n]]
        if spherical:
            norm = np.linalg.norm(new, axis=1, keepdims=True)
            new = np.where(norm > 0, new / np.where(norm > 0, norm, 1), new)
        if np.array_equal(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row by squared L2, and that distance; by tiles that stay in a core's cache. ``second`` takes the distance to the next one."""
    at, best = np.empty(len(x), np.int64), np.empty(len(x))
    cc, twice = (c * c).sum(1), np.ascontiguousarray(-2 * c.T)
    step = max(64, TILE_CELLS // len(c))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d = part @ twice
        d += cc
        near, xx = d.argmin(1), (part * part).sum(1)
        at[i : i + step] = near
        best[i : i + step] = d[np.arange(len(near)), near] + xx
        if second is not None:
            d[np.arange(len(near)), near] = np.inf
            second[i : i + step] = d.min(1) + xx
    return at, best


class Bounds:
    """Nearest centroids of rows of few columns, again and again as the centroids move.

    Of each row it keeps the most that its centroid can be away and the least that any other
    can be. While they don't meet, the row is not looked at. Else it is compared with the
    ``CLOSE`` centroids around its own, if none beyond them can be nearer, or with all. The
    bounds allow for rounding, so rows get the centroids that ``nearest`` gives, but for ties
    within that rounding.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.columns, self.xx = x, np.ascontiguousarray(x.T), (x * x).sum(1)
        self.rounding = 64 * np.finfo(np.float64).eps * self.xx.max()
        self.c: np.ndarray | None = None

    def _set(self, rows, best: np.ndarray, second: np.ndarray, beyond=np.inf) -> None:
        self.most[rows] = np.sqrt(np.maximum(best, 0) + self.rounding)
        self.least[rows] = np.minimum(np.sqrt(np.maximum(second - self.rounding, 0)), beyond)

    def nearest(self, c: np.ndarray) -> np.ndarray:
        if self.c is None:
            second, self.most, self.least = (np.empty(len(self.x)) for _ in range(3))
            self.at, best = nearest(self.x, c, second)
            self._set(slice(None), best, second)
        else:
            self._move(c)
        self.c = c
        return self.at

    def _move(self, c: np.ndarray) -> None:
        moved = np.sqrt(((c - self.c) ** 2).sum(1)) * (1 + 1e-9)
        apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
        np.fill_diagonal(apart, -1)  # each centroid is the first of those around it
        order = np.argpartition(apart, CLOSE + 1, axis=1)
        far = apart[np.arange(len(c)), order[:, CLOSE + 1]] * (1 - 1e-9)
        close = np.sort(order[:, : CLOSE + 1], 1)
        self.most += moved[self.at]
        self.least = np.minimum(self.least - moved[close].max(1)[self.at], far[self.at] - self.most)
        open_ = np.flatnonzero(self.most >= self.least)
        wide = 2 * self.most[open_] >= far[self.at[open_]]
        if len(rows := open_[wide]):
            second = np.empty(len(rows))
            self.at[rows], best = nearest(self.x[rows], c, second)
            self._set(rows, best, second)
        some, close = open_[~wide], np.ascontiguousarray(close.T)
        products, cc = [-2 * column[close] for column in c.T], (c * c).sum(1)[close]
        step = TILE_CELLS // (CLOSE + 1)
        for i in range(0, len(some), step):
            rows = some[i : i + step]
            was, each = self.at[rows], np.arange(len(rows))
            d = cc.take(was, 1)
            for column, product in zip(self.columns, products, strict=True):
                d += product.take(was, 1) * column[rows]
            best, near = d.min(0), np.empty(len(rows), np.int64)
            for j in range(CLOSE, -1, -1):
                near[d[j] == best] = j
            d[near, each] = np.inf
            self.at[rows] = close[near, was]
            self._set(rows, best + self.xx[rows], d.min(0) + self.xx[rows], far[was] - self.most[rows])


@dataclass
class Quantizer:
    """A trained codec. ``books`` is (parts, centroids, width) for pq and opq; ``low`` and ``scale`` serve sq8."""

    codec: str
    dimension: int
    books: np.ndarray | None = None
    rotation: np.ndarray | None = None
    low: np.ndarray | None = None
    scale: np.ndarray | None = None
    extra: dict = field(default_factory=dict)

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if self.codec == "sq8":
            return np.clip(np.floor((x - self.low) / self.scale + 0.5), 0, 255).astype(np.uint8)
        x = x @ self.rotation if self.rotation is not None else x
        parts = x.reshape(len(x), len(self.books), -1)
        return np.stack([nearest(parts[:, p], b)[0] for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        if self.codec == "sq8":
            return codes * self.scale + self.low
        x = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)
        return x @ self.rotation.T if self.rotation is not None else x

    def tables(self, query: np.ndarray, metric: str) -> np.ndarray:
        """A (parts, values) table whose sum over a code's values is the score of that code."""
        q = np.asarray(query, np.float64)
        if self.codec == "sq8":
            values = np.arange(256) * self.scale[:, None] + self.low[:, None]
            return (values - q[:, None]) ** 2 if metric == "euclidean" else values * q[:, None]
        q = q @ self.rotation if self.rotation is not None else q
        q = q.reshape(len(self.books), -1)
        if metric == "euclidean":
            return ((self.books - q[:, None, :]) ** 2).sum(2)
        return (self.books * q[:, None, :]).sum(2)

    def scores(self, codes: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
        t = self.tables(query, metric)
        s = t[np.arange(codes.shape[1])[None, :], codes].sum(1)
        return np.sqrt(np.maximum(s, 0)) if metric == "euclidean" else 1.0 - s if metric == "cosine" else -s

    def dumps(self) -> str:
        a = {n: getattr(self, n) for n in ("books", "rotation", "low", "scale")}
        return json.dumps({"codec": self.codec, "dimension": self.dimension, **{n: v.tolist() if v is not None else None for n, v in a.items()}})

    @classmethod
    def loads(cls, text: str) -> Quantizer:
        d = json.loads(text)
        return cls(d["codec"], d["dimension"], **{n: np.array(d[n]) if d[n] is not None else None for n in ("books", "rotation", "low", "scale")})


def _fitted(x: np.ndarray, p: int, width: int, k: int, iterations: int, rotation: np.ndarray | None, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The centroids of part ``p``, unless ``book`` has them, and, with a rotation, the products of all columns with what that part decodes to."""
    at = slice(p * width, (p + 1) * width)
    y = np.ascontiguousarray(x[:, at] if rotation is None else x @ rotation[:, at])
    book = kmeans(y, k, iterations) if book is None else book
    return book, None if rotation is None else x.T @ book[nearest(y, book)[0]]


def train(x: np.ndarray, params: QuantParams, sc: SparkContext | None = None, plain: Quantizer | None = None) -> Quantizer:
    """A codec fitted on the rows of ``x``; with ``sc``, tasks that hold ``x`` fit a part each.

    ``plain`` is the pq codec of the same rows and settings, if there is one: opq begins
    without a rotation, so its first books are those.
    """
    x = np.asarray(x, np.float64)
    if not len(x):
        raise ConfigError("nothing to train on")
    dim = x.shape[1]
    if params.codec == "sq8":
        low, high = x.min(0), x.max(0)
        return Quantizer("sq8", dim, low=low, scale=np.where(high > low, (high - low) / 255, 1.0))
    if params.codec not in ("pq", "opq"):
        raise ConfigError("the codec none is not trained")
    parts = params.pq_dim or choose_pq_dim(dim)
    if dim % parts:
        raise ConfigError("pq_dim must divide the dimension")
    k = 1 << params.pq_bits
    rotation = np.eye(dim) if params.codec == "opq" else None
    held = sc.broadcast(x) if sc is not None and len(x) * k > TASK_CELLS else None

    def fitted(rotation: np.ndarray | None, books: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
        width, iterations = dim // parts, params.iterations
        of = [None] * parts if books is None else books
        if held is None:
            return [_fitted(x, p, width, k, iterations, rotation, of[p]) for p in range(parts)]
        return sc.parallelize(range(parts), parts).map(lambda p: _fitted(held.value, p, width, k, iterations, rotation, of[p])).collect()

    for i in range(6 if rotation is not None else 0):
        u, _, vt = np.linalg.svd(np.concatenate([m for _, m in fitted(rotation, plain.books if plain is not None and not i else None)], 1))
        rotation = u @ vt
    books = np.stack([b for b, _ in fitted(rotation)])
    if held is not None:
        held.destroy()
    return Quantizer(params.codec, dim, books, rotation)


def train_on(df: DataFrame, params: QuantParams, vector: str = "vector", id: str = "id") -> Quantizer:
    """A codec of a vector column, from at most ``params.train_rows`` rows; sq8 bounds come from all rows."""
    rows = df.filter(F.col(vector).isNotNull())
    if params.codec == "sq8":
        at = rows.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi")).orderBy("at").collect()
        low, high = np.array([r[1] for r in at]), np.array([r[2] for r in at])
        return train(np.stack([low, high]), params)
    return train(sample_matrix(rows, vector, id, params.train_rows), params, df.sparkSession.sparkContext)


def sample_matrix(rows: DataFrame, vector: str, id: str, most: int) -> np.ndarray:
    """Vectors of the ``most`` rows with the least hash of their id, in that order."""
    got = rows.select(F.xxhash64(id).alias("h"), F.col(id).cast("string").alias("i"), F.col(vector).alias("v")).orderBy("h", "i").limit(most).toArrow()
    lists = got.column("v").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def of_vectors(v: pa.Array, values: Callable[[np.ndarray], pa.Array], kind: pa.DataType) -> pa.Array:
    """What ``values`` gives for the matrix of a column of vectors; rows without a vector get null."""
    some = v.drop_null()
    if not len(some):
        return pa.nulls(len(v), kind)
    got = values(_matrix(some))
    there = v.is_valid().to_numpy(zero_copy_only=False)
    return got if there.all() else got.take(pa.array(np.cumsum(there) - 1, mask=~there))


def encode_column(df: DataFrame, q: Quantizer, vector: str = "vector", out: str = "codes") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(q)

    def run(v: pa.Array) -> pa.Array:
        return of_vectors(v, lambda x: pa.array([r.tobytes() for r in held.value.encode(x)], pa.binary()), pa.binary())

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, "binary").asNondeterministic()(F.col(vector)))


def decode_column(df: DataFrame, q: Quantizer, codes: str = "codes", out: str = "vector", kind: str = "float") -> DataFrame:
    held, number = df.sparkSession.sparkContext.broadcast(q), {"float": np.float32, "double": np.float64}[kind]

    def run(c: pa.Array) -> pa.Array:
        rows = c.to_pylist()
        some = [np.frombuffer(r, np.uint8) for r in rows if r is not None]
        got = iter(held.value.decode(np.stack(some)).astype(number) if some else [])
        return pa.array([None if r is None else next(got) for r in rows], pa.list_(pa.from_numpy_dtype(number)))

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, f"array<{kind}>").asNondeterministic()(F.col(codes)))


def scored_codes(df: DataFrame, q: Quantizer, query, metric: str, codes: str = "codes") -> DataFrame:
    """``df`` with the distance of its codes to a query, from lookup tables."""
    held = df.sparkSession.sparkContext.broadcast((q, np.asarray(query, np.float64)))

    def run(c: pa.Array) -> pa.Array:
        q, query = held.value
        rows = c.to_pylist()
        some = [np.frombuffer(r, np.uint8) for r in rows if r is not None]
        got = iter(q.scores(np.stack(some), query, metric).tolist() if some else [])
        return pa.array([None if r is None else next(got) for r in rows], pa.float64())

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return df.withColumn("distance", F.arrow_udf(run, "double").asNondeterministic()(F.col(codes)))


def batch_codes_knn(df: DataFrame, q: Quantizer, queries: DataFrame, k: int, metric: str, id: str = "id", codes: str = "codes", **options) -> DataFrame:
    """(query_id, rank, id, distance) of the ``k`` nearest codes of each of ``queries`` (query_id, query).

    The score of a code is the distance of what it decodes to, so this is batch search over
    those vectors, in double; ties are broken by id.
    """
    rows = df.filter(F.col(codes).isNotNull()).select(id, codes)
    return batch_knn(decode_column(rows, q, codes, "vector", "double"), queries, k, metric, id=id, **options)
