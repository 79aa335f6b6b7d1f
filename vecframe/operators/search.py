"""Nearest-neighbour search over a DataFrame with a vector column.

One query: score, filter, order, limit, which Spark runs as a bounded top-k per partition
and a merge. A batch of queries: each partition keeps its own best k per query with blocked
matrix products, and a window over those picks the rest; query sets too large to hold in a
task are cut into blocks, and every block of queries meets every block of rows in a task of
its own. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DimensionMismatch, InvalidVector
from ..functions import text as text_functions
from ..functions import vectors as V
from .filters import ColumnBinding, Filter, MetaBinding

#: Largest query matrix, in values, that every task holds; beyond it queries go in blocks.
HELD_VALUES = 4 << 20
#: Values of a block of rows or of queries.
BLOCK_VALUES = 2 << 20
#: Rows of a block, and distances that a task computes at once.
HELD_ROWS = 32_768
HELD_CELLS = 1 << 22
#: Hybrid search ranks so many times the results that are asked for.
OVERFETCH = 5


def check_query(query: Sequence[float], dimension: int, metric: str) -> list[float]:
    """A query vector, validated and, for cosine, normalised."""
    q = [float(x) for x in query]
    if dimension and len(q) != dimension:
        raise DimensionMismatch(f"expected {dimension} components, got {len(q)}")
    if not np.isfinite(q).all():
        raise InvalidVector("a query component is not finite")
    return V.normalized(q) if metric == "cosine" else q


def binding_of(df: DataFrame, binding: MetaBinding | ColumnBinding | None = None) -> MetaBinding | ColumnBinding:
    if binding is not None:
        return binding
    kind = df.schema["meta"].dataType if "meta" in df.columns else None
    return MetaBinding() if isinstance(kind, T.MapType) else ColumnBinding(df.schema)


def matching(df: DataFrame, where: Filter | None, binding: MetaBinding | ColumnBinding | None = None) -> DataFrame:
    return df if where is None or where.matches_all() else df.filter(where.column(binding_of(df, binding)))


def scored(df: DataFrame, query: Sequence[float], metric: str, vector: str = "vector", normalize: bool = False) -> DataFrame:
    """``df`` with its distance to a query; ``normalize`` for cosine over vectors that aren't of unit length."""
    v = F.col(vector)
    if normalize and metric == "cosine":
        n = V.magnitude(v)
        return df.withColumn("distance", 1.0 - F.when(n == 0, F.lit(0.0)).otherwise(V.dot(v, list(query)) / n))
    return df.withColumn("distance", V.distance(metric, v, list(query)))


def exact_knn(df: DataFrame, query: Sequence[float], top: int | None, metric: str = "cosine", where: Filter | None = None, threshold: float | None = None, vector: str = "vector", id: str = "id", binding=None, normalize: bool = False) -> DataFrame:
    """The ``top`` rows nearest to the query, with ``distance``; a threshold is inclusive.

    Rows without a vector are never found. ``top`` None gives all rows, in order.
    """
    if top == 0:
        return scored(df, query, metric, vector, normalize).limit(0)
    rows = scored(matching(df.filter(F.col(vector).isNotNull()), where, binding), query, metric, vector, normalize)
    if threshold is not None:
        rows = rows.filter(F.col("distance") <= threshold)
    rows = rows.orderBy("distance", id)
    return rows if top is None else rows.limit(top)


def range_search(df: DataFrame, query: Sequence[float], threshold: float, top: int | None = None, **options) -> DataFrame:
    """All rows within the threshold, nearest first; at most ``top`` if it is given."""
    return exact_knn(df, query, top, threshold=threshold, **options)


def _near(v: np.ndarray, q: np.ndarray, metric: str, k: int, seen: np.ndarray | None = None) -> np.ndarray:
    """Which of rows ``q`` may be among the ``k`` nearest of each of ``v``: all that are, and few others. ``seen`` says which rows each may find.

    Distances by matrix products round; the bound on that rounding is allowed for. For
    euclidean distances the vectors are centred first, so that it is small where they are.
    """
    if len(q) <= k or not len(v):
        return np.ones((len(v), len(q)), bool) if seen is None else seen
    plain, sound = np.isfinite(v).all(1), np.isfinite(q).all(1)
    if not (plain.all() and sound.all()):  # what has NaN or infinite components is left to exact distances
        near, both = np.ones((len(v), len(q)), bool), np.ix_(plain, sound)
        near[both] = _near(v[plain], q[sound], metric, k, None if seen is None else seen[both])
        return near if seen is None else near & seen
    eps = np.finfo(np.float64).eps
    if metric != "euclidean":
        d = -(v @ q.T)
        if seen is not None:
            d[~seen] = np.inf
        slack = 4 * v.shape[1] * eps * np.linalg.norm(v, axis=1) * np.linalg.norm(q, axis=1).max()
        near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * slack[:, None]
        return near if seen is None else near & seen
    centre = q.mean(0)
    shift = 4 * eps * v.shape[1] ** 0.5 * max(np.abs(v).max(), np.abs(q).max())
    v, q = v - centre, q - centre
    vv, qq = (v * v).sum(1), (q * q).sum(1)
    d = vv[:, None] + qq[None, :] - 2 * (v @ q.T)
    if seen is not None:
        d[~seen] = np.inf
    slack = 8 * (v.shape[1] + 2) * eps * (vv + qq.max())[:, None]
    most = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack, 0)) + shift
    near = d - slack <= most * most
    return near if seen is None else near & seen


def _block(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of (rows, queries) in double, by matrix products."""
    if metric == "euclidean":
        d = (v * v).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (v @ q.T)
        return np.sqrt(np.maximum(d, 0))
    d = v @ q.T
    return 1.0 - d if metric == "cosine" else -d


def _exact(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, by differences where that is more exact."""
    if metric == "euclidean":
        return np.sqrt(((v - q) ** 2).sum(1))
    d = (v * q).sum(1)
    return 1.0 - d if metric == "cosine" else -d


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def batch_knn(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Filter | None = None, vector: str = "vector", id: str = "id", query_id: str = "query_id", query_vector: str = "query", binding=None, held_values: int = HELD_VALUES) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest rows of each query.

    Vectors and queries are compared as they are; normalise both for cosine. Queries are
    held by every task if they have at most ``held_values`` values, else they go in blocks;
    both ways give the same rows.
    """
    rows = matching(df.filter(F.col(vector).isNotNull()), where, binding).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")).filter(F.col("q").isNotNull())
    return best(rows, q, k, metric, held_values)


def best(rows: DataFrame, q: DataFrame, k: int, metric: str, held_values: int, probed: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The ``k`` nearest rows (id, v) of each query (query_id, q); with ``probed``, those of the lists that it gives for a matrix of queries, rows being (id, v, list)."""
    n, width = q.agg(F.count("*"), F.max(F.size("q"))).first()
    out = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    near = _met(rows, q, n * (width or 0), held_values, out, lambda ids, m, batch: _best_of(ids, m, batch, k, metric, None if probed is None else probed(m)))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _met(rows: DataFrame, q: DataFrame, values: int, held: int, out: T.StructType, meet) -> DataFrame:
    """What ``meet`` (ids of queries, their matrix, a batch of rows) yields where all queries meet all rows (id, v, what else it needs).

    Queries of at most ``held`` values are held by every task, and rows stay where they
    are. Else rows and queries are dealt to blocks by a hash of their ids, and each pair of
    blocks is a task: a block of rows is sent once for each block of queries.
    """
    if values <= held:
        got = q.orderBy(q.columns[0]).collect()
        matrix = np.array([r[1] for r in got], np.float64).reshape(len(got), -1) if got else np.zeros((0, 0))
        sent = rows.sparkSession.sparkContext.broadcast(([r[0] for r in got], matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, HELD_ROWS):
                    yield from meet(ids, m, batch.slice(at, HELD_ROWS))

        return rows.mapInArrow(run, out)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    of_rows, of_queries = (max(1, -(-x // BLOCK_VALUES)) for x in (n * (width or 0), values))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(block("id", of_rows).alias("rb"), every(of_queries).alias("qb"), *rows.columns)
    right = q.select(every(of_rows).alias("rb"), block(q.columns[0], of_queries).alias("qb"), *q.columns)

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, m = asked.column(2).to_pylist(), _matrix(asked.column(3).combine_chunks()) if asked.num_rows else None
        parts = [b for batch in rows.select(range(2, rows.num_columns)).combine_chunks().to_batches(HELD_ROWS) for b in meet(ids, m, batch)] if ids else []
        return pa.Table.from_batches(parts) if parts else to_arrow_schema(out).empty_table()

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(cell, out)


def _best_of(ids: list, q: np.ndarray, part: pa.RecordBatch, k: int, metric: str, probed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Of a batch of rows, the ``k`` nearest of each query and what ties with the last of them; queries go in blocks too, so memory doesn't grow with them.

    With ``probed`` (queries, lists), a query finds the rows of its lists alone, and the third column has the list of each row.
    """
    v = _matrix(part.column(1))
    lists = None if probed is None else part.column(2).to_numpy()
    step = max(1, HELD_CELLS // max(1, len(v)))
    for first in range(0, len(ids) if len(v) else 0, step):
        some = q[first : first + step]
        # all that may tie with the k-th stay, so that ids can break the tie
        near = _near(some, v, metric, k, None if probed is None else probed[first : first + step][:, lists])
        for j in np.flatnonzero(near.sum(1) > 8 * k):
            rows = np.flatnonzero(near[j])
            dist = _exact(v[rows], some[j], metric)
            last = np.partition(dist, k - 1)[k - 1]
            close = rows[(dist <= last) | np.isnan(last)]
            if len(close) > 8 * k:
                keys = part.column(0).take(pa.array(close)).to_pylist()
                dist = _exact(v[close], some[j], metric)
                close = close[sorted(range(len(close)), key=lambda i: (np.isnan(dist[i]), np.nan_to_num(dist[i]), keys[i]))[:k]]
            near[j] = False
            near[j, close] = True
        of, rows = np.divmod(np.flatnonzero(near), len(v))
        yield pa.RecordBatch.from_arrays([pa.array([ids[first + j] for j in of.tolist()]), part.column(0).take(pa.array(rows)), pa.array(_exact(v[rows], some[of], metric))], names=["query_id", "id", "distance"])


def _all_of(ids: list, q: np.ndarray, part: pa.RecordBatch, metric: str) -> Iterator[pa.RecordBatch]:
    """The distance of every query to every row of a batch, by blocks of ``HELD_CELLS`` pairs.

    The pairs of a block come by their distance: rounded distances that are equal lie
    together, and the files that they are written to are smaller by half.
    """
    v = _matrix(part.column(1))
    step = max(1, HELD_CELLS // max(1, len(v)))
    for first in range(0, len(ids) if len(v) else 0, step):
        some, names = q[first : first + step], pa.array(ids[first : first + step])
        d = np.concatenate([_exact(v, x, metric) for x in some])
        order = np.argsort(d)
        for at in range(0, len(d), HELD_ROWS):
            pairs = order[at : at + HELD_ROWS]
            of, rows = np.divmod(pairs, len(v))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), part.column(0).take(pa.array(rows)), pa.array(d[pairs])], names=["a_id", "b_id", "distance"])


def distance_matrix(a: DataFrame, b: DataFrame, metric: str, a_id: str = "id", b_id: str = "id", a_vector: str = "vector", b_vector: str = "vector", held_values: int = HELD_VALUES) -> DataFrame:
    """(a_id, b_id, distance) of every row of ``a``, which are taken as queries, to every row of ``b``; rows without a vector are in no pair."""
    left = a.select(F.col(a_id).alias("a_id"), F.col(a_vector).cast("array<double>").alias("q")).filter(F.col("q").isNotNull())
    right = b.select(F.col(b_id).alias("id"), F.col(b_vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    n, width = left.agg(F.count("*"), F.max(F.size("q"))).first()
    out = T.StructType([T.StructField("a_id", left.schema["a_id"].dataType), T.StructField("b_id", right.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    return _met(right, left, n * (width or 0), held_values, out, lambda ids, m, batch: _all_of(ids, m, batch, metric))


def row_top_k(a: DataFrame, b: DataFrame, k: int, metric: str, a_id: str = "id", b_id: str = "id", a_vector: str = "vector", b_vector: str = "vector", held_values: int = HELD_VALUES) -> DataFrame:
    """(a_id, rank, b_id, distance): the ``k`` least distances of each row of the matrix of ``a`` and ``b``, which is never made as a whole."""
    queries = a.select(F.col(a_id).alias("query_id"), F.col(a_vector).alias("query"))
    return batch_knn(b, queries, k, metric, vector=b_vector, id=b_id, held_values=held_values).select(F.col("query_id").alias("a_id"), "rank", F.col("id").alias("b_id"), "distance")


def hybrid(df: DataFrame, query: Sequence[float], text: str, weight: float, top: int, metric: str = "cosine", where: Filter | None = None, threshold: float | None = None, document: Column | None = None, vector: str = "vector", id: str = "id", binding=None, normalize: bool = False) -> DataFrame:
    """Vector search for ``OVERFETCH * top`` rows, then ``(1 - w) * distance + w * (1 - lexical overlap)``.

    The weight is clamped to 0 to 1. Without text or weight this is vector search. A
    threshold holds for the vector distance. Rows without a document have no overlap.
    """
    w = min(1.0, max(0.0, weight))
    near = exact_knn(df, query, top if not text or not w else OVERFETCH * top, metric, where, threshold, vector, id, binding, normalize)
    return near if not text or not w else fused(near, text, w, top, document, id)


def fused(near: DataFrame, text: str, w: float, top: int, document: Column | None = None, id: str = "id") -> DataFrame:
    doc = document if document is not None else F.col("document.text")
    lexical = F.coalesce(text_functions.lexical_overlap(F.lit(text), doc), F.lit(0.0))
    return near.withColumn("distance", (1.0 - w) * F.col("distance") + w * (1.0 - lexical)).orderBy("distance", id).limit(top)


def rank_by(hits: DataFrame, value: Column, kind: Column | None = None, id: str = "id") -> DataFrame:
    """Hits sorted again by a metadata value, missing ones last, then by distance and id.

    ``kind`` ranks values of kinds that don't compare: numbers, bools, strings.
    """
    first = [kind.asc_nulls_last()] if kind is not None else []
    return hits.orderBy(*first, value.asc_nulls_last(), F.col("distance"), F.col(id))


def meta_rank(field: str, column: str = "meta") -> list[Column]:
    """Sort columns of a field of the metadata map: missing last, numbers by value, then bools, then strings."""
    v = F.try_element_at(F.col(column), F.lit(field))
    kind = F.when(v["k"] <= 1, 0).when(v["k"] == 2, 1).when(v["k"] == 3, 2)
    number = F.coalesce(v["d"], v["i"].cast("double"))
    return [kind.asc_nulls_last(), number.asc_nulls_last(), v["i"].asc_nulls_last(), v["b"].asc_nulls_last(), v["s"].asc_nulls_last()]


def project(hits: DataFrame, fields: Sequence[str], column: str = "meta") -> DataFrame:
    """Hits with their metadata cut to these fields; names that a record lacks are dropped."""
    return hits.withColumn(column, F.map_filter(column, lambda k, v: k.isin(list(fields)))) if fields else hits


def scan(df: DataFrame, where: Filter | None = None, offset: int = 0, limit: int | None = None, id: str = "id", binding=None) -> DataFrame:
    """Matching rows in order of their ids, from ``offset`` on."""
    rows = matching(df, where, binding).orderBy(id)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def fetch(df: DataFrame, key, id: str = "id") -> DataFrame:
    return df.filter(F.col(id) == F.lit(key))


def pull(df: DataFrame, keys: Sequence, id: str = "id") -> DataFrame:
    """Rows of these keys in their order: missing ones are skipped, repeated ones repeated."""
    wanted = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], T.StructType([T.StructField("_at", T.LongType()), T.StructField("_key", df.schema[id].dataType)]))
    wanted = F.broadcast(wanted) if len(keys) <= 100_000 else wanted
    return df.join(wanted, F.col(id) == F.col("_key")).orderBy("_at").drop("_at", "_key")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the true ``k`` of each query that were found: one row, ``recall``."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.least(F.count("*"), F.lit(k))).alias("r")).agg(F.avg("r").alias("recall"))
