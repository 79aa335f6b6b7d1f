"""Approximate search on inverted lists: rows are laid out by their nearest centroid.

A query reads only the lists whose centroids are nearest to it, which is partition pruning
when the table is written with ``list_id`` as its partition column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import quantize
from .filters import Filter
from .search import HELD_CELLS, HELD_VALUES, _block, _matrix, best, matching

#: Centroids are fitted on at most so many rows, those with the least hash of their id; every row is indexed.
TRAIN_ROWS = 100_000


@dataclass
class Ivf:
    """Centroids of the lists, under a metric."""

    centroids: np.ndarray
    metric: str

    def order(self, query: Sequence[float]) -> np.ndarray:
        """List numbers by the distance of their centroids to the query."""
        return np.argsort(_block(self.centroids, np.asarray([query], np.float64), self.metric)[:, 0], kind="stable")

    def probed(self, queries: np.ndarray, nprobe: int) -> np.ndarray:
        """Which lists (queries, lists) are among the ``nprobe`` nearest to each query."""
        out, step = np.zeros((len(queries), len(self.centroids)), bool), max(1, HELD_CELLS // len(self.centroids))
        for i in range(0, len(queries), step):
            near = np.argsort(_block(queries[i : i + step], self.centroids, self.metric), 1, kind="stable")[:, :nprobe]
            np.put_along_axis(out[i : i + step], near, True, 1)
        return out


def lists_for(n: int) -> int:
    """Lists of a table of ``n`` rows: its root, and at most so many that each has 40 training rows."""
    return max(1, min(int(round(n**0.5)), TRAIN_ROWS // 40))


def probes_for(lists: int, ef_search: int = 50) -> int:
    """How many lists are read at first: four fifths of them at the default ``ef_search``, 65 % at least.

    Vectors without clusters have their neighbours in many lists: over sf0.1's, a quarter of
    the lists gives a recall@10 of 0.71, four fifths give 0.98.
    """
    return min(lists, max(1, -(-lists * (650 + 3 * ef_search) // 1000)))


def train(df: DataFrame, lists: int, metric: str, vector: str = "vector", id: str = "id", iterations: int = 20, rows: int = TRAIN_ROWS) -> Ivf:
    """Centroids from at most ``rows`` rows, spherical for cosine."""
    return fitted(quantize.sample_matrix(df.filter(F.col(vector).isNotNull()), vector, id, rows), lists, metric, iterations)


def fitted(x: np.ndarray, lists: int, metric: str, iterations: int = 20) -> Ivf:
    """Centroids from the rows of ``x``."""
    return Ivf(quantize.kmeans(x, min(lists, len(x)), iterations, metric == "cosine"), metric)


def assign(df: DataFrame, index: Ivf, vector: str = "vector", out: str = "list_id") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(v: pa.Array) -> pa.Array:
        return quantize.of_vectors(v, lambda x: pa.array(nearest_lists(x, held.value), pa.int32()), pa.int32())

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, "int").asNondeterministic()(F.col(vector)))


def nearest_lists(x: np.ndarray, index: Ivf) -> np.ndarray:
    """The list of each row, by tiles of rows, so that memory stays with many lists."""
    step = max(1, (1 << 22) // len(index.centroids))
    return np.concatenate([_block(x[i : i + step], index.centroids, index.metric).argmin(1) for i in range(0, len(x), step)])


def write_lists(df: DataFrame, path: str, list_id: str = "list_id") -> None:
    """One directory per list; rows of a list come together first, so files are few."""
    df.repartition(list_id).write.partitionBy(list_id).mode("overwrite").parquet(path)


def search(df: DataFrame, index: Ivf, query: Sequence[float], top: int, nprobe: int, where: Filter | None = None, vector: str = "vector", id: str = "id", list_id: str = "list_id", binding=None) -> DataFrame:
    """The nearest rows in the ``nprobe`` nearest lists."""
    chosen = [int(i) for i in index.order(query)[:nprobe]]
    rows = matching(df.filter(F.col(list_id).isin(chosen)), where, binding)
    return rows.withColumn("distance", V.distance(index.metric, F.col(vector), list(query))).orderBy("distance", id).limit(top)


def search_filled(df: DataFrame, index: Ivf, query: Sequence[float], top: int, nprobe: int, **options) -> DataFrame:
    """``search``, with four times the lists until ``top`` rows are found or all lists are read.

    Every try runs once; the one that found enough is returned as it was collected.
    """
    lists = len(index.centroids)
    while nprobe < lists:
        hits = search(df, index, query, top, nprobe, **options)
        rows = hits.collect()
        if len(rows) >= top:
            return df.sparkSession.createDataFrame(rows, hits.schema)
        nprobe *= 4
    return search(df, index, query, top, lists, **options)


def batch_search(df: DataFrame, index: Ivf, queries: DataFrame, k: int, nprobe: int, vector: str = "vector", id: str = "id", list_id: str = "list_id", query_id: str = "query_id", query_vector: str = "query", held_values: int = HELD_VALUES) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest rows of each query in the ``nprobe`` lists nearest to it.

    Rows stay where they are and meet the queries in blocks, as in ``search.batch_knn``; of a
    block, each query sees the rows of its lists. No pair leaves its task unless it is among
    the ``k`` best of its block.
    """
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(list_id).alias("list")).filter(F.col("v").isNotNull() & F.col("list").isNotNull())
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")).filter(F.col("q").isNotNull())
    if nprobe >= len(index.centroids):
        return best(rows.drop("list"), q, k, index.metric, held_values)
    held, last = df.sparkSession.sparkContext.broadcast(index), []

    def probed(m: np.ndarray) -> np.ndarray:
        """The lists of each query; those of the queries that a task holds are found once."""
        if not last or last[0] is not m:
            last[:] = m, held.value.probed(m, nprobe)
        return last[1]

    return best(rows, q, k, index.metric, held_values, probed)


@dataclass
class IvfPq:
    """Lists and a product quantizer of the residuals to their centroids."""

    ivf: Ivf
    codec: quantize.Quantizer


def train_pq(df: DataFrame, lists: int, metric: str, params, vector: str = "vector", id: str = "id") -> IvfPq:
    index = train(df, lists, metric, vector, id)
    x = quantize.sample_matrix(df.filter(F.col(vector).isNotNull()), vector, id, params.train_rows)
    return IvfPq(index, quantize.train(x - index.centroids[nearest_lists(x, index)], params, df.sparkSession.sparkContext))


def encode_pq(df: DataFrame, index: IvfPq, vector: str = "vector") -> DataFrame:
    """``df`` with ``list_id`` and ``codes`` of the residuals."""
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(v: pa.Array) -> pa.Array:
        x = _matrix(v)
        c = held.value.ivf.centroids
        if not len(x):
            return pa.array([], pa.struct([("l", pa.int32()), ("c", pa.binary())]))
        at = nearest_lists(x, held.value.ivf)
        codes = held.value.codec.encode(x - c[at])
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary())], names=["l", "c"])

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    out = df.filter(F.col(vector).isNotNull()).withColumn("_lc", F.arrow_udf(run, "l int, c binary").asNondeterministic()(F.col(vector)))
    return out.withColumns({"list_id": F.col("_lc.l"), "codes": F.col("_lc.c")}).drop("_lc")


def search_pq(df: DataFrame, index: IvfPq, query: Sequence[float], top: int, nprobe: int, vector: str = "vector", id: str = "id", over: int = 4) -> DataFrame:
    """Rank codes in the probed lists, then score the best ``over * top`` by their vectors."""
    metric = index.ivf.metric
    chosen = [int(i) for i in index.ivf.order(query)[:nprobe]]
    held = df.sparkSession.sparkContext.broadcast((index, np.asarray(query, np.float64)))

    def rough(lists: pa.Array, codes: pa.Array) -> pa.Array:
        ix, q = held.value
        if not len(lists):
            return pa.array([], pa.float64())
        at = lists.to_numpy(zero_copy_only=False)
        x = ix.ivf.centroids[at] + ix.codec.decode(np.stack([np.frombuffer(c, np.uint8) for c in codes.to_pylist()]))
        return pa.array(_block(x, q[None, :], ix.ivf.metric)[:, 0])

    rough.__annotations__ = {"lists": pa.Array, "codes": pa.Array, "return": pa.Array}
    near = df.filter(F.col("list_id").isin(chosen)).withColumn("_rough", F.arrow_udf(rough, "double").asNondeterministic()(F.col("list_id"), F.col("codes"))).orderBy("_rough", id).limit(over * top).drop("_rough")
    return near.withColumn("distance", V.distance(metric, F.col(vector), list(query))).orderBy("distance", id).limit(top)
