"""Indexes with one contract: insert, remove, search, size, vacuum, rebuild, save and load.

Rows are DataFrames of ``id`` and ``vector`` (and what else filters need). Removed ids are
kept apart until a vacuum, which a removal starts by itself at the compaction ratio; lists
are trained again when the rows have grown by ``GROWTH``. What a vacuum or a rebuild makes
is written to the folder that the index is given, so plans stay short.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, GraphParams
from ..errors import ConfigError, StorageError
from ..sources.files import Files
from . import ivf, search
from .filters import Filter

GROWTH = 2


class ExactIndex:
    """Every live row is scored."""

    type_name = "exact"

    def __init__(self, spark: SparkSession, folder: str, dimension: int, metric: str, graph: GraphParams | None = None):
        self.spark, self.folder, self.dimension, self.metric = spark, folder.rstrip("/"), dimension, metric
        self.graph = graph or GraphParams()
        self.rows: DataFrame | None = None
        self.gone: DataFrame | None = None
        self._held, self._removed = 0, 0

    def size(self) -> int:
        return self._held - self._removed

    def tombstone_ratio(self) -> float:
        return self._removed / max(1, self._held)

    def live(self) -> DataFrame:
        if self.rows is None:
            raise ConfigError("the index has no rows yet")
        return self.rows if self.gone is None else self.rows.join(self.gone, "id", "left_anti")

    def insert(self, df: DataFrame) -> None:
        """Add rows; one with an id that is there already takes its place."""
        wrong = df.filter(F.col("vector").isNull() | (F.size("vector") != self.dimension)).limit(1).count()
        if wrong:
            raise ConfigError(f"a vector has not {self.dimension} components")
        if self.rows is None:
            self._keep(df)
            return
        self._keep(self.live().join(df.select("id"), "id", "left_anti").unionByName(self._placed(df), allowMissingColumns=True))

    def _placed(self, df: DataFrame) -> DataFrame:
        return df

    def remove(self, ids: Sequence | DataFrame) -> int:
        """Mark rows as removed and say how many there were; a vacuum follows at the compaction ratio."""
        kind = self.rows.schema["id"].dataType.simpleString()
        given = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], f"id {kind}")
        found = self._written(self.live().join(given.select("id").distinct(), "id", "left_semi").select("id"), "gone")
        n = found.count()
        self.gone = found if self.gone is None else self.gone.unionByName(found)
        self._removed += n
        if n and self.tombstone_ratio() >= self.graph.compaction_ratio:
            self.vacuum()
        return n

    def search(self, query: Sequence[float], top: int, where: Filter | None = None) -> DataFrame:
        return search.exact_knn(self.live(), search.check_query(query, self.dimension, self.metric), top, self.metric, where)

    def search_batch(self, queries: DataFrame, top: int) -> DataFrame:
        """(query_id, rank, id, distance) of queries (query_id, query)."""
        return search.batch_knn(self.live(), queries, top, self.metric)

    def vacuum(self) -> None:
        """Drop removed rows for good."""
        if self.rows is not None:
            self._keep(self.live())

    def rebuild(self) -> None:
        self.vacuum()

    def _keep(self, rows: DataFrame) -> None:
        self.rows, self.gone = self._written(rows, "rows"), None
        self._held, self._removed = self.rows.count(), 0

    def _written(self, rows: DataFrame, what: str) -> DataFrame:
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _state(self) -> dict:
        return {}

    def save(self, path: str) -> None:
        """Write the live rows and the index's own data to a folder."""
        self.live().write.parquet(f"{path.rstrip('/')}/rows")
        about = {"type": self.type_name, "dimension": self.dimension, "metric": self.metric, "size": self.size(), **self._state()}
        Files(self.spark, path).publish("index.json", json.dumps(about))

    @classmethod
    def load(cls, spark: SparkSession, path: str, folder: str, graph: GraphParams | None = None) -> ExactIndex:
        """An index as ``save`` wrote it, of whichever type it was."""
        about = json.loads(Files(spark, path).read("index.json"))
        kind = {k.type_name: k for k in (ExactIndex, ListIndex)}.get(about["type"])
        if kind is None:
            raise StorageError(f"unknown index type {about['type']}")
        out = kind(spark, folder, about["dimension"], about["metric"], graph)
        out.rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
        out._held = out.rows.count()
        if out._held != about["size"]:
            raise StorageError(f"the index has {out._held} rows, not {about['size']}")
        out._restore(about)
        return out

    def _restore(self, about: dict) -> None:
        pass


class ListIndex(ExactIndex):
    """Rows lie in inverted lists; a search reads those nearest to the query, and more until it has enough."""

    type_name = "graph"

    def __init__(self, *args, **options):
        super().__init__(*args, **options)
        self.lists: ivf.Ivf | None = None
        self._trained = 0

    def insert(self, df: DataFrame) -> None:
        super().insert(df)
        if self.lists is None or self._held > GROWTH * self._trained:
            self.rebuild()

    def _placed(self, df: DataFrame) -> DataFrame:
        return ivf.assign(df, self.lists)

    def rebuild(self) -> None:
        """Train the lists on the live rows and lay them out."""
        rows = self.live().drop("list_id")
        self._trained = self.size()
        self.lists = ivf.train(rows, ivf.lists_for(self._trained), self.metric)
        self._keep(ivf.assign(rows, self.lists))

    def _probes(self) -> int:
        return ivf.probes_for(len(self.lists.centroids), self.graph.ef_search)

    def search(self, query: Sequence[float], top: int, where: Filter | None = None) -> DataFrame:
        q = search.check_query(query, self.dimension, self.metric)
        return ivf.search_filled(self.live(), self.lists, q, top, self._probes(), where=where)

    def search_batch(self, queries: DataFrame, top: int) -> DataFrame:
        return ivf.batch_search(self.live(), self.lists, queries, top, self._probes())

    def _state(self) -> dict:
        return {"lists": self.lists.centroids.tolist(), "trained": self._trained}

    def _restore(self, about: dict) -> None:
        self.lists, self._trained = ivf.Ivf(np.array(about["lists"]), self.metric), about["trained"]


def make_index(spark: SparkSession, folder: str, config: Config) -> ExactIndex:
    """The index that a configuration asks for."""
    kind = ListIndex if config.index == "graph" else ExactIndex
    return kind(spark, folder, config.dimension, config.metric, config.graph)
