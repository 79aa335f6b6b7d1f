"""Durable collections: Parquet segments, a mutation log and versioned manifests.

A commit writes its rows to ``log/<seq>-<token>`` and then publishes ``log/<seq>.json``;
only published entries are visible, so a batch is seen whole or not at all and a crash
leaves nothing to undo. A checkpoint folds the log into new segments and publishes the next
``manifest-<n>.json``. Two writers can't publish the same entry: the second is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..errors import ConfigError, LockConflict, StorageError
from ..types import RECORD
from .files import Files

LOG = T.StructType([T.StructField("collection", T.StringType(), False), T.StructField("op", T.StringType(), False), T.StructField("at", T.LongType(), False), *[T.StructField(f.name, f.dataType, True) for f in RECORD.fields]])


@dataclass
class Manifest:
    number: int
    config: Config
    log_from: int = 0
    collections: dict[str, dict] = field(default_factory=dict)
    embedder: dict | None = None

    def dumps(self) -> str:
        return json.dumps({"config": self.config.as_dict(), "log_from": self.log_from, "collections": self.collections, "embedder": self.embedder}, indent=1)

    @classmethod
    def loads(cls, number: int, text: str) -> Manifest:
        try:
            d = json.loads(text)
            return cls(number, Config.from_dict(d["config"]), d["log_from"], d["collections"], d.get("embedder"))
        except (KeyError, TypeError, ValueError, ConfigError) as e:
            raise StorageError(f"manifest {number} is damaged: {e}") from e


class Store:
    """Tables and manifests under a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._entries: dict[int, dict] = {}

    def manifest(self) -> Manifest | None:
        """The newest manifest, None if there is no database here yet."""
        numbers = [int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")]
        return Manifest.loads(max(numbers), self.files.read(f"manifest-{max(numbers):012d}.json")) if numbers else None

    def publish(self, m: Manifest) -> Manifest:
        m = Manifest(m.number + 1, m.config, m.log_from, m.collections, m.embedder)
        self.files.publish(f"manifest-{m.number:012d}.json", m.dumps())
        return m

    def entries(self, m: Manifest) -> list[tuple[int, dict]]:
        """Published log entries that the manifest's segments don't have yet."""
        numbers = sorted(int(n[:-5]) for n in self.files.names("log") if n.endswith(".json"))
        self._entries = {n: self._entries.get(n) or json.loads(self.files.read(f"log/{n:012d}.json")) for n in numbers if n >= m.log_from}
        return list(self._entries.items())

    def commit(self, m: Manifest, rows: DataFrame, collections: list[str], expected: int | None = None) -> int:
        """Append log rows (the schema LOG, without caring for ``at``'s start) and publish them."""
        known = self.entries(m)
        seq = known[-1][0] + 1 if known else m.log_from
        if expected is not None and seq != expected:
            raise LockConflict("another writer has committed")
        folder = f"log/{seq:012d}-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in LOG.fields]).write.parquet(f"{self.root}/{folder}")
        self.files.publish(f"log/{seq:012d}.json", json.dumps({"folder": folder, "collections": sorted(collections)}))
        return seq

    def log(self, m: Manifest) -> DataFrame | None:
        """All pending mutations, with the sequence number of their commit; one scan, however many commits."""
        folders = [e["folder"] for _, e in self.entries(m)]
        return read_commits(self.spark, self.root, folders) if folders else None

    def pending(self, m: Manifest, collection: str) -> int:
        """How many published commits that no segment has yet touch a collection."""
        return sum(collection in e["collections"] for _, e in self.entries(m))

    def records(self, m: Manifest, collection: str, log: DataFrame | None = None) -> DataFrame:
        """Live records of a collection: its segment with the log's latest mutations over it."""
        info = m.collections.get(collection, {})
        base = self.spark.read.schema(RECORD).parquet(f"{self.root}/{info['segment']}") if info.get("segment") else self.spark.createDataFrame([], RECORD)
        log = self.log(m) if log is None else log
        if log is None or not any(collection in e["collections"] for _, e in self.entries(m)):
            return base
        newest = latest(log.filter(F.col("collection") == collection), ["id"], ["seq", "at"])
        placed = newest.filter("op = 'place'").select(*[f.name for f in RECORD.fields])
        return base.join(newest.select("id"), "id", "left_anti").select(*[f.name for f in RECORD.fields]).unionByName(placed)

    def collections(self, m: Manifest) -> list[str]:
        return sorted({*m.collections, *(c for _, e in self.entries(m) for c in e["collections"])})

    def checkpoint(self, m: Manifest, rewrite: dict[str, tuple[DataFrame, dict]] | None = None) -> Manifest:
        """Fold the log into new segments. ``rewrite`` has other rows and info for some collections."""
        entries = self.entries(m)
        upto = entries[-1][0] + 1 if entries else m.log_from
        touched = {c for _, e in entries for c in e["collections"]} | set(rewrite or {})
        infos = {c: dict(i) for c, i in m.collections.items()}
        log = self.log(m)
        for c in sorted(touched):
            rows, extra = (rewrite or {}).get(c, (None, {}))
            rows = self.records(m, c, log) if rows is None else rows
            segment = f"segments/{c}-{m.number + 1:012d}-{uuid.uuid4().hex[:8]}"
            by_list = bool(extra.get("lists") or infos.get(c, {}).get("lists"))
            writer = (rows.repartition("list_id") if by_list else rows).write
            (writer.partitionBy("list_id") if by_list else writer).parquet(f"{self.root}/{segment}")
            n = self.spark.read.schema(RECORD).parquet(f"{self.root}/{segment}").count()
            infos[c] = {**infos.get(c, {}), **extra, "segment": segment, "rows": n}
        out = self.publish(Manifest(m.number, m.config, upto, infos, m.embedder))
        return out

    def sweep(self, m: Manifest) -> int:
        """Delete what no manifest from this one on refers to: older manifests, segments and log entries."""
        keep = {i["segment"].split("/")[1] for i in m.collections.values() if i.get("segment")}
        gone = [f"segments/{n}" for n in self.files.names("segments") if n not in keep]
        gone += [f"log/{n}" for n in self.files.names("log") if int(n[:12]) < m.log_from]
        gone += [n for n in self.files.names() if n.startswith("manifest-") and int(n[9:-5]) < m.number]
        for n in gone:
            self.files.delete(n)
        return len(gone)


def read_commits(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Log rows of published commits, with the sequence number that the folder's name has."""
    rows = spark.read.schema(LOG).parquet(*[f"{root}/{f}" for f in folders])
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/log/(\d+)-", 1).cast("long").alias("seq"))


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by these columns."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no tombstone."""
    return rows.join(gone, key, "left_anti")
