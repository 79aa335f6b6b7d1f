"""Databases and collections: the public interface.

Reads give lazy DataFrames. Writes are commits; ``transaction`` gathers several into one.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Config, QuantParams, requires_normalization
from .errors import ConfigError, DimensionMismatch, InvalidVector, LockConflict, NotFound, StorageError
from .functions import vectors as V
from .functions.ids import generate_id, id_column, id_of, new_ids
from .functions.text import HashEmbedder, embed_column
from .operators import ivf, quantize, search
from .operators.filters import Filter, MetaBinding
from .plans import query_language as ql
from .plans.planner import QueryPlan, plan_seek
from .sources import jsonl
from .sources.files import Files
from .sources.store import LOG, Manifest, Store
from .types import META, RECORD, MetaValue, meta_row

EMBEDDER = "embedder.json"
SNAPSHOT = "vecframe-snapshot"
#: Inverted lists are trained again when a collection has grown by this factor.
GROWTH = 2
#: After so many commits the log is folded into segments by itself.
PENDING_COMMITS = 64
_writers: set[str] = set()
HIT = [f.name for f in RECORD.fields if f.name not in ("vector", "codes", "list_id")]


@dataclass(frozen=True)
class CollectionInfo:
    name: str
    count: int
    dimension: int
    metric: str
    codec: str
    code_bytes: int


@dataclass(frozen=True)
class CollectionHealth:
    count: int
    tombstones: int
    tombstone_ratio: float
    codec: str
    compression_ratio: float
    read_only: bool
    sealed: bool


def connect(path: str, *, spark: SparkSession | None = None, dimension: int = 0, metric: str = "cosine", index: str = "graph", access_mode: str = "read_write", embedder=None, embedder_provider: str = "python", embedder_model: str = "callable", embedder_revision: str = "", use_default_text_embedder: bool = True, quantization: QuantParams | str | None = None, metadata_acceleration: bool = True, segmented_storage: bool = True, durability: str = "standard") -> Engine:
    """Open a database at a path, or a temporary one at ``":memory:"``."""
    q = QuantParams(quantization) if isinstance(quantization, str) else quantization or QuantParams()
    config = Config(dimension, metric, index, quantization=q, access_mode=access_mode, metadata_acceleration=metadata_acceleration, segmented_storage=segmented_storage, auto_text_embedder=use_default_text_embedder, durability=durability)
    lineage = {"provider": embedder_provider, "model": embedder_model, "revision": embedder_revision}
    return Engine(spark or SparkSession.active(), path, config, embedder, lineage)


class Engine:
    """An open database."""

    def __init__(self, spark: SparkSession, path: str, config: Config, embedder=None, lineage: dict | None = None):
        self.spark, self.temporary = spark, path == ":memory:"
        if self.temporary:
            path = f"{_scratch(spark)}/memory-{uuid.uuid4().hex}"
            atexit.register(_delete, spark, path)
        self.path, self.closed, self._frozen = path, False, set()
        self.store = Store(spark, path)
        found = self.store.manifest()
        if found is None:
            if config.access_mode == "read_only":
                raise StorageError(f"no database at {path}")
            if not config.dimension:
                raise ConfigError("a new database needs a dimension")
            local = embedder is None and config.auto_text_embedder
            model = HashEmbedder(config.dimension).identity if local else {**lineage} if embedder is not None and lineage else None
            if local:
                self.store.files.publish(EMBEDDER, json.dumps(HashEmbedder(config.dimension).artifact()))
            found = self.store.publish(Manifest(0, replace(config, access_mode="read_write"), embedder=model))
        elif config.dimension and config.dimension != found.config.dimension:
            raise ConfigError(f"the database has dimension {found.config.dimension}")
        elif embedder is not None and found.embedder and lineage and found.embedder != lineage:
            raise ConfigError(f"the database was made with the text embedder {found.embedder}")
        self.manifest, self.read_only = found, config.access_mode == "read_only"
        self.config = replace(found.config, access_mode=config.access_mode)
        self._embedder, self._local, self._lineage = embedder, None, found.embedder
        self._held = None
        if not self.read_only:
            self._held = None if path in _writers else self.store.files.lock()
            if self._held is None:
                raise LockConflict(f"{path} is open for writing")
            _writers.add(path)

    @property
    def persistent(self) -> bool:
        return not self.temporary

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def collection(self, name: str) -> Collection:
        if not name or not name.replace("_", "").replace("-", "").replace(".", "").isalnum():
            raise ConfigError(f"{name!r} is no collection name")
        return Collection(self, name)

    def collection_names(self) -> list[str]:
        return self.store.collections(self.manifest)

    def embedder(self):
        """The text embedder: the one that was given, or the database's own, loaded at first use."""
        if self._embedder is not None:
            return self._embedder
        if self._local is None:
            self._local = self._loaded()
        return self._local

    def embedder_loaded(self) -> bool:
        return self._embedder is not None or self._local is not None

    def unload_embedder(self) -> None:
        """Let go of the database's own embedder; the next use loads and checks it again."""
        self._local = None

    def _loaded(self) -> HashEmbedder:
        if self._lineage and self._lineage.get("provider") == "local":
            made = HashEmbedder.from_artifact(json.loads(self.store.files.read(EMBEDDER)))
            if made.dimension != self.config.dimension or made.identity != self._lineage:
                raise ConfigError("the embedder's file is of another database")
            return made
        raise ConfigError("this database has no text embedder")

    def describe_embedder(self) -> dict:
        e = self.embedder()
        return {**(self._lineage or {}), "dimension": self.config.dimension, "fingerprint": e.fingerprint() if hasattr(e, "fingerprint") else ""}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        e = self.embedder()
        got = [[float(x) for x in v] for v in getattr(e, "embed_batch", e)(list(texts))]
        if len(got) != len(texts):
            raise ConfigError(f"the embedder gave {len(got)} vectors for {len(texts)} texts")
        for v in got:
            if len(v) != self.config.dimension:
                raise DimensionMismatch(f"the embedder gave {len(v)} components, not {self.config.dimension}")
        return got

    def writable(self, collection: str | None = None) -> None:
        if self.closed:
            raise StorageError("the database is closed")
        if self.read_only or collection in self._frozen:
            raise StorageError("this is read-only")

    def transaction(self) -> Transaction:
        return Transaction(self)

    def pending_writes(self) -> DataFrame:
        """Log rows that no segment has yet, in order."""
        log = self.store.log(self.manifest)
        return (self.spark.createDataFrame([], LOG).withColumn("seq", F.lit(0).cast("long")) if log is None else log).orderBy("seq", "at")

    def checkpoint(self) -> None:
        """Fold the log into segments; inverted lists whose collection has grown to GROWTH times what they were trained on are trained again."""
        self.writable()
        if self.store.entries(self.manifest):
            pending = {n for _, e in self.store.entries(self.manifest) for n in e["collections"]}
            listed = {n: (self.collection(n)._listed(), {}) for n in pending if self.manifest.collections.get(n, {}).get("lists")}
            self.manifest = self.store.checkpoint(self.manifest, listed)
            for name, info in list(self.manifest.collections.items()):
                if info.get("lists") and info["rows"] > GROWTH * info.get("trained_rows", info["rows"]) and not info.get("codebook"):
                    self.collection(name).rebuild()

    def _settle(self) -> None:
        """After a commit: a checkpoint, if so many commits are pending."""
        if not self.temporary and len(self.store.entries(self.manifest)) >= PENDING_COMMITS:
            self.checkpoint()

    def compact(self) -> None:
        """Fold the log into segments, train inverted lists again and delete what is unused."""
        for name in self.collection_names():
            self.collection(name).rebuild()
        self.vacuum()

    def vacuum(self) -> None:
        self.checkpoint()
        self.store.sweep(self.manifest)

    def query(self, text: str, bindings: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
        """Run a statement of the query language: hits with ``distance``, 0 for fetch and scan."""
        s = ql.parse(text)
        c = self.collection(s.vault)
        if isinstance(s, ql.Seek):
            hits = c.probe(ql.resolve(s.query, bindings), top=ql.top_of(s), where=s.where, threshold=s.threshold)
            if s.rank_by:
                hits = hits.orderBy(*search.meta_rank(s.rank_by), "distance", "id")
            return search.project(hits, s.fields)
        zero = F.lit(0.0).alias("distance")
        if isinstance(s, ql.Fetch):
            return search.fetch(c.records(), id_of(s.id)).select(*HIT, zero)
        if isinstance(s, ql.Scan):
            return c.sweep(where=s.where, offset=s.offset, limit=s.limit).select(*HIT, zero)
        if isinstance(s, ql.Place):
            key = c.write(vector=s.vector, meta=s.data)
            return search.fetch(c.records(), key).select(*HIT, zero)
        c.discard([s.id], missing_ok=True)
        return c.records().limit(0).select(*HIT, zero)

    def save_snapshot(self, path: str) -> None:
        """Write all collections, with what they need, as one table and one description with a checksum."""
        tables = [self.collection(n).records().withColumn("collection", F.lit(n)) for n in self.collection_names()]
        empty = self.spark.createDataFrame([], T.StructType([*RECORD.fields, T.StructField("collection", T.StringType())]))
        rows = reduce(DataFrame.unionByName, tables, empty)
        path = path.rstrip("/")
        rows.write.parquet(f"{path}/records")
        infos = {n: {k: v for k, v in i.items() if k not in ("segment", "rows")} for n, i in self.manifest.collections.items()}
        about = {"magic": SNAPSHOT, "version": 1, "config": self.manifest.config.as_dict(), "embedder": self.manifest.embedder, "collections": infos, "checksum": _checksum(self.spark, path)}
        Files(self.spark, path).publish("snapshot.json", json.dumps(about))

    @classmethod
    def load_snapshot(cls, spark: SparkSession, path: str, target: str) -> Engine:
        """A new database at ``target`` from a snapshot; StorageError if that is none, of another version or damaged."""
        path = path.rstrip("/")
        try:
            about = json.loads(Files(spark, path).read("snapshot.json"))
        except ValueError as e:
            raise StorageError(f"the snapshot at {path} is damaged: {e}") from e
        if about.get("magic") != SNAPSHOT or about.get("version") != 1:
            raise StorageError(f"{path} is no snapshot of a version that can be read")
        if _checksum(spark, path) != about["checksum"]:
            raise StorageError(f"the records of the snapshot at {path} are damaged")
        out = cls(spark, target, Config.from_dict(about["config"]), lineage=about["embedder"])
        if out.manifest.collections or out.store.entries(out.manifest):
            raise StorageError(f"there is a database at {target}")
        rows = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("collection", T.StringType())])).parquet(f"{path}/records")
        names = {r[0] for r in rows.select("collection").distinct().collect()} | set(about["collections"])
        out.manifest = out.store.checkpoint(out.manifest, {n: (rows.filter(F.col("collection") == n).drop("collection"), about["collections"].get(n, {})) for n in names})
        return out

    def verify(self) -> str:
        """``OK``, or ``CORRUPT`` and why, after reading every record."""
        try:
            for name in self.collection_names():
                rows = self.collection(name).records()
                bad = rows.filter(F.col("id").isNull() | (F.col("vector").isNotNull() & (F.size("vector") != self.config.dimension))).count()
                if bad:
                    return f"CORRUPT: {bad} records of {name}"
        except Exception as e:  # whatever reading raises is damage
            return f"CORRUPT: {str(e).splitlines()[0]}"
        return "OK"

    def totals(self) -> dict[str, int]:
        return {n: self.collection(n).count() for n in self.collection_names()}

    def close(self) -> None:
        """Checkpoint and seal; reading still works. Closing again does nothing."""
        if self.closed:
            return
        if not self.read_only and not self.temporary:
            self.checkpoint()
        self.abandon()

    def abandon(self) -> None:
        """Let go without a checkpoint, as a crash would."""
        self.closed = True
        if not self.read_only:
            _writers.discard(self.path)
            if hasattr(self._held, "close"):
                self._held.close()


def _checksum(spark: SparkSession, path: str) -> list[str]:
    """How many records a snapshot has, and a sum of their hashes, whatever their order."""
    try:
        rows = spark.read.parquet(f"{path}/records")
        text = F.to_json(F.struct(*[c for c in rows.columns]))
        return [str(x) for x in rows.agg(F.count("*"), F.sum(F.xxhash64(text).cast("decimal(38,0)"))).first()]
    except Exception as e:
        raise StorageError(f"the records of {path} can't be read: {str(e).splitlines()[0]}") from e


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a temporary database at the end of the driver, since what was read from it is lazy."""
    with contextlib.suppress(Exception):  # the session has ended before, and its folder with it
        Files(spark, path).delete("")


def _scratch(spark: SparkSession) -> str:
    """The folder for temporary databases: the cluster's shared one; in local mode one of our own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vecframe-")
    atexit.register(shutil.rmtree, made, True)
    return "file://" + made


class Transaction:
    """Writes to any collections that become visible together."""

    def __init__(self, engine: Engine):
        self.engine, self.rows, self.done = engine, [], False

    def place(self, collection: str, vector: Sequence[float] | None = None, meta: Mapping[str, MetaValue] | None = None, id: str | None = None, **parts) -> str:
        row = self.engine.collection(collection)._row(vector=vector, meta=meta, key=id, **parts)
        self.rows.append((collection, "place", row))
        return row["id"]

    def erase(self, collection: str, id: str) -> None:
        self.rows.append((collection, "erase", {"id": id_of(id), "codec": "none"}))

    def commit(self) -> None:
        if self.done:
            raise StorageError("the transaction has ended")
        for c in {r[0] for r in self.rows}:
            self.engine.writable(c)
        self.engine._commit(self.rows)
        self.done = True

    def rollback(self) -> None:
        self.rows, self.done = [], True

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.rollback() if kind else self.commit()


def _commit(self: Engine, rows: list[tuple[str, str, dict]]) -> None:
    if not rows:
        return
    codecs = {c: self.collection(c).quantizer() for c in {r[0] for r in rows}}
    out = []
    for at, (c, op, row) in enumerate(rows):
        q = codecs[c]
        if q is not None and op == "place":
            row = {**row, "codes": bytearray(q.encode(np.array([row["vector"]]))[0].tobytes()), "codec": q.codec, "vector": None}
        out.append(tuple([c, op, at, *[row.get(f.name) for f in RECORD.fields]]))
    self.store.commit(self.manifest, self.spark.createDataFrame(out, LOG), list(codecs))
    self._settle()


Engine._commit = _commit


class Collection:
    """A named set of records of one dimension and metric."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self._erased = engine, name, 0

    # writing

    def _row(self, vector=None, meta=None, key=None, text=None, document=None, chunk=None, lineage=None) -> dict:
        e = self.engine
        if vector is None and text is None:
            raise ConfigError("a record needs a vector or a text")
        key = id_of(key) if key is not None else generate_id()
        if text is not None:
            document = {"uri": "", **(document or {}), "text": text}
        if vector is None:
            [vector] = e.embed([text])
            lineage = lineage or e._lineage
            chunk = {"document_key": key, "ordinal": 0, "char_start": 0, "char_end": len(text), **(chunk or {})}
        v = [float(x) for x in vector]
        if len(v) != e.config.dimension:
            raise DimensionMismatch(f"expected {e.config.dimension} components, got {len(v)}")
        if not np.isfinite(v).all():
            raise InvalidVector("a component is not finite")
        if requires_normalization(e.config.metric):
            v = V.normalized(v)
        doc = document and {"text": None, "uri": None, **document, "mime_type": document.get("mime_type") or "text/plain"}
        line = lineage and {**{k: lineage.get(k) for k in ("provider", "model", "revision")}, "attributes": meta_row(lineage.get("attributes"))}
        return {"id": key, "vector": v, "meta": meta_row(meta), "document": doc, "chunk": chunk, "lineage": line, "codec": "none"}

    def write(self, record: Mapping | None = None, /, **fields) -> str:
        """Write or replace one record and return its id."""
        return self.write_many([{**(record or {}), **fields}])[0]

    add = write

    def write_many(self, records: Iterable[Mapping]) -> list[str]:
        """Write records in one commit; texts without vectors are embedded in one batch."""
        self.engine.writable(self.name)
        rows = [_coerced(r) for r in records]
        bare = [r for r in rows if r.get("vector") is None and r.get("text") is not None]
        for r, v in zip(bare, self.engine.embed([r["text"] for r in bare]) if bare else []):
            r["chunk"] = {"ordinal": 0, "char_start": 0, "char_end": len(r["text"]), **(r.get("chunk") or {})}
            r["lineage"] = r.get("lineage") or self.engine._lineage
            r["vector"] = v
        made = []
        for r in rows:
            row = self._row(**r)
            if row["chunk"] is not None:
                row["chunk"] = {"document_key": row["id"], "ordinal": 0, "char_start": 0, "char_end": 0, **row["chunk"]}
            made.append((self.name, "place", row))
        self.engine._commit(made)
        return [r["id"] for *_, r in made]

    add_many = write_many

    def ingest(self, records: Iterable[Mapping] | None = None, *, vectors: Sequence | None = None, texts: Sequence | None = None, meta: Sequence | None = None, keys: Sequence | None = None, documents: Sequence | None = None, chunks: Sequence | None = None, lineages: Sequence | None = None) -> list[str]:
        """``write_many`` of rows, or of columns, which must have one length."""
        if records is not None:
            return self.write_many(records)
        cols = {n: c for n, c in (("vector", vectors), ("text", texts), ("meta", meta), ("key", keys), ("document", documents), ("chunk", chunks), ("lineage", lineages)) if c is not None}
        if not cols or len({len(c) for c in cols.values()}) != 1:
            raise ConfigError("columns must have one length")
        return self.write_many([dict(zip(cols, row)) for row in zip(*cols.values())])

    merge = ingest

    def ingest_df(self, df: DataFrame, meta: Sequence[str] = (), id: str | None = None, vector: str = "vector", text: str | None = None) -> None:
        """Write a DataFrame in one commit, distributed; columns named in ``meta`` become metadata.

        A value of ``id`` that is no record id stands for one that is made from its text, as
        everywhere (``ids.id_of``), so ``pull`` and ``discard`` take the same values; a null
        gets a new id. Without ``id`` every row gets a new one, repeated rows too. Of rows
        with one id the last stays. If there is no column ``vector``, it is embedded from ``text``.
        """
        self.engine.writable(self.name)
        e = self.engine
        fields = {f.name: f.dataType for f in df.schema.fields}
        if text and vector not in df.columns:
            df = embed_column(df, e.embedder(), text, vector)
        v = _sound(F.col(vector), e)
        made = new_ids(uuid.uuid4().hex, F.monotonically_increasing_id())
        key = F.coalesce(id_column(F.col(id).cast("string")), made) if id else made
        m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in meta]), F.array(*[_tagged(F.col(n), fields[n]) for n in meta])), lambda k, x: x["k"].isNotNull()) if meta else F.lit(None)
        doc = F.struct(F.col(text).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit("text/plain").alias("mime_type")) if text else F.lit(None)
        nulls = {f.name: F.lit(None) for f in RECORD.fields}
        rows = {**nulls, "id": key, "vector": v, "meta": m, "document": doc, "codec": F.lit("none")}
        self._place(df.select(*[c.alias(n) if n == "vector" else c.cast(RECORD[n].dataType).alias(n) for n, c in rows.items()]))

    def _place(self, rows: DataFrame) -> None:
        """Commit rows of the schema RECORD, encoded if the collection is."""
        e, q = self.engine, self.quantizer()
        out = rows.select(F.lit(self.name).alias("collection"), F.lit("place").alias("op"), F.monotonically_increasing_id().alias("at"), "*")
        if q is not None:
            coded = quantize.encode_column(out.drop("codes"), q, out="new_codes")
            out = coded.withColumns({"codes": F.col("new_codes"), "codec": F.lit(q.codec), "vector": F.lit(None).cast("array<float>")})
        e.store.commit(e.manifest, out, [self.name])
        e._settle()

    def place_records(self, rows: DataFrame) -> None:
        """Write rows of the schema RECORD as they are: nothing is embedded, normalised or encoded again.

        For records that another collection of the same dimension, metric and codec gave.
        """
        self.engine.writable(self.name)
        e = self.engine
        out = rows.select(F.lit(self.name).alias("collection"), F.lit("place").alias("op"), F.monotonically_increasing_id().alias("at"), *[F.col(f.name) for f in RECORD.fields if f.name != "list_id"], F.lit(None).cast("int").alias("list_id"))
        e.store.commit(e.manifest, out, [self.name])
        e._settle()

    def discard(self, keys: Sequence[str] | None = None, where: Filter | None = None, missing_ok: bool = False) -> int:
        """Delete the records that have one of these keys or pass the filter; their number."""
        self.engine.writable(self.name)
        rows = self.records()
        wanted = [id_of(k) for k in keys or ()]
        hit = F.lit(False)
        if wanted:
            hit = hit | F.col("id").isin(wanted)
        if where is not None:
            hit = hit | F.coalesce(where.column(MetaBinding()), F.lit(False))
        gone = rows.filter(hit).select("id").distinct()
        n = gone.count()
        if not n:
            if missing_ok:
                return 0
            raise NotFound("no record to delete")
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in RECORD.fields}
        out = gone.select(F.lit(self.name).alias("collection"), F.lit("erase").alias("op"), F.lit(0).cast("long").alias("at"), *[{**nulls, "id": F.col("id"), "codec": F.lit("none")}[f.name].alias(f.name) for f in RECORD.fields])
        e = self.engine
        e.store.commit(e.manifest, out, [self.name])
        self._erased += n
        if not e.temporary and self._erased >= e.config.graph.compaction_ratio * max(1, self._known_rows()):
            e.checkpoint()
            self._erased = 0
        e._settle()
        return n

    delete = discard

    def _known_rows(self) -> int:
        """Records, by the manifest if no commit is pending, else counted."""
        e = self.engine
        info = e.manifest.collections.get(self.name, {})
        return info["rows"] if "rows" in info and not e.store.pending(e.manifest, self.name) else self.count()

    # reading

    def records(self) -> DataFrame:
        return self.engine.store.records(self.engine.manifest, self.name)

    def count(self) -> int:
        return self.records().count()

    def _listed(self) -> DataFrame:
        """Records with rows that are in no inverted list yet put into theirs, codes by what they decode to."""
        rows, lists = self.records(), self._lists()
        fresh = rows.filter(F.col("list_id").isNull()).drop("list_id")
        if self.quantizer() is not None:
            fresh = quantize.decode_column(fresh, self.quantizer(), out="_decoded")
            fresh = ivf.assign(fresh, lists, "_decoded").drop("_decoded")
        else:
            fresh = ivf.assign(fresh, lists)
        return rows.filter(F.col("list_id").isNotNull()).unionByName(fresh.select(*[f.name for f in RECORD.fields]))

    def quantizer(self) -> quantize.Quantizer | None:
        book = self.engine.manifest.collections.get(self.name, {}).get("codebook")
        return quantize.Quantizer.loads(book) if book else None

    def _lists(self) -> ivf.Ivf | None:
        lists = self.engine.manifest.collections.get(self.name, {}).get("lists")
        return ivf.Ivf(np.array(lists), self.engine.config.metric) if lists else None

    def pull(self, keys: Sequence[str], include_vectors: bool = False) -> DataFrame:
        rows = search.pull(self._hydrated(self.records()) if include_vectors else self.records(), [id_of(k) for k in keys])
        return rows.select(*HIT, *(["vector"] if include_vectors else []))

    def sweep(self, where: Filter | None = None, offset: int = 0, limit: int | None = None, include_vectors: bool = False) -> DataFrame:
        rows = search.scan(self.records(), where, offset, limit)
        return (self._hydrated(rows) if include_vectors else rows).select(*HIT, *(["vector"] if include_vectors else []))

    scan = sweep

    def _hydrated(self, rows: DataFrame) -> DataFrame:
        """Rows with vectors; those of codes are decoded and so approximate."""
        q = self.quantizer()
        if q is None:
            return rows
        return quantize.decode_column(rows, q, out="_decoded").withColumn("vector", F.coalesce("vector", "_decoded")).drop("_decoded")

    def plan(self, top: int, where: Filter | None = None, threshold: float | None = None, text: bool = False) -> QueryPlan:
        rows, e = self.records(), self.engine
        q = self.quantizer()
        n = self._known_rows()
        exact = where is not None and where.exact_constraints() is not None
        fit = search.matching(rows, where, MetaBinding()).count() if exact and e.config.metadata_acceleration else None
        return plan_seek(n, top, where, threshold, e.config.index, q.codec if q else "none", e.config.metadata_acceleration, fit, text)

    def explain(self, query: Sequence[float] | None = None, top: int = 10, where: Filter | None = None, threshold: float | None = None, text: str | None = None) -> QueryPlan:
        if query is not None:
            search.check_query(query, self.engine.config.dimension, self.engine.config.metric)
        return self.plan(top, where, threshold, text is not None)

    def probe(self, query: Sequence[float], top: int = 10, where: Filter | None = None, threshold: float | None = None, include_vectors: bool = False) -> DataFrame:
        """Hits nearest to a vector, with ``distance``; ``approximate`` marks those scored by codes."""
        hits = self._near(query, top, where, threshold)
        extra = ["vector"] if include_vectors else []
        return (self._hydrated(hits) if include_vectors else hits).select(*HIT, *extra, "distance", (F.col("codec") != "none").alias("approximate"))

    seek = search_vector = probe

    def _near(self, query, top, where, threshold) -> DataFrame:
        e, rows = self.engine, self.records()
        if top == 0:
            return rows.limit(0).withColumn("distance", F.lit(0.0))
        q = search.check_query(query, e.config.dimension, e.config.metric)
        codec, lists = self.quantizer(), self._lists()
        ann = lists is not None and e.config.index == "graph" and threshold is None and top is not None and self.plan(top, where).strategy == "ann_index"
        probes = ivf.probes_for(len(lists.centroids), e.config.graph.ef_search) if ann else 0
        if codec is not None:
            # rows written since the lists were made are in none and always scored
            order = [int(i) for i in lists.order(q)] if ann else []
            while True:
                some = rows.filter(F.col("list_id").isNull() | F.col("list_id").isin(order[:probes])) if probes < len(order) else rows
                near = quantize.scored_codes(search.matching(some, where, MetaBinding()), codec, q, e.config.metric)
                near = near.filter(F.col("distance") <= threshold) if threshold is not None else near
                near = near.orderBy("distance", "id")
                near = near if top is None else near.limit(top)
                if probes >= len(order):
                    return near
                found = near.collect()
                if len(found) >= top:
                    return e.spark.createDataFrame(found, near.schema)
                probes *= 4
        if ann:
            fresh = rows.filter(F.col("list_id").isNull())
            rows = ivf.assign(fresh, lists).unionByName(rows.filter(F.col("list_id").isNotNull()))
            return ivf.search_filled(rows, lists, q, top, probes, where=where, binding=MetaBinding())
        return search.exact_knn(rows, q, top, e.config.metric, where, threshold, binding=MetaBinding())

    def probe_text(self, text: str, top: int = 10, where: Filter | None = None, threshold: float | None = None, include_vectors: bool = False) -> DataFrame:
        """Vector search by the embedding of a text."""
        return self.probe(self.engine.embed([text])[0], top, where, threshold, include_vectors)

    search = seek_text = probe_text

    def probe_hybrid(self, text: str, query: Sequence[float] | None = None, weight: float = 0.5, top: int = 10, where: Filter | None = None, threshold: float | None = None) -> DataFrame:
        """Vector search ranked again with lexical overlap."""
        query = self.engine.embed([text])[0] if query is None else query
        w = min(1.0, max(0.0, weight))
        if not text or not w:
            return self.probe(query, top, where, threshold)
        near = search.fused(self._near(query, None if top is None else search.OVERFETCH * top, where, threshold), text, w, top)
        return near.select(*HIT, "distance", (F.col("codec") != "none").alias("approximate"))

    search_hybrid = seek_hybrid = probe_hybrid

    # maintenance

    def _rewrite(self, rows: DataFrame, info: dict) -> None:
        e = self.engine
        e.manifest = e.store.checkpoint(e.manifest, {self.name: (rows, info)})

    def rebuild(self) -> None:
        """Fold pending writes in and, for approximate search, train and lay out inverted lists."""
        e = self.engine
        e.writable(self.name)
        rows = self.records()
        n = rows.filter(F.col("vector").isNotNull()).count()
        if e.config.index != "graph" or n <= 128:
            self._rewrite(rows, {})
            return
        index = ivf.train(rows, ivf.lists_for(n), e.config.metric)
        self._rewrite(ivf.assign(rows, index).select(*[f.name for f in RECORD.fields]), {"lists": index.centroids.tolist(), "trained_rows": n})

    def vacuum(self) -> None:
        self.engine.vacuum()

    def compress(self, params: QuantParams | str | None = None) -> None:
        """Train a codec, encode every record and drop the vectors; this can't be undone.

        For approximate search the inverted lists are made first, and codes stay in them.
        """
        e = self.engine
        e.writable(self.name)
        p = QuantParams(params) if isinstance(params, str) else params or e.config.quantization
        if p.codec == "none":
            raise ConfigError("no codec is set")
        if self.quantizer() is not None:
            raise ConfigError("the collection is compressed already")
        if e.config.index == "graph":
            self.rebuild()
        rows = self.records()
        q = quantize.train_on(rows, p)
        out = quantize.encode_column(rows.drop("codes"), q).withColumns({"codec": F.lit(q.codec), "vector": F.lit(None).cast("array<float>")})
        self._rewrite(out.select(*[f.name for f in RECORD.fields]), {"codebook": q.dumps()})

    quantize = compress

    def freeze(self, frozen: bool = True) -> None:
        (self.engine._frozen.add if frozen else self.engine._frozen.discard)(self.name)

    @property
    def read_only(self) -> bool:
        return self.engine.read_only or self.name in self.engine._frozen

    @property
    def sealed(self) -> bool:
        return self.engine.closed

    def pending_removals(self) -> int:
        return self.engine.pending_writes().filter((F.col("collection") == self.name) & (F.col("op") == "erase")).select("id").distinct().count()

    def info(self) -> CollectionInfo:
        c, q = self.engine.config, self.quantizer()
        p = QuantParams(q.codec, pq_dim=len(q.books) if q.books is not None else 0) if q else QuantParams()
        return CollectionInfo(self.name, self.count(), c.dimension, c.metric, p.codec, quantize.code_bytes(p, c.dimension))

    def health(self) -> CollectionHealth:
        i, gone = self.info(), self.pending_removals()
        return CollectionHealth(i.count, gone, gone / max(1, i.count + gone), i.codec, 4 * i.dimension / max(1, i.code_bytes), self.read_only, self.sealed)

    def export_jsonl(self, path: str) -> None:
        jsonl.write_jsonl(self._hydrated(self.records()), path)

    def import_jsonl(self, path: str) -> None:
        """Read JSON lines in one commit; records without an id, or with an empty one, get one each."""
        self.engine.writable(self.name)
        e = self.engine
        rows = jsonl.read_jsonl(e.spark, path)
        key = F.coalesce(id_column(F.nullif(F.col("id"), F.lit(""))), new_ids(uuid.uuid4().hex, F.monotonically_increasing_id()))
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in RECORD.fields}
        cols = {**nulls, **{n: F.col(n) for n in ("meta", "document", "chunk", "lineage")}, "id": key, "vector": _sound(F.col("vector"), e), "codec": F.lit("none")}
        self._place(rows.select(*[c.alias(n) for n, c in cols.items()]))


def _sound(v: Column, e: Engine) -> Column:
    """A vector column of the engine's dimension, normalised for cosine; a null vector or one that isn't sound raises an error."""
    fails = lambda text: F.raise_error(F.lit(text)).cast("array<float>")
    given = v.cast("array<float>")
    made = (V.normalize(given) if requires_normalization(e.config.metric) else given).cast("array<float>")
    wrong = given.isNull() | (F.size(given) != e.config.dimension)
    return F.when(wrong, fails(f"DimensionMismatch: expected {e.config.dimension} components")).when(~F.coalesce(V.is_finite(given), F.lit(False)), fails("InvalidVector: a component is not finite")).otherwise(made)


def _coerced(record: Mapping) -> dict:
    """A record with one name for each part: ``data`` is ``meta`` and ``id`` is ``key``."""
    out = {k: v for k, v in record.items() if v is not None}
    for other, own in (("data", "meta"), ("id", "key")):
        if other in out:
            if own in out and out[own] != out[other]:
                raise ConfigError(f"{own} and {other} differ")
            out[own] = out.pop(other)
    unknown = set(out) - {"vector", "meta", "key", "text", "document", "chunk", "lineage"}
    if unknown:
        raise ConfigError(f"unknown parts {sorted(unknown)}")
    return out


def _tagged(c, kind: T.DataType):
    """A column as a tagged metadata value, null where it is null."""
    slot = 2 if isinstance(kind, T.BooleanType) else 0 if isinstance(kind, T.IntegralType) else 1 if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else 3
    value = META.valueType
    parts = [F.lit(slot).cast("byte").alias("k")] + [(c if i == slot else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(value.fields[1:])]
    return F.when(c.isNotNull(), F.struct(*parts)).cast(value)
