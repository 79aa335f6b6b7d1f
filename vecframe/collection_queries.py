"""Registered queries that open a database, write to it and read it again, and their SQL.

Each has a database of its own in the session's shared folder, which is deleted when the
driver ends. Keys are numbers of the driver's tables, so records carry them as metadata.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .config import Config, GraphParams
from .engine import Collection, Engine
from .functions import vectors as V
from .functions.ids import canonical, id_column, id_of
from .operators import ivf
from .operators.filters import Filter
from .sources import jsonl
from .streaming import mutations

#: Probes all lists, so that approximate search gives what exact search does.
ALL_LISTS = GraphParams(ef_search=1000)


def _open(spark: SparkSession, metric: str = "cosine", index: str = "graph", dimension: int = 64, path: str = ":memory:") -> Engine:
    return Engine(spark, path, Config(dimension, metric, index, ALL_LISTS))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _number(field: str = "vec_id"):
    return F.col("meta")[field]["i"].alias(field)


def _vectors(spark: SparkSession, d: str, metric: str = "cosine", index: str = "graph") -> tuple[Engine, Collection]:
    db = _open(spark, metric, index)
    c = db.collection("vectors")
    c.ingest_df(_table(spark, d, "embeddings"), meta=["vec_id", "label"], id="vec_id", vector="embedding")
    return db, c


def _query(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


def collection_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of three times their length come out of a cosine collection with length one."""
    c = _open(spark).collection("vectors")
    rows = _table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    c.ingest_df(rows, meta=["vec_id", "label"], id="vec_id", vector="embedding")
    return c.records().select(_number(), _number("label"), F.round(V.magnitude(F.col("vector")), 4).alias("magnitude"))


def collection_ingest_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents embedded at ingest, with their text and metadata."""
    c = _open(spark).collection("documents")
    c.ingest_df(_table(spark, d, "documents"), meta=["doc_id", "lang", "n_chars"], id="doc_id", text="text")
    kept = F.col("meta")["lang"]["s"].alias("lang")
    return c.records().select(_number("doc_id"), kept, _number("n_chars"), F.col("document.text").alias("text"), F.size("vector").alias("dimension"))


def jsonl_import(spark: SparkSession, d: str) -> DataFrame:
    """Records exported to JSON lines and imported into another database, ids, vectors and metadata with them."""
    db, c = _vectors(spark, d, "euclidean")
    path = f"{db.path}/lines"
    c.export_jsonl(path)
    other = _open(spark, "euclidean").collection("copies")
    other.import_jsonl(path)
    first = c.records().select("id", F.col("vector").alias("before"))
    both = other.records().join(first, "id")
    return both.select(_number(), _number("label"), (F.col("vector") == F.col("before")).alias("same_vector"))


def collection_writes(spark: SparkSession, d: str) -> DataFrame:
    """Records written, replaced and erased, by keys and by a filter; the database closed and opened again."""
    path = _open(spark).path + "/kept"
    db = _open(spark, path=path)
    c = db.collection("vectors")
    rows = _table(spark, d, "embeddings")
    c.ingest_df(rows, meta=["vec_id", "label"], id="vec_id", vector="embedding")
    db.checkpoint()
    c.ingest_df(rows.filter("vec_id % 50 = 0").withColumn("label", F.lit(-1)), meta=["vec_id", "label"], id="vec_id", vector="embedding")
    c.discard(where=Filter.compare("label", "=", 3))
    c.discard(["1", "50"], missing_ok=True)
    db.close()
    again = _open(spark, path=path)
    out = again.collection("vectors").sweep().select(_number(), _number("label"))
    again.abandon()
    return out


def collection_transactions(spark: SparkSession, d: str) -> DataFrame:
    """A transaction over two collections that is committed, and one that isn't."""
    db = _open(spark)
    v = _query(spark, d)
    with db.transaction() as t:
        t.place("a", v, {"vec_id": 1}, "1")
        t.place("b", v, {"vec_id": 2}, "2")
        t.place("a", v, {"vec_id": 3}, "1")
        t.erase("b", "none such")
    undone = db.transaction()
    undone.place("a", v, {"vec_id": 4})
    undone.rollback()
    parts = [db.collection(n).sweep().select(F.lit(n).alias("vault"), _number()) for n in db.collection_names()]
    return parts[0].unionByName(parts[1])


def collection_plans(spark: SparkSession, d: str) -> DataFrame:
    """Which way searches take."""
    _, c = _vectors(spark, d)
    q = _query(spark, d)
    label = Filter.compare("label", "=", 3)
    cases = {
        "nearest": c.explain(q, 10),
        "most": c.explain(q, 10**9),
        "threshold": c.explain(q, 10, threshold=0.5),
        "no value": c.explain(q, 10, Filter.compare("label", "=", 99)),
        "filtered": c.explain(q, 10**9, label),
        "not equal": c.explain(q, 10, Filter.compare("label", "!=", 3)),
        "text": c.explain(q, 10, text="words"),
    }
    return spark.createDataFrame([(n, p.strategy) for n, p in cases.items()], "search string, strategy string")


def collection_seek(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search in trained lists, and in rows written since."""
    db = _open(spark)
    c = db.collection("vectors")
    rows = _table(spark, d, "embeddings")
    add = lambda some: c.ingest_df(some, meta=["vec_id", "label"], id="vec_id", vector="embedding")
    add(rows.filter("vec_id % 4 > 0"))
    c.rebuild()
    add(rows.filter("vec_id % 4 = 0"))
    return c.probe(_query(spark, d), 10).select(_number(), _number("label"), F.round("distance", 6).alias("distance"))


def collection_compressed(spark: SparkSession, d: str) -> DataFrame:
    """Search over codes in lists, with a record written after compression."""
    _, c = _vectors(spark, d, "euclidean")
    c.compress("sq8")
    c.ingest_df(_table(spark, d, "embeddings").filter("vec_id = 5"), meta=["vec_id", "label"], id="vec_id", vector="embedding")
    return c.probe(_query(spark, d), 10).select(_number(), F.round("distance", 6).alias("distance"))


def collection_statements(spark: SparkSession, d: str) -> DataFrame:
    """place, erase, seek, scan and fetch through the query language, with rank_by and project."""
    db, _ = _vectors(spark, d)
    q = _query(spark, d)
    db.query("place in vectors vector [" + ", ".join(f"{x:.12f}" for x in q) + '] data {"vec_id": -1, "label": 0}')
    db.query(f'erase from vectors id "{id_of("7")}"')
    hits = db.query("seek in vectors nearest $q top 20 where not (label = 2) rank_by label project vec_id yield", {"q": q})
    found = hits.select(F.lit("seek").alias("statement"), _number(), F.size("meta").alias("fields"))
    scanned = db.query("scan in vectors where label = 3 yield").select(F.lit("scan").alias("statement"), _number(), F.size("meta").alias("fields"))
    fetched = db.query(f'fetch from vectors id "{id_of("9")}" yield').select(F.lit("fetch").alias("statement"), _number(), F.size("meta").alias("fields"))
    return found.unionByName(scanned).unionByName(fetched)


def collection_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Totals after commits, a checkpoint and a vacuum; nothing is pending afterwards."""
    db, c = _vectors(spark, d)
    db.collection("events").ingest_df(_table(spark, d, "benchmark"), meta=["item_id"], text="text")
    before = db.totals()
    c.discard(where=Filter.compare("label", "=", 1))
    db.checkpoint()
    db.vacuum()
    after, left = db.totals(), db.pending_writes().count()
    rows = [("before", n, x) for n, x in before.items()] + [("after", n, x) for n, x in after.items()] + [("pending", "all", left)]
    return spark.createDataFrame(rows, "at string, vault string, records long")


def collection_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The mutation log, streamed into a table of live records; a commit that was never published stays unseen."""
    db, c = _vectors(spark, d)
    c.ingest_df(_table(spark, d, "embeddings").filter("vec_id % 7 = 0").withColumn("label", F.lit(70)), meta=["vec_id", "label"], id="vec_id", vector="embedding")
    c.discard(where=Filter.compare("label", "=", 2))
    lost = db.pending_writes().limit(1).drop("seq").withColumn("id", F.lit(id_of("lost")))
    lost.write.parquet(f"{db.path}/log/{99:012d}-lost")
    out = f"{db.path}/streamed"

    def apply(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    mutations.apply_log(spark, db.path, apply, f"{db.path}/stream-state", "vectors").awaitTermination()
    return spark.read.parquet(out).filter("op = 'place'").select(_number(), _number("label"))


def collection_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two collections, one of them compressed, saved as a snapshot and loaded into another database."""
    db, c = _vectors(spark, d, "euclidean")
    c.compress("sq8")
    db.collection("texts").ingest_df(_table(spark, d, "benchmark"), meta=["item_id"], text="text")
    db.save_snapshot(f"{db.path}/snapshot")
    other = Engine.load_snapshot(spark, f"{db.path}/snapshot", f"{db.path}/loaded")
    other.abandon()
    parts = [other.collection(n).sweep().select(F.lit(n).alias("vault"), _number(k), "codec").withColumnRenamed(k, "number") for n, k in (("texts", "item_id"), ("vectors", "vec_id"))]
    near = other.collection("vectors").probe(_query(spark, d), 10).select(F.lit("near").alias("vault"), _number().alias("number"), "codec")
    return parts[0].unionByName(parts[1]).unionByName(near)


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of number keys, and the canonical form of ids written in other ways."""
    key = F.col("doc_id").cast("string")
    return _table(spark, d, "documents").select("doc_id", id_column(key).alias("id"), canonical(F.upper(F.md5(key))).alias("canonical"), canonical(F.col("lang")).alias("no_id"))


def filter_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a filter passes when it is evaluated in Python, row by row."""
    where = Filter().field("lang").one_of(["en", "de"]).field("n_chars").ge(200).lt(3000) & ~Filter.has_substring("source", "1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            passed = [where.matches({k: v for k, v in r.items() if v is not None}) for r in b.to_pylist()]
            yield b.filter(pa.array(passed, pa.bool_())).select(["doc_id"])

    return _table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source").mapInArrow(run, "doc_id long")


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest mean of a label's vectors."""
    e = _table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("label").collect()
    index = ivf.Ivf(np.array([[x.x for x in r.v] for r in rows]), "euclidean")
    label = F.element_at(F.array(*[F.lit(r.label) for r in rows]), F.col("list_id") + 1)
    return ivf.assign(e, index, "embedding").select("vec_id", label.alias("nearest"))


def collection_hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Vectors decoded from scalar codes, component by component."""
    _, c = _vectors(spark, d, "euclidean", "exact")
    c.compress("sq8")
    return c.sweep(include_vectors=True).select(_number(), F.posexplode("vector").alias("at", "x")).select("vec_id", "at", F.round(F.col("x").cast("double"), 4).alias("x"))


def collection_health(spark: SparkSession, d: str) -> DataFrame:
    """Counts, tombstones and compression of a collection as it is written, deleted from and compressed."""
    db, c = _vectors(spark, d, "euclidean", "exact")
    out = []
    for step in ("written", "deleted", "compressed"):
        if step == "deleted":
            c.discard(where=Filter.compare("vec_id", "<", 10))
        if step == "compressed":
            c.compress("sq8")
        h, i = c.health(), c.info()
        out.append((step, h.count, h.tombstones, round(h.tombstone_ratio, 6), h.compression_ratio, h.codec, i.code_bytes, h.read_only))
    return spark.createDataFrame(out, "step string, records long, tombstones long, tombstone_ratio double, compression_ratio double, codec string, code_bytes int, read_only boolean")


def command_line(spark: SparkSession, d: str) -> DataFrame:
    """What the commands print: import, info, stats, vaults, query, export, quantize, verify."""
    path = _open(spark).path
    lines, kept = f"{path}/lines", f"{path}/kept"
    e = _table(spark, d, "embeddings")
    e.select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.struct("vec_id", "label").alias("data"))).alias("value")).write.text(lines)
    out: list[tuple[str, str]] = []

    def run(command: str, *more: str) -> None:
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            code = cli.main([command, "--path", kept, *more], spark)
        out.append((command, str(code)))
        for line in said.getvalue().splitlines():
            got = json.loads(line) if line.startswith("{") else line
            if isinstance(got, dict):
                got = [got[k] for k in ("vault", "vaults", "records", "dimension", "metric") if k in got] or [got["data"]["vec_id"], got["data"]["label"]]
            out.append((command, " ".join(map(str, got)) if isinstance(got, list) else got))

    run("import", "--dimension", "64", "--vault", "v", "--input", lines)
    run("info")
    run("stats")
    run("vaults")
    run("query", "--query", "scan in v where label = 4 yield")
    run("export", "--vault", "v", "--output", f"{path}/exported")
    run("quantize", "--vault", "v", "--quantize", "sq8")
    run("checkpoint")
    run("verify")
    return spark.createDataFrame(out, "command string, said string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (collection_ingest, collection_ingest_texts, jsonl_import, collection_writes, collection_transactions, collection_plans, collection_seek, collection_compressed, collection_statements, collection_upkeep, collection_log_stream, collection_snapshot, record_ids, filter_matches, nearest_centroid, collection_hydrated, collection_health, command_line)}


_HYPHENS = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


def oracle_sql(knn: str, sq8: str) -> dict[str, str]:
    """SQL of these queries, given that of the ten nearest rows by cosine distance, and by codes."""
    near = "1.0 - list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
    return {
        "collection_ingest": "SELECT vec_id, label::BIGINT AS label, 1.0::DOUBLE AS magnitude FROM embeddings",
        "collection_ingest_texts": "SELECT doc_id, lang, n_chars, text, 64::INTEGER AS dimension FROM documents",
        "jsonl_import": "SELECT vec_id, label::BIGINT AS label, true AS same_vector FROM embeddings",
        "collection_writes": "SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE label END::BIGINT AS label FROM embeddings WHERE (vec_id % 50 = 0 OR label <> 3) AND vec_id NOT IN (1, 50)",
        "collection_transactions": "SELECT * FROM (VALUES ('a', 3::BIGINT), ('b', 2::BIGINT)) t(vault, vec_id)",
        "collection_plans": "SELECT * FROM (VALUES ('nearest', 'ann_index'), ('most', 'full_scan'), ('threshold', 'full_scan'), ('no value', 'exact_candidates'), ('filtered', 'exact_candidates'), ('not equal', 'ann_index'), ('text', 'hybrid_fusion')) t(search, strategy)",
        "collection_seek": f"SELECT vec_id, label::BIGINT AS label, distance FROM ({knn})",
        "collection_compressed": f"SELECT vec_id, distance FROM ({sq8})",
        "collection_statements": f"""
WITH n AS (SELECT e.vec_id, e.label, {near} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label <> 2 AND e.vec_id <> 7
           UNION ALL SELECT -1, 0, (SELECT {near} FROM embeddings e, embeddings q WHERE e.vec_id = 0 AND q.vec_id = 0))
SELECT 'seek' AS statement, vec_id, 1::INTEGER AS fields FROM (SELECT vec_id FROM n ORDER BY dist LIMIT 20)
UNION ALL SELECT 'scan', vec_id, 2 FROM embeddings WHERE label = 3 AND vec_id <> 7
UNION ALL SELECT 'fetch', vec_id, 2 FROM embeddings WHERE vec_id = 9""",
        "collection_upkeep": """
SELECT 'before' AS "at", 'vectors' AS vault, count(*) AS records FROM embeddings UNION ALL SELECT 'before', 'events', count(*) FROM benchmark
UNION ALL SELECT 'after', 'vectors', count(*) FROM embeddings WHERE label <> 1 UNION ALL SELECT 'after', 'events', count(*) FROM benchmark
UNION ALL SELECT 'pending', 'all', 0::BIGINT""",
        "collection_snapshot": f"SELECT 'texts' AS vault, item_id AS number, 'none' AS codec FROM benchmark UNION ALL SELECT 'vectors', vec_id, 'sq8' FROM embeddings UNION ALL SELECT 'near', vec_id, 'sq8' FROM ({sq8})",
        "record_ids": f"SELECT doc_id, {_HYPHENS.format('md5(doc_id::VARCHAR)')} AS id, {_HYPHENS.format('md5(doc_id::VARCHAR)')} AS canonical, NULL::VARCHAR AS no_id FROM documents",
        "filter_matches": "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 200 AND n_chars < 3000 AND NOT coalesce(contains(source, '1'), false)",
        "nearest_centroid": """
WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
s AS (SELECT u.vec_id, c.label, sum((u.x - c.x) * (u.x - c.x)) AS dist FROM u JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, label AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS r FROM s) WHERE r = 1""",
        "collection_hydrated": """
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1.0 END AS scale FROM u GROUP BY i)
SELECT vec_id, (i - 1)::INTEGER AS "at", round((greatest(0, least(255, floor((x - lo) / scale + 0.5))) * scale + lo)::FLOAT::DOUBLE, 4) + 0.0 AS x FROM u JOIN s USING (i)""",
        "collection_health": """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id < 10) AS gone FROM embeddings)
SELECT 'written' AS step, n AS records, 0::BIGINT AS tombstones, 0.0::DOUBLE AS tombstone_ratio, 1.0::DOUBLE AS compression_ratio, 'none' AS codec, 256::INTEGER AS code_bytes, false AS read_only FROM n
UNION ALL SELECT 'deleted', n - gone, gone, round(gone / n, 6), 1.0, 'none', 256, false FROM n
UNION ALL SELECT 'compressed', n - gone, 0, 0.0, 4.0, 'sq8', 64, false FROM n""",
        "command_line": """
SELECT unnest(['import', 'info', 'stats', 'vaults', 'query', 'export', 'quantize', 'checkpoint', 'verify']) AS command, '0' AS said
UNION ALL SELECT 'info', '1 ' || count(*) || ' 64 cosine' FROM embeddings
UNION ALL SELECT unnest(['stats', 'vaults']), 'v ' || count(*) FROM embeddings
UNION ALL SELECT 'query', vec_id || ' ' || label FROM embeddings WHERE label = 4
UNION ALL SELECT 'verify', 'OK'""",
        "collection_log_stream": "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 70 ELSE label END::BIGINT AS label FROM embeddings WHERE vec_id % 7 = 0 OR label <> 2",
    }
