"""Registered queries over the driver's tables and the SQL that gives the same rows.

Distances are compared after rounding to 6 digits; sums accumulate in double on both sides.
Query vectors are rows of ``embeddings`` itself, searches run over the whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collection_queries
from .config import QuantParams
from .engine import _scratch
from .functions import text as X
from .functions import vectors as V
from .operators import ivf, quantize, search
from .operators.filters import ColumnBinding, Filter
from .plans import query_language as ql
from .sources import jsonl, store
from .streaming import mutations

TOP = 10
#: Batch searches ask with every row whose id this divides.
EVERY = 50
#: Recall that codes alone and inverted lists must have.
FLOORS = {"sq8": 0.95, "pq": 0.55, "opq": 0.55, "ivf": 0.9}
#: Benchmark items about, that a task holds at once.
ITEMS = 1000
Query = Callable[[SparkSession, str], DataFrame]
METRIC_SQL = {
    "cosine": "1.0 - list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])",
    "euclidean": "list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])",
    "dot_product": "-list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vector(spark: SparkSession, d: str, key: int = 0) -> list[float]:
    row = _t(spark, d, "embeddings").filter(F.col("vec_id") == key).select("embedding").first()
    return [float(x) for x in row[0]]


_E = {"vector": "embedding", "id": "vec_id"}
_HIT = ("vec_id", "label")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("distance", 6).alias("distance"))


def _knn(metric: str, where: Filter | None = None, threshold: float | None = None, top: int | None = TOP) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(search.exact_knn(_t(spark, d, "embeddings"), _vector(spark, d), top, metric, where, threshold, **_E), *_HIT)

    return run


def _knn_sql(metric: str, where: str = "true", top: int | None = TOP, order: str = "") -> str:
    m = METRIC_SQL[metric]
    limit = f"LIMIT {top}" if top else ""
    return f"SELECT e.vec_id, e.label, round({m}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY {m}, e.vec_id {limit}"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set of batch searches: every row whose id is divisible by EVERY, asked against all rows."""
    return _t(spark, d, "embeddings").filter(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _ranked(out: DataFrame) -> DataFrame:
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.batch_knn(_t(spark, d, "embeddings"), _asked(spark, d), TOP, "cosine", **_E))


def batch_knn_joined(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.batch_knn(_t(spark, d, "embeddings"), _asked(spark, d), TOP, "euclidean", held_values=0, **_E))


def _batch_sql(metric: str) -> str:
    m = METRIC_SQL[metric]
    return f"""
SELECT query_id, rank::INTEGER AS rank, vec_id, round(dist, 6) + 0.0 AS distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {m} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {m}, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q) WHERE rank <= {TOP}"""


_SIDES = {"a_id": "vec_id", "b_id": "vec_id", "a_vector": "embedding", "b_vector": "embedding"}


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings")
    return e.filter(f"vec_id % {EVERY} = 0"), e


def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return search.distance_matrix(*_sides(spark, d), "euclidean", **_SIDES).select("a_id", "b_id", F.round("distance", 6).alias("distance"))


def row_top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.row_top_k(*_sides(spark, d), 5, "dot_product", **_SIDES).select("a_id", "rank", "b_id", F.round("distance", 6).alias("distance"))


def rank_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nearest, sorted again by their label; 50 is the feature."""
    hits = search.exact_knn(_t(spark, d, "embeddings"), _vector(spark, d), 50, "cosine", **_E)
    ranked = search.rank_by(hits, F.col("label"), id="vec_id").select(*_HIT, "distance").collect()
    rows = [(i, r.vec_id, r.label, r.distance) for i, r in enumerate(ranked, 1)]
    return _rounded(spark.createDataFrame(rows, "position int, vec_id long, label int, distance double"), "position", *_HIT)


def vql_seek(spark: SparkSession, d: str) -> DataFrame:
    s = ql.parse("seek in embeddings nearest $q top 10 where label in [1, 2, 3] and not (label = 2) project label yield")
    q = ql.resolve(s.query, {"q": _vector(spark, d)})
    hits = search.exact_knn(_t(spark, d, s.vault), q, ql.top_of(s), "cosine", s.where, s.threshold, **_E)
    return _rounded(hits, "vec_id", *s.fields)


def vql_scan(spark: SparkSession, d: str) -> DataFrame:
    s = ql.parse('scan in documents where lang = "en" and n_chars >= 500 offset 5 limit 50 yield')
    return search.scan(_t(spark, d, s.vault), s.where, s.offset, s.limit, "doc_id").select("doc_id", "lang", "n_chars")


def vql_fetch(spark: SparkSession, d: str) -> DataFrame:
    s = ql.parse('fetch from documents id "7" yield')
    return search.fetch(_t(spark, d, s.vault), int(s.id), "doc_id").select("doc_id", "lang", "source", F.lit(0.0).alias("distance"))


def scan_contains(spark: SparkSession, d: str) -> DataFrame:
    where = Filter.has_substring("text", "license").or_(Filter.has_substring("text", "License"))
    return search.matching(_t(spark, d, "documents"), where).select("doc_id", "source")


def scan_not_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    where = Filter.not_(Filter.compare("toxic", "=", 1)).and_(Filter.compare("lang", "!=", "en"))
    return search.matching(docs, where, ColumnBinding(docs.schema)).select("doc_id", "lang", "toxic")


def filter_tree(spark: SparkSession, d: str) -> DataFrame:
    f = Filter().field("l_quantity").ge(20).lt(40.5).field("l_returnflag").one_of(["A", "R"]).and_(Filter.compare("l_discount", ">", 0.05).or_(Filter.compare("l_shipmode", "=", "AIR")))
    return search.matching(_t(spark, d, "lineitem"), f).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def pull_keys(spark: SparkSession, d: str) -> DataFrame:
    got = search.pull(_t(spark, d, "documents"), [5, 3, 5, 10**9, 8], "doc_id")
    return got.groupBy("doc_id", "lang").agg(F.count("*").alias("times"))


TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = [_t(spark, d, n).agg(F.count("*").alias("records")).select(F.lit(n).alias("vault"), "records") for n in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalize_magnitude(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _t(spark, d, "embeddings").select("vec_id", F.round(V.magnitude(v), 6).alias("magnitude"), F.round(V.magnitude(V.normalize(v)), 6).alias("unit"), V.is_finite(F.col("embedding")).alias("finite"))


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each document against every benchmark item, in blocks of items that tasks can hold."""
    docs = _t(spark, d, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    items = _t(spark, d, "benchmark").select("item_id", F.coalesce(F.array_distinct(X.tokens(F.col("text"))), F.array().cast("array<string>")).alias("q"))
    blocks = max(1, -(-items.count() // ITEMS))
    parts = [_overlaps(docs, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _overlaps(docs: DataFrame, rows: list) -> DataFrame:
    """Scores of documents (doc_id, t) with a block of items, which the tasks hold as a matrix of tokens and items."""
    at = {t: i for i, t in enumerate(sorted({t for r in rows for t in r[1]}))}
    has = np.zeros((len(at) + 1, len(rows)), np.float32)
    for j, r in enumerate(rows):
        has[[at[t] for t in r[1]], j] = 1
    held = docs.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in rows], pa.int64()), pa.array(list(at), pa.string()), has))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, words, has = held.value
        sizes = np.maximum(has.sum(0, dtype=np.float64), 1)
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                n = np.array([x or 0 for x in pc.list_value_length(part.column(1)).to_pylist()], int)
                there = np.zeros((part.num_rows, len(has)), np.float32)
                found = pc.fill_null(pc.index_in(part.column(1).flatten(), value_set=words), len(words)).to_numpy(zero_copy_only=False)
                there[np.repeat(np.arange(len(n)), n), found] = 1
                score = (there @ has).astype(np.float64) / sizes
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), len(items))))
                yield pa.RecordBatch.from_arrays([ids, items.take(pa.array(np.tile(np.arange(len(items)), len(n)))), pa.array(score.ravel())], names=["doc_id", "item_id", "score"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, score double").withColumn("score", F.round("score", 6))


_TOKENS_SQL = "list_filter(list_transform(regexp_split_to_array({}, '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: t <> '')"


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """All vectors, with the document of the same number where there is one; text of benchmark item 0 as the query."""
    e = _t(spark, d, "embeddings").join(_t(spark, d, "documents").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    text = _t(spark, d, "benchmark").filter("item_id = 0").first()["text"]
    return _rounded(search.hybrid(e, _vector(spark, d), text, 0.3, TOP, "cosine", document=F.col("text"), **_E), "vec_id")


def hybrid_search_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document by the vector of its text; text of benchmark item 0 as the query."""
    model = X.HashEmbedder(128)
    text = _t(spark, d, "benchmark").filter("item_id = 0").first()["text"]
    docs = X.embed_column(_t(spark, d, "documents").select("doc_id", "text"), model)
    hits = search.hybrid(docs, V.normalized(model.embed(text).tolist()), text, 0.3, TOP, "cosine", document=F.col("text"), id="doc_id", normalize=True)
    return _rounded(hits, "doc_id")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    model = X.HashEmbedder(128)
    docs = X.embed_column(_t(spark, d, "documents").select("doc_id", "text"), model)
    query = V.normalized(model.embed(_t(spark, d, "benchmark").filter("item_id = 0").first()["text"]).tolist())
    hits = search.exact_knn(docs, query, TOP, "cosine", id="doc_id", normalize=True)
    return hits.select("doc_id", F.round("distance", 6).alias("distance"))


def _sq8(spark: SparkSession, d: str) -> tuple[DataFrame, quantize.Quantizer]:
    e = _t(spark, d, "embeddings")
    q = quantize.train_on(e, QuantParams("sq8"), "embedding", "vec_id")
    return quantize.encode_column(e, q, "embedding"), q


def sq8_encode(spark: SparkSession, d: str) -> DataFrame:
    codes, _ = _sq8(spark, d)
    at = F.sequence(F.lit(1), F.length("codes"))
    return codes.select("vec_id", F.transform(at, lambda i: F.conv(F.hex(F.substring(F.col("codes"), i, F.lit(1))), 16, 10).cast("long")).alias("code"))


SQ8_SQL = """
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1.0 END AS scale FROM u GROUP BY i)
SELECT vec_id, list(greatest(0, least(255, floor((x - lo) / scale + 0.5)))::BIGINT ORDER BY i) AS code FROM u JOIN s USING (i) GROUP BY vec_id"""


def sq8_knn(spark: SparkSession, d: str) -> DataFrame:
    codes, q = _sq8(spark, d)
    return _rounded(quantize.scored_codes(codes, q, _vector(spark, d), "euclidean").orderBy("distance", "vec_id").limit(TOP), "vec_id")


SQ8_KNN_SQL = f"""
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1.0 END AS scale FROM u GROUP BY i),
v AS (SELECT vec_id, i, greatest(0, least(255, floor((x - lo) / scale + 0.5))) * scale + lo AS y FROM u JOIN s USING (i)),
z AS (SELECT v.vec_id, sqrt(sum((y - q.x) * (y - q.x))) AS dist FROM v JOIN (SELECT i, x FROM u WHERE vec_id = 0) q USING (i) GROUP BY v.vec_id)
SELECT vec_id, round(dist, 6) + 0.0 AS distance FROM z ORDER BY dist, vec_id LIMIT {TOP}"""


#: Parts and bits of the codes; the rows that they rank first are scored by their vectors.
CODE = {"pq_dim": 32, "pq_bits": 6}


def reranked(n: int) -> int:
    """How many of ``n`` rows are scored again, so that recall stays as the table grows."""
    return max(10 * TOP, 2 * round(n**0.5))


def _codec_knn(codec: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e, query = _t(spark, d, "embeddings"), _vector(spark, d)
        q = quantize.train_on(e, QuantParams(codec, **CODE), "embedding", "vec_id")
        rough = quantize.scored_codes(quantize.encode_column(e, q, "embedding"), q, query, "cosine").orderBy("distance", "vec_id").limit(reranked(e.count()))
        return _rounded(search.exact_knn(rough.drop("distance"), query, TOP, "cosine", **_E), "vec_id")

    return run


def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    """Recall of codes and of inverted lists against exact search, over the query set of batch searches.

    The methods run side by side: while the driver fits the lists, tasks fit the codebooks.
    Those of pq are what opq starts from, and all are fitted on one draw of rows.
    """
    e, queries, sc = _t(spark, d, "embeddings"), _asked(spark, d), spark.sparkContext
    truth = search.batch_knn(e, queries, TOP, "cosine", **_E).persist()
    plain, rotated = (QuantParams(codec, pq_dim=32) for codec in ("pq", "opq"))

    def reached(found: DataFrame) -> float:
        known.result()
        return search.recall(found, truth, TOP).first()[0]

    def coded(q: quantize.Quantizer) -> float:
        return reached(quantize.batch_codes_knn(quantize.encode_column(e, q, "embedding"), q, queries, TOP, "cosine", "vec_id"))

    def listed() -> float:
        index = ivf.fitted(rows[: ivf.TRAIN_ROWS], ivf.lists_for(e.count()), "cosine")
        return reached(ivf.batch_search(ivf.assign(e, index, "embedding"), index, queries, TOP, ivf.probes_for(len(index.centroids)), "embedding", "vec_id"))

    with ThreadPoolExecutor() as pool:
        known = pool.submit(truth.count)
        rows = quantize.sample_matrix(e.filter(F.col("embedding").isNotNull()), "embedding", "vec_id", max(ivf.TRAIN_ROWS, plain.train_rows))
        of = {"ivf": pool.submit(listed), "sq8": pool.submit(lambda: coded(quantize.train_on(e, QuantParams("sq8"), "embedding", "vec_id")))}
        pq = quantize.train(rows[: plain.train_rows], plain, sc)
        of["pq"] = pool.submit(coded, pq)
        of["opq"] = pool.submit(coded, quantize.train(rows[: rotated.train_rows], rotated, sc, pq))
        out = [(method, of[method].result()) for method in FLOORS]
    truth.unpersist()
    return spark.createDataFrame(out, "method string, recall double").withColumn("recall", F.round("recall", 4))


def recall_floors(spark: SparkSession, d: str) -> DataFrame:
    """Whether codes alone, and lists at the default probes, find what they should of the ten nearest."""
    return recall_at_10(spark, d).select("method", (F.col("recall") >= F.element_at(F.create_map(*[F.lit(x) for m, r in FLOORS.items() for x in (m, r)]), F.col("method"))).alias("reached"))


def _ivf(spark: SparkSession, d: str, metric: str = "cosine") -> tuple[DataFrame, ivf.Ivf]:
    e = _t(spark, d, "embeddings")
    index = ivf.train(e, ivf.lists_for(e.count()), metric, "embedding", "vec_id")
    return ivf.assign(e, index, "embedding"), index


def ivf_flat_knn(spark: SparkSession, d: str) -> DataFrame:
    """All lists probed, so that the result is the exact one."""
    rows, index = _ivf(spark, d)
    return _rounded(ivf.search(rows, index, _vector(spark, d), TOP, len(index.centroids), **_E), *_HIT)


def ivf_batch(spark: SparkSession, d: str) -> DataFrame:
    rows, index = _ivf(spark, d)
    out = ivf.batch_search(rows, index, _asked(spark, d), TOP, len(index.centroids), "embedding", "vec_id")
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def ivf_filled(spark: SparkSession, d: str) -> DataFrame:
    """A selective filter: the search widens until it has ten rows or has read all lists."""
    rows, index = _ivf(spark, d)
    return _rounded(ivf.search_filled(rows, index, _vector(spark, d), TOP, 1, where=Filter.compare("label", "=", 4), **_E), *_HIT)


def ivf_pq_rerank(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    n = e.count()
    index = ivf.train_pq(e, ivf.lists_for(n), "cosine", QuantParams("pq", **CODE), "embedding", "vec_id")
    probes = ivf.probes_for(len(index.ivf.centroids))
    return _rounded(ivf.search_pq(ivf.encode_pq(e, index, "embedding"), index, _vector(spark, d), TOP, probes, "embedding", "vec_id", -(-reranked(n) // TOP)), *_HIT)


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    gone = store.latest(events, ["user_id"], ["ts", "event_id"]).filter("event_type = 'purchase'").select("user_id")
    return store.without(events, gone, ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


def discard_union(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    keys = docs.filter(F.col("doc_id").isin([1, 2, 3]))
    return keys.unionByName(search.matching(docs, Filter.compare("source", "=", "src3"))).select("doc_id").distinct()


def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    return x.groupBy("label", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    path = f"{_scratch(spark)}/jsonl-{uuid.uuid4().hex}"
    from .engine import _tagged

    fields = {f.name: f.dataType for f in docs.schema.fields}
    meta = F.map_from_arrays(F.array(F.lit("lang"), F.lit("n_chars")), F.array(_tagged(F.col("lang"), fields["lang"]), _tagged(F.col("n_chars"), fields["n_chars"])))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.array(F.col("doc_id").cast("float")).alias("vector"), meta.alias("meta"), F.struct(F.col("text"), F.lit(None).cast("string").alias("uri"), F.lit("text/plain").alias("mime_type")).alias("document"), *[F.lit(None).cast(jsonl.INPUT[n].dataType).alias(n) for n in ("chunk", "lineage")])
    jsonl.write_jsonl(rows, path)
    got = jsonl.read_jsonl(spark, path)
    return got.select(F.col("id").cast("long").alias("doc_id"), F.col("document.text").alias("text"), F.col("meta")["lang"]["s"].alias("lang"), F.col("meta")["n_chars"]["i"].alias("n_chars"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    out = mutations.windowed_counts(_t(spark, d, "events"))
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def embedder_vectors(spark: SparkSession, d: str) -> DataFrame:
    model = X.HashEmbedder(64, "compact")
    return X.embed_column(_t(spark, d, "conversations"), model).select("conv_id", "turn", F.round(V.magnitude(F.col("vector")), 4).alias("magnitude"))


def queries() -> dict[str, Query]:
    f = Filter.compare
    return {
        "knn_cosine_top10": _knn("cosine"),
        "knn_euclidean_top10": _knn("euclidean"),
        "knn_dot_top10": _knn("dot_product"),
        "knn_filtered_label": _knn("cosine", f("label", "=", 3)),
        "knn_in_set": _knn("euclidean", Filter.in_set("label", [1, 5, 7.0])),
        "knn_not_label": _knn("cosine", Filter.not_(f("label", "=", 0))),
        "range_threshold": _knn("cosine", None, 0.8, None),
        "batch_knn_20q": batch_knn,
        "batch_knn_joined": batch_knn_joined,
        "distance_matrix": distance_matrix,
        "row_top_k": row_top_k,
        "rank_by_label": rank_by_label,
        "vql_seek": vql_seek,
        "vql_scan": vql_scan,
        "vql_fetch": vql_fetch,
        "scan_contains": scan_contains,
        "scan_not_missing": scan_not_missing,
        "filter_tree": filter_tree,
        "pull_keys": pull_keys,
        "collection_stats": collection_stats,
        "normalize_magnitude": normalize_magnitude,
        "tokenize_docs": tokenize_docs,
        "lexical_overlap": lexical_overlap,
        "hybrid_search": hybrid_search,
        "hybrid_search_all": hybrid_search_all,
        "text_search": text_search,
        "sq8_encode": sq8_encode,
        "sq8_knn": sq8_knn,
        "pq_knn": _codec_knn("pq"),
        "opq_knn": _codec_knn("opq"),
        "recall_at_10": recall_at_10,
        "recall_floors": recall_floors,
        "ivf_flat_knn": ivf_flat_knn,
        "ivf_batch": ivf_batch,
        "ivf_filled": ivf_filled,
        "ivf_pq_rerank": ivf_pq_rerank,
        "upsert_latest": upsert_latest,
        "tombstone_anti_join": tombstones,
        "discard_union": discard_union,
        "centroid_by_label": centroid_by_label,
        "jsonl_roundtrip": jsonl_roundtrip,
        "windowed_events": windowed_events,
        "embedder_vectors": embedder_vectors,
    } | collection_queries.queries()


def oracle_sql() -> dict[str, str]:
    c = METRIC_SQL["cosine"]
    tok = _TOKENS_SQL.format
    overlap = "CASE WHEN len(b.q) > 0 AND len(d.t) > 0 THEN len(list_intersect(b.q, d.t))::DOUBLE / len(b.q) ELSE 0.0 END"
    latest = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
    return {
        "knn_cosine_top10": _knn_sql("cosine"),
        "knn_euclidean_top10": _knn_sql("euclidean"),
        "knn_dot_top10": _knn_sql("dot_product"),
        "knn_filtered_label": _knn_sql("cosine", "e.label = 3"),
        "knn_in_set": _knn_sql("euclidean", "e.label IN (1, 5, 7)"),
        "knn_not_label": _knn_sql("cosine", "NOT coalesce(e.label = 0, false)"),
        "range_threshold": _knn_sql("cosine", f"{c} <= 0.8", None),
        "batch_knn_20q": _batch_sql("cosine"),
        "batch_knn_joined": _batch_sql("euclidean"),
        "distance_matrix": f"SELECT q.vec_id AS a_id, e.vec_id AS b_id, round({METRIC_SQL['euclidean']}, 6) + 0.0 AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q",
        "row_top_k": f"SELECT a_id, rank::INTEGER AS rank, b_id, round(dist, 6) + 0.0 AS distance FROM (SELECT q.vec_id AS a_id, e.vec_id AS b_id, {METRIC_SQL['dot_product']} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {METRIC_SQL['dot_product']}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q) WHERE rank <= 5",
        "rank_by_label": f"SELECT row_number() OVER (ORDER BY label, dist, vec_id)::INTEGER AS position, vec_id, label, round(dist, 6) + 0.0 AS distance FROM (SELECT e.vec_id, e.label, {c} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dist, e.vec_id LIMIT 50)",
        "vql_seek": _knn_sql("cosine", "e.label IN (1, 3)"),
        "vql_scan": "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 ORDER BY doc_id LIMIT 50 OFFSET 5",
        "vql_fetch": "SELECT doc_id, lang, source, 0.0::DOUBLE AS distance FROM documents WHERE doc_id = 7",
        "scan_contains": "SELECT doc_id, source FROM documents WHERE contains(text, 'license') OR contains(text, 'License')",
        "scan_not_missing": "SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 1, false) AND lang <> 'en'",
        "filter_tree": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 20 AND l_quantity < 40.5 AND l_returnflag IN ('A', 'R') AND l_discount > 0.05::DOUBLE GROUP BY 1",
        "pull_keys": "SELECT doc_id, lang, CASE WHEN doc_id = 5 THEN 2 ELSE 1 END::BIGINT AS times FROM documents WHERE doc_id IN (3, 5, 8)",
        "collection_stats": " UNION ALL ".join(f"SELECT '{n}' AS vault, count(*) AS records FROM {n}" for n in TABLES),
        "normalize_magnitude": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings), m AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v) SELECT vec_id, round(n, 6) AS magnitude, round(sqrt(list_inner_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))), 6) AS unit, true AS finite FROM m",
        "tokenize_docs": f"SELECT doc_id, len({tok('text')})::BIGINT AS n_tokens, len(list_distinct({tok('text')}))::BIGINT AS n_distinct FROM documents",
        "lexical_overlap": f"WITH b AS (SELECT item_id, list_distinct({tok('text')}) AS q FROM benchmark), d AS (SELECT doc_id, list_distinct({tok('text')}) AS t FROM documents) SELECT doc_id, item_id, round({overlap}, 6) AS score FROM d, b",
        "hybrid_search": f"WITH b AS (SELECT list_distinct({tok('text')}) AS q FROM benchmark WHERE item_id = 0), n AS (SELECT e.vec_id, {c} AS dist, list_distinct({tok('t.text')}) AS t FROM embeddings e LEFT JOIN documents t ON t.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dist, e.vec_id LIMIT {5 * TOP}), f AS (SELECT vec_id, 0.7::DOUBLE * dist + 0.3::DOUBLE * (1.0 - {overlap.replace('d.t', 'n.t')}) AS dist FROM n, b) SELECT vec_id, round(dist, 6) + 0.0 AS distance FROM f ORDER BY dist, vec_id LIMIT {TOP}",
        "sq8_encode": SQ8_SQL,
        "sq8_knn": SQ8_KNN_SQL,
        "recall_floors": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', true)" for m in FLOORS) + ") t(method, reached)",
        "ivf_flat_knn": _knn_sql("cosine"),
        "ivf_batch": _batch_sql("cosine"),
        "upsert_latest": f"SELECT user_id, event_id, event_type, value FROM ({latest})",
        "tombstone_anti_join": f"SELECT event_type, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM ({latest}) WHERE event_type = 'purchase') GROUP BY 1",
        "discard_union": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (1, 2, 3) OR source = 'src3'",
        "centroid_by_label": "SELECT label, (i - 1)::INTEGER AS \"at\", round(avg(x::DOUBLE), 6) + 0.0 AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2",
        "jsonl_roundtrip": "SELECT doc_id, text, lang, n_chars FROM documents",
        "windowed_events": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    } | collection_queries.oracle_sql(_knn_sql("cosine"), SQ8_KNN_SQL)
