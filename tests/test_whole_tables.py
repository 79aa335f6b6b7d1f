"""Queries over whole tables against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from vecframe import queries as q
from vecframe.config import QuantParams
from vecframe.functions import text as X
from vecframe.operators import ivf, quantize, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def distances(x, metric):
    if metric == "euclidean":
        return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return (1.0 if metric == "cosine" else 0.0) - (x[:, None] * x[None]).sum(2)


@pytest.mark.parametrize("name, metric, k", [("batch_knn_20q", "cosine", 10), ("batch_knn_joined", "euclidean", 10), ("ivf_batch", "cosine", 10), ("row_top_k", "dot_product", 5)])
def test_every_fiftieth_row_is_a_query(spark, vectors, name, metric, k):
    ids, x = vectors
    d = distances(x, metric)
    got = {(r[0], r[1]): (r[2], r[3]) for r in q.queries()[name](spark, SF).collect()}
    asked = [i for i, v in enumerate(ids) if v % 50 == 0]
    assert len(got) == k * len(asked) and len(asked) == 10
    for i in asked:
        row = d[i]
        for rank, j in enumerate(np.lexsort((ids, row))[:k], 1):
            assert got[ids[i], rank] == (ids[j], pytest.approx(row[j], abs=2e-6))


def test_distance_matrix_has_every_row(spark, vectors):
    ids, x = vectors
    at, d = {v: i for i, v in enumerate(ids)}, distances(x, "euclidean")
    got = {(r[0], r[1]): r[2] for r in q.distance_matrix(spark, SF).collect()}
    assert got.keys() == {(a, b) for a in ids if a % 50 == 0 for b in ids} and all(abs(d[at[a], at[b]] - v) < 2e-6 for (a, b), v in got.items())


def test_recall_is_over_the_query_set(spark, vectors, monkeypatch):
    asked, recall = [], search.recall
    monkeypatch.setattr(search, "recall", lambda found, truth, k: asked.append(truth.select("query_id").distinct().count()) or recall(found, truth, k))
    q.recall_at_10(spark, SF)
    assert asked == [10] * 4


def test_ties_are_broken_by_id_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD_CELLS", 16)
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(400)], "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2)]) for i in range(7)], "query_id long, query array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in search.batch_knn(rows, asked, 3, "euclidean").collect()}
    assert got == {(i, k + 1): i % 2 + 2 * k for i in range(7) for k in range(3)}


def overlap(item, doc):
    a, b = set(X.tokens_of(item or "")), set(X.tokens_of(doc or ""))
    return len(a & b) / len(a) if a else 0.0


def test_overlap_with_every_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    got = {(r.doc_id, r.item_id): r.score for r in q.lexical_overlap(spark, SF).collect()}
    assert got.keys() == {(a[0], b[0]) for a in docs for b in items}
    for a in docs:
        for b in items:
            assert abs(got[a[0], b[0]] - overlap(b[1], a[1])) < 1e-6


@pytest.mark.parametrize("items", [1000, 2])
def test_overlap_of_odd_rows(spark, tmp_path, monkeypatch, items):
    monkeypatch.setattr(q, "ITEMS", items)
    docs = [(1, None), (2, ""), (3, "A b, a"), (3, "c")]
    rows = [(0, "a B"), (1, ""), (2, None), (7, "c d")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, q.lexical_overlap(spark, str(tmp_path)).collect()))
    assert got == sorted((i, j, overlap(b, a)) for i, a in docs for j, b in rows)


def test_hybrid_search_sees_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    text = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id = 0").first()["text"]
    model = X.HashEmbedder(128)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    asked = unit(model.embed(text).astype(np.float64))
    near = sorted((1.0 - unit(model.embed(t).astype(np.float64)) @ asked, i, t) for i, t in docs)[:50]
    want = sorted((0.7 * x + 0.3 * (1 - overlap(text, t)), i) for x, i, t in near)[:10]
    got = [(r.doc_id, r.distance) for r in q.hybrid_search_all(spark, SF).collect()]
    assert [i for i, _ in got] == [i for _, i in want] and np.allclose([x for _, x in got], [x for x, _ in want], atol=2e-6)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
@pytest.mark.parametrize("held", [search.HELD_VALUES, 0])
def test_blocks_of_rows_and_queries(spark, monkeypatch, metric, held):
    """Neither ties nor block sizes change what is found; rows without a vector aren't."""
    monkeypatch.setattr(search, "BLOCK_VALUES", 150)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (200, 4)).astype(float)
    rows = spark.createDataFrame([(f"r{i:03}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i * 2].tolist()) for i in range(90)] + [(1000, None)], "query_id long, query array<double>")
    exact = lambda q: np.sqrt(((x - q) ** 2).sum(1)) if metric == "euclidean" else (1.0 if metric == "cosine" else 0.0) - (x * q).sum(1)
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in search.batch_knn(rows, asked, 7, metric, held_values=held).collect()}
    want = {}
    for i in range(90):
        d = exact(x[i * 2])
        for rank, j in enumerate(np.lexsort((np.arange(200), d))[:7], 1):
            want[i, rank] = (f"r{j:03}", pytest.approx(d[j]))
    assert got == want
    pairs = {(r.a_id, r.b_id): r.distance for r in search.distance_matrix(asked, rows, metric, "query_id", "id", "query", "vector", held).collect()}
    assert pairs == {(i, f"r{j:03}"): pytest.approx(v) for i in range(90) for j, v in enumerate(exact(x[i * 2]))}
    assert search.batch_knn(rows.limit(0), asked, 3, metric, held_values=held).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
@pytest.mark.parametrize("held", [search.HELD_VALUES, 0])
def test_vectors_far_from_the_origin(spark, metric, held):
    """Both ways give the true neighbours where matrix products round away all differences."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 16) * 2e5 + rng.normal(0, 1e-4, (3000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i * 500].tolist()) for i in range(5)], "query_id long, query array<double>")
    got = {}
    for r in search.batch_knn(rows, asked, 10, metric, held_values=held).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for i in range(5):
        q = x[i * 500]
        if metric == "euclidean":
            want = sorted((np.sqrt(((v - q) ** 2).sum()), j) for j, v in enumerate(x))[:10]
            assert [j for _, j in sorted(got[i])] == [j for _, j in want]
        else:
            d = -(x * q).sum(1)
            assert all(d[j] <= np.sort(d)[9] + abs(d).max() * 1e-14 for _, j in got[i])


def test_range_search_has_no_limit_of_its_own(spark):
    rows = spark.range(120_000).selectExpr("id", "array(1.0D, 0.0D) AS vector")
    assert search.range_search(rows, [1.0, 0.0], 0.5).count() == 120_000
    assert search.range_search(rows, [1.0, 0.0], 0.5, top=7).count() == 7


def test_embedder_adds_up_its_features():
    """Vectors of batches are those of the features one by one."""
    texts = ["Hello, big WORLD of a b hello", "", "x", "ab12 " * 300 + "y" * 400, "é_ü ä", "one two three one two"]
    for model in (X.HashEmbedder(48), X.HashEmbedder(33, "compact")):
        seed, _, _, projections = X._MODELS[model.model, model.revision]
        for t, got in zip(texts, model.embed_batch(texts)):
            want = np.zeros(model.dimension)
            for f in model.features(t):
                for p in range(projections):
                    h = X.mix64(((X.fnv1a(f.encode()) ^ seed) + p * 0x9E3779B97F4A7C15) & X._M64)
                    want[h % model.dimension] += (1 if h >> 63 else -1) / (p + 1)
            assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("codec, metric", [("sq8", "cosine"), ("pq", "euclidean"), ("opq", "cosine")])
def test_batches_of_queries_score_codes_by_blocks(spark, monkeypatch, codec, metric):
    """Every query finds the codes of the least scores, ties by id, without a pass over the rows for each query."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x = np.repeat(x[:3], 100, 0) if codec == "pq" else x
    c = quantize.train(x, QuantParams(codec, 4, 4))
    rows = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(c.encode(x))] + [(999, None)], "id long, codes binary").repartition(3)
    asked = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(7)], "query_id long, query array<double>")
    want = {}
    for r in asked.collect():
        d = np.round(c.scores(c.encode(x), np.array(r.query), metric), 9)
        want |= {(r.query_id, n): (j, pytest.approx(d[j])) for n, j in enumerate(np.lexsort((np.arange(300), d))[:5].tolist(), 1)}
    monkeypatch.setattr(quantize.Quantizer, "scores", None)
    for held in (search.HELD_VALUES, 0):
        assert {(r.query_id, r["rank"]): (r.id, r.distance) for r in quantize.batch_codes_knn(rows, c, asked, 5, metric, held_values=held).collect()} == want


@pytest.mark.parametrize("codec", ["pq", "opq"])
def test_tasks_fit_the_same_codebooks(spark, monkeypatch, codec):
    monkeypatch.setattr(quantize, "TASK_CELLS", 1000)
    x, params = np.random.default_rng(4).normal(size=(500, 12)), QuantParams(codec, 4, 4)
    here = quantize.train(x, params)
    monkeypatch.setattr(quantize, "kmeans", None)  # tasks have their own
    there = quantize.train(x, params, spark.sparkContext)
    assert np.allclose(here.books, there.books) and (codec == "pq" or np.allclose(here.rotation, there.rotation))


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
@pytest.mark.parametrize("nprobe", [1, 4, 9])
def test_lists_are_searched_by_blocks(spark, metric, nprobe):
    """A query finds the nearest rows of its lists; no join makes a row of each pair."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (400, 4)).astype(float)
    index = ivf.Ivf(rng.normal(size=(9, 4)), metric)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)] + [(1000, None)], "query_id long, query array<double>")
    at, want = ivf.nearest_lists(x, index), {}
    for i in range(40):
        d = (np.sqrt(((x - x[i]) ** 2).sum(1)) if metric == "euclidean" else (metric == "cosine") - (x * x[i]).sum(1)) + np.where(np.isin(at, index.order(x[i])[:nprobe]), 0, np.inf)
        want |= {(i, n): (j, pytest.approx(d[j])) for n, j in enumerate(np.lexsort((np.arange(400), d))[:6].tolist(), 1) if d[j] < np.inf}
    for held in (search.HELD_VALUES, 0):
        found = ivf.batch_search(ivf.assign(rows, index), index, asked, 6, nprobe, held_values=held)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.query_id, r["rank"]): (r.id, r.distance) for r in found.collect()} == want


@pytest.mark.parametrize("metric", ["euclidean", "dot_product"])
def test_row_top_k_makes_no_matrix(spark, monkeypatch, metric):
    """Ties by id, rows of any id type; no task makes or sorts a row for each pair."""
    monkeypatch.setattr(search, "_all_of", None)
    x = np.random.default_rng(6).integers(-2, 3, (300, 4)).astype(float)
    b = spark.createDataFrame([(f"r{i:03}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "id string, vector array<double>").repartition(3)
    a = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)] + [(1000, None)], "key long, of array<double>")
    want = {}
    for i in range(50):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) if metric == "euclidean" else -(x * x[i]).sum(1)
        want |= {(i, n): (f"r{j:03}", pytest.approx(d[j])) for n, j in enumerate(np.lexsort((np.arange(300), d))[:5], 1)}
    for held in (search.HELD_VALUES, 0):
        got = search.row_top_k(a, b, 5, metric, "key", "id", "of", "vector", held).collect()
        assert {(r.a_id, r["rank"]): (r.b_id, r.distance) for r in got} == want


@pytest.mark.parametrize("metric", ["euclidean", "dot_product"])
@pytest.mark.parametrize("held", [search.HELD_VALUES, 0])
def test_odd_vectors_come_last_and_hide_no_others(spark, metric, held):
    """A vector with NaN or infinity changes nothing for the rest of its block; NaN is more than any distance, as in SQL."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4))
    x[50:150, 1], x[150], x[151] = np.nan, np.inf, -np.inf
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(2)
    a = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 1, 60, 150)], "query_id long, query array<double>")
    index, want = ivf.Ivf(rng.normal(size=(3, 4)), metric), {}
    for k in (5, 120):
        for i in (0, 1, 60, 150):
            with np.errstate(invalid="ignore"):
                d = np.sqrt(((x - x[i]) ** 2).sum(1)) if metric == "euclidean" else -(x * x[i]).sum(1)
            want[i] = np.lexsort((np.arange(200), np.nan_to_num(d, posinf=np.inf, neginf=-np.inf), np.isnan(d)))[:k].tolist()
        for found in (search.batch_knn(b, a, k, metric, held_values=held), ivf.batch_search(ivf.assign(b, index), index, a, k, 3, held_values=held)):
            got = {}
            for r in sorted(found.collect(), key=lambda r: r["rank"]):
                got.setdefault(r.query_id, []).append(r.id)
            assert got == want
    for nprobe in (2, 3):
        assert ivf.batch_search(ivf.assign(b, index), index, a.limit(0), 5, nprobe, held_values=held).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
def test_pairs_of_a_block_come_by_distance(monkeypatch, metric):
    """Each pair is there once, equal distances of a block lie together, and no batch is large."""
    monkeypatch.setattr(search, "HELD_CELLS", 5 * 70)
    monkeypatch.setattr(search, "HELD_ROWS", 100)
    rng = np.random.default_rng(8)
    x, ids = rng.integers(-2, 3, (70, 4)).astype(float), [f"q{i}" for i in range(12)]
    part = pa.RecordBatch.from_arrays([pa.array(range(70)), pa.array(x.tolist())], names=["id", "v"])
    batches = [b.to_pydict() for b in search._all_of(ids, x[:12], part, metric)]
    assert [len(b["a_id"]) for b in batches] == [100, 100, 100, 50] * 2 + [100, 40]
    got, d = [r for b in batches for r in zip(b["a_id"], b["b_id"], b["distance"])], np.array([t for b in batches for t in b["distance"]])
    assert all((np.diff(d[at : at + 350]) >= 0).all() for at in (0, 350, 700))
    want = np.sqrt(((x[None] - x[:12, None]) ** 2).sum(2)) if metric == "euclidean" else (metric == "cosine") - x[:12] @ x.T
    assert {(a, b): t for a, b, t in got} == {(f"q{i}", j): pytest.approx(want[i, j]) for i in range(12) for j in range(70)} and len(got) == 840


def test_recall_floors_take_no_pass_for_each_query(spark, monkeypatch):
    monkeypatch.setattr(quantize.Quantizer, "scores", None)
    monkeypatch.setattr(quantize, "TASK_CELLS", 0)
    assert sorted(map(tuple, q.recall_floors(spark, SF).collect())) == [(m, True) for m in sorted(q.FLOORS)]


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "equal", "line", "far"])
def test_narrow_parts_are_fitted_with_few_distances(monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    x = {"normal": x, "ties": np.round(x * 2), "copies": np.repeat(x[:50], 80, 0), "equal": x * 0, "line": x * [1, 0], "far": x * [1, 1e-3] + [30, 0]}[kind]
    want = _lloyd(x, 64, 20)
    compared, nearest = [], quantize.nearest
    monkeypatch.setattr(quantize, "nearest", lambda x, *a: compared.append(len(x)) or nearest(x, *a))
    got = quantize.kmeans(x, 64, 20)
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    assert kind != "normal" or sum(compared) < 6 * len(x)


def _lloyd(x, k, iterations):
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(iterations):
        at, d = quantize.nearest(x, c)
        new, sizes = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(new, at, x)
        new /= np.maximum(sizes, 1)[:, None]
        new[sizes == 0] = x[np.argsort(-d, kind="stable")[np.arange((sizes == 0).sum()) % len(x)]]
        c = new
    return c


def test_opq_begins_with_the_books_of_pq():
    x = np.random.default_rng(5).normal(size=(600, 8))
    pq, opq = (quantize.train(x, QuantParams(c, pq_dim=4, pq_bits=6)) for c in ("pq", "opq"))
    got = quantize.train(x, QuantParams("opq", pq_dim=4, pq_bits=6), None, pq)
    assert np.array_equal(got.books, opq.books) and np.array_equal(got.rotation, opq.rotation)


def test_recall_draws_rows_and_fits_books_without_rotation_once(spark, monkeypatch):
    drawn, fitted, sample, kmeans = [], [], quantize.sample_matrix, quantize.kmeans
    monkeypatch.setattr(quantize, "sample_matrix", lambda *a: drawn.append(a) or sample(*a))
    monkeypatch.setattr(quantize, "kmeans", lambda x, *a: fitted.append(x.shape[1]) or kmeans(x, *a))
    monkeypatch.setattr(quantize, "TASK_CELLS", 1 << 60)
    assert {m for m, _ in q.recall_at_10(spark, SF).collect()} == {*q.FLOORS}
    assert len(drawn) == 1 and fitted.count(2) == 7 * 32 and len(fitted) == 7 * 32 + 1


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_columns_of_vectors_keep_rows_without_one(kind):
    x = np.random.default_rng(2).normal(size=(7, 4)).astype(kind.to_pandas_dtype())
    rows = [None, *x[:3], None, *x[3:], None]
    got = quantize.of_vectors(pa.array(rows, pa.list_(kind)).slice(1), lambda m: pa.array(m.sum(1)), pa.float64())
    assert got.to_pylist() == [None if r is None else pytest.approx(r.astype(np.float64).sum()) for r in rows[1:]]
    for empty in ([], [None, None]):
        assert quantize.of_vectors(pa.array(empty, pa.list_(kind)), None, pa.int32()).to_pylist() == empty


@pytest.mark.parametrize("codec", ["sq8", "pq", "opq"])
def test_codes_and_lists_of_rows_without_vectors(spark, vectors, codec):
    ids, x = vectors
    rows = spark.createDataFrame([(i, None if i % 3 == 1 else v.tolist()) for i, v in zip(ids[:90], x[:90])], "id long, vector array<float>").coalesce(2)
    c, index = quantize.train(x, QuantParams(codec, 4, 4)), ivf.Ivf(x[:5], "cosine")
    got = {r.id: (r.codes, r.list_id) for r in ivf.assign(quantize.encode_column(rows, c), index).collect()}
    codes, lists = c.encode(x[:90].astype(np.float32)), ivf.nearest_lists(x[:90], index)
    assert got == {i: (None, None) if i % 3 == 1 else (codes[j].tobytes(), lists[j]) for j, i in enumerate(ids[:90])}
