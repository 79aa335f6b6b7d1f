"""Recall of codes and inverted lists against brute force, every row being a query."""

import numpy as np
import pytest

from vecframe import queries as q
from vecframe.config import QuantParams
from vecframe.operators import ivf, quantize

SIZES = ["sf0.001", "sf0.1"]


def table(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    return e, np.array([r[0] for r in e.orderBy("vec_id").select("embedding").collect()], np.float64)


def best(d, k=10):
    return np.argsort(d, 1, kind="stable")[:, :k]


def recall(seen, x):
    """Of what exact scores of the rows in ``seen`` (queries, rows) find."""
    d = 1 - x @ x.T
    got, want = best(np.where(seen, d, np.inf)), best(d)
    return np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want)])


def first(rough, k):
    seen = np.zeros(rough.shape, bool)
    np.put_along_axis(seen, best(rough, k), True, 1)
    return seen


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("codec", ["pq", "opq"])
def test_codes(spark, sf, codec):
    e, x = table(spark, sf)
    c = quantize.train_on(e, QuantParams(codec, **q.CODE), "embedding", "vec_id")
    assert recall(first(1 - x @ c.decode(c.encode(x)).T, q.reranked(len(x))), x) >= 0.9


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("ef_search", [16, 50])
def test_lists(spark, sf, ef_search):
    e, x = table(spark, sf)
    index = ivf.train_pq(e, ivf.lists_for(len(x)), "cosine", QuantParams("pq", **q.CODE), "embedding", "vec_id")
    c = index.ivf.centroids
    at = (x @ c.T).argmax(1)
    probed = np.zeros((len(x), len(c)), bool)
    np.put_along_axis(probed, best(1 - x @ c.T, ivf.probes_for(len(c), ef_search)), True, 1)
    assert recall(probed[:, at], x) >= 0.9
    rough = 1 - x @ (c[at] + index.codec.decode(index.codec.encode(x - c[at]))).T
    assert recall(first(np.where(probed[:, at], rough, np.inf), q.reranked(len(x))) & probed[:, at], x) >= 0.9


@pytest.mark.parametrize("name", ["pq_knn", "opq_knn", "ivf_pq_rerank"])
def test_queries(spark, name, monkeypatch):
    _, x = table(spark, "sf0.1")
    hits = 0
    for key in (1, 500, 1000, 1500):
        monkeypatch.setattr(q, "_vector", lambda spark, d, key=key: x[key].tolist())
        got = {r.vec_id for r in q.queries()[name](spark, "/root/testdata/sf0.1").collect()}
        hits += len(got & set(best(1 - x[key : key + 1] @ x.T)[0].tolist()))
    assert hits >= 36
