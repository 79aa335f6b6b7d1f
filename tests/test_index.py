"""The contract of indexes, for each type."""

import numpy as np
import pytest

from vecframe.config import Config, GraphParams
from vecframe.errors import ConfigError, StorageError
from vecframe.operators import index as ix

X = np.random.default_rng(3).normal(size=(700, 8))


def frame(spark, ids):
    return spark.createDataFrame([(i, X[i].tolist(), i % 5) for i in ids], "id long, vector array<double>, label int")


def nearest(ids, q, k):
    ids = np.array(ids)
    return ids[np.argsort(((X[ids] - q) ** 2).sum(1), kind="stable")[:k]].tolist()


@pytest.mark.parametrize("kind", ["exact", "graph"])
def test_contract(spark, tmp_path, kind):
    config = Config(8, "euclidean", kind, GraphParams(ef_search=1000, compaction_ratio=0.2))
    i = ix.make_index(spark, str(tmp_path / "work"), config)
    with pytest.raises(ConfigError):
        i.search(X[0], 3)
    i.insert(frame(spark, range(300)))
    assert i.type_name == kind and i.size() == 300
    assert [r.id for r in i.search(X[5], 10).collect()] == nearest(range(300), X[5], 10)
    assert i.remove([5, 6, 7, 5000]) == 3 and i.size() == 297 and 0 < i.tombstone_ratio() < 0.2
    assert 5 not in [r.id for r in i.search(X[5], 10).collect()]
    i.insert(frame(spark, range(290, 320)))
    assert i.size() == 317 and i.tombstone_ratio() == 0
    assert i.remove(frame(spark, range(100, 200))) == 100 and i.tombstone_ratio() == 0, "a vacuum came by itself"
    i.insert(frame(spark, range(320, 700)))
    live = sorted(set(range(700)) - {5, 6, 7} - set(range(100, 200)))
    assert i.size() == len(live)
    got = i.search_batch(spark.createDataFrame([(k, X[k].tolist()) for k in (1, 650)], "query_id long, query array<double>"), 4).collect()
    assert {(r.query_id, r["rank"]): r.id for r in got} == {(k, n + 1): v for k in (1, 650) for n, v in enumerate(nearest(live, X[k], 4))}
    i.save(str(tmp_path / "saved"))
    j = ix.ExactIndex.load(spark, str(tmp_path / "saved"), str(tmp_path / "other"), config.graph)
    assert type(j) is type(i) and j.size() == i.size()
    assert [r.id for r in j.search(X[9], 10).collect()] == nearest(live, X[9], 10)
    with pytest.raises(ConfigError):
        i.insert(spark.createDataFrame([(1, [1.0], 0)], "id long, vector array<double>, label int"))
    frame(spark, [900 - 300]).write.mode("append").parquet(str(tmp_path / "saved" / "rows"))
    with pytest.raises(StorageError):
        ix.ExactIndex.load(spark, str(tmp_path / "saved"), str(tmp_path / "other"))


def test_lists_are_trained_after_growth(spark, tmp_path):
    i = ix.make_index(spark, str(tmp_path), Config(8, "cosine"))
    i.insert(frame(spark, range(100)))
    first = len(i.lists.centroids)
    i.insert(frame(spark, range(100, 150)))
    assert len(i.lists.centroids) == first and i.live().filter("list_id IS NULL").count() == 0
    i.insert(frame(spark, range(150, 400)))
    assert len(i.lists.centroids) == 20 and i.size() == 400
