import math
from collections import Counter

import numpy as np
from llm_cases import docs_of

from vecframe.llm import quality as q

D = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model = q.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = q.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "quality_score").toPandas()
    keep = got.quality_score > 0
    assert keep[got.quality == 1].mean() >= 0.95 and keep[got.quality == 0].mean() <= 0.15
    for r in docs.limit(20).collect():
        x = q.features(r.text.encode())
        one = q.score(docs.filter(f"doc_id = {r.doc_id}"), model).first().quality_score
        assert abs(one - (((x - model.mean) / model.scale) @ model.weights + model.bias)) < 1e-6


def test_risk_recovers_classes_and_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (2000, 3)), rng.normal(-1.5, 1, (600, 3))
    m = q.train(good[:500], np.vstack([good[500:], bad]))
    assert abs(m.prior - 1500 / 2100) < 0.15
    assert (m.scores(good) > 0).mean() > 0.93 and (m.scores(bad) > 0).mean() < 0.1


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, "good text here"), (1, "good text here"), (2, None), (None, ""), (3, "x" * 400_000), (None, None, None, None)]).selectExpr("*", "9 AS quality_score", "8 AS `a.b`")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0)], "doc_id long, quality int")
    got = q.keep_good(docs, labels, out="quality_score")
    assert got.columns == [*docs.columns, "_quality_score"]
    rows = got.collect()
    assert all(r.text is not None and r._quality_score > 0 for r in rows) and sum(r.doc_id == 1 for r in rows) in (0, 2)
    scored = q.score(docs, q.fit(docs, labels), out="s").collect()
    assert len(scored) == 6 and all((r.s is None) == (r.text is None) for r in scored)
    assert q.keep_good(docs, labels.filter("quality = 0")).count() == 6
    assert q.keep_good(docs.limit(0), labels).count() == 0 and q.keep_good(docs, labels.limit(0)).count() == 6
    assert not q.features(b"").any()


def plain_risk(w, p, u, pi):
    """The non-negative risk of a linear score by plain loops."""
    score = lambda x: sum(a * b for a, b in zip(x, w)) + w[-1]
    loss = lambda z: math.log1p(math.exp(-z))
    right = sum(loss(score(x)) for x in p) / len(p)
    wrong = sum(loss(-score(x)) for x in p) / len(p)
    rest = sum(loss(-score(x)) for x in u) / len(u) - pi * wrong
    return pi * right + max(0.0, rest), rest


def test_risk_and_gradients_by_plain_loops():
    rng = np.random.default_rng(3)
    p, u = rng.normal(0.5, 1, (30, 4)), rng.normal(0, 1, (70, 4))
    for scale in (0.1, 1.0, 4.0):
        w = rng.normal(0, scale, 5)
        value, rest, g, g_rest, h = q.risk(w, p, q._Rows(u), len(u), 0.4, np.zeros(5))
        want, want_rest = plain_risk(w.tolist(), p.tolist(), u.tolist(), 0.4)
        assert abs(value - want) < 1e-9 and abs(rest - want_rest) < 1e-9
        for k in range(5):
            step = np.eye(5)[k] * 1e-6
            part = lambda v: plain_risk(v.tolist(), p.tolist(), u.tolist(), 0.4)  # noqa: B023, E731
            (a, ra), (b, rb) = part(w + step), part(w - step)
            assert abs((ra - rb) / 2e-6 - g_rest[k]) < 1e-5
            assert abs((a - max(0, ra) - b + max(0, rb)) / 2e-6 - g[k]) < 1e-5
    curve = q.risk(w + 1e-5, p, q._Rows(u), len(u), 0.4, np.zeros(5))[3] + q.risk(w + 1e-5, p, q._Rows(u), len(u), 0.4, np.zeros(5))[2]
    assert np.allclose((curve - g - g_rest) / 1e-5, h.sum(1), atol=1e-3)


def test_training_finds_the_least_risk():
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (200, 3)), np.vstack([rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (300, 3))])
    m = q.train(p, u, prior=0.5)
    x, y = (p - m.mean) / m.scale, (u - m.mean) / m.scale
    decay = 1e-3 + q.RIDGE / len(u)
    cost = lambda w: plain_risk([*w], x.tolist(), y.tolist(), 0.5)[0] + decay / 2 * float(w[:-1] @ w[:-1])
    best = np.append(m.weights, m.bias)
    assert all(cost(best) <= cost(best + rng.normal(0, 0.05, 4)) + 1e-4 for _ in range(30))


def test_query_by_plain_loops(spark):
    """Every document's score and fate, from the table as it is, by the model's weights and loops over bytes."""
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    m = q.fit(docs, labels)
    kinds = [" \t", "\r\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "'\"", "()[]{}<>", "|", "&@#$%*", "-_/\\", "=+~^`"]
    of = {b: next((k for k, c in enumerate(kinds) if chr(b) in c), 15) if b < 128 else 14 for b in range(256)}
    want = {}
    for r in docs.collect():
        raw = r.text.encode()
        k = [of[b] for b in raw]
        pairs = Counter(zip(k, k[1:]))
        words, lines = raw.split(), raw.split(b"\n")
        n = max(1, len(words))
        x = [math.sqrt(pairs[a, b] / max(1, len(raw) - 1)) for a in range(16) for b in range(16)]
        x += [sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), min(len(raw) / n, 50) / 10, math.log1p(len(raw)) / 10, math.log1p(n / len(lines)) / 5, k.count(3) / len(raw)]
        want[r.doc_id] = sum((v - a) / b * w for v, a, b, w in zip(x, m.mean, m.scale, m.weights)) + m.bias
    got = {r.doc_id: r.quality_score for r in q.op4(spark, D).collect()}
    near = {i for i, v in want.items() if abs(v) < 1e-3}
    assert got.keys() - near == {i for i, v in want.items() if v > 0} - near
    assert all(abs(v - want[i]) < 1e-3 for i, v in got.items())


def test_every_unlabelled_document_counts(spark):
    """Sums in Spark are those over all rows, whatever their partitions."""
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    a, b = q.fit(docs, labels), q.fit(docs.repartition(7), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and a.prior == b.prior
    x = np.array([q.features((r.text or "").encode()).astype(np.float16) for r in docs.collect()], np.float64)
    assert np.allclose(a.mean, x.mean(0))
