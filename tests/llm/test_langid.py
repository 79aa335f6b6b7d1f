import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import docs_of

from vecframe.llm import langid

D = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    got = langid.identify(docs.filter("doc_id % 2 = 1"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97
    assert abs(got.lang_prob.mean() - (got.lang == got.lang_pred).mean()) < 0.03
    assert 0 < (model.weights != 0).mean() < 0.6
    for r in got.head(20).itertuples():
        p = model.probabilities(r.text.encode())
        assert model.languages[p.argmax()] == r.lang_pred and abs(p.max() - r.lang_prob) < 1e-9


def test_document_frequencies_cover_all(spark):
    texts = ["ab", "abc", "", "b" * 200_000, "ÄB", None]
    df, n = langid.document_frequencies(docs_of(spark, list(enumerate(texts))).repartition(3))
    want = np.zeros(langid.SIZE, int)
    for t in texts[:-1]:
        want[langid.grams(t.encode())[0]] += 1
    assert n == 5 and (df == want).all()


def test_penalties_make_weights_sparse_and_temperature_fits():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 5 + rng.integers(100)]), np.array([0.9, 0.3]), y) for y in rng.integers(0, 3, 600)]
    w, b = langid.train(rows, 3)
    assert all((x @ w[a] + b).argmax() == y for a, x, y in rows)
    assert (langid.train(rows, 3, l1=5.0)[0] != 0).sum() < (w != 0).sum()
    y = rng.integers(0, 3, 4000)
    z = np.eye(3)[np.where(rng.random(4000) < 0.7, y, rng.integers(0, 3, 4000))] * 20
    assert langid.temperature(z, y) > 5 and langid.temperature(z[:0], y[:0]) == 1.0


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, "the cat", "en", "a"), (2, "le chat", "fr", None), (2, "le chat", "fr", None), (None, None, None, None), (3, "", "en", "a"), (4, "the dog " * 50_000, None, "b")]).selectExpr("*", "'x' AS lang_pred", "1 AS lang_found", "2 AS `a.b`")
    got = langid.identify(docs, langid.fit(docs))
    assert got.columns == [*docs.columns, "_lang_pred", "lang_prob"] and got.count() == 6
    assert all((r._lang_pred is None) == (not r.text) for r in got.collect())
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert langid.fit(none) is None and {r.lang_pred for r in langid.identify(none, None).collect()} == {None}
    assert langid.fit(docs.limit(0)) is None and langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def test_training_step_by_step():
    """FTRL-proximal with plain loops over coordinates gives the same weights."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 6)), None, int(rng.integers(3))) for _ in range(50)]
    rows = [(a, rng.random(len(a)), y) for a, _, y in rows]
    w, b = langid.train(rows, 3, seed=1, epochs=2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        v = z[i, c]
        return 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(1)
    for _ in range(2):
        for r in order.permutation(50):
            at, x, y = rows[r]
            x = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
            now = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            s = [sum(v * now[i, c] for i, v in x) for c in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(3):
                p = e[c] / sum(e) - (c == y)
                for i, v in x:
                    g = v * p
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / langid.ALPHA * now[i, c]
                    n[i, c] += g * g
    for c in range(3):
        assert abs(b[c] - weight("bias", c)) < 1e-9
        assert all(abs(w[i, c] - weight(i, c)) < 1e-9 for i in range(40))


def test_query_by_plain_loops(spark):
    """Every document's n-grams, weights and probabilities, by loops and the model's numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.lang_prob) for r in langid.op5(spark, "/root/testdata/sf0.001").collect()}
    mask = 0xFFFFFFFF
    a, b, c = (int(x) for x in (langid._A, langid._B, langid._C))
    for r in docs.collect():
        one = [(ord(x) + 1) * a & mask for x in r.text.lower()]
        two = [((x ^ x >> 15) * b + y) & mask for x, y in zip(one, one[1:])]
        two = [(x ^ x >> 13) * c & mask for x in two]
        three = [((x ^ x >> 16) * b + y) & mask for x, y in zip(two, one[2:])]
        three = [(x ^ x >> 13) * a & mask for x in three]
        counts = Counter(x >> 32 - langid.BITS for x in one + two + three)
        v = {i: (1 + math.log(n)) * m.idf[i] for i, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        s = [(sum(x / size * m.weights[i, k] for i, x in v.items()) + m.bias[k]) / m.temperature for k in range(len(m.languages))]
        e = [math.exp(x - max(s)) for x in s]
        best = e.index(max(e))
        assert got[r.doc_id] == (m.languages[best], pytest.approx(e[best] / sum(e), abs=1e-6))


def test_rows_without_ids_are_drawn_one_by_one(spark):
    rows = [(None, f"some text number {i} {'abc'[i % 3] * 9}", "en" if i % 2 else "fr", "a") for i in range(600)] + [(5, "the very same row", "en", "a")] * 400
    docs = docs_of(spark, rows).repartition(3)
    seen = []
    kept, langid.train = langid.train, lambda rows, *a, **k: seen.append(len(rows)) or kept(rows, *a, **k)
    try:
        langid.fit(docs, per_language=100)
    finally:
        langid.train = kept
    assert 80 <= seen[0] <= 200
