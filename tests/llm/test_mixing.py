import hashlib
import random
import re
from collections import defaultdict

import pytest
from llm_cases import bag, docs_of

from vecframe.llm import mixing


def brute(rows, weights, default, budget=None, tenths=9):
    """(doc_id, source, n_tokens, finish_time) of the mixture; rows are (doc_id, text, lang, source)."""
    of = defaultdict(list)
    for i, text, _, source in rows:
        w = weights.get(source, default)
        if w > 0:
            key = hashlib.md5((mixing.SEED + ":" + ("" if i is None else str(i))).encode()).hexdigest()
            of[source].append((key, i, len(re.findall(r"[^ \t\r\n]+", text or "")), w))
    timed = []
    for source, items in of.items():
        for key, i, n, w in items:
            timed.append((i, source, n, float(sum(m for k, _, m, _ in items if k <= key)) / w))
    budget = sum(r[2] for r in timed) * tenths // 10 if budget is None else budget
    return [r for r in timed if sum(x[2] for x in timed if x[3] <= r[3]) <= budget]


def rows_of(n=120):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["src1", "src2", "x", None])) for i in range(n)]
    return rows + [(3, "tied tie", "en", "src1"), rows[5], (None, "a b", None, None), (None, None, None, "src1"), (500, "", "en", "x"), (501, "long " * 3000, "en", "zero")]


@pytest.mark.parametrize("fine", [200_000, 4])
@pytest.mark.parametrize("budget", [None, 0, 1, 700, 10**9])
def test_same_as_brute_force(spark, monkeypatch, fine, budget):
    monkeypatch.setattr(mixing, "FINE_ROWS", fine)
    monkeypatch.setattr(mixing, "BINS", 8)
    rows, weights = rows_of(), {"src1": 3.0, "src2": 0.5, "zero": 0.0}
    got = mixing.mix(docs_of(spark, rows), weights, 1.0, budget)
    want = brute(rows, weights, 1.0, budget)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    times = [r.finish_time for r in got.collect()]
    assert times == sorted(times)


def test_documents_are_those_of_the_mixture(spark):
    rows, weights = rows_of(), {"src1": 3.0, "zero": 0.0}
    docs = docs_of(spark, rows).selectExpr("*", "1 AS mix_key", "2 AS mix_last", "3 AS finish_time", "4 AS `a.b`")
    got = mixing.mix_documents(docs, weights)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.source) for r in got.collect()], key=repr) == sorted([x[:2] for x in brute(rows, weights, 1.0)], key=repr)
    assert not bag(got) - bag(docs)


def test_shares_follow_weights(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(docs_of(spark, rows), {"a": 3.0, "b": 1.0}, budget=1000).collect()
    n = {s: sum(r.n_tokens for r in got if r.source == s) for s in "ab"}
    assert abs(n["a"] - 3 * n["b"]) <= 40 and 980 <= sum(n.values()) <= 1000


def test_no_rows(spark):
    docs = docs_of(spark, [(1, "a")])
    assert mixing.mix(docs.limit(0), {}).count() == 0 and mixing.mix_documents(docs.limit(0), {}).count() == 0
    assert mixing.mix_documents(docs, {}, default=0.0).count() == 0
