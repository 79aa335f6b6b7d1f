import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from llm_cases import bag, docs_of

from vecframe.llm.exact_dedup import exact_dedup, radix_groups


def brute(rows):
    best, n = {}, {}
    for r in rows:
        if r[1] is not None:
            n[r[1]] = n.get(r[1], 0) + 1
            key = (r[0] is None, r[0] if r[0] is not None else 0)
            if r[1] not in best or key < best[r[1]][0]:
                best[r[1]] = (key, r[0])
    return sorted([(t, i, n[t]) for t, (_, i) in best.items()], key=repr)


@pytest.mark.parametrize("limits", [{}, {"split_bytes": 400, "split_rows": 3, "held_bytes": 100}])
def test_same_as_brute_force(spark, limits):
    rng = random.Random(3)
    stem = "p" * 70
    texts = ["", "a", "ab", "é", "é", stem, stem + "x", stem * 10 + "1", stem * 10 + "2", "z" * 300_000, "z" * 299_999 + "y"]
    texts += [stem + "".join(rng.choice("xy") for _ in range(4)) for _ in range(20)]
    rows = [(rng.randrange(1000), rng.choice(texts)) for _ in range(300)] + [(None, "a"), (None, "only"), (7, None), (7, None), (None, None), (1, "twice"), (1, "twice")]
    got = exact_dedup(docs_of(spark, rows).repartition(3), count="n_copies", **limits).collect()
    assert sorted([(r.text, r.doc_id, r.n_copies) for r in got if r.text is not None], key=repr) == brute(rows)
    assert sorted([r.doc_id for r in got if r.text is None], key=repr) == [7, 7, None]


def test_radix_groups_decide_by_all_bytes():
    texts = [b"a" * 500 + b"1", b"a" * 500 + b"2", b"a" * 500 + b"1", b"b" * 501]
    assert sorted(map(sorted, radix_groups(texts))) == [[0, 2], [1], [3]]
    assert list(radix_groups([b"", b""])) == [[0, 1]]


def test_names_that_are_taken_ties_and_no_rows(spark):
    docs = docs_of(spark, [(1, "t", None, None), (1, "t", "fr", "b"), (2, "u", None, None)]).selectExpr("*", "5 AS n_copies", "6 AS digits", "7 AS N_BYTES", "array(1) AS tie", "8 AS `a.b`")
    got = exact_dedup(docs, count="n_copies")
    assert got.columns == [*docs.columns, "_n_copies"]
    assert sorted((r.doc_id, r._n_copies) for r in got.collect()) == [(1, 2), (2, 1)]
    assert bag(exact_dedup(docs)) == bag(exact_dedup(docs.repartition(3)))
    assert exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind, ids", [
    ("timestamp", [datetime(2020, 1, d) for d in (9, 2, 5)]),
    ("date", [date(2020, 1, d) for d in (9, 2, 5)]),
    ("binary", [bytearray(x) for x in (b"\xff", b"\x01\x02", b"\x02")]),
    ("boolean", [True, False, True]),
    ("decimal(5,2)", [Decimal("1.50"), Decimal("-2.25"), Decimal("0.10")]),
    ("double", [float("nan"), -1.0, 3.0]),
    ("struct<a:int,b:string>", [(1, "z"), (None, "b"), (0, "c")]),
    ("array<int>", [[2, 1], [None, 7], [1, 9]]),
])
def test_least_id_of_any_type(spark, kind, ids):
    docs = spark.createDataFrame([(i, "same") for i in ids] + [(None, "same")], f"doc_id {kind}, text string")
    [row] = exact_dedup(docs.repartition(3), count="n").collect()
    assert row.n == 4 and row.doc_id == docs.filter("doc_id IS NOT NULL").orderBy("doc_id").first().doc_id


def test_ids_without_an_order(spark):
    docs = spark.createDataFrame([({"a": i}, "same") for i in range(3)], "doc_id map<string,int>, text string")
    assert exact_dedup(docs).count() == 1
