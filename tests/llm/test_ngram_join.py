import random

import numpy as np
import pytest
from llm_cases import SF, docs_of

from vecframe.llm import ngram_join as nj


def grams(text, n=3):
    w = (text or "").lower().split()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, threshold=0.5):
    sets = {}
    for i, t in rows:
        if i is not None and grams(t):
            sets.setdefault(i, []).append(grams(t))
    out, ids = {}, sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            j = max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b])
            if j >= threshold:
                out[a, b] = j
    return out


def near_copies(n=25, seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 7)):
            t = [w if rng.random() > 0.06 else word() for w in base] if rng.random() < 0.8 else base
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    return rows


def check(got, want):
    assert all(a < b for a, b in got) and len(set(got)) == len(got)
    assert all(p in want and abs(want[p] - j) < 1e-9 for p, j in got.items())
    assert len(got) >= 0.9 * len(want)


def as_dict(pairs):
    rows = pairs.collect()
    out = {(r.doc_a, r.doc_b): r.jaccard for r in rows}
    assert len(out) == len(rows)
    return out


def test_recall_and_precision(spark):
    rows = near_copies()
    check(as_dict(nj.all_pairs(nj.similar_pairs(docs_of(spark, rows)))), brute(rows))


def classes_of(pairs):
    """{doc: (class, highest jaccard, links, links of the class)} of pairs, without the documents that name classes."""
    low = {x: x for p in pairs for x in p}
    for _ in low:
        before = dict(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    of = lambda x: [j for p, j in pairs.items() if x in p]
    total = {c: sum(low[a] == c for a, _ in pairs) for c in low.values()}
    return {x: (c, max(of(x)), len(of(x)), total[c]) for x, c in low.items() if c != x}


def check_classes(found, pairs):
    rows = found.collect()
    got = {r.doc_b: (r.doc_a, r.jaccard, r.n_links, r.class_links) for r in rows}
    assert len(got) == len(rows) and got == {x: (c, pytest.approx(j), n, t) for x, (c, j, n, t) in classes_of(pairs).items()}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pairs = as_dict(nj.all_pairs(nj.similar_pairs(docs_of(spark, rows))))
    check(pairs, brute(rows))
    check_classes(nj.op8(spark, SF), pairs)


@pytest.mark.parametrize("block", [2000, 3])
def test_classes_count_every_link(spark, block):
    rows = near_copies(30, 6)
    top = max(i for i, _ in rows)
    rows += [(top + 1 + k, t) for k, (_, t) in enumerate(rows[:30] + rows[:6] * 5)] + rows[5:9] + [(None, rows[0][1]), (5000, None), (5001, "")]
    docs = docs_of(spark, rows)
    pairs = as_dict(nj.all_pairs(nj.similar_pairs(docs)))
    check_classes(nj.similar_classes(docs, block=block), pairs)
    low = classes_of(pairs)
    kept = [r.doc_id for r in nj.keep_one(docs, nj.links(docs, block=block)).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(i) for i, _ in rows if i not in low)
    assert nj.similar_classes(docs.limit(0)).count() == 0


def families(n, seed=3):
    """Per family two texts about ``link`` similar, and a near copy of each."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(n):
        link = rng.choice([0.52, 0.55, 0.57, 0.62, 0.7, 0.75, 0.85])
        a = [word() for _ in range(120)]
        common = round(2 * 118 * link / (1 + link)) + 2
        b = a[:common] + [word() for _ in range(120 - common)]
        rows += [(4 * k + i, " ".join(x)) for i, x in enumerate((a, a[:-2] + [word(), word()], b, [word(), word()] + b[2:]))]
    return rows


def test_recall_in_each_band_beside_close_partners(spark):
    rows = families(90)
    want = {p: j for i in range(0, len(rows), 4) for p, j in brute(rows[i : i + 4]).items()}
    got = as_dict(nj.similar_pairs(docs_of(spark, rows)))
    assert all(abs(want[p] - j) < 1e-9 for p, j in got.items())
    for low, high in ((0.5, 0.6), (0.6, 0.8), (0.8, 1.01)):
        band = {p for p, j in want.items() if low <= j < high}
        assert len(band) > 60 and len(band & got.keys()) >= 0.92 * len(band), (low, len(band & got.keys()), len(band))


def test_pairs_do_not_depend_on_the_block(spark, monkeypatch):
    rows = near_copies() + [(i + 10_000, t) for i, t in families(12)]
    hub = "all of these share one long opening that goes on and on for quite some time until it ends".split()
    rows += [(20_000 + i, " ".join(hub + [f"own{i}_{k}" for k in range(i % 12)])) for i in range(60)]
    want = as_dict(nj.similar_pairs(docs_of(spark, rows)))
    check(as_dict(nj.all_pairs(nj.similar_pairs(docs_of(spark, rows)))), brute(rows))
    for block in (1, 2, 7):
        assert as_dict(nj.similar_pairs(docs_of(spark, rows), block=block)) == want
    monkeypatch.setattr(nj, "BLOCK_GRAMS", 300)
    monkeypatch.setattr(nj, "FEW", 0)
    assert as_dict(nj.similar_pairs(docs_of(spark, rows))) == want


def test_a_chain_moves_each_text_to_few_cells(spark, monkeypatch):
    """Texts that only chain up, each like the next, make no component whose parts all meet."""
    words = [f"c{i}" for i in range(6000)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 40])) for i in range(1000)]
    cells, kept = [], nj.written

    def seen(df, what):
        out = kept(df, what)
        if what == "forest-cells":
            cells.append(out.count())
        return out

    monkeypatch.setattr(nj, "written", seen)
    got = as_dict(nj.similar_pairs(docs_of(spark, rows), block=50))
    assert cells[0] < 40 * len(rows)
    want = {(i, i + k): 0 for i in range(1000) for k in (1, 2) if i + k < 1000}
    assert got.keys() <= want.keys() and len(got) >= 0.92 * len(want)


def test_copies_are_members_of_their_class(spark):
    rows = near_copies()
    top = max(i for i, _ in rows)
    rows += [(top + 1 + k, t) for k, (_, t) in enumerate(rows[:40] + rows[:10] * 4)]
    want = brute(rows)
    pairs = as_dict(nj.similar_pairs(docs_of(spark, rows)))
    check(as_dict(nj.all_pairs(nj.similar_pairs(docs_of(spark, rows)))), want)
    sets = {}
    for i, t in sorted(rows):
        sets.setdefault(frozenset(grams(t)), []).append(i)
    assert {p for p, j in pairs.items() if j == 1} == {(v[0], x) for v in sets.values() for x in v[1:]}
    assert all({a, b} <= {v[0] for v in sets.values()} for (a, b), j in pairs.items() if j < 1)


def test_documents_with_several_texts(spark):
    a, b = "one two three four five six seven", "one two three four five six eight"
    rows = [(2, a), (2, b), (3, b), (4, a)]
    got = as_dict(nj.similar_pairs(docs_of(spark, rows)))
    assert {p for p, j in got.items() if j == 1} == {(2, 3), (2, 4)} and got.keys() <= brute(rows).keys()
    assert nj.similar_pairs(docs_of(spark, rows).limit(0)).count() == 0


def test_grams_are_hashed_alike_wherever_they_stand():
    rng = random.Random(2)
    words = [rng.choice(["a", "bb", "Stra\u00dfe", "x" * 50, "\u4e2d\u6587"]) + str(rng.randrange(9)) for _ in range(3000)]
    got, of = {}, {}
    for i in range(len(words) - 2):
        [h] = nj.grams("  ".join(words[i : i + 3]).encode()).tolist()
        got.setdefault(h, set()).add(tuple(words[i : i + 3]))
        of[tuple(words[i : i + 3])] = h
    assert all(len(x) == 1 for x in got.values()) and set(nj.grams(" \n".join(words).encode()).tolist()) == set(of.values())
    assert len(nj.grams(b"")) == 0 and len(nj.grams(b"one")) == 1 and len(nj.grams(b"one \xff two")) == 1


def test_prefixes_are_as_short_as_the_recall_needs():
    assert nj.found(0.5, nj.shortest(0.5, nj.TREES, 0.92), nj.TREES) >= 0.92 > nj.found(0.5, nj.shortest(0.5, nj.TREES, 0.92) + 1, nj.TREES)
    with pytest.raises(ValueError):
        nj.shortest(0.1, 2, 0.99)


def test_few_documents_are_compared_as_in_sorted_tries(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.append(base[: rng.integers(150, 300)], rng.integers(0, 1 << 62, rng.integers(1, 90), dtype=np.uint64))) for _ in range(12)]
    tries = np.array([int(rng.integers(1 << 40)) for _ in sets])
    tries[:] = tries[0]
    few = [list(nj.similar(sets, 0.5, nj.TREES, nj.RECALL, t, s)) for t in (None, tries) for s in (None, np.arange(12) % 2)]
    monkeypatch.setattr(nj, "FEW", 0)
    assert few == [list(nj.similar(sets, 0.5, nj.TREES, nj.RECALL, t, s)) for t in (None, tries) for s in (None, np.arange(12) % 2)]
    assert len(few[0]) > len(few[3]) > 0


@pytest.mark.parametrize("link", [0.52, 0.55, 0.6, 0.65])
def test_close_partners_do_not_hide_links_near_the_threshold(link):
    rng = np.random.default_rng(7)
    new = lambda k: rng.integers(0, 1 << 62, k, dtype=np.uint64)
    found = links = apart = 0
    for _ in range(60):
        a = new(400)
        common = round(800 * link / (1 + link))
        b = np.append(a[:common], new(400 - common))
        sets = [np.unique(x) for x in (a, np.append(a[10:], new(10)), b, np.append(b[:-10], new(10)))]
        want = {(i, j) for i in (0, 1) for j in (2, 3) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5}
        got = {(i, j) for i, j, _ in nj.similar(sets, 0.5, nj.TREES, nj.RECALL)}
        assert {(0, 1), (2, 3)} <= got <= want | {(0, 1), (2, 3)}
        found, links, apart = found + len(got & want), links + len(want), apart + (not got & want)
    assert found >= 0.92 * links and apart <= 0.08 * 60, (found, links, apart)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)]
    low = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert nj.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, "one two three four"), (2, "One  two\nthree four"), (2, "One  two\nthree four"), (3, "one two three four five"), (None, "one two three four"), (4, None), (5, ""), (6, " \n"), (7, "hi"), (8, "hi"), (9, long), (10, long + " y"), (11, "alone here")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS node", "2 AS near_copy", "3 AS raw", "4 AS key", "5 AS `a.b`")
    pairs = nj.similar_pairs(docs)
    assert {(r.doc_a, r.doc_b) for r in nj.all_pairs(pairs).collect()} == {(1, 2), (1, 3), (2, 3), (7, 8), (9, 10)}
    kept = nj.keep_one(docs, pairs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([1, None, 4, 5, 6, 7, 9, 11], key=repr)
    assert nj.similar_pairs(docs.limit(0)).count() == 0 and nj.keep_one(docs.limit(0), pairs).count() == 0
