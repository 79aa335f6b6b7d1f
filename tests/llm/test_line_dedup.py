import random
from collections import defaultdict

import pytest
from llm_cases import docs_of

from vecframe.llm.line_dedup import boilerplate, remove_boilerplate


def brute(rows, sites, chars):
    of = defaultdict(set)
    for _, text, _, site in rows:
        for line in (text or "").split("\n") if text is not None and site is not None else []:
            if len(line.strip(" ")) >= chars:
                of[line.strip(" ")].add(site)
    out = []
    for i, text, _, _ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if len(of.get(x.strip(" "), ())) < sites]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("inline", [20_000, 0])
@pytest.mark.parametrize("sites", [3, 10])
def test_same_as_brute_force(spark, inline, sites):
    rng = random.Random(5)
    lines = [f"boilerplate line {i}" for i in range(30)] + ["short", "", "  padded boiler line  ", "Zeile mit Umlaut é"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 8))), "en", f"s{min(rng.randrange(20), rng.randrange(20))}") for i in range(150)]
    rows += [(200, None, "en", "s1"), (201, "", "en", "s2"), (202, "boilerplate line 1", None, None), (203, "\n".join(["boilerplate line 2"] * 20_000 + ["end"]), "en", "s1"), (None, rows[0][1], None, "s3"), rows[1]]
    got = remove_boilerplate(docs_of(spark, rows), sites, inline=inline).collect()
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got], key=repr) == brute(rows, sites, 10)


def test_near_lines_get_exact_counts(spark):
    """With the smallest sketch nearly all counts are near the threshold, and all are right."""
    rows = [(s * 1000 + k, f"line number {k:04}", "en", f"s{s}") for k in range(40) for s in range(k)]
    assert boilerplate(docs_of(spark, rows), 20, lg_k=4).count() == 20


def test_names_that_are_taken_and_no_rows(spark):
    docs = docs_of(spark, [(1, "a line that all have", "en", s) for s in "abc"]).selectExpr("*", "1 AS n_removed", "2 AS kept_lines", "3 AS row_key", "4 AS `x.y`")
    for inline in (0, 10):
        got = remove_boilerplate(docs, 3, inline=inline)
        assert got.columns == [*docs.columns, "_n_removed"]
        assert {(r.text, r.n_removed, r._n_removed) for r in got.collect()} == {("", 1, 1)}
        assert remove_boilerplate(docs.limit(0), 3, inline=inline).count() == 0
