import pytest
import tiktoken
from llm_cases import SF, bag, docs_of
from test_mixing import brute as mixed
from test_ngram_join import brute as near

import corpus_pipeline as cp
from vecframe.llm import bpe, common, mixing, quality


def brute(spark):
    """The rows by plain loops, stage by stage; the classifier's weights are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.orderBy("doc_id").collect() if r.text is not None and model.scores(quality.features(r.text.encode())[None])[0] > 0]
    seen = {}
    for r in rows:
        seen.setdefault(r.text, r)
    rows = list(seen.values())
    low = {r.doc_id: r.doc_id for r in rows}
    pairs = list(near([(r.doc_id, r.text) for r in rows]))
    for _ in pairs:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    rows = [r for r in rows if low[r.doc_id] == r.doc_id]
    keep = {x[0] for x in mixed([(r.doc_id, r.text, r.lang, r.source) for r in rows], mixing.WEIGHTS, mixing.DEFAULT_WEIGHT)}
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.BytePairs(bpe.read_vocabulary(bpe.VOCABULARY)).ranks, special_tokens={})
    return {r.doc_id: (r.lang, r.source, r.n_chars, e.encode_ordinary(r.text)) for r in rows if r.doc_id in keep}


def test_same_as_brute_force(spark):
    got = cp.run(spark, SF).collect()
    assert {r.doc_id: (r.lang, r.source, r.n_chars, r.token_ids) for r in got} == brute(spark) and len(got) == len({r.doc_id for r in got})


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = spark.createDataFrame([], docs.schema)
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "tokens"]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, empty, SF)
        assert out.count() == 0
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns


LONG = "a very long text " * 60_000
ODD = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, "one two three four five six seven"), (None, "one two three four five six"), (None, None), (None, None), (4, None), (5, ""), (6, ""), (7, LONG), (8, LONG + "end"), (9, "alone among many others, this text", None, None), (9, "alone among many others, this text", None, None)]


def odd(spark):
    """Null, empty, very long, tied and repeated rows, and columns whose names the stages use themselves."""
    return docs_of(spark, ODD).repartition(3).selectExpr("*", "1 AS quality_score", "2 AS n_copies", "3 AS digits", "4 AS near_copy", "5 AS node", "6 AS mix_source", "7 AS mix_last", "8 AS token_ids", "9 AS n_tokens", "10 AS text_bytes", "11 AS `a.b`", "array(doc_id) AS RAW")


@pytest.fixture
def sf(spark, tmp_path):
    """A folder whose labels trust documents 1 and 9."""
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (None, 1, 0), (7, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, sf, k):
    docs = odd(spark)
    name, stage = cp.STAGES[k]
    out = stage(spark, docs, sf)
    rows = out.collect()
    ids = sorted([repr(r.doc_id) for r in rows])
    if k < 4:
        assert out.columns == docs.columns and not bag(out) - bag(docs)
    if name == "quality":
        of = {}
        for r in docs.collect():
            of.setdefault(r.text, []).append(r)
        kept = {r.text for r in rows}
        assert None not in kept and all(sum(r.text == t for r in rows) == len(of[t]) for t in kept)
        nothing = str(sf) + "/none"
        spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{nothing}/labels.parquet")
        assert stage(spark, docs, nothing).count() == len(ODD)
    elif name == "exact_dedup":
        assert ids == sorted(map(repr, [1, 3, None, None, 4, 5, 7, 8, 9]))
    elif name == "near_dedup":
        assert ids == sorted(map(repr, [1, None, None, None, 4, 5, 6, 7, 9, 9]))
    elif name == "mixing":
        assert ids == sorted(repr(x[0]) for x in mixed([(*r, "en", "a") if len(r) == 2 else r for r in ODD], mixing.WEIGHTS, mixing.DEFAULT_WEIGHT))
    else:
        added = dict(zip(["_token_ids", "_n_tokens"], out.columns[-2:]))
        assert added == {"_token_ids": "_token_ids", "_n_tokens": "_n_tokens"} and "text" not in out.columns
        assert ids == sorted(repr(x[0]) for x in ODD)
        assert sorted(r._n_tokens is None for r in rows) == sorted(x[1] is None for x in ODD)
        assert {r._n_tokens for r in rows if r.doc_id in (5, 6)} == {0}


def test_the_chain_on_odd_rows_and_its_tables(spark, sf):
    docs = odd(spark)
    docs.write.parquet(f"{sf}/documents.parquet")
    before = set(common._tables)
    out = cp.run(spark, sf)
    assert set(out.columns) >= {"doc_id", "lang", "source", "n_chars", "token_ids", "a.b"}
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(common._tables) - before} == {"pipeline-mixing"}
