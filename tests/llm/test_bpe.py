import random

import numpy as np
import pytest
import tiktoken
from llm_cases import SF, docs_of

from vecframe.llm import bpe


@pytest.fixture(scope="module")
def mine():
    return bpe.BytePairs(bpe.read_vocabulary(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def other(mine):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})


def test_query_gives_the_ids_of_another_encoder(spark, other):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op10(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.token_ids == other.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_words_of_all_kinds(mine, other):
    rng = random.Random(0)
    alphabets = ["ab", "the ingou", "éèß中文字🎉", "0123 .,!", " \n\t\r", "aA'sdmtllvere "]
    for _ in range(600):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(0, 60)))
        assert mine.encode(text).tolist() == other.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text.encode()
        raw = text.encode()
        assert not raw or mine.short([raw]) == [np.array(mine.long(raw), "<i4").tobytes()]


def test_very_long_words(mine, other):
    for text in ("a" * 50_000, "ab" * 20_000, "é" * 9_000, " " * 30_000, "x" * bpe.LONG, "x" * (bpe.LONG + 1)):
        assert mine.encode(text).tolist() == other.encode_ordinary(text)


def test_odd_rows(spark):
    rows = [(1, "a text"), (1, "a text"), (2, None), (3, ""), (None, "<|endoftext|>"), (4, "long " * 60_000)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS token_ids", "2 AS N_TOKENS", "3 AS text_bytes", "4 AS `a.b`")
    got = bpe.encode(docs, verified="ok")
    assert got.columns == [*[c for c in docs.columns if c != "text"], "_token_ids", "_n_tokens", "ok"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[2]._token_ids is None and by[2]._n_tokens is None and by[2].ok is None and by[3]._token_ids == [] and by[3]._n_tokens == 0
    assert all(r.ok for i, r in by.items() if i != 2) and got.count() == 6
    back = bpe.decode(got, ids="_token_ids").select("doc_id", "text").collect()
    assert sorted([tuple(r) for r in back], key=repr) == sorted(rows, key=repr)
    assert bpe.encode(docs.limit(0)).count() == 0 and bpe.decode(got.limit(0), ids="_token_ids").count() == 0


def one_word(ranks, word):
    """Ids of a word with one list of boundaries and one of adjacent ranks, a word at a time."""
    none = 1 << 40
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while adjacent and min(adjacent) < none:
        i = adjacent.index(min(adjacent))
        del bounds[i + 1], adjacent[i]
        for k in (i - 1, i):
            if 0 <= k < len(adjacent):
                adjacent[k] = ranks.get(word[bounds[k] : bounds[k + 2]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def test_words_encoded_together_are_as_one_by_one(mine):
    rng = random.Random(7)
    words = [bytes(rng.choice(b"etaoin shrdlu\xc3\xa9.") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    words += [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 3, 50, bpe.LONG)]
    assert [np.frombuffer(x, "<i4").tolist() for x in mine.short(words)] == [one_word(mine.ranks, w) for w in words]


def test_texts_encoded_together(mine, other, monkeypatch):
    """White space of all kinds around words, and memories that are cleared now and then."""
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    rng = random.Random(5)
    texts = ["".join(rng.choice([" ", " ", "\n", "\t", "\x1c", "\u00a0", "a", "bb", "'s", "'", "1", ".", "\u00e9", "\u4e2d", "x" * 300]) for _ in range(rng.randrange(0, 14))) for _ in range(20_000)]
    for i in range(0, len(texts), 500):
        for t, got in zip(texts[i : i + 500], mine.encode_all(texts[i : i + 500])):
            assert got.tolist() == other.encode_ordinary(t), repr(t)
    assert len(mine.known) < 4000 and all(len(w) <= bpe.LONG for w in mine.known)
