"""Parts that need no session: the query language, settings, ids, planner, values, quantizers, hashes."""

import math
import random

import numpy as np
import pytest

from vecframe.config import Config, GraphParams, QuantParams, requires_normalization
from vecframe.errors import ConfigError, NotFound, ParseError, StorageError
from vecframe.functions import ids
from vecframe.functions import text as X
from vecframe.functions import vectors as V
from vecframe.operators import ivf, quantize
from vecframe.operators.filters import Filter
from vecframe.operators.search import check_query
from vecframe.plans import query_language as ql
from vecframe.plans.planner import plan_seek
from vecframe.sources.jsonl import parse_line
from vecframe.sources.store import Manifest
from vecframe.types import kind_of, meta_row


def test_tokens():
    got = [(t.kind, t.text) for t in ql.tokenize('seek in v_1 # words\n nearest [1, -2.5] where a.b != "x y" $q *')]
    assert got == [("word", "seek"), ("word", "in"), ("word", "v_1"), ("word", "nearest"), ("punct", "["), ("number", "1"), ("punct", ","), ("number", "-2.5"), ("punct", "]"), ("word", "where"), ("word", "a.b"), ("punct", "!="), ("string", "x y"), ("punct", "$"), ("word", "q"), ("punct", "*"), ("end", "")]
    for bad in ('"open', "a ; b", "a & b"):
        with pytest.raises(ParseError):
            ql.tokenize(bad)


def test_statements():
    s = ql.parse('seek in v nearest [1, 2] top 5 threshold 0.5 where a = 1 rank_by year project x, y yield')
    assert (s.vault, s.query, s.top, s.threshold, s.rank_by, s.fields) == ("v", [1.0, 2.0], 5, 0.5, "year", ["x", "y"])
    s = ql.parse("seek in v nearest $q rank_by distance project * yield")
    assert s.query == "q" and s.rank_by is None and s.fields == [] and ql.top_of(s) == ql.DEFAULT_TOP
    assert ql.top_of(ql.parse("seek in v nearest $q threshold 1 yield")) is None
    assert ql.resolve("q", {"q": [1.0]}) == [1.0]
    with pytest.raises(NotFound):
        ql.resolve("q", {"other": [1.0]})
    assert ql.parse('fetch from v id "abc" yield') == ql.Fetch("v", "abc")
    s = ql.parse("scan in v where n >= 9223372036854775807 offset 2 limit 3 yield")
    assert (s.offset, s.limit) == (2, 3) and s.where.matches({"n": 2**63 - 1}) and not s.where.matches({"n": 2**63 - 2})
    s = ql.parse('place in v vector [1] data {"a": 1, "b": -2.5, "c": true, "d": "s", "a": 9}')
    assert s.data == {"a": 1, "b": -2.5, "c": True, "d": "s"} and type(s.data["a"]) is int
    assert ql.parse('erase from v id "x"') == ql.Erase("v", "x")


@pytest.mark.parametrize("bad", ["", "look in v", "seek in v", "seek in v nearest [1] top -1 yield", "seek in v nearest [1] top 1.5 yield", "seek in v nearest [1 2] yield", "seek in v nearest [1] yield more", "scan in v where yield", "scan in v where a = yield", "scan in v where (a = 1 yield", "scan in v where a ~ 1 yield", "scan in v where a in 1 yield", "scan in v where a contains 1 yield", "scan in v where a = 9223372036854775808 yield", "fetch from v id abc yield", 'fetch from v id "a"', "place in v vector $q", "scan in v top 3 yield"])
def test_malformed_statements(bad):
    assert ql.validate(bad)
    with pytest.raises(ParseError):
        ql.parse(bad)


def test_precedence_of_booleans():
    rng = random.Random(1)
    for _ in range(300):
        names = [rng.choice("xy") for _ in range(4)]
        words = [f"{rng.choice(['', 'not '])}{n} = {rng.randrange(2)}" for n in names]
        ops = [rng.choice(["and", "or"]) for _ in range(3)]
        text = words[0] + "".join(f" {o} {w}" for o, w in zip(ops, words[1:]))
        python = text.replace(" = ", " == ")
        where = ql.parse(f"scan in v where {text} yield").where
        for x in (0, 1):
            for y in (0, 1):
                assert where.matches({"x": x, "y": y}) == eval(python, {"x": x, "y": y}), text
    assert ql.validate("scan in v where not (a = 1 or b in [1, 2]) and c contains \"z\" yield") is None


def test_filters_are_two_valued():
    f = Filter.compare
    assert not f("a", "!=", 1).matches({}) and Filter.not_(f("a", "=", 1)).matches({})
    assert f("a", "=", 1).matches({"a": 1.0}) and not f("a", "=", 1).matches({"a": True}) and not f("a", "<", "b").matches({"a": 1})
    assert not Filter.in_set("a", []).matches({"a": 1}) and Filter().matches({}) and Filter().matches_all()
    assert Filter.has_substring("a", "").matches({"a": ""}) and not Filter.has_substring("a", "1").matches({"a": 1})
    where = Filter().field("a").equals(1).field("b").one_of([2, 3])
    assert where.exact_constraints() == [("a", [1]), ("b", [2, 3])]
    assert (where | f("c", "=", 1)).exact_constraints() is None and f("a", "<", 1).exact_constraints() is None
    for bad in (lambda: f("a", "~", 1), lambda: f("a", "=", float("nan")), lambda: f("a", "=", 1 << 63), lambda: f("a", "=", None), lambda: Filter().equals(1)):
        with pytest.raises(ConfigError):
            bad()


def test_settings():
    assert Config.from_dict(Config(4, "euclidean", graph=GraphParams(m=8), quantization=QuantParams("pq", 2)).as_dict()) == Config(4, "euclidean", graph=GraphParams(m=8), quantization=QuantParams("pq", 2))
    assert requires_normalization("cosine") and not requires_normalization("dot_product") and QuantParams("sq").codec == "sq8"
    for bad in (lambda: Config(metric="Cosine"), lambda: Config(-1), lambda: Config(70_000), lambda: Config(index="tree"), lambda: Config(access_mode="w"), lambda: Config(durability="none"), lambda: Config(6, quantization=QuantParams("pq", 4)), lambda: QuantParams("lz"), lambda: QuantParams("pq", pq_bits=9), lambda: QuantParams("pq", pq_bits=3), lambda: QuantParams("pq", -1), lambda: GraphParams(m=1), lambda: GraphParams(ef_search=0), lambda: GraphParams(compaction_ratio=0)):
        with pytest.raises(ConfigError):
            bad()
    m = Manifest(3, Config(4), 7, {"c": {"segment": "s"}}, {"model": "default"})
    assert Manifest.loads(3, m.dumps()) == m
    for text in ("", "{}", '{"config": {"metric": "x"}, "log_from": 0, "collections": {}}'):
        with pytest.raises(StorageError):
            Manifest.loads(1, text)


def test_ids():
    made = [ids.generate_id() for _ in range(5000)]
    assert made == sorted(set(made)) and all(x[14] == "7" and x[19] in "89ab" and ids.is_valid_id(x) for x in made)
    u = made[0]
    assert ids.parse_id(u.upper()) == ids.parse_id(u.replace("-", "")) == u and ids.id_of(u.upper()) == u
    assert ids.is_valid_id(ids.NIL) and ids.text_of(0) == ids.NIL
    for bad in ("", "7", u + "0", u[:-1], u.replace("-", "_"), "g" * 32, 7, None):
        assert not ids.is_valid_id(bad)
        with pytest.raises(ConfigError):
            ids.parse_id(bad)
    assert ids.id_of("7") == ids.id_of("7") != ids.id_of("07") and ids.is_valid_id(ids.id_of(""))


def test_plans():
    label, other = Filter.compare("l", "=", 1), Filter.compare("l", "<", 1)
    way = lambda *a, **k: plan_seek(*a, **k).strategy
    assert way(0, 10) == "full_scan" and way(0, 10, text=True) == "text_probe" and way(1000, 0) == "full_scan"
    assert way(128, 10) == "full_scan" and way(129, 10) == "ann_index" and way(1000, 500) == "full_scan" and way(1000, 499) == "ann_index"
    assert way(1000, 10, threshold=0.1) == "full_scan" and way(1000, 10, other) == "ann_index"
    assert way(1000, 10, label, candidates=0) == way(1000, 10, label, candidates=128) == "exact_candidates"
    assert way(1000, 10, label, candidates=129) == "ann_index" and way(1000, 20, label, candidates=160) == "exact_candidates"
    assert way(1000, 10, label, accelerate=False, candidates=1) == "ann_index" and way(1000, 10, label, candidates=1, text=True) == "hybrid_fusion"
    p = plan_seek(1000, 10, label, codec="pq", candidates=3)
    assert (p.candidate_count, p.metadata_accelerated, p.index_type, p.codec) == (3, True, "graph_quantized", "pq")


def test_values_of_records():
    assert [kind_of(x) for x in (1, 1.5, True, "s", -(1 << 63))] == [0, 1, 2, 3, 0]
    assert meta_row({"a": 2}) == {"a": (0, 2, None, None, None)} and meta_row(None) == {}
    r = parse_line('{"id": "x", "vector": [1], "data": {"a": 1, "a": 2, "b": true}, "chunk": {"ordinal": 3}}')
    assert dict(r["meta"])["a"]["i"] == 1 and r["chunk"] == {"document_key": None, "ordinal": 3, "char_start": None, "char_end": None} and r["lineage"] is None
    assert parse_line('{"vector": [1], "meta": {"c": 0.5}}')["meta"][0][1]["d"] == 0.5
    assert check_query([3, 4], 2, "cosine") == [0.6, 0.8] and check_query([3, 4], 2, "euclidean") == [3.0, 4.0]
    assert V.normalized([0.0, 0.0]) == [0.0, 0.0] and V.distance_of("euclidean", [0, 0], [3, 4]) == 5 and V.distance_of("cosine", [1, 0], [0, 1]) == 1 and V.distance_of("dot_product", [2, 1], [1, 1]) == -3


def test_hashes_and_tokens():
    assert X.fnv1a(b"") == 1469598103934665603
    h = X.fnv1a(b"a")
    assert h == (1469598103934665603 ^ 97) * 1099511628211 % 2**64 and X.fnv1a(b"ab") == (h ^ 98) * 1099511628211 % 2**64
    assert X.mix64(0) == 0xE220A8397B1DCDAF  # the first output of splitmix64 seeded with 0
    assert X.mix64(np.array([0, 5], np.uint64)).tolist() == [X.mix64(0), X.mix64(5)]
    assert X.tokens_of("Ab-1 Kéx__Y") == ["ab", "1", "x", "y"]
    m = X.HashEmbedder(16)
    assert X.HashEmbedder.from_artifact(m.artifact()) == m and m.fingerprint() != X.HashEmbedder(16, "compact").fingerprint()
    assert set(m.features("ab cd")) >= {"ab", "ab_cd", "cd", "^ab", "ab$", "^ab$"}
    for bad in ({}, {**m.artifact(), "seed": 1}, {**m.artifact(), "dimension": None}, {**m.artifact(), "model": "none"}):
        with pytest.raises((ConfigError, TypeError)):
            X.HashEmbedder.from_artifact(bad)


def test_quantizers():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16))
    assert quantize.choose_pq_dim(64) == 8 and quantize.choose_pq_dim(7) == 1 and quantize.choose_pq_dim(100) == 10
    assert quantize.compression_ratio(QuantParams("sq8"), 64) == 4 and quantize.code_bytes(QuantParams("pq", 16), 64) == 16
    errors = {}
    for codec in ("sq8", "pq", "opq"):
        q = quantize.train(x, QuantParams(codec, 8, 5))
        codes = q.encode(x)
        errors[codec] = float(((q.decode(codes) - x) ** 2).mean())
        again = quantize.Quantizer.loads(q.dumps())
        assert (again.encode(x) == codes).all() and codes.dtype == np.uint8
        for metric in ("euclidean", "cosine", "dot_product"):
            want = [V.distance_of(metric, v, x[3]) for v in q.decode(codes[:20])]
            assert np.allclose(q.scores(codes[:20], x[3], metric), want, atol=1e-9)
        if codec == "opq":
            assert np.allclose(q.rotation @ q.rotation.T, np.eye(16), atol=1e-9)
    assert errors["sq8"] < 1e-3 < errors["pq"] < 0.5 and errors["opq"] <= errors["pq"] * 1.05
    with pytest.raises(ConfigError):
        quantize.train(x, QuantParams("pq", 5))
    with pytest.raises(ConfigError):
        quantize.train(x[:0], QuantParams("sq8"))


def test_kmeans_and_lists():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in (0, 5, -4)])
    c = quantize.kmeans(x, 3)
    assert sorted(round(float(v)) for v in c[:, 0]) == [-4, 0, 5]
    at, d = quantize.nearest(x, c)
    assert all(np.bincount(at) == 50) and np.allclose(d, ((x - c[at]) ** 2).sum(1))
    assert len(quantize.kmeans(np.ones((4, 2)), 3)) == 3
    unit = quantize.kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 2, spherical=True)
    assert np.allclose(np.linalg.norm(unit, axis=1), 1)
    index = ivf.Ivf(c, "euclidean")
    assert (ivf.nearest_lists(x, index) == at).all() and index.order(x[0])[0] == at[0]
    assert ivf.lists_for(1) == 1 and ivf.lists_for(10_000) == 100 and ivf.lists_for(10**12) == ivf.TRAIN_ROWS // 40
    assert ivf.probes_for(10, 1000) == 10 and ivf.probes_for(1) == 1
    assert math.isclose(ivf.probes_for(1000) / 1000, 0.8)
