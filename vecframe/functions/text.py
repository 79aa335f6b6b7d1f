"""Tokens, lexical overlap and the hashing embedder."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..partitions import spread

_SPLIT = "[^A-Za-z0-9]+"
_M64 = (1 << 64) - 1


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; every other character separates."""
    return F.filter(F.transform(F.split(text, _SPLIT), F.lower), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    return [t.lower() for t in re.split(_SPLIT, text) if t]


def lexical_overlap(query: Column, document: Column) -> Column:
    """Share of the distinct query tokens that the document has; 0 if either has none."""
    q, d = F.array_distinct(tokens(query)), F.array_distinct(tokens(document))
    score = F.size(F.array_intersect(q, d)) / F.size(q)
    return F.coalesce(F.when((F.size(q) > 0) & (F.size(d) > 0), score), F.lit(0.0))


def fnv1a(data: bytes) -> int:
    h = 1469598103934665603
    for b in data:
        h = (h ^ b) * 1099511628211 & _M64
    return h


def mix64(v):
    """The finaliser of splitmix64, of a Python int or a uint64 array."""
    if isinstance(v, int):
        v = (v + 0x9E3779B97F4A7C15) & _M64
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & _M64
        v = (v ^ v >> 27) * 0x94D049BB133111EB & _M64
        return v ^ v >> 31
    u = np.uint64
    v = v + u(0x9E3779B97F4A7C15)
    v = (v ^ v >> u(30)) * u(0xBF58476D1CE4E5B9)
    v = (v ^ v >> u(27)) * u(0x94D049BB133111EB)
    return v ^ v >> u(31)


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing of tokens, token pairs and character n-grams within tokens.

    The same text always gives the same vector; the sums run over all tokens of the whole text.
    """

    dimension: int
    model: str = "default"
    revision: str = "v1"
    provider: str = "local"

    def __post_init__(self):
        if (self.model, self.revision) not in _MODELS:
            raise ConfigError(f"unknown text embedder {self.model}@{self.revision}")
        if self.dimension < 1:
            raise ConfigError("a text embedder needs a dimension")

    @property
    def identity(self) -> dict[str, str]:
        return {"provider": self.provider, "model": self.model, "revision": self.revision}

    def fingerprint(self) -> str:
        return f"{fnv1a(repr((self.provider, self.model, self.revision, self.dimension, *_MODELS[self.model, self.revision])).encode()):016x}"

    def artifact(self) -> dict:
        """All that the vectors depend on, to be kept with a database."""
        seed, least, most, projections = _MODELS[self.model, self.revision]
        return {"format": "hash-embedder", "version": 1, **self.identity, "dimension": self.dimension, "seed": seed, "least": least, "most": most, "projections": projections, "fingerprint": self.fingerprint()}

    @classmethod
    def from_artifact(cls, found: dict) -> HashEmbedder:
        """The embedder of an artifact; ConfigError if this one would give other vectors."""
        try:
            made = cls(found["dimension"], found["model"], found["revision"])
        except (KeyError, TypeError) as e:
            raise ConfigError(f"the embedder's file is damaged: {e}") from e
        wrong = [k for k, v in made.artifact().items() if found.get(k) != v]
        if wrong:
            raise ConfigError(f"the embedder's file differs in {', '.join(wrong)}")
        return made

    def features(self, text: str) -> list[str]:
        _, least, most, _ = _MODELS[self.model, self.revision]
        words, out = tokens_of(text), []
        for i, w in enumerate(words):
            out.append(w)
            if i + 1 < len(words):
                out.append(f"{w}_{words[i + 1]}")
            bounded = f"^{w}$"
            out += [bounded[s : s + n] for n in range(least, most + 1) for s in range(len(bounded) - n + 1)]
        return out

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        """Vectors of texts, one to a row."""
        out, first, size = np.zeros((len(texts), self.dimension), np.float32), 0, 0
        words: list[list[str]] = []
        for i, t in enumerate(texts):
            words.append(tokens_of(t))
            size += len(words[-1])
            if size >= _TOKENS or i == len(texts) - 1:
                out[first : i + 1] = self._embedded(words)
                words, first, size = [], i + 1, 0
        return out

    def _embedded(self, texts: list[list[str]]) -> np.ndarray:
        """The features of a text add up, so each different token is projected once and its vector counted as often as it occurs."""
        _, least, most, _ = _MODELS[self.model, self.revision]
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
        at = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        if not len(ids):
            return np.zeros((len(texts), self.dimension))
        flat, starts, sizes = _joined([f"^{w}$".encode() for w in number])
        plain = _fnv(flat, starts + 1, sizes - 2, np.full(len(sizes), _FNV, np.uint64))
        of, hashes = [np.arange(len(sizes))], [plain]
        ends = np.repeat(starts + sizes, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for n in range(least, most + 1):
            begin = np.flatnonzero(np.arange(len(flat)) + n <= ends)
            h = np.full(len(begin), _FNV, np.uint64)
            for k in range(n):
                h = (h ^ flat[begin + k]) * _PRIME
            of.append(owner[begin])
            hashes.append(h)
        vectors = self._projected(np.concatenate(hashes), np.concatenate(of), len(sizes))
        pair, times = np.unique(at * len(sizes) + ids, return_counts=True)
        out = np.zeros((len(texts), self.dimension))
        owners, words = np.divmod(pair, len(sizes))
        for first, end in zip(*(np.searchsorted(owners, np.arange(len(texts)), side) for side in ("left", "right"))):
            out[owners[first : first + 1]] = times[first:end] @ vectors[words[first:end]]
        next_to = np.flatnonzero(at[1:] == at[:-1])
        h = (plain[ids[next_to]] ^ np.uint64(ord("_"))) * _PRIME
        second = ids[next_to + 1]
        h = _fnv(flat, starts[second] + 1, sizes[second] - 2, h)
        return out + self._projected(h, at[next_to], len(texts))

    def _projected(self, hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Signed sums of hashed features for each of ``n`` owners."""
        seed, _, _, projections = _MODELS[self.model, self.revision]
        base = hashes ^ np.uint64(seed)
        out = np.zeros(n * self.dimension)
        for p in range(projections):
            mixed = mix64(base + np.uint64(p * 0x9E3779B97F4A7C15 & _M64))
            sign = np.where(mixed >> np.uint64(63), 1.0, -1.0) / (p + 1)
            out += np.bincount(of * self.dimension + (mixed % np.uint64(self.dimension)).astype(np.int64), sign, len(out))
        return out.reshape(n, -1)


_MODELS = {("default", "v1"): (0x6A09E667F3BCC909, 3, 5, 4), ("compact", "v1"): (0xBB67AE8584CAA73B, 3, 4, 2)}
_FNV, _PRIME = np.uint64(1469598103934665603), np.uint64(1099511628211)
#: So many tokens at least are embedded together.
_TOKENS = 100_000


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _fnv(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``fnv1a`` of many parts of a byte array at once, a byte of each at a time, going on from ``h``."""
    if not len(sizes):
        return h
    order = np.argsort(-sizes, kind="stable")
    starts, h = starts[order], h[order]
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left")
    for at, n in enumerate(live):
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * _PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def embed_column(df: DataFrame, embedder, text: str = "text", out: str = "vector") -> DataFrame:
    """``df`` with vectors of a text column; ``embedder`` has ``embed_batch`` or is a callable of texts.

    Runs in Arrow batches. A null text has a null vector. A result of another length than
    the batch, or of changing dimension, raises an error.
    """
    call = getattr(embedder, "embed_batch", embedder)
    expect = getattr(embedder, "dimension", 0)

    def run(texts: pa.Array) -> pa.Array:
        given = [t for t in texts.to_pylist() if t is not None]
        got = list(call(given)) if given else []
        if len(got) != len(given):
            raise ValueError(f"the embedder gave {len(got)} vectors for {len(given)} texts")
        sizes = {len(v) for v in got}
        if len(sizes) > 1 or expect and sizes - {expect}:
            raise ValueError(f"the embedder gave vectors of dimension {sorted(sizes)}")
        flat = np.asarray(got, np.float32).ravel()
        there = np.array([t.is_valid for t in texts], bool)
        ends = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * (sizes.pop() if sizes else 0)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(~there)) if len(there) else pa.array([], pa.list_(pa.float32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # called non-deterministic so that no filter on the vectors embeds the texts once more
    return spread(df).withColumn(out, F.arrow_udf(run, "array<float>").asNondeterministic()(F.col(text)))
