"""Byte-level BPE with a contiguous rank array per short word.

A word keeps one array of its parts and one of the ranks of adjacent parts. The lowest rank
is found by scanning, one boundary is deleted, and the two neighbouring ranks are refreshed;
this is done for all words that are new in a group of texts at a time, a row for each. Words
longer than ``LONG`` bytes, for which scanning would be quadratic, take a heap over a linked
list instead and give the same ids.

The vocabulary file (``base64-token rank`` per line) is read on the driver, from a path
that is a parameter, and broadcast. Words recur, so each Python worker remembers the ids
of the words it met, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, name

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 192
#: Words that a worker remembers before it starts anew, and characters encoded together.
REMEMBERED = 150_000
GROUP = 1 << 20
NONE = 1 << 40


class BytePairs:
    """Encoder and decoder of one vocabulary; it remembers the ids of words, as bytes of little-endian int32."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        self.words = regex.compile(pattern).findall
        self.bytes_of = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[str, bytes] = {}
        self._bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                x, y = get(token[:i]), get(token[i:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = rank
        self._pairs = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[k] for k in self._pairs.tolist()] + [0], np.int64)

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of pairs of adjacent parts, NONE where their bytes are no token or a part is missing (-1)."""
        key = x.astype(np.int64) << 32 | y.astype(np.int64)
        at = np.searchsorted(self._pairs, key)
        hit = (x >= 0) & (y >= 0) & (at < len(self._pairs))
        hit[hit] = self._pairs[at[hit]] == key[hit]
        return np.where(hit, self._merged[at], NONE)

    def short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each by scanning its contiguous array of adjacent ranks, all words at a time.

        A row holds the parts of a word and another one the ranks of adjacent parts. The first
        least rank of each row is merged, which deletes a boundary, and the ranks of the new
        part with its two neighbours are refreshed; rows without a rank are done.
        """
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max()) + 1
        at = np.arange(width)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        parts = np.where(at < sizes[:, None], self._bytes[flat], -1)
        if (parts[at < sizes[:, None]] < 0).any():
            raise KeyError("a byte is no token of the vocabulary")
        ranks = np.full(parts.shape, NONE, np.int64)
        ranks[:, :-1] = self._rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
        out, counts, rows = parts.copy(), sizes.copy(), np.arange(len(words))
        while len(rows):
            i = ranks.argmin(1)
            best = np.take_along_axis(ranks, i[:, None], 1)[:, 0]
            more = best < NONE
            if not more.all():
                done = rows[~more]
                out[done] = parts[~more]
                rows, parts, ranks, i, best = rows[more], parts[more], ranks[more], i[more], best[more]
                if not len(rows):
                    break
            counts[rows] -= 1
            here = np.arange(len(rows))
            parts[here, i] = best
            after = np.minimum(at + (at > i[:, None]), width - 1)
            parts = np.take_along_axis(parts, after, 1)
            parts[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(at + (at >= i[:, None]), width - 1), 1)
            ranks[:, -1] = NONE
            ranks[here, i] = self._rank(parts[here, i], parts[here, np.minimum(i + 1, width - 1)])
            left = np.flatnonzero(i)
            ranks[left, i[left] - 1] = self._rank(parts[left, i[left] - 1], parts[left, i[left]])
        raw, step = out.astype("<i4").tobytes(), 4 * width
        return [raw[k * step : k * step + 4 * n] for k, n in enumerate(counts.tolist())]

    def long(self, word: bytes) -> list[int]:
        """The same ids for a long word, with a heap of pairs over linked parts."""
        n, rank = len(word), self.ranks.get
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if end[i] > 0 else n
            if end[i] < 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := rank(word[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Remember the ids of words."""
        short = []
        for w in words:
            raw = w.encode("utf-8", "surrogateescape")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[w] = whole.to_bytes(4, "little")
            elif len(raw) <= LONG:
                short.append((raw, w))
            else:
                self.known[w] = np.array(self.long(raw), "<i4").tobytes()
        short.sort(key=lambda x: len(x[0]))
        first = 0
        while first < len(short):
            # rows of one block differ little in length
            most = max(6, len(short[first][0]) * 5 // 4)
            end = first
            while end < len(short) and end - first < 8192 and len(short[end][0]) <= most:
                end += 1
            for (_, w), ids in zip(short[first:end], self.short([r for r, _ in short[first:end]])):
                self.known[w] = ids
            first = end

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; words that are new are encoded together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [self.words(t) for t in texts]
        new = set(chain.from_iterable(words)).difference(self.known)
        self.learn(new)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, w)), "<i4") for w in words]
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict[tuple[int, str], BytePairs] = {}


def _encoder(vocabulary: bytes, pattern: str) -> BytePairs:
    key = (hash(vocabulary), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = BytePairs(vocabulary, pattern)
    return _made[key]


def _groups(raws: pa.Array) -> Iterator[list[bytes | None]]:
    """The values of a column in groups of about GROUP bytes."""
    group, size = [], 0
    for raw in raws:
        group.append(raw.as_py())
        size += len(group[-1] or b"")
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, ids: str = "token_ids", count: str = "n_tokens", verified: str | None = None) -> DataFrame:
    """``docs`` with token ids (array of int) and their number in place of the text.

    A null text has null ids and a null number; an empty text has no ids and the number 0.
    Whole texts are encoded, however long. With ``verified``, a column of that name says
    whether decoding the ids gave the bytes of the text. Bytes that aren't UTF-8 survive.
    Other columns stay; a new column whose name is taken gets a leading underscore.
    """
    rest = [c for c in docs.columns if c != text]
    added = fresh(rest, ids, count, *([verified] if verified else []))
    [source] = fresh(docs, "text_bytes")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    check = bool(verified)
    kinds = [T.ArrayType(T.IntegerType(), False), T.LongType(), T.BooleanType()]
    out = T.StructType([docs.schema[c] for c in rest] + [T.StructField(n, k) for n, k in zip(added, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(held.value, pattern)
        for batch in batches:
            parts, lengths, good = [], [], []
            for raws in _groups(batch.column(len(rest))):
                got = iter(bpe.encode_all([r.decode("utf-8", "surrogateescape") for r in raws if r is not None]))
                for raw in raws:
                    if raw is None:
                        lengths.append(None)
                        good.append(None)
                        continue
                    parts.append(next(got))
                    lengths.append(len(parts[-1]))
                    if check:
                        good.append(bpe.decode(parts[-1].tolist()) == raw)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ends = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum([x or 0 for x in lengths], out=ends[1:])
            empty = pa.array([x is None for x in lengths], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=empty) if len(lengths) else pa.array([], pa.list_(pa.int32()))
            made = [lists, pa.array(lengths, pa.int64())] + ([pa.array(good, pa.bool_())] if check else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], names=[*rest, *added])

    return map_arrow(docs.select(*map(name, rest), name(text).cast("binary").alias(source)), run, out)


def decode(df: DataFrame, ids: str = "token_ids", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the text of its ids in their place.

    Null ids give a null text, no ids an empty one. An id that the vocabulary lacks raises
    IndexError, since no text stands for it.
    """
    rest = [c for c in df.columns if c != ids]
    [added] = fresh(rest, text)
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    out = T.StructType([df.schema[c] for c in rest] + [T.StructField(added, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(held.value, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.binary())], names=[*rest, added])

    texts = map_arrow(df.select(*map(name, rest), name(ids)), run, out)
    return texts.withColumn(added, name(added).cast("string"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, verified="round_trip")
