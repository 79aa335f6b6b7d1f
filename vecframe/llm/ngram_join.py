"""n-gram Jaccard join with a MinHash LSH forest.

A document's set is its word n-grams (lower case, split at white space). Each of ``TREES``
prefix tries indexes documents by a MinHash signature of up to ``DEEPEST`` values; the
shortest prefix that is ever needed is the longest at which a pair right at the threshold
still meets in some trie with the target recall.

1. One pass over the texts gives each document its trie keys at that prefix and a digest of
   its set. Documents with equal sets are one node from here on.
2. Aggregation by trie key finds the trie nodes that several documents share, and the least
   document of each, its leader. A document goes to the cells of its leaders, of which it
   has as many as it has different ones: linear in the documents, whatever they chain up to.
3. Texts of documents that have company move to their cells. There the tries are sorted and
   walked from the longest prefixes to the shortest, until all pairs of the cell that can
   ever meet are decided: verified on the sets, or ruled out since Jaccard distance is a
   metric and a close partner, verified at a longer prefix, is known to be too far. A pair
   that meets in several cells belongs to the cell of the first trie in which it meets.

A cell of more than ``BLOCK`` documents, or ``BLOCK_GRAMS`` n-grams, is cut into blocks and
every pair of blocks is a task of its own. What is found depends on neither: the pairs that
share a shortest prefix in some trie are verified, all of them and no others.

64-bit hashes stand for n-grams, and 128-bit ones for sets, in the verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..partitions import spread
from .common import forget, fresh, name, releasing, small, written

N = 3
#: Documents that share half of their n-grams are near copies; 40 tries are the fewest with
#: which a prefix of 4 values, long enough to keep strangers apart, meets ``RECALL`` there.
THRESHOLD = 0.5
TREES = 40
DEEPEST = 8
RECALL = 0.92
BLOCK = 2000
BLOCK_GRAMS = 4 << 20
#: In cells of so few documents, prefixes are compared pair by pair instead of in sorted tries.
FEW = 12
SEED = 17
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX1, _MIX2, _HALF = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: An odd base and its inverse modulo 2**64, and a random value for each byte.
_BASES = (_M1, np.uint64(pow(int(_M1), -1, 1 << 64)))
_BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate(_BASES):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    up, down = _powers[0][:n], _powers[1][:n]
    if n > 1 << 22:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return up, down


def grams(raw: bytes, n: int = N) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; a text of fewer words has one gram of all its words, a text of none has none.

    An n-gram's hash is a polynomial in its bytes, words joined by one space, from the
    differences of running sums, and then mixed.
    """
    words = raw.decode("utf-8", "surrogateescape").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    b = np.frombuffer(" ".join(words).encode("utf-8", "surrogateescape") + b" ", np.uint8)
    up, down = _powers_to(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up, out=sums[1:])
    ends = np.flatnonzero(b == 32)
    starts = np.concatenate([[0], ends[: len(ends) - n] + 1])
    h = (sums[ends[n - 1 :]] - sums[starts]) * down[starts]
    h ^= h >> _HALF
    h *= _MIX1
    h ^= h >> _HALF
    h *= _MIX2
    h ^= h >> _HALF
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


_kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _factors(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    if (trees, depth) not in _kept:
        rng = np.random.default_rng(SEED)
        a = rng.integers(0, 1 << 32, (DEEPEST, trees), np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, (DEEPEST, trees), np.uint32)
        _kept[trees, depth] = a[:depth].ravel(), b[:depth].ravel()
    return _kept[trees, depth]


def signature(g: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """MinHash values of a set as (depth, trees): level by level, so that shorter ones are prefixes."""
    a, b = _factors(trees, depth)
    x = (g >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] * a
        h += b
        np.minimum(low, h.min(0), out=low)
    return low.reshape(depth, trees)


def prefix_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each trie, of all the values of its signature."""
    key = np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * _M3
    for level in sig:
        key = (key ^ (key >> np.uint64(31))) * _M1 + (level.astype(np.uint64) + np.uint64(1)) * _M2
    return key ^ (key >> np.uint64(32))


def found(j, depth: int, trees: int):
    """The chance that a pair of Jaccard similarity ``j`` shares a prefix of ``depth`` in some trie."""
    return 1 - (1 - j**depth) ** trees


def shortest(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which pairs at the threshold are found with the target recall."""
    fits = [d for d in range(1, DEEPEST + 1) if found(threshold, d, trees) >= recall]
    if not fits:
        raise ValueError(f"{trees} tries can't reach recall {recall} at {threshold}; at least {log(1 - recall) / log(1 - threshold):.0f} can")
    return fits[-1]


def _sorted_tries(sigs: np.ndarray, trees: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each trie the rows in the order of their signatures, and how long a prefix each shares with the next."""
    out = []
    for t in range(trees):
        s = sigs[:, :, t]
        order = np.lexsort(s.T[::-1])
        s = s[order]
        out.append((order, np.cumprod(s[1:] == s[:-1], axis=1).sum(1)))
    return out


def _together(order: np.ndarray, shared: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """The rows of each node of a sorted trie at a depth that has several."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], shared >= depth, [False]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        yield order[a : b + 1]


def similar(sets: list[np.ndarray], threshold: float, trees: int, recall: float, tries: np.ndarray | None = None, side: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
    """Verified pairs of one cell: indices and Jaccard similarity.

    ``tries`` has a bit for each trie through which a row came here: a pair counts if the
    first trie in which it meets is one of them. With ``side``, only pairs of different
    sides count.
    """
    m = len(sets)
    depth = shortest(threshold, trees, recall)
    sigs = np.stack([signature(g, trees, DEEPEST) for g in sets])
    if m <= FEW:
        # each pair's shared prefix in each trie, without sorting
        prefix = np.cumprod(sigs[:, None] == sigs[None], axis=2, dtype=np.int8).sum(2, dtype=np.int8)
        here = prefix >= depth
        left = here.any(2)
        if tries is not None:
            left &= (tries[:, None] >> here.argmax(2) & 1).astype(bool)
        longest = prefix.max(2)
    else:
        sorted_tries, longest = _sorted_tries(sigs, trees), None
        seen, left = np.zeros((m, m), bool), np.zeros((m, m), bool)
        for t, trie in enumerate(sorted_tries):
            for rows in _together(*trie, depth):
                at = np.ix_(rows, rows)
                if tries is None or int(tries[rows[0]]) >> t & 1:
                    left[at] |= ~seen[at]
                seen[at] = True
    left &= np.triu(np.ones((m, m), bool), 1)
    if side is not None:
        left &= side[:, None] != side[None, :]
    sizes = np.array([len(g) for g in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids_of = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(ids.max()) + 1, bool)
    far = np.full((m, m), np.nan, np.float32)
    for d in range(DEEPEST, depth - 1, -1):
        if not left.any():
            break
        if longest is not None:
            meet = longest >= d
        else:
            meet = np.zeros((m, m), bool)
            for trie in sorted_tries:
                for rows in _together(*trie, d):
                    meet[np.ix_(rows, rows)] = True
        meet &= left
        left &= ~meet
        for i in np.flatnonzero(meet.any(1)).tolist():
            others = np.flatnonzero(meet[i])
            if not np.isnan(far[i]).all():
                close = int(np.nanargmin(far[i]))
                others = others[~(far[close, others] - far[close, i] > 1 - threshold + 1e-5)]
                if not len(others):
                    continue
            mark[ids_of[i]] = True
            there = mark[np.concatenate([ids_of[j] for j in others])]
            shared = np.add.reduceat(there, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]), dtype=np.int64)
            mark[ids_of[i]] = False
            jac = shared / (sizes[i] + sizes[others] - shared)
            far[i, others] = far[others, i] = 1 - jac
            good = jac >= threshold
            yield from ((i, int(j), float(x)) for j, x in zip(others[good], jac[good]))


def _digest(g: np.ndarray) -> bytes:
    return hashlib.blake2b(g.tobytes(), digest_size=16).digest()


def _sketches(docs: DataFrame, doc_id: str, text: str, n: int, trees: int, depth: int) -> DataFrame:
    """id, digest of the set, its size, and a key of each trie; of all rows that have an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys, keep = [], [], [], []
            for i, x in enumerate(b.column(1)):
                g = grams(x.as_py(), n)
                if len(g):
                    keep.append(i)
                    digests.append(_digest(g))
                    sizes.append(len(g))
                    keys.append(prefix_keys(signature(g, trees, depth)).view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * trees), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["id", "digest", "size", "keys"])

    rows = docs.filter(name(doc_id).isNotNull() & name(text).isNotNull()).select(name(doc_id).alias("id"), name(text).cast("binary").alias("raw"))
    return spread(rows).mapInArrow(releasing(run), f"id {dict(rows.dtypes)['id']}, digest binary, size long, keys array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of undirected edges; a component's name is its least node.

    Large-star and small-star contraction alternate until nothing changes; every round is a
    written table, the one before is deleted. The least neighbour comes from an aggregation
    and a join, so a node of many edges is split like any skewed key.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "star-0")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(lows, "u")
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = written(out, "star")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = nxt
        if state == tuple(seen):
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _forest(docs: DataFrame, threshold: float, n: int, trees: int, recall: float, doc_id: str, text: str, block: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets that have company, members of sets that several documents have, and what the cells found.

    Sets: digest, node (the least doc_id that has it) and at, a number of its own. Members:
    digest, node and id, once each. Found, with ``every``: each verified pair of sets once,
    as (doc_a, doc_b, jaccard) of their nodes. Else, of each set of a cell that has links
    there: at, node, root (the least node that links connect it with in the cell), links
    (how many documents it is linked with through the cell) and jaccard (the highest), so
    what is written grows with the documents and not with their pairs.
    """
    if trees > 63:
        raise ValueError("at most 63 tries")
    depth = shortest(threshold, trees, recall)
    sketches = written(_sketches(docs, doc_id, text, n, trees, depth), "forest-keys")
    nodes = sketches.groupBy("digest", "size", "keys").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    nodes = written(nodes.withColumn("at", F.monotonically_increasing_id()), "forest-nodes")
    several = nodes.filter("n > 1").select("digest", "node")
    members = written(sketches.select("id", "digest").join(small(several, several.count()), "digest").distinct(), "forest-members")
    keyed = nodes.select("at", F.posexplode("keys").alias("trie", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("at").alias("leader")).filter("c > 1").select("key", "leader")
    sent = keyed.join(shared, "key").groupBy("leader", "at").agg(F.expr("bit_or(shiftleft(1L, trie))").alias("tries"))
    copies = members.groupBy("digest").agg(F.count("*").alias("copies"))
    sent = sent.join(nodes.select("at", "node", "digest", "size"), "at").join(copies, "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    sent = written(sent, "forest-cells")
    forget(sketches)
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    large = written(sent.groupBy("leader").agg(parts.alias("blocks")).filter("blocks > 1"), "forest-large")
    placed = sent.join(small(large, large.count()), "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("at"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "at", "copies", "digest", "leader", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "tries")
    texts = docs.select(name(doc_id).alias("node"), name(text).cast("binary").alias("raw")).filter(F.col("raw").isNotNull())
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = texts.join(small(placed, placed.count()), "node").select("leader", "low", "high", "side", "tries", "at", "copies", "digest", "node", "raw")
    moved = moved.repartition(tasks, "leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    kind = dict(moved.dtypes)["node"]
    names = ["doc_a", "doc_b", "jaccard"] if every else ["at", "node", "root", "links", "jaccard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            sides, tries, at, copies, ids, sets = zip(*rows.values())
            got = list(similar(list(sets), threshold, trees, recall, np.array(tries), np.array(sides) if cell[1] != cell[2] else None))
            if not got:
                return
            if every:
                a, b, x = zip(*[(*sorted((ids[i], ids[j])), x) for i, j, x in got])
                cols = [pa.array(a, id_type), pa.array(b, id_type), pa.array(x, pa.float64())]
            else:
                use, root, links, best = _summary(got, ids, np.array(copies))
                cols = [pa.array([at[i] for i in use], pa.int64()), pa.array([ids[i] for i in use], id_type), pa.array([ids[root[i]] for i in use], id_type), pa.array(links[use]), pa.array(best[use])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            id_type = batch.schema.field(8).type
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for k, (leader, low, high, side, tries, at, copies, digest, node) in enumerate(zip(*cols)):
                if (leader, low, high) != cell:
                    if len(rows) > 1:
                        yield from flush()
                    cell, rows = (leader, low, high), {}
                # of rows that share a doc_id, those with another set were sent for another node
                if digest not in rows and _digest(g := grams(batch.column(9)[k].as_py(), n)) == digest:
                    rows[digest] = (side, tries, at, copies, node, g)
        if len(rows) > 1:
            yield from flush()

    return nodes, members, moved.mapInArrow(releasing(run), f"doc_a {kind}, doc_b {kind}, jaccard double" if every else f"at long, node {kind}, root {kind}, links long, jaccard double")


def _summary(pairs: list[tuple[int, int, float]], ids: tuple, copies: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Of a cell's pairs: the rows in them, and by row the one of the least id it is connected with, the documents it is linked with and the highest similarity."""
    m = len(ids)
    root = list(range(m))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j, _ in pairs:
        a, b = top(i), top(j)
        if a != b:
            root[a if ids[b] < ids[a] else b] = b if ids[b] < ids[a] else a
    a, b, x = (np.array(c) for c in zip(*pairs))
    links = (np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)).astype(np.int64)
    best = np.zeros(m)
    np.maximum.at(best, a, x)
    np.maximum.at(best, b, x)
    return np.union1d(a, b), [top(i) for i in range(m)], links, best


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, trees: int = TREES, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, jaccard) of documents whose n-gram sets have at least this similarity.

    Of documents with equal sets the one of the least doc_id stands for them; every other
    one is paired with it, with a jaccard of 1. All pairs of similar documents of different
    sets are given as those of the documents that stand for them, with a jaccard below 1, so
    this is as many rows as there are such pairs: ``similar_classes`` gives a row for each
    document instead. ``all_pairs`` writes out the pairs of copies. doc_a is the lesser id.
    Rows without a doc_id, a text or a word join nothing. Rows that share a doc_id are one
    document: their matches are united, and it is never paired with itself. Repeated rows
    change nothing. ``block`` only bounds what a task holds; no pair depends on it.
    """
    _, members, near = _forest(docs, threshold, n, trees, recall, doc_id, text, block, True)
    copies = members.filter("id <> node").select(F.col("node").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return copies.unionByName(near.filter("doc_a <> doc_b")).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, trees: int = TREES, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b): links between similar documents, not all of them, but as many as connect what ``similar_pairs`` connects."""
    _, members, near = _forest(docs, threshold, n, trees, recall, doc_id, text, block, False)
    return _edges(members, near)


def _edges(members: DataFrame, near: DataFrame) -> DataFrame:
    copies = members.filter("id <> node").select(F.col("node").alias("doc_a"), F.col("id").alias("doc_b"))
    return copies.unionByName(near.filter("node <> root").select(F.col("root").alias("doc_a"), F.col("node").alias("doc_b"))).distinct()


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, trees: int = TREES, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document that is similar to one of a lesser doc_id, directly or through others.

    doc_a names its class by the least doc_id in it, and is no doc_b itself; doc_b is the
    document; n_links is how many other documents it is similar to, copies and all, jaccard
    its highest similarity to one of them (1 if it has copies), and class_links the number
    of all links within the class; that of doc_a is therefore twice class_links less the
    n_links of its rows. No two classes have a link between them. A document whose rows have
    several sets counts the links of each of them. For the rest see ``similar_pairs``.
    """
    nodes, members, near = _forest(docs, threshold, n, trees, recall, doc_id, text, block, False)
    near = written(near, "forest-links")
    of_set = near.groupBy("at").agg(F.sum("links").alias("far"), F.max("jaccard").alias("jaccard"))
    of_set = of_set.join(nodes.select("at", "digest", "node", F.col("n").alias("rows")), "at")
    sizes = members.groupBy("digest").agg((F.count("*") - 1).alias("near"))
    single = of_set.filter("rows = 1").select(F.col("node").alias("doc"), F.col("far").alias("links"), "jaccard")
    shared = members.select("id", "digest").join(sizes, "digest").join(of_set.select("digest", "far", "jaccard"), "digest", "left")
    best = F.when(F.col("near") > 0, 1.0).otherwise(F.col("jaccard"))
    shared = shared.select(F.col("id").alias("doc"), (F.col("near") + F.coalesce("far", F.lit(0))).alias("links"), best.alias("jaccard"))
    per = single.unionByName(shared.filter("links > 0")).groupBy("doc").agg(F.sum("links").alias("n_links"), F.max("jaccard").alias("jaccard"))
    groups = components(_edges(members, near), "doc_a", "doc_b")
    rows = written(per.join(groups, F.col("doc") == F.col("node")).select("component", "doc", "jaccard", "n_links"), "forest-classes")
    totals = rows.groupBy("component").agg((F.sum("n_links") / 2).cast("long").alias("class_links"))
    return rows.join(totals, "component").filter("component <> doc").select(F.col("component").alias("doc_a"), F.col("doc").alias("doc_b"), "jaccard", "n_links", "class_links")


def all_pairs(pairs: DataFrame) -> DataFrame:
    """Every pair (doc_a < doc_b) that ``similar_pairs`` implies, copies' pairs included."""
    copy = pairs.filter("jaccard = 1").select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("id"))
    reps = pairs.select(F.col("doc_a").alias("rep")).unionByName(pairs.select(F.col("doc_b").alias("rep"))).distinct().join(copy.select(F.col("id").alias("rep")), "rep", "left_anti")
    of = copy.unionByName(reps.select("rep", F.col("rep").alias("id")))
    a, b = of.select(F.col("rep").alias("ra"), F.col("id").alias("x")), of.select(F.col("rep").alias("rb"), F.col("id").alias("y"))
    same = a.join(b, F.col("ra") == F.col("rb")).filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    far = pairs.filter("jaccard < 1").join(a, F.col("doc_a") == F.col("ra")).join(b, F.col("doc_b") == F.col("rb"))
    return same.unionByName(far.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "jaccard")).select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), "jaccard")


def keep_one(docs: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document, the least id, of each group that pairs connect.

    Rows with a null id, or in no pair, stay; so do all rows of a document that stays.
    """
    groups = written(components(pairs, "doc_a", "doc_b").filter("node <> component"), "near-copies")
    [key] = fresh(docs, "near_copy")
    gone = groups.select(F.col("node").alias(key))
    return docs.join(small(gone, gone.count()), name(doc_id) == F.col(key), "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
