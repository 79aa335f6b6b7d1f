"""Exact deduplication by distributed MSD radix partitioning.

The radix key of a text is its byte length followed by its bytes, most significant first. A
histogram of the leading digits (the length and the first ``WIDTH`` bytes) finds groups too
large for a task; those are split by more and more of their bytes, after each input
partition has merged its own copies, until no group is too large or all have ended. Then
rows move once, by their digits, and each task splits its groups by successive bytes,
digits growing with depth, until a group is a single text or has ended. Texts in an ended
group are equal byte for byte: nothing is decided by a digest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, map_arrow, name, small, written

WIDTH = 64
#: A group with more bytes or rows than this is split further before rows move.
SPLIT_BYTES = 256 << 20
SPLIT_ROWS = 5_000_000
#: Bytes of one open group that a task holds before it merges the copies among them.
HELD_BYTES = 64 << 20


def radix_groups(texts: list[bytes], start: int = 0, width: int = WIDTH) -> Iterator[list[int]]:
    """Groups of indices of equal texts, for texts of one length, by splitting on successive bytes."""
    stack = [(list(range(len(texts))), start, width)]
    while stack:
        rows, at, w = stack.pop()
        if len(rows) == 1 or at >= len(texts[rows[0]]):
            yield rows
            continue
        parts = defaultdict(list)
        for r in rows:
            parts[texts[r][at : at + w]].append(r)
        stack += [(x, at + w, w * 4) for x in parts.values()]


def _sortable(x):
    """A value that Python orders as Spark orders the column's: nulls last at the top, first within; NaN above all numbers."""
    if isinstance(x, dict):
        return tuple((v is not None, v if v is None else _sortable(v)) for v in x.values())
    if isinstance(x, list):
        return tuple((v is not None, v if v is None else _sortable(v)) for v in x)
    return (x != x, 0.0 if x != x else x) if isinstance(x, float) else x


def _reduce(table: pa.Table, text: int, order: list[int], count: int) -> pa.Table:
    """One row per distinct text of rows that all have one length: the least by order, counts added."""
    texts = [x.as_py() for x in table.column(text)]
    keys = list(zip(*[table.column(k).to_pylist() for k in order]))
    n = table.column(count).to_pylist()
    keep, sums = [], []
    for rows in radix_groups(texts):
        keep.append(min(rows, key=lambda r: (*[(x is None, 0 if x is None else _sortable(x)) for x in keys[r]], r)))
        sums.append(sum(n[r] for r in rows))
    return table.take(pa.array(keep, pa.int64())).set_column(count, table.field(count), pa.array(sums, pa.int64()))


def _merge_sorted(path: list[int], text: int, order: list[int], count: int, held: int):
    """mapInArrow over rows in which those of a radix path are consecutive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([tail, t]) if tail is not None else t).combine_chunks()
            starts = _starts(t, path)
            done, tail = t.slice(0, starts[-1]), t.slice(starts[-1])
            yield from _out(done, starts[:-1])
            if tail.column(text).nbytes > held and tail.num_rows > 1:
                tail = _reduce(tail, text, order, count)
        if tail is not None:
            yield from _out(tail, np.zeros(1, np.int64))

    def _starts(t: pa.Table, path: list[int]) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in path:
            col = t.column(c)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy()
        return np.flatnonzero(new)

    def _out(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        sizes = np.diff(np.append(starts, t.num_rows))
        parts = [t.take(pa.array(starts[sizes == 1]))]
        parts += [_reduce(t.slice(a, n), text, order, count) for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist())]
        yield from pa.concat_tables(parts).combine_chunks().to_batches()

    return run


def _merge_here(length: int, text: int, order: list[int], count: int, held: int):
    """mapInArrow that merges the copies which an input partition holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_tables, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held_tables).combine_chunks()
            by = defaultdict(list)
            for i, n in enumerate(t.column(length).to_pylist()):
                by[n].append(i)
            for rows in by.values():
                yield from _reduce(t.take(pa.array(rows, pa.int64())), text, order, count).combine_chunks().to_batches()

        for batch in batches:
            held_tables.append(pa.Table.from_batches([batch]))
            size += batch.column(text).nbytes
            if size > held:
                yield from flush()
                held_tables, size = [], 0
        if held_tables:
            yield from flush()

    return run


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: str | None = None, split_bytes: int = SPLIT_BYTES, split_rows: int = SPLIT_ROWS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row of each distinct text, with all columns; ``count`` adds the number of its copies.

    The row with the least doc_id stays, in Spark's order of its type, whatever that is, and
    nulls last; among rows with the same doc_id, the one with the least hash of the other
    columns. Of ids that have no order (maps), that hash alone decides. Texts are equal if all their bytes are.
    Rows without a text are no copies of anything and all stay, with a count of 1. Empty
    texts are copies of one another. If ``count`` is taken, it gets a leading underscore.
    """
    cols = docs.columns
    added, n_bytes, digits, raw, tie, made = fresh(docs, count or "n_copies", "n_bytes", "digits", "raw", "tie", "over")
    rest = [c for c in cols if c not in (text, doc_id)]
    rows = docs.filter(name(text).isNotNull()).withColumns({raw: name(text).cast("binary"), n_bytes: F.octet_length(name(text)), added: F.lit(1).cast("long")})
    sortable = "map<" not in docs.schema[doc_id].dataType.simpleString()
    rows = rows.withColumn(tie, F.xxhash64(*[name(c).cast("string") for c in rest]) if rest else F.lit(0).cast("long"))
    rows = rows.withColumn(digits, F.substring(F.col(raw), 1, WIDTH))
    slim = [c for c in cols if c != text]
    rows = rows.select(*map(name, slim), raw, n_bytes, digits, tie, added)
    at = {c: i for i, c in enumerate(rows.columns)}
    order = ([at[doc_id]] if sortable else []) + [at[tie]]

    def too_large(of: DataFrame) -> DataFrame:
        sizes = of.groupBy(n_bytes, digits).agg(F.count("*").alias(made))
        return sizes.filter((F.col(made) * F.col(n_bytes) > split_bytes) | (F.col(made) > split_rows)).select(n_bytes, digits)

    first = over = written(too_large(rows), "radix-over")
    n = over.count()
    if n:
        merge = _merge_here(at[n_bytes], at[raw], order, at[added], held_bytes)
        hot = written(map_arrow(rows.join(small(over, n), [n_bytes, digits], "left_semi").select(*map(name, rows.columns)), merge, rows.schema), "radix-hot")
        cold = rows.join(small(over, n), [n_bytes, digits], "left_anti").select(*map(name, rows.columns))
        width = WIDTH
        while True:
            again = written(too_large(hot.filter(F.col(n_bytes) > width)), "radix-over")
            if over is not first:
                forget(over)
            over, n = again, again.count()
            if not n:
                break
            width *= 8
            wider = over.withColumn(made, F.lit(True))
            longer = hot.join(small(wider, n), [n_bytes, digits], "left")
            longer = longer.withColumn(digits, F.when(F.col(made), F.substring(F.col(raw), 1, width)).otherwise(F.col(digits)))
            next_hot = written(longer.select(*map(name, rows.columns)), "radix-hot")
            forget(hot)
            hot = next_hot
        rows = cold.unionByName(hot)
    moved = rows.repartition(n_bytes, digits).sortWithinPartitions(n_bytes, digits)
    once = map_arrow(moved, _merge_sorted([at[n_bytes], at[digits]], at[raw], order, at[added], held_bytes), rows.schema)
    out = once.select(*[F.col(raw).cast("string").alias(text) if c == text else name(c) for c in cols], added)
    out = out.unionByName(docs.filter(name(text).isNull()).withColumn(added, F.lit(1).cast("long")))
    return out if count else out.drop(added)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), count="n_copies")


def op2_sql() -> str:
    return """
SELECT doc_id, text, lang, source, n_chars, n_copies FROM (
  SELECT *, count(*) OVER (PARTITION BY text) AS n_copies, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
WHERE r = 1"""
