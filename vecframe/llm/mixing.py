"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id. Within a source, a document's virtual finish
time is the source's cumulative tokens, up to and with it, divided by the source's target
weight. All documents are range-sorted by that time and cut where the total budget of
tokens ends, so at any cut the sources have got tokens in proportion to their weights
until they run out.

No running sum runs in one task: the shuffle key's leading hex digits divide each source
into 4,096 buckets, whose sums give every bucket its offset. The cut is found by
histograms over the finish time that close in on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh, name, small, written

#: Target weights of the registered query; sources not named have the default.
WEIGHTS = {"src1": 3.0, "src2": 2.0, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
#: Share of the corpus' tokens that the mixture may have, in tenths.
BUDGET_TENTHS = 9
SEED = "mix-1"
DIGITS = 3
BINS = 1024
FINE_ROWS = 200_000


def tokens(text: Column) -> Column:
    """Runs of characters other than space, tab, carriage return and line feed."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for s, x in weights.items():
        w = F.when(source == s, F.lit(float(x))).otherwise(w)
    return w


def finish_times(docs: DataFrame, weights: dict[str, float], default: float = DEFAULT_WEIGHT, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """doc_id, source, mix_key, n_tokens and finish_time of every document whose weight is above 0.

    Rows of a source with the same key, so the same doc_id, are tied: all have the time at
    which the last of them ends. A null source is a source of its own with the default
    weight; a null or empty text has 0 tokens; a null doc_id is shuffled like "".
    """
    w = _weight(name(source), weights, default)
    narrow = docs.select(name(doc_id).alias("doc_id"), name(source).alias("source"), shuffle_key(name(doc_id), seed).alias("mix_key"), tokens(name(text)).alias("n_tokens"), w.alias("w")).filter("w > 0")
    narrow = written(narrow.withColumn("bucket", F.substring("mix_key", 1, DIGITS)), "mix-rows")
    sums = narrow.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("mix_key")
    timed = narrow.withColumn("cum", F.sum("n_tokens").over(within))
    timed = timed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    out = written(timed.select("doc_id", "source", "mix_key", "n_tokens", ((F.col("cum") + F.col("offset")) / F.col("w")).alias("finish_time")), "mix-times")
    forget(narrow)
    return out


def cut_time(times: DataFrame, budget: int) -> float | None:
    """The last finish time up to which all documents together have at most ``budget`` tokens.

    Documents tied at a time come in together or not at all. None if not even the first fits.
    """
    lo, hi, n, total = times.agg(F.min("finish_time"), F.max("finish_time"), F.count("*"), F.sum("n_tokens")).first()
    if not n:
        return None
    if total <= budget:
        return hi
    base = 0
    rows = times
    while n > FINE_ROWS and hi > lo:
        width = (hi - lo) / BINS
        if lo + width == lo:
            break
        at = F.least(F.floor((F.col("finish_time") - lo) / width), F.lit(BINS - 1)).cast("int")
        bins = sorted(rows.groupBy(at.alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"), F.min("finish_time").alias("lo"), F.max("finish_time").alias("hi")).collect())
        for b in bins:
            if base + b["t"] > budget:
                break
            base += b["t"]
        rows = times.filter((F.col("finish_time") >= b["lo"]) & (F.col("finish_time") <= b["hi"]))
        if b["c"] == n:
            break
        lo, hi, n = b["lo"], b["hi"], b["c"]
    steps = rows.groupBy("finish_time").agg(F.sum("n_tokens").alias("t"))
    run = steps.select("finish_time", F.sum("t").over(Window.orderBy("finish_time")).alias("c"))
    last = run.filter(F.col("c") <= budget - base).agg(F.max("finish_time")).first()[0]
    return last if last is not None else times.filter(F.col("finish_time") < F.lit(lo)).agg(F.max("finish_time")).first()[0]


def mix(docs: DataFrame, weights: dict[str, float], default: float = DEFAULT_WEIGHT, budget: int | None = None, budget_tenths: int = BUDGET_TENTHS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixture in its order: doc_id, source, n_tokens and finish_time, sorted by time.

    ``budget`` is in tokens; without it, the budget is so many tenths of the tokens that
    sources with a weight have. See ``finish_times`` for nulls, empty texts and ties.
    """
    kept = _kept(docs, weights, default, budget, budget_tenths, seed, doc_id, source, text)
    return kept.select("doc_id", "source", "n_tokens", "finish_time").orderBy("finish_time", "source", "doc_id")


def _kept(docs, weights, default, budget, tenths, seed, doc_id, source, text) -> DataFrame:
    times = finish_times(docs, weights, default, doc_id, source, text, seed)
    if budget is None:
        budget = (times.agg(F.sum("n_tokens")).first()[0] or 0) * tenths // 10
    last = cut_time(times, budget)
    return times.filter(F.lit(False) if last is None else F.col("finish_time") <= F.lit(last))


def mix_documents(docs: DataFrame, weights: dict[str, float], default: float = DEFAULT_WEIGHT, budget: int | None = None, budget_tenths: int = BUDGET_TENTHS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mixture has, with all their columns.

    In a source, times grow with the shuffle key, so the cut is one key per source: the
    documents are filtered where they are and no text is shuffled.
    """
    kept = _kept(docs, weights, default, budget, budget_tenths, seed, doc_id, source, text)
    s, k = fresh(docs, "mix_source", "mix_last")
    cuts = written(kept.groupBy(F.col("source").alias(s)).agg(F.max("mix_key").alias(k)), "mix-cuts")
    here = (name(source).eqNullSafe(F.col(s))) & (shuffle_key(name(doc_id), seed) <= F.col(k)) & (_weight(name(source), weights, default) > 0)
    return docs.join(small(cuts, cuts.count()), here, "left_semi")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


def op6_sql() -> str:
    case = " ".join(f"WHEN source = '{s}' THEN {w!r}::DOUBLE" for s, w in WEIGHTS.items())
    return f"""
WITH t AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens,
         CASE {case} ELSE {DEFAULT_WEIGHT!r}::DOUBLE END AS w
  FROM documents),
f AS (
  SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY k))::BIGINT::DOUBLE / w AS finish_time FROM t WHERE w > 0),
g AS (
  SELECT *, sum(n_tokens) OVER (ORDER BY finish_time) AS together, sum(n_tokens) OVER () AS whole FROM f)
SELECT doc_id, source, n_tokens, finish_time FROM g WHERE together <= whole * {BUDGET_TENTHS} // 10"""
