"""Cross-site boilerplate lines, by how many distinct sites a line spreads over.

Per line hash, a HyperLogLog sketch of its sites is merged by aggregation. Lines whose
estimate is clearly above or below the threshold are decided by it; those near it get an
exact count of distinct sites. Lines at or above the threshold are then removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, name, small, written

MIN_SITES = 10
MIN_CHARS = 10
LG_K = 12
#: Standard errors of the sketch that count as near the threshold.
ERRORS = 5
#: Up to so many boilerplate lines, a set in the plan finds them; beyond, joins do, with the
#: same result.
INLINE = 20_000


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text", site: str = "source", lg_k: int = LG_K) -> DataFrame:
    """``line_hash`` of the lines that at least ``min_sites`` distinct sites have.

    Lines are compared without outer spaces; those shorter than ``min_chars`` never count.
    Null sites and null texts count for nothing; a line that a site repeats counts once.
    """
    rows = docs.filter(name(site).isNotNull()).select(F.xxhash64(name(site)).alias("site"), F.explode(_lines(name(text))).alias("line"))
    rows = rows.filter(F.char_length(F.trim("line")) >= min_chars).select("site", _hash(F.col("line")).alias("line_hash"))
    merged = rows.groupBy("line_hash").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"))
    seen = merged.select("line_hash", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    band = max(1.0, ERRORS * 1.04 / (1 << lg_k) ** 0.5 * min_sites)
    # a line has at most as many sites as copies, so fewer copies need no sketch to decide
    seen = written(seen.filter((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - band)), "line-spread")
    near = seen.filter(F.col("sites") <= min_sites + band).select("line_hash")
    exact = rows.join(small(near, near.count()), "line_hash", "left_semi").groupBy("line_hash").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    out = written(seen.filter(F.col("sites") > min_sites + band).select("line_hash").unionByName(exact.select("line_hash")), "line-boilerplate")
    forget(seen)
    return out


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text", site: str = "source", count: str = "n_removed", inline: int = INLINE) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and how many were.

    A text of nothing else becomes empty; a null text stays null with 0 lines removed. Every
    row stays, repeated ones too. A ``count`` column that exists already keeps its name and
    the new one gets a leading underscore.
    """
    bad = boilerplate(docs, min_sites, min_chars, text, site)
    n = bad.count()
    kept, added, key, drop = fresh(docs, "kept_lines", count, "row_key", "drop_at")
    lines = _lines(name(text))
    if n <= inline:
        hashes = [r[0] for r in bad.collect()]
        hit = lambda x: (F.char_length(F.trim(x)) >= min_chars) & (_hash(x).isin(hashes) if hashes else F.lit(False))
        out = docs.withColumn(kept, F.filter(lines, lambda x: ~hit(x)))
    else:
        # rows are known by a number that is written with them, since neither ids nor texts need be unique
        out = written(docs.withColumn(key, F.monotonically_increasing_id()), "line-rows")
        at = out.select(key, F.posexplode(_lines(name(text))).alias("pos", "line")).filter(F.char_length(F.trim("line")) >= min_chars)
        at = at.select(key, "pos", _hash(F.col("line")).alias("line_hash")).join(bad, "line_hash", "left_semi")
        places = at.groupBy(key).agg(F.collect_list("pos").alias(drop))
        out = out.join(places, key, "left")
        out = out.withColumn(kept, F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(F.col(drop), i), F.lit(False)))).drop(key, drop)
    out = out.withColumn(added, F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long"))
    new = F.when(F.col(added) > 0, F.array_join(kept, "\n")).otherwise(name(text))
    out = out.withColumn(added, F.when(name(text).isNull(), F.lit(0)).otherwise(F.col(added)).cast("long"))
    return out.select(*[new.alias(c) if c == text else name(c) for c in docs.columns], added)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_sql() -> str:
    return f"""
WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE source IS NOT NULL),
bad AS (SELECT line FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, count(*) FILTER (b.line IS NOT NULL) AS n_removed,
             coalesce(string_agg(e.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL), '') AS kept
      FROM e LEFT JOIN bad b ON trim(e.line) = b.line GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN k.n_removed > 0 THEN kept ELSE text END AS text, lang, source, n_chars, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)"""
