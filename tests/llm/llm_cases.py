"""Small document tables that the tests here share."""

from collections import Counter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "a")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], SCHEMA)


def bag(df):
    return Counter(map(repr, df.collect()))
