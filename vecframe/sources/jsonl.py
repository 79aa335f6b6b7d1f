"""JSON lines of records: ``{"id": ..., "vector": [...], "data": {...}}``, with documents, chunks and lineage."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..types import CHUNK, DOCUMENT, LINEAGE, META, meta_dict, meta_row

INPUT = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("meta", META), T.StructField("document", DOCUMENT), T.StructField("chunk", CHUNK), T.StructField("lineage", LINEAGE)])


def write_jsonl(records: DataFrame, path: str) -> None:
    """Records as JSON lines; numbers keep their full precision, documents, chunks and lineage are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                row = {k: v for k, v in r.items() if v is not None and k != "meta"}
                row["data"] = meta_dict(dict(r["meta"] or []))
                if "lineage" in row:
                    row["lineage"]["attributes"] = meta_dict(dict(row["lineage"]["attributes"] or []))
                out.append(json.dumps(row, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records.select(*[f.name for f in INPUT.fields]).mapInArrow(run, "value string").write.mode("errorifexists").text(path)


def _first(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def parse_line(line: str) -> dict:
    """One record of JSON; of repeated keys the first counts, and ``meta`` may stand for ``data``."""
    d = json.loads(line, object_pairs_hook=_first)
    part = lambda name, kind: {f.name: (d[name] or {}).get(f.name) for f in kind.fields} if d.get(name) else None
    lineage = part("lineage", LINEAGE)
    if lineage:
        lineage["attributes"] = _tagged(lineage["attributes"])
    return {"id": d.get("id"), "vector": d.get("vector"), "meta": _tagged(d.get("data", d.get("meta"))), "document": part("document", DOCUMENT), "chunk": part("chunk", CHUNK), "lineage": lineage}


def _tagged(meta: dict | None) -> list[tuple]:
    return [(k, dict(zip("kidbs", v))) for k, v in meta_row(meta).items()]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines (the schema INPUT); those without an id get one at ingest. Blank lines are skipped."""
    schema = to_arrow_schema(INPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_line(x) for x in b.column(0).to_pylist() if x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], names=schema.names)

    return spark.read.text(path).mapInArrow(run, INPUT)
