"""Command line: info, vaults, query, checkpoint, export, import, verify, stats, bench, quantize."""

from __future__ import annotations

import argparse
import json
import sys
import time

import numpy as np
from pyspark.sql import SparkSession

from .config import QuantParams
from .engine import Engine, connect
from .errors import VecframeError
from .operators import search
from .types import meta_dict


def _print_hits(df) -> None:
    for r in df.collect():
        d = r.asDict(recursive=True)
        print(json.dumps({"id": d["id"], "distance": d["distance"], "data": meta_dict(d["meta"]), "document": (d["document"] or {}).get("text")}))


def _bench(spark: SparkSession, count: int, dim: int) -> None:
    rng = np.random.default_rng(42)
    rows = [(f"{i:08d}", rng.standard_normal(dim).astype(float).tolist()) for i in range(count)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").cache()
    df.count()
    q = spark.createDataFrame([(i, rng.standard_normal(dim).tolist()) for i in range(1000)], "query_id long, query array<float>")
    t = time.perf_counter()
    search.batch_knn(df, q, 10, "euclidean").count()
    s = time.perf_counter() - t
    waits = latencies(lambda v: search.exact_knn(df, v, 10, "euclidean").collect(), [rng.standard_normal(dim).tolist() for _ in range(20)])
    print(json.dumps({"vectors": count, "dimension": dim, "queries": 1000, "seconds": round(s, 3), "qps": round(1000 / s, 1), **waits}))


def latencies(ask, queries: list) -> dict[str, float]:
    """Milliseconds of single searches after a first one: p50, p95 and p99."""
    ask(queries[0])
    took = []
    for q in queries:
        t = time.perf_counter()
        ask(q)
        took.append(1000 * (time.perf_counter() - t))
    return {f"p{p}_ms": round(float(np.percentile(took, p)), 2) for p in (50, 95, 99)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="vecframe")
    p.add_argument("command", choices=["info", "vaults", "query", "checkpoint", "export", "import", "verify", "stats", "bench", "quantize"])
    p.add_argument("--path", default=":memory:")
    p.add_argument("--dimension", type=int, default=0)
    p.add_argument("--vault")
    p.add_argument("--query")
    p.add_argument("--file")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--quantize", default="sq8")
    p.add_argument("--pq-dim", type=int, default=0)
    p.add_argument("--pq-bits", type=int, default=8)
    p.add_argument("--count", type=int, default=10_000)
    p.add_argument("--dim", type=int, default=128)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "bench":
        _bench(spark, a.count, a.dim)
        return 0
    try:
        with connect(a.path, spark=spark, dimension=a.dimension) as db:
            return _run(a, db)
    except (VecframeError, OSError) as e:
        print(f"{'CORRUPT' if a.command == 'verify' else 'error'}: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, db: Engine) -> int:
    if a.command == "info":
        infos = [db.collection(n).info() for n in db.collection_names()]
        c = db.config
        ratio = {i.name: round(4 * i.dimension / max(1, i.code_bytes), 2) for i in infos}
        print(json.dumps({"path": db.path, "dimension": c.dimension, "metric": c.metric, "index": c.index, "vaults": len(infos), "records": sum(i.count for i in infos), "compression": ratio}))
    elif a.command in ("vaults", "stats"):
        for name, n in db.totals().items():
            print(json.dumps({"vault": name, "records": n}))
    elif a.command == "query":
        text = a.query
        if a.file:
            with open(a.file) as f:
                text = f.read()
        _print_hits(db.query(text or ""))
    elif a.command == "checkpoint":
        db.checkpoint()
    elif a.command == "export":
        c = db.collection(a.vault)
        if c.quantizer() is not None:
            print("warning: the vectors are decoded from codes", file=sys.stderr)
        c.export_jsonl(a.output)
    elif a.command == "import":
        db.collection(a.vault).import_jsonl(a.input)
        db.checkpoint()
    elif a.command == "verify":
        print(found := db.verify())
        return int(found != "OK")
    else:
        params = QuantParams(a.quantize, a.pq_dim, a.pq_bits)
        for name in [a.vault] if a.vault else db.collection_names():
            db.collection(name).compress(params)
    return 0


if __name__ == "__main__":
    sys.exit(main())
