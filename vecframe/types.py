"""The schema of records and conversion of metadata."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import types as T

from .errors import ConfigError

#: A metadata value: k is 0 for int, 1 for double, 2 for bool, 3 for string.
VALUE = T.StructType([T.StructField("k", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("s", T.StringType())])
META = T.MapType(T.StringType(), VALUE)
DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "uri", "mime_type")])
CHUNK = T.StructType([T.StructField("document_key", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("ordinal", "char_start", "char_end")])
LINEAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("provider", "model", "revision")] + [T.StructField("attributes", META)])
RECORD = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("meta", META),
    T.StructField("document", DOCUMENT),
    T.StructField("chunk", CHUNK),
    T.StructField("lineage", LINEAGE),
    T.StructField("codes", T.BinaryType()),
    T.StructField("codec", T.StringType(), False),
    T.StructField("list_id", T.IntegerType()),
])

MetaValue = int | float | bool | str


def kind_of(value: MetaValue) -> int:
    """The tag of a metadata value; other types, NaN and ints beyond 64 bits are refused."""
    if isinstance(value, bool):
        return 2
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ConfigError(f"{value} does not fit 64 bits")
        return 0
    if isinstance(value, float):
        if math.isnan(value):
            raise ConfigError("NaN is no metadata value")
        return 1
    if isinstance(value, str):
        return 3
    raise ConfigError(f"metadata values are int, float, bool or str, not {type(value).__name__}")


def meta_row(meta: Mapping[str, MetaValue] | None) -> dict[str, tuple]:
    out = {}
    for key, v in (meta or {}).items():
        row = [kind_of(v), None, None, None, None]
        row[row[0] + 1] = v
        out[key] = tuple(row)
    return out


def meta_dict(row) -> dict[str, MetaValue]:
    return {k: v["kidbs"[v["k"] + 1]] for k, v in sorted((row or {}).items())}
