"""Column functions of float vectors; sums accumulate in double, in order.

Up to ``UNROLLED`` dimensions against a literal are written out, so that they stay inside
whole-stage code generation; others are higher-order functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import METRICS, one_of

UNROLLED = 128


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(a: Column, b: Column | Sequence[float], term) -> Column:
    if not isinstance(b, Column) and len(b) <= UNROLLED:
        total = F.lit(0.0)
        for i, x in enumerate(b):
            total = total + term(F.get(a, F.lit(i)).cast("double"), F.lit(float(x)))
        return total
    b = b if isinstance(b, Column) else literal(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column | Sequence[float]) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column | Sequence[float]) -> Column:
    return F.sqrt(squared_l2(a, b))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = magnitude(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def distance(metric: str, a: Column, b: Column | Sequence[float]) -> Column:
    """Smaller is closer: 1 - dot (inputs are normalised by the caller), L2, or -dot."""
    one_of(metric, METRICS, "metric")
    if metric == "euclidean":
        return l2(a, b)
    return 1.0 - dot(a, b) if metric == "cosine" else -dot(a, b)


def distance_of(metric: str, a: Sequence[float], b: Sequence[float]) -> float:
    """``distance`` of two Python vectors, without normalising them."""
    one_of(metric, METRICS, "metric")
    if metric == "euclidean":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    d = sum(x * y for x, y in zip(a, b, strict=True))
    return 1.0 - d if metric == "cosine" else -d


def normalized(v: Sequence[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else list(v)
