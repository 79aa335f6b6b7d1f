"""Which physical path a search takes, decided above the DataFrame, by counts that the caller has."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.filters import Filter

SMALL = 128


@dataclass(frozen=True)
class QueryPlan:
    strategy: str
    candidate_count: int
    metadata_accelerated: bool
    index_type: str
    codec: str = "none"


def plan_seek(n: int, top: int, where: Filter | None = None, threshold: float | None = None, index: str = "graph", codec: str = "none", accelerate: bool = True, candidates: int | None = None, text: bool = False) -> QueryPlan:
    """The plan of a search over ``n`` records.

    ``candidates`` is how many records meet the filter's equality constraints, if the caller
    knows; it counts only if the filter is a pure AND of ``=`` and ``in``.
    """
    kind = index + ("_quantized" if codec != "none" else "")
    plan = lambda s, c, m: QueryPlan(s, c, m, kind, codec)
    if n == 0 or top == 0:
        return plan("text_probe" if text else "full_scan", n, False)
    full = threshold is not None or n <= SMALL or top >= max(n // 2, 1)
    count, fast = n, False
    if accelerate and where is not None and where.exact_constraints() is not None and candidates is not None:
        count, fast = candidates, True
        if candidates == 0 or candidates <= max(8 * top, SMALL) or full:
            return plan("hybrid_fusion" if text else "exact_candidates", count, True)
    if full:
        return plan("hybrid_fusion" if text else "full_scan", count, fast)
    return plan("hybrid_fusion" if text else "ann_index", count, fast)
