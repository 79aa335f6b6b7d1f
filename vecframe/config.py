"""Settings of a database and their validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from .errors import ConfigError

METRICS = ("cosine", "euclidean", "dot_product")
INDEXES = ("graph", "exact")
CODECS = ("none", "pq", "opq", "sq8")
DURABILITY = ("paranoid", "standard", "relaxed", "ephemeral")
ACCESS = ("read_write", "read_only")


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ConfigError(f"unknown {what} {value!r}; one of {', '.join(allowed)}")
    return value


def requires_normalization(metric: str) -> bool:
    return one_of(metric, METRICS, "metric") == "cosine"


@dataclass(frozen=True)
class GraphParams:
    """Accepted for approximate search; ``ef_search`` sets how many lists are probed first."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    compaction_ratio: float = 0.2

    def __post_init__(self):
        if self.m < 2 or self.ef_construction < 1 or self.ef_search < 1 or not 0 < self.compaction_ratio <= 1:
            raise ConfigError("graph parameters are out of range")


@dataclass(frozen=True)
class QuantParams:
    codec: str = "none"
    pq_dim: int = 0
    pq_bits: int = 8
    iterations: int = 20
    train_rows: int = 100_000

    def __post_init__(self):
        one_of("sq8" if self.codec == "sq" else self.codec, CODECS, "codec")
        if self.codec == "sq":
            object.__setattr__(self, "codec", "sq8")
        if not 4 <= self.pq_bits <= 8:
            raise ConfigError("pq_bits must be between 4 and 8")
        if self.pq_dim < 0:
            raise ConfigError("pq_dim must not be negative")


@dataclass(frozen=True)
class Config:
    dimension: int = 0
    metric: str = "cosine"
    index: str = "graph"
    graph: GraphParams = field(default_factory=GraphParams)
    quantization: QuantParams = field(default_factory=QuantParams)
    durability: str = "standard"
    access_mode: str = "read_write"
    segmented_storage: bool = True
    metadata_acceleration: bool = True
    auto_text_embedder: bool = True

    def __post_init__(self):
        one_of(self.metric, METRICS, "metric")
        one_of(self.index, INDEXES, "index")
        one_of(self.durability, DURABILITY, "durability")
        one_of(self.access_mode, ACCESS, "access mode")
        if not 0 <= self.dimension <= 65_535:
            raise ConfigError("dimension must be between 0 and 65535")
        d, q = self.dimension, self.quantization
        if d and q.codec in ("pq", "opq") and q.pq_dim and d % q.pq_dim:
            raise ConfigError("pq_dim must divide the dimension")

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Config:
        return cls(**{**d, "graph": GraphParams(**d.get("graph", {})), "quantization": QuantParams(**d.get("quantization", {}))})
