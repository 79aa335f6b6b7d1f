"""A PySpark-native vector and document retrieval engine."""

from .config import Config, GraphParams, QuantParams
from .engine import Collection, Engine, Transaction, connect
from .operators.filters import ColumnBinding, Filter, MetaBinding

__all__ = ["Collection", "ColumnBinding", "Config", "Engine", "Filter", "GraphParams", "MetaBinding", "QuantParams", "Transaction", "connect"]
