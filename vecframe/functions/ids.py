"""Record ids: time-ordered UUIDs in canonical lower-case text."""

from __future__ import annotations

import hashlib
import os
import re
import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError

NIL = "00000000-0000-0000-0000-000000000000"
_FORM = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_lock, _last = threading.Lock(), [0, 0]


def generate_id() -> str:
    """A version 7 UUID; ids of one process also grow within a millisecond."""
    with _lock:
        now = time.time_ns() // 1_000_000
        if now > _last[0]:
            _last[:] = [now, int.from_bytes(os.urandom(1), "big")]
        else:
            _last[1] += 1
            if _last[1] > 0xFFF:
                _last[:] = [_last[0] + 1, 0]
        ms, n = _last
    tail = (int.from_bytes(os.urandom(8), "big") & ((1 << 62) - 1)) | 1 << 63
    return text_of((ms & ((1 << 48) - 1)) << 80 | 7 << 76 | n << 64 | tail)


def text_of(value: int) -> str:
    h = f"{value:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def is_valid_id(text: str) -> bool:
    return isinstance(text, str) and bool(_FORM.fullmatch(text))


def parse_id(text: str) -> str:
    """The canonical form of an id in either case, with or without hyphens."""
    if not is_valid_id(text):
        raise ConfigError(f"{text!r} is no record id")
    return text_of(int(text.replace("-", ""), 16))


def id_of(key: str) -> str:
    """The id of a key: its canonical form if it is a record id, else one that is made from its text, always the same."""
    return parse_id(key) if is_valid_id(key) else text_of(int(hashlib.md5(str(key).encode()).hexdigest(), 16))


def _hyphens(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def canonical(column: Column) -> Column:
    """``parse_id`` as a column; null for what is no id."""
    return F.when(column.rlike(rf"^(?:{_FORM.pattern})$"), _hyphens(F.lower(F.regexp_replace(column, "-", ""))))


def id_column(column: Column) -> Column:
    """``id_of`` as a column; null for a null key."""
    return F.when(column.isNotNull(), F.coalesce(canonical(column), _hyphens(F.md5(column))))


def new_ids(salt: str, *parts: Column) -> Column:
    """Ids made from a salt and columns that tell rows apart, so that a task that runs again makes the same ones."""
    return _hyphens(F.md5(F.concat_ws("/", F.lit(salt), *[p.cast("string") for p in parts])))
