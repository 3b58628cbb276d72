"""Keyed randomness: every draw is a pure function of (purpose, seed, keys).

A draw is the first 32 bits of MD5 over the keys joined by ``|``; Spark, plain SQL and
Python compute the same integer, so results do not depend on partitioning, on retries or on
the engine.  An event of probability p happens if draw < p * 2^32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from _md5 import md5  # the interpreter's own starts faster on short keys
except ImportError:
    from hashlib import md5

TWO32 = 4294967296.0


def u32(purpose: str, seed: int, *keys: Column) -> Column:
    joined = F.concat_ws("|", F.lit(f"{purpose}|{seed}"), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def uniform(purpose: str, seed: int, *keys: Column) -> Column:
    """In [0, 1)."""
    return u32(purpose, seed, *keys) / F.lit(TWO32)


def sql_u32(purpose: str, seed: int, *keys: str) -> str:
    joined = " || '|' || ".join([f"'{purpose}|{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def sql_uniform(purpose: str, seed: int, *keys: str) -> str:
    return f"({sql_u32(purpose, seed, *keys)} / 4294967296.0::DOUBLE)"


def draw(text: str) -> int:
    """The same for ``purpose|seed|key|...`` in Python."""
    return int.from_bytes(md5(text.encode()).digest()[:4], "big")
