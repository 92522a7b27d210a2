"""Reproducible pseudo-random draws: functions of a key alone, the same in every engine."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def draw(key: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1 drawn by the MD5 of ``key``."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(n) if isinstance(n, int) else n)


def seed64(key: Column) -> Column:
    """The first eight bytes of the SHA-256 of ``key`` as an unsigned big-endian number."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


@F.pandas_udf(LongType())
def blake_seed(key: pd.Series) -> pd.Series:
    """A seed below 2^63 from the eight-byte BLAKE2b digest of ``key``, big-endian."""
    return key.map(lambda k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest()) % (1 << 63), na_action="ignore").astype("Int64")
