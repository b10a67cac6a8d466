"""Key hashes of the keyed dispatcher."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MASK = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes; a native fold, bigint throughout."""
    hexed = F.hex(text.cast("binary"))
    n = F.length(hexed) / 2
    places = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(MASK).cast("long")))


def murmur2_value(data: bytes, seed: int = 0xC58F1A7A) -> int:
    """MurmurHash2, 32 bits; empty input is 0."""
    if not data:
        return 0
    m = 0x5BD1E995
    h = seed ^ len(data)
    whole = len(data) & ~3
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        k = k * m & MASK
        k = (k ^ k >> 24) * m & MASK
        h = h * m & MASK ^ k
    rest = data[whole:]
    if rest:
        h = (h ^ int.from_bytes(rest, "little")) * m & MASK
    h = (h ^ h >> 13) * m & MASK
    return h ^ h >> 15


@F.pandas_udf(LongType())
def murmur2(text: pd.Series) -> pd.Series:
    distinct = {t: murmur2_value(t.encode() if isinstance(t, str) else bytes(t)) for t in text.dropna().unique()}
    return text.map(distinct).astype("Int64")


def partition_of(hashed: Column, partitions: int) -> Column:
    if partitions < 1:
        raise ValueError("at least one partition is needed")
    return (hashed % F.lit(partitions)).cast("int")
