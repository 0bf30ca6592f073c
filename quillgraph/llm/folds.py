"""Folds of labelled rows, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, mod `parts`; 2 is held out.  A null id has the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % parts


def sampled(rows: DataFrame, key: str, bound: int, salt: str) -> DataFrame:
    """About `bound` rows, or all if there are fewer: those whose hashed key lies below a threshold.

    Nothing is sorted or gathered; rows with equal keys stay together.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
