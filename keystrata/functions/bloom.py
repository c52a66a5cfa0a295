"""Bloom filter arithmetic, for Python numbers and for columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_per_key(fpr: float) -> int:
    """Bits a key for a false-positive rate, with 44 % on top of the optimum."""
    if not 0 < fpr < 1:
        raise ValueError("the rate must lie between 0 and 1")
    return max(1, math.floor(-math.log(fpr) / math.log(2) ** 2 * 1.44))


def hash_count(bits: int) -> int:
    return max(1, math.floor(bits * math.log(2)))


def bits_per_key_col(fpr: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(-F.log(fpr) / (math.log(2) ** 2) * 1.44).cast("int"))


def hash_count_col(bits: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(bits * math.log(2)).cast("int"))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key: two 32-bit parts of its MD5 digest, stepped."""
    digest = F.md5(key)
    a, b = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))
