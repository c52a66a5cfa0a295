"""Membership of keys: exact by semi and anti joins, approximate by a Bloom sketch."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bloom import positions

#: Bits of a filter that is broadcast as one array, and of one that may become a single value.
SMALL_BITS, MOST_BITS = 1 << 24, 1 << 31


def contains(keys: DataFrame, members: DataFrame, on: str = "key") -> DataFrame:
    return keys.join(members.select(on).distinct(), on, "left_semi")


def absent(keys: DataFrame, members: DataFrame, on: str = "key") -> DataFrame:
    return keys.join(members.select(on).distinct(), on, "left_anti")


class Sketch:
    """A Bloom filter as a table of 64-bit words.

    Up to ``SMALL_BITS`` the words are one broadcast array, and a key is probed
    by an expression on it: no row moves. Larger filters are joined by word.
    Keys are probed by their text, or their bytes if they are binary.
    """

    def __init__(self, words: DataFrame, bits: int, hashes: int, each: int = 0, keys: int = 0):
        self.words, self.bits, self.hashes, self.each, self.keys = words, bits, hashes, each, keys

    def __repr__(self) -> str:
        return f"Sketch(bits_per_key={self.each}, hashes={self.hashes}, bits={self.bits}, keys={self.keys})"

    @classmethod
    def build(cls, members: DataFrame, bits: int, hashes: int, on: str = "key", each: int = 0, keys: int = 0) -> Sketch:
        at = members.select(F.explode(positions(_hashed(members, on), bits, hashes)).alias("bit"))
        words = at.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set"))
        return cls(words, bits, hashes, each, keys)

    def _array(self) -> DataFrame:
        """One row with all words in order."""
        n = -(-self.bits // 64)
        rows = self.words.sparkSession.range(n).withColumnRenamed("id", "word").join(self.words, "word", "left")
        words = F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("bigint")).alias("set"))))
        return rows.agg(F.transform(words, lambda x: x["set"]).alias("_words"))

    def might_contain(self, keys: DataFrame, on: str = "key") -> DataFrame:
        """The rows of ``keys`` whose bits are all set: every member, and few others."""
        if self.bits <= SMALL_BITS:
            hit = F.forall(positions(_hashed(keys, on), self.bits, self.hashes), lambda p: F.getbit(F.get("_words", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
            return keys.crossJoin(F.broadcast(self._array())).where(hit).select(*keys.columns)  # one row, SMALL_BITS at most
        asked = keys.select(F.col(on), F.explode(F.array_distinct(positions(_hashed(keys, on), self.bits, self.hashes))).alias("bit")).withColumn("word", F.expr("bit div 64")).distinct()
        hit = asked.join(self.words, "word", "left").withColumn("hit", F.coalesce(F.expr("getbit(`set`, cast(bit % 64 as int)) = 1"), F.lit(False)))
        found = hit.groupBy(on).agg(F.min("hit").alias("maybe")).where("maybe").select(on)
        return keys.join(found, on, "left_semi")

    def fill_ratio(self) -> DataFrame:
        return self.words.agg((F.sum(F.bit_count("set")) / F.lit(float(self.bits))).alias("fill"))

    def grow(self, members: DataFrame, on: str = "key") -> Sketch:
        """A filter of twice the bits. Bits of a key depend on the size, so it is built anew from the members."""
        return Sketch.build(members, 2 * self.bits, self.hashes, on, self.each, self.keys)

    def to_bytes(self) -> bytes:
        """Bits a key, hashes, bits and keys as little-endian 32-bit integers, then the bit array."""
        if self.bits > MOST_BITS:
            raise ValueError("the filter is too large for one value")
        body = np.zeros(-(-self.bits // 64), "<i8")
        rows = self.words.collect()  # MOST_BITS / 64 rows at most
        body[[r["word"] for r in rows]] = [r["set"] for r in rows]
        return struct.pack("<IIII", self.each, self.hashes, self.bits, self.keys) + body.tobytes()[: -(-self.bits // 8)]

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> Sketch:
        """The filter that :meth:`to_bytes` wrote.

        Bits that were cut off count as set: a damaged filter lets more keys
        through, but never denies a member.
        """
        if len(data) < 16:
            raise ValueError("the data are too short for a filter")
        each, hashes, bits, keys = struct.unpack("<IIII", data[:16])
        if not hashes or not bits:
            raise ValueError("the filter has no bits or no hashes")
        size = -(-bits // 64) * 8
        whole = data[16 : 16 + -(-bits // 8)]
        body = np.frombuffer(whole + b"\xff" * (-(-bits // 8) - len(whole)) + b"\0" * (size - -(-bits // 8)), "<i8")
        at = np.flatnonzero(body)
        rows = pa.table({"word": pa.array(at, pa.int64()), "set": pa.array(body[at].astype(np.int64))})
        return cls(spark.createDataFrame(rows), bits, hashes, each, keys)


def _hashed(df: DataFrame, on: str):
    return F.col(on) if dict(df.dtypes)[on] == "binary" else F.col(on).cast("string")


def sketch_for(spark: SparkSession, members: DataFrame, capacity: int, fpr: float, on: str = "key") -> Sketch:
    from ..functions.bloom import bits_per_key, hash_count

    each = bits_per_key(fpr)
    return Sketch.build(members, max(64, each * max(1, capacity)), hash_count(each), on, each, capacity)
