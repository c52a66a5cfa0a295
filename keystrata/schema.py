"""The change log: one row a write, the newest of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = "P", "D"

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("op", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

#: Rows of a log batch: with a checksum.
STORED = T.StructType([*LOG_SCHEMA.fields, T.StructField("crc", T.LongType(), False)])


def encode_text(col: Column) -> Column:
    """Strings become UTF-8; binary columns pass."""
    return F.encode(col.cast("string"), "UTF-8")


def encode_integer(col: Column) -> Column:
    """Eight bytes whose unsigned order is the order of the integers."""
    return F.unhex(F.lpad(F.hex(col.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def encode_fixed(col: Column, width: int = 8) -> Column:
    """Zero-padded decimal text, which orders like the integers of at most ``width`` digits."""
    return F.lpad(col.cast("string"), width, "0")


def as_log(df: DataFrame, key: Column, value: Column, seq: Column, deleted: Column | None = None) -> DataFrame:
    """A change log from any table; rows where ``deleted`` holds are tombstones."""
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    return df.select(key.alias("key"), F.when(~gone, value).alias("value"), F.when(gone, DELETE).otherwise(PUT).alias("op"), seq.cast("bigint").alias("seq"))
