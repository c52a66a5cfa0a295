"""Views of a change log. Each is ``DataFrame -> DataFrame`` and lazy, but for the bounds that
:mod:`.ordering` takes where neighbours in key order count.

Keys order by unsigned bytes. The newest write of a key, by ``seq``, hides older
ones on every read path; tombstones hide and are never returned. Predicates on
keys commute with this, so Catalyst pushes them to the scan; predicates on
values do not, and stay above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE, PUT
from .ordering import RANGE, with_ranges, within


def latest_wins(log: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key (default ``key``), tombstones included."""
    newest = Window.partitionBy(*(keys or ("key",))).orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def live(log: DataFrame) -> DataFrame:
    """Keys that exist, with their newest value."""
    return latest_wins(log).where(F.col("op") == PUT)


def deleted(log: DataFrame) -> DataFrame:
    return latest_wins(log).where(F.col("op") == DELETE)


def get(log: DataFrame, key) -> DataFrame:
    return live(log.where(F.col("key") == F.lit(key))).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Every row of ``keys(key)`` with its value, null for absent keys."""
    wanted = keys.select("key").distinct()
    found = live(log.join(wanted, "key", "left_semi")).select("key", "value")
    return keys.join(found, "key", "left")


def bounds(start=None, end=None, end_inclusive: bool = False) -> Column:
    """``start <= key < end``; None leaves a side open."""
    key, out = F.col("key"), F.lit(True)
    if start is not None:
        out = key >= F.lit(start)
    if end is not None:
        upper = key <= F.lit(end) if end_inclusive else key < F.lit(end)
        out = upper if start is None else out & upper
    return out


def range_scan(log: DataFrame, start=None, end=None, end_inclusive: bool = False, limit: int | None = None) -> DataFrame:
    """Live rows of a key range in key order, the first ``limit`` if given."""
    rows = live(log.where(bounds(start, end, end_inclusive))).select("key", "value").orderBy("key")
    return rows if limit is None else rows.limit(limit)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix: bytes | str, limit: int | None = None, every: bool = False) -> DataFrame:
    """Live rows whose key starts with ``prefix``, in key order.

    With ``every`` no put hides another: the log is a table in which keys repeat.
    """
    if isinstance(prefix, bytes):
        inside = bounds(bytearray(prefix), None if (end := prefix_end(prefix)) is None else bytearray(end))
    else:
        inside = F.col("key").startswith(prefix)
    rows = log.where(inside)
    rows = rows.where(F.col("op") == PUT).orderBy("key", "seq") if every else live(rows).orderBy("key")
    rows = rows.select("key", "value")
    return rows if limit is None else rows.limit(limit)


def checksum(key: Column, value: Column, op: Column, seq: Column) -> Column:
    """CRC-32 of a log row's fields; a null value differs from an empty one."""
    return F.crc32(F.concat_ws("|", F.hex(key), F.coalesce(F.hex(value), F.lit("-")), op, seq.cast("string")))


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", checksum(F.col("key"), F.col("value"), F.col("op"), F.col("seq")))


def intact(log: DataFrame) -> DataFrame:
    """Rows whose checksum fits; damaged ones are skipped, and the rest stays readable."""
    return log.where(F.col("crc") == checksum(F.col("key"), F.col("value"), F.col("op"), F.col("seq"))).drop("crc")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live rows as they were after write ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def replay(log: DataFrame, after: int) -> DataFrame:
    """Writes after ``after`` in write order."""
    return log.where(F.col("seq") > after).orderBy("seq")


def seek(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each row of ``probes(probe)`` the first live key not below it, or null.

    Keys and probes are laid out in one order; a running value from the end of
    each range answers its probes, and the first live key of the later ranges,
    one row a range, answers the rest.
    """
    keys = live(log).select("key", F.lit(False).alias("asks"))
    rows = with_ranges(keys.unionByName(probes.select(F.col("probe").alias("key"), F.lit(True).alias("asks"))))
    back = within(F.desc("key"), F.asc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("next", F.last(F.when(~F.col("asks"), F.col("key")), ignorenulls=True).over(back)).where("asks")
    heads = rows.groupBy(RANGE).agg(F.min(F.when(~F.col("asks"), F.col("key"))).alias("head"))
    later = Window.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(RANGE, F.min("head").over(later).alias("head"))  # one row a range
    return found.join(F.broadcast(heads), RANGE).select(F.col("key").alias("probe"), F.coalesce("next", "head").alias("key"))


def first_last(log: DataFrame) -> DataFrame:
    """One row: the first and last live key with their values."""
    rows = live(log)
    return rows.agg(F.min("key").alias("first_key"), F.min_by("value", "key").alias("first_value"), F.max("key").alias("last_key"), F.max_by("value", "key").alias("last_value"))


def neighbours(log: DataFrame) -> DataFrame:
    """Each live key with the live keys before and after it, null at the ends."""
    rows = with_ranges(live(log).select("key"))
    own = within("key")
    edges = rows.groupBy(RANGE).agg(F.min("key").alias("_low"), F.max("key").alias("_high"))
    order = Window.orderBy(RANGE)
    edges = edges.select(RANGE, F.lag("_high").over(order).alias("_high"), F.lead("_low").over(order).alias("_low"))  # one row a range
    rows = rows.select("*", F.lag("key").over(own).alias("_before"), F.lead("key").over(own).alias("_after")).join(F.broadcast(edges), RANGE)
    return rows.select("key", F.coalesce("_before", "_high").alias("prev_key"), F.coalesce("_after", "_low").alias("next_key"))
