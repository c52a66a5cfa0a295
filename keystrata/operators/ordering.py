"""Global key order without a global sort: ranges of keys as a plain column.

A bounded sample of the keys gives the bounds, once; from then on the range of a
row is a function of its key alone, so that every part of a plan, and every
retried task, deals a row to the same range. Windows run within ranges, and what
they need from other ranges is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = "_p"
#: Sampled keys for each bound.
EACH = 40


def bounds_of(df: DataFrame, key: str = "key", parts: int | None = None) -> list:
    """Keys that cut ``df`` into at most ``parts`` ranges of about the same number of rows."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return []
    rows = df.select(key).where(F.col(key).isNotNull()).orderBy(F.rand(17)).limit(parts * EACH).collect()
    seen = sorted(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in rows)
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []


def range_number(key: Column, bounds: list) -> Column:
    """How many bounds are at most the key, by binary search in an array."""
    if not bounds:
        return F.lit(0)
    limits = F.array(*(F.lit(bytearray(b) if isinstance(b, bytes) else b) for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(limits, at + step - 1) <= key), at + step).otherwise(at))


def with_ranges(df: DataFrame, key: str = "key", parts: int | None = None) -> DataFrame:
    """``df`` with its range number ``_p``; takes one small job for the bounds."""
    return df.withColumn(RANGE, range_number(F.col(key), bounds_of(df, key, parts)))


def within(*order) -> "Window":
    return Window.partitionBy(RANGE).orderBy(*order)


def before(rows: DataFrame, size: Column) -> Column:
    """The sum of ``size`` over all ranges before a row's own; one row a range comes to the driver."""
    totals = {r[0]: r[1] or 0 for r in rows.groupBy(RANGE).agg(F.sum(size)).collect()}
    out = [0]
    for p in range(max(totals, default=0)):
        out.append(out[-1] + totals.get(p, 0))
    return F.get(F.array(*(F.lit(n).cast("bigint") for n in out)), F.col(RANGE))


def numbered(df: DataFrame, key: str = "key") -> DataFrame:
    """``df`` in key order with ``pos`` from 0 and ``prev``, the key before; keys are distinct."""
    rows = with_ranges(df, key)
    own = within(key)
    edges = rows.groupBy(RANGE).agg(F.max(key).alias("_high"), F.count("*").alias("_n"))
    order = Window.orderBy(RANGE)
    edges = edges.select(RANGE, F.lag("_high").over(order).alias("_high"), F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    out = rows.select("*", F.lag(key).over(own).alias("_prev"), F.row_number().over(own).alias("_row")).join(F.broadcast(edges), RANGE)
    return out.select(*df.columns, (F.col("_first") + F.col("_row") - 1).alias("pos"), F.coalesce("_prev", "_high").alias("prev"))
