"""Sorted runs: Parquet files in key order with disjoint ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.ordering import RANGE, with_ranges
from ..schema import LOG_SCHEMA
from .manifest import Run


def row_bytes():
    return F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 8


def write_run(df: DataFrame, run_id: int, level: int, config: Config) -> Run:
    """Write ``key, value, op, seq`` as one run, then read its statistics back."""
    path = f"{config.data_path}/run_id={run_id}"
    df.select("key", "value", "op", "seq").repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.options(**config.writer_options()).parquet(path)
    return _described(df.sparkSession, path, run_id, level)[0]


def write_runs(df: DataFrame, first_id: int, level: int, config: Config, parts: int) -> list[Run]:
    """Write ``key, value, op, seq`` as up to ``parts`` runs of disjoint key ranges."""
    path = f"{config.data_path}/run_id={first_id}"
    rows = with_ranges(df.select("key", "value", "op", "seq"), parts=parts)
    rows = rows.withColumnRenamed(RANGE, "part").repartition(max(1, parts), "part").sortWithinPartitions("part", "key", F.desc("seq"))
    rows.write.partitionBy("part").options(**config.writer_options()).parquet(path)
    return _described(df.sparkSession, path, first_id, level)


def _described(spark: SparkSession, path: str, first_id: int, level: int) -> list[Run]:
    """The runs below a path that was written, numbered on in key order; an empty one if there are no rows."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(part=\d+)/[^/]*$", 1)
    rows = spark.read.schema(LOG_SCHEMA).parquet(path).select(folder.alias("folder"), "key", "value", "seq")
    found = rows.groupBy("folder").agg(F.count("*"), F.sum(row_bytes()), F.hex(F.min("key")), F.hex(F.max("key")), F.min("seq"), F.max("seq")).collect()  # one row a run
    found.sort(key=lambda r: r[3] or "")
    return [Run(first_id + i, level, f"{path}/{r[0]}".rstrip("/"), *r[1:]) for i, r in enumerate(found)] or [Run(first_id, level, path, 0, 0, None, None, 0, 0)]


def read_runs(spark: SparkSession, runs: list[Run], skip_corrupt: bool = False) -> DataFrame:
    """The rows of the runs; corrupt files raise unless ``skip_corrupt``."""
    paths = [r.path for r in runs if r.rows]
    if not paths:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).option("ignoreCorruptFiles", skip_corrupt).parquet(*paths)


def zone_map(log: DataFrame, *by: str) -> DataFrame:
    """Count, bytes and key bounds of each run of a log."""
    return log.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(row_bytes()).cast("bigint").alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def overlaps(zones: DataFrame) -> DataFrame:
    """Pairs of runs whose closed key ranges meet; zone maps are small."""
    a, b = zones.alias("a"), zones.alias("b")
    return a.join(b, (F.col("a.run_id") < F.col("b.run_id")) & (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("a.max_key") >= F.col("b.min_key")))
