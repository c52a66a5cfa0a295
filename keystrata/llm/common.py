"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the longest batch that one Arrow step holds, about.
BATCH_CHARS = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Where a local session names none (tests), a temporary folder is set; a
    cluster that names none is an error, as its executors share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def persist(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`persist` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, where the session does not: rows hold whole texts."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_CHARS))


def text_class(col) -> "F.Column":
    """A 32-byte digest that equal texts share; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(col, F.lit("")), 256))


def slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``text``."""
    col = batch.column(batch.schema.get_field_index(text))
    n = len(col)
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    part = np.cumsum(sizes) // limit
    start = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), n]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def arrow_schema(spark: SparkSession, schema) -> tuple:
    """A schema for Spark and for Arrow; batches that go to Python are bounded from now on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded(spark)
    target = spark.createDataFrame([], schema).schema
    return target, to_arrow_schema(target)


def map_arrow(df: DataFrame, fn: Callable, schema, text: str | None = None, limit: int = BATCH_CHARS) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> dict | RecordBatch | None``, by bounded batches.

    A dict holds the columns of ``schema`` by name. ``text`` names the column
    whose bytes bound a batch.
    """
    target, arrow = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, limit) if text else [whole]:
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, dict):
                    cols = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, out[f.name]) for f in arrow)]
                    out = pa.RecordBatch.from_arrays(cols, schema=arrow)
                yield out

    return df.mapInArrow(run, target)


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours in a sorted array, and its length."""
    if len(values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).astype(np.int64)
