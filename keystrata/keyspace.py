"""A keyspace: batches of writes, flushes, compactions and reads of a snapshot.

One writer, any number of readers: files are never changed, and a version of
the manifest names those that are live.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import view
from .operators.cursor import Cursor
from .plans import compaction
from .schema import DELETE, LOG_SCHEMA, PUT, STORED
from .sources.manifest import Manifest, Version
from .sources.runs import read_runs, write_run, write_runs

#: Keys that a lookup may send to the scan as a predicate.
FEW_KEYS = 1000
_SIZE = "length(key) + coalesce(length(value), 0)"


@dataclass(frozen=True)
class Batch:
    """A batch of the log that no flush has taken."""

    number: int
    path: str
    last_seq: int
    bytes: int
    stream: tuple[str, int] | None = None


#: batch=<number>, and for micro-batches the stream's name in hex and their number
_NAME = re.compile(r"batch=(\d+)(?:\.([0-9a-f]*)\.(\d+))?$")


def _bytes(x) -> bytearray | None:
    return None if x is None else bytearray(x.encode() if isinstance(x, str) else x)


class Keyspace:
    """``with Keyspace(spark, config) as ks: ks.put("a", "1"); ks.get("a")``"""

    def __init__(self, spark: SparkSession, config: Config | str):
        self.spark = spark
        self.config = config if isinstance(config, Config) else Config(config)
        self.manifest = Manifest(spark, f"{self.config.path}/manifest")
        self.version = self.manifest.read()
        self._batches = self._unflushed()
        self._seq = max([self.version.last_seq, *(b.last_seq for b in self._batches)])
        self._open = True

    def __enter__(self) -> Keyspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __del__(self) -> None:
        # staged batches are safe in the log, so nothing is flushed here
        if getattr(self, "_open", False):
            self._open = False
            self.manifest.close()

    # -- the log ---------------------------------------------------------------

    def _log_rows(self, paths: list[str]) -> DataFrame:
        """Rows of batches whose checksums fit, with ``skip_damaged_log`` without unreadable files."""
        rows = self.spark.read.schema(STORED).option("ignoreCorruptFiles", self.config.skip_damaged_log).parquet(*paths)
        return view.intact(rows) if self.config.skip_damaged_log else rows

    def _unflushed(self) -> list[Batch]:
        """Batches that no flush has taken, up to the first number that is missing.

        A batch appears by a rename once it is complete, so a write that was cut
        short leaves no number behind; what comes after a lost one is not replayed.
        """
        found = {int(m[1]): (name, m) for name in self.manifest.names(self.config.log_path) if (m := _NAME.match(name))}
        number, names = self.version.flushed_batch + 1, {}
        while number in found:
            names[number] = found[number]
            number += 1
        if not names:
            return []
        at = {n: f"{self.config.log_path}/{name}" for n, (name, _) in names.items()}
        which = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)[^/]*/[^/]*$", 1).cast("long")
        rows = self._log_rows(list(at.values())).select(which.alias("number"), "key", "value", "seq")
        size = {r[0]: r for r in rows.groupBy("number").agg(F.max("seq"), F.sum(F.expr(_SIZE))).collect()}  # one row a batch
        out = []
        for n, (_, m) in names.items():
            _, seq, total = size.get(n, (n, 0, 0))
            out.append(Batch(n, at[n], seq, total, (bytes.fromhex(m[2]).decode(), int(m[3])) if m[3] else None))
        return out

    def _guard(self) -> None:
        if not self._open:
            raise ValueError("the keyspace is closed")

    def write_batch(self, df: DataFrame, order_by: str | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Append ``key, value[, op]`` as one atomic batch; False if it was there already.

        ``order_by`` orders writes within the batch; without it a key may occur
        once only. Strings are encoded as UTF-8. Sequence numbers rise from
        batch to batch and with the order, though not without gaps. The input is
        evaluated once: what is checked is what was written, and a batch that
        fails the checks is deleted. ``stream`` names a micro-batch; one that was
        written before, flushed or not, is not written again.
        """
        self._guard()
        if stream and stream[1] <= max((n for name, n in [*self.version.streams, *(b.stream for b in self._batches if b.stream)] if name == stream[0]), default=-1):
            return False
        kinds = dict(df.dtypes)
        if "op" not in kinds:
            df = df.withColumn("op", F.lit(PUT))
        cols = [F.encode(F.col(c), "UTF-8").alias(c) if kinds.get(c) == "string" else F.col(c).cast("binary").alias(c) for c in ("key", "value")]
        rows = df.select(*cols, "op", *([F.col(order_by).alias("_order")] if order_by else []))
        if self.config.empty_is_tombstone:
            rows = rows.withColumn("op", F.when((F.col("op") == PUT) & (F.length("value") == 0), DELETE).otherwise(F.col("op")))
        rows = rows.withColumn("value", F.when(F.col("op") == PUT, F.col("value")))
        if order_by:
            rows = rows.repartitionByRange("_order").sortWithinPartitions("_order")
        number = max([self.version.flushed_batch, *(b.number for b in self._batches)]) + 1
        path = self.manifest._path
        temp = f"{self.config.log_path}/.{uuid.uuid4().hex}"
        rows = rows.select("key", "value", "op", (F.monotonically_increasing_id() + self._seq + 1).alias("seq"))
        view.with_checksum(rows).write.option("compression", self.config.codec).parquet(temp)
        written = self.spark.read.schema(STORED).parquet(temp)
        last, total, nulls = written.agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.sum(F.expr(_SIZE)), F.lit(0)), F.count(F.when(F.col("key").isNull(), 1))).first()
        error = "a key is null" if nulls else None
        if not error and not order_by and not written.groupBy("key").count().where("count > 1").isEmpty():
            error = "a key occurs twice in the batch; pass order_by"
        if error:
            self.manifest.fs.delete(path(temp), True)
            raise ValueError(error)
        at = f"{self.config.log_path}/batch={number}" + (f".{stream[0].encode().hex()}.{stream[1]}" if stream else "")
        self.manifest.move(path(temp), path(at))
        self._seq = max(self._seq, last)
        self._batches.append(Batch(number, at, last, total, stream))
        if self.staged_bytes() >= self.config.memtable_bytes:
            self.flush()
        return True

    def put(self, key, value) -> None:
        self.write_batch(self.spark.createDataFrame([(_bytes(key), _bytes(value))], "key binary, value binary"))

    def delete(self, key) -> None:
        self.delete_batch(self.spark.createDataFrame([(_bytes(key),)], "key binary"))

    def delete_batch(self, keys: DataFrame) -> None:
        self.write_batch(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(DELETE).alias("op")).distinct())

    def staged(self) -> DataFrame:
        """Rows of the batches that no flush has taken."""
        if not self._batches:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self._log_rows([b.path for b in self._batches]).select(*LOG_SCHEMA.names)

    def staged_bytes(self) -> int:
        return sum(b.bytes for b in self._batches)

    def is_staged_empty(self) -> bool:
        return not self._batches

    def clear_staged(self) -> None:
        """Drop the batches that no flush has taken; flushed data stay."""
        self._guard()
        for b in self._batches:
            self.manifest.fs.delete(self.manifest._path(b.path), True)
        self._batches = []

    # -- maintenance -----------------------------------------------------------

    def flush(self) -> None:
        """Staged batches become a run of level 0; the manifest is published last."""
        self._guard()
        if not self._batches:
            return
        v = self.version
        run = write_run(view.latest_wins(self.staged()), v.next_run, 0, self.config)
        streams = dict(v.streams)
        for b in self._batches:
            if b.stream:
                streams[b.stream[0]] = max(b.stream[1], streams.get(b.stream[0], -1))
        self.version = self.manifest.publish(Version(v.version + 1, v.next_run + 1, self._seq, self._batches[-1].number, (*v.runs, run), (run.run_id,), (), tuple(sorted(streams.items()))))
        self._batches = []
        if self.config.auto_compact:
            while compaction.needed(self.version, self.config):
                if not self.compact():
                    break

    def compact(self, level: int | None = None, force: bool = False) -> bool:
        """Run one compaction; False if there was none to run."""
        self._guard()
        job = compaction.pick(self.version, self.config, level, force)
        if job is None:
            return False
        v = self.version
        rows = compaction.merge(read_runs(self.spark, list(job.inputs)), job.bottom)
        parts = max(1, sum(r.bytes for r in job.inputs) // self.config.level_file_bytes(job.target))
        runs = write_runs(rows, v.next_run, job.target, self.config, int(parts))
        gone = {r.run_id for r in job.inputs}
        kept = tuple(r for r in v.runs if r.run_id not in gone)
        self.version = self.manifest.publish(replace(v, version=v.version + 1, next_run=runs[-1].run_id + 1, runs=(*kept, *runs), added=tuple(r.run_id for r in runs), removed=tuple(sorted(gone))))
        return True

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete runs that none of the newest versions names, and flushed batches."""
        self._guard()
        live = {r.path for n in self.manifest.versions()[-max(1, keep_versions) :] for r in self.manifest.read(n).runs}
        gone = []
        for name in self.manifest.names(self.config.data_path):
            at = f"{self.config.data_path}/{name}"
            parts = [f"{at}/{p}" for p in self.manifest.names(at) if p.startswith("part=")]
            if at not in live and not live.intersection(parts):
                gone.append(at)
            else:
                gone += [p for p in parts if p not in live]
        gone += [f"{self.config.log_path}/{name}" for name in self.manifest.names(self.config.log_path) if (m := _NAME.match(name)) and int(m[1]) <= self.version.flushed_batch]
        for at in gone:
            self.manifest.fs.delete(self.manifest._path(at), True)
        return gone

    def close(self) -> None:
        if self._open:
            self.flush()
            self._open = False
            self.manifest.close()

    # -- reads -----------------------------------------------------------------

    def log(self, low=None, high=None, version: int | None = None) -> DataFrame:
        """Rows of the runs that may hold keys of the range, and of the staged batches."""
        v = self.version if version is None else self.manifest.read(version)
        runs = [r for r in v.runs if r.overlaps(low, high)]
        rows = read_runs(self.spark, runs)
        return rows.unionByName(self.staged()) if version is None else rows

    def get(self, key) -> bytes | None:
        k = _bytes(key)
        row = view.get(self.log(bytes(k), bytes(k)), k).first()
        return None if row is None else bytes(row["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Every row of ``keys(key)`` with its value, null for absent keys.

        The least and greatest key choose the runs that are read, and up to
        ``FEW_KEYS`` keys go to the scan as a predicate, which Bloom filters and
        row group bounds answer.
        """
        low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
        if low is None:
            return view.multi_get(self.log().limit(0), keys)
        log = self.log(bytes(low), bytes(high))
        if n <= FEW_KEYS:
            asked = {bytes(r["key"]) for r in keys.select("key").where("key IS NOT NULL").collect()}
            log = log.where(F.col("key").isin([bytearray(k) for k in sorted(asked)]))
        else:
            log = log.where(F.col("key").between(F.lit(low), F.lit(high)))
        return view.multi_get(log, keys)

    def seek(self, probes: DataFrame) -> DataFrame:
        return view.seek(self.log(), probes)

    def first_last(self) -> DataFrame:
        return view.first_last(self.log())

    def neighbours(self) -> DataFrame:
        return view.neighbours(self.log())

    def deleted(self) -> DataFrame:
        """Keys whose newest write is a delete that no compaction has dropped."""
        return view.deleted(self.log()).select("key", "seq")

    def as_of(self, seq: int) -> DataFrame:
        """Live rows after write ``seq``, as far as older versions of the keys were not yet merged away."""
        return view.as_of(self.log(), seq).select("key", "value")

    def cursor(self, page: int = 1000) -> Cursor:
        """A cursor over the live rows as they are now."""
        return Cursor(self.log(), page)

    def range(self, start=None, end=None, limit: int | None = None, end_inclusive: bool = False) -> DataFrame:
        low, high = _bytes(start), _bytes(end)
        log = self.log(None if low is None else bytes(low), None if high is None else bytes(high))
        return view.range_scan(log, low, high, end_inclusive, limit)

    def items(self) -> DataFrame:
        return self.range()

    def prefix(self, prefix, limit: int | None = None) -> DataFrame:
        p = bytes(_bytes(prefix))
        return view.prefix_scan(self.log(p, view.prefix_end(p)), p, limit)

    def snapshot(self, version: int) -> DataFrame:
        """Live rows of flushed data as of a version of the manifest."""
        return view.live(self.log(version=version)).select("key", "value")

    def may_contain(self, keys: DataFrame) -> DataFrame:
        """Keys that occur in the log at all, tombstones included."""
        from .operators.membership import contains

        return contains(keys, self.log())

    def info(self) -> dict:
        runs = self.version.runs
        total = sum(r.bytes for r in runs)
        return {"version": self.version.version, "runs": len(runs), "bytes": total, "mean_bytes": total / len(runs) if runs else 0.0, "staged_batches": len(self._batches), "levels": {n: len(self.version.level(n)) for n in range(self.config.levels) if self.version.level(n)}}
