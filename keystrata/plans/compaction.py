"""What to compact, and how runs merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..operators.ordering import RANGE, before, with_ranges, within
from ..operators.view import latest_wins
from ..schema import PUT
from ..sources.manifest import Run, Version


@dataclass(frozen=True)
class Job:
    inputs: tuple[Run, ...]
    target: int
    bottom: bool  # no older run outside the job can hold its keys


def level_limit(config: Config, level: int) -> int:
    return config.level_max_bytes(level)


def needed(version: Version, config: Config) -> list[int]:
    """Levels over their limit, the most urgent first."""
    out = [0] if len(version.level(0)) >= config.level0_trigger else []
    return out + [n for n in range(1, config.levels - 1) if version.bytes_at(n) > level_limit(config, n)]


def pick(version: Version, config: Config, level: int | None = None, force: bool = False) -> Job | None:
    """The next job: the oldest runs of level 0, as many as trigger it, or the first run of a
    deeper level, and the runs of the level below that they meet.

    Runs of level 0 that stay are newer than those that go, so reads still find
    the newest write of a key by its sequence number.
    """
    if level is None:
        due = needed(version, config)
        if due:
            level = due[0]
        elif force:
            level = next((n for n in range(config.levels - 1) if version.level(n)), None)
    if level is None or not version.level(level) or level >= config.levels - 1:
        return None
    chosen = version.level(0)[: config.level0_trigger] if level == 0 else version.level(level)[:1]
    bounds = [bytes.fromhex(k) for r in chosen for k in (r.min_key, r.max_key) if k is not None]
    low, high = (min(bounds), max(bounds)) if bounds else (None, None)
    below = [r for r in version.level(level + 1) if bounds and r.overlaps(low, high)]
    inputs = tuple(chosen + below)
    bounds = [bytes.fromhex(k) for r in inputs for k in (r.min_key, r.max_key) if k is not None]
    low, high = (min(bounds), max(bounds)) if bounds else (None, None)
    deeper = [r for r in version.runs if r.level > level + 1 and bounds and r.overlaps(low, high)]
    return Job(inputs, level + 1, not deeper)


def merge(log: DataFrame, drop_tombstones: bool) -> DataFrame:
    """The newest row of each key; tombstones stay unless nothing older is left below."""
    rows = latest_wins(log)
    return rows.where(F.col("op") == PUT) if drop_tombstones else rows


def split_runs(rows: DataFrame, target_bytes: int) -> DataFrame:
    """``part``: consecutive key ranges of about ``target_bytes`` each.

    A row's part is the number of whole targets in the bytes of all keys before
    it. Cutting by running sums lets every range find its parts alone; a part may
    hence exceed the target by less than its last row, instead of ending just
    before it would. Keys are distinct.
    """
    size = (F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 8).cast("bigint")
    rows = with_ranges(rows.withColumn("_size", size))
    earlier = within("key").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_run", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).withColumn("_before", before(rows, F.col("_size")))
    return out.withColumn("part", F.expr(f"(_before + _run) div {target_bytes}")).drop("_size", RANGE, "_run", "_before")
