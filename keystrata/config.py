"""Settings of a keyspace and their presets."""

from __future__ import annotations

import os
import warnings
from dataclasses import asdict, dataclass, fields, replace

MB = 1 << 20


@dataclass(frozen=True)
class Config:
    """``memtable_bytes`` and sizes are bytes; counts are counts."""

    path: str = "./keyspace"
    memtable_bytes: int = 4 * MB
    empty_is_tombstone: bool = True
    levels: int = 7
    level0_trigger: int = 4
    level_multiplier: int = 10
    base_file_bytes: int = MB
    auto_compact: bool = True
    bloom: bool = True
    bloom_fpr: float = 0.01
    expected_keys: int = 1_000_000
    row_group_bytes: int = 128 * MB
    codec: str = "zstd"
    skip_damaged_log: bool = False

    def __post_init__(self):
        object.__setattr__(self, "path", self.path.rstrip("/") or "/")
        if not 0 < self.bloom_fpr < 1:
            raise ValueError("bloom_fpr must lie between 0 and 1")

    @property
    def data_path(self) -> str:
        return os.path.join(self.path, "runs")

    @property
    def log_path(self) -> str:
        return os.path.join(self.path, "log")

    def level_max_bytes(self, level: int) -> int:
        """Level 0: trigger x base; each deeper level ten times more."""
        return self.level0_trigger * self.base_file_bytes * self.level_multiplier**level

    def level_file_bytes(self, level: int) -> int:
        return self.base_file_bytes * self.level_multiplier ** max(0, level - 1)

    def writer_options(self) -> dict[str, str]:
        """Options of the Parquet writer of a run."""
        out = {"compression": self.codec, "parquet.block.size": str(self.row_group_bytes)}
        if self.bloom:
            out |= {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(self.expected_keys), "parquet.bloom.filter.fpp#key": str(self.bloom_fpr)}
        return out

    def bloom_options(self) -> dict | None:
        return {"expected_keys": self.expected_keys, "fpr": self.bloom_fpr} if self.bloom else None

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        for k in sorted(set(values) - known):
            warnings.warn(f"unknown setting {k}", stacklevel=2)
        return cls(**{k: v for k, v in values.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)


def point_lookup(path: str = "./keyspace") -> Config:
    """Small row groups and a sharp Bloom filter."""
    return Config(path, memtable_bytes=64 * MB, bloom_fpr=0.001, row_group_bytes=16 * MB)


def heavy_writes(path: str = "./keyspace") -> Config:
    """Large batches, late compaction."""
    return Config(path, memtable_bytes=128 * MB, level0_trigger=8, base_file_bytes=4 * MB)


def range_scans(path: str = "./keyspace") -> Config:
    """Large row groups without a Bloom filter."""
    return replace(Config(path), bloom=False, row_group_bytes=256 * MB)
