"""A cursor over the live rows of a log, read in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import view


class Cursor:
    """Steps through live rows in key order, in either direction.

    Each page is one query for at most ``page`` rows beyond the current key, so
    the driver holds a page however large the keyspace is. The cursor reads the
    log it was made of; later writes are not seen.
    """

    def __init__(self, log: DataFrame, page: int = 1000):
        self._log, self._size = log, page
        self._rows: list[tuple[bytes, bytes | None]] = []
        self._at = 0

    def _load(self, where=None, back: bool = False) -> list[tuple[bytes, bytes | None]]:
        log = self._log if where is None else self._log.where(where)
        rows = view.live(log).select("key", "value").orderBy(F.desc("key") if back else F.asc("key")).limit(self._size).collect()
        return sorted((bytes(r[0]), None if r[1] is None else bytes(r[1])) for r in rows)

    def _place(self, rows: list, at: int) -> bool:
        self._rows, self._at = rows, at
        return self.valid()

    def valid(self) -> bool:
        return 0 <= self._at < len(self._rows)

    def seek_to_first(self) -> bool:
        return self._place(self._load(), 0)

    def seek_to_last(self) -> bool:
        rows = self._load(back=True)
        return self._place(rows, len(rows) - 1)

    def seek(self, key) -> bool:
        """To the first key that is not below ``key``."""
        return self._place(self._load(F.col("key") >= F.lit(bytearray(key.encode() if isinstance(key, str) else key))), 0)

    def _need(self) -> tuple[bytes, bytes | None]:
        if not self.valid():
            raise ValueError("the cursor is at no row")
        return self._rows[self._at]

    def key(self) -> bytes:
        return self._need()[0]

    def value(self) -> bytes | None:
        return self._need()[1]

    def next(self) -> bool:
        key, _ = self._need()
        if self._at + 1 < len(self._rows):
            self._at += 1
            return True
        return self._place(self._load(F.col("key") > F.lit(bytearray(key))), 0)

    def prev(self) -> bool:
        key, _ = self._need()
        if self._at:
            self._at -= 1
            return True
        rows = self._load(F.col("key") < F.lit(bytearray(key)), back=True)
        return self._place(rows, len(rows) - 1)

    def __iter__(self):
        more = self.seek_to_first()
        while more:
            yield self._need()
            more = self.next()
