"""Words of texts as numbers: hashes, windows and streaming of sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, kept for a bounded number of words."""

    def __init__(self, most: int = 200_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.seen.get, words))
        if None in got:
            if len(self.seen) > self.most:
                self.seen.clear()
            for i, h in enumerate(got):
                if h is None:
                    w = words[i]
                    got[i] = self.seen[w] = xxhash.xxh64_intdigest(w)
        return np.array(got, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.full(n, _P_INV)
        down[0] = 1
        down = np.cumprod(down, dtype=np.uint64)
        up = np.full(n, _P)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down, dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * up[: n - k + 1])


#: Kept between the batches of a worker.
_HASHES = WordHashes()


def batch_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the number of words of each."""
    words = [(t or "").encode().split() for t in texts]
    return _HASHES(list(chain.from_iterable(words))), np.fromiter(map(len, words), np.int64, len(words))


def within_texts(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the joined array where runs of ``k`` words of one text start, and their texts."""
    n = np.maximum(sizes - k + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    return np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n), text


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each run of ``span`` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = span - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, rows: int, fn: Callable) -> Iterator:
    """Call ``fn`` on tables of whole groups of a sorted stream, about ``rows`` rows each.

    The first ``keys`` columns are the key; a group lies in one call.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.num_rows - 1
        same = np.ones(table.num_rows, bool)
        for k in range(keys):
            col = np.asarray(table.column(k))
            same &= col == col[last]
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield from fn(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches() if cut < table.num_rows else []
        n = sum(map(len, held))
    if n:
        yield from fn(pa.Table.from_batches(held).combine_chunks())
