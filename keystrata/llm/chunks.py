"""Cutting texts into chunks that tokenizers with the public pattern treat apart.

A cut before a space that follows, or is followed by, a character that is no
white space never falls inside a match of the pattern. Texts with longer runs
of white space around such a space are left whole.
"""

from __future__ import annotations

from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _blank_ends(part: str) -> int:
    """Bit 0: starts with white space or is empty; bit 1: ends so."""
    if part and "!" <= part[0] <= "~" and "!" <= part[-1] <= "~":
        return 0
    return 3 if not part else part[0].isspace() + 2 * part[-1].isspace()


class Chunks:
    """Numbers for distinct chunks; numbers stay the same until ``clear``."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.after: dict[str, int] = {}  # chunks that begin with a space, without it
        self.first: dict[str, int] = {}
        self.flags = np.zeros(1 << 16, np.uint8)  # of all chunks: bit 0 if one starts with white space, bit 1 if it ends so
        self.texts: list[str] = []  # the new ones since drain()
        self.odd: list[int] = []  # which of them do not begin with one space or end with white space
        self._next = count().__next__

    def __len__(self) -> int:
        return len(self.after) + len(self.first)

    def _add(self, where: dict, key: str, text: str, flags: int) -> int:
        n = where[key] = self._next()
        if n >= len(self.flags):
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        if flags:
            self.flags[n] = flags
        if flags or where is self.first:
            self.odd.append(len(self.texts))
        self.texts.append(text)
        return n

    def drain(self) -> list[str]:
        return self.drain_with_odd()[0]

    def drain_with_odd(self) -> tuple[list[str], list[int]]:
        """The chunks that are new, and which of them cannot be joined with others."""
        out = self.texts, self.odd
        self.texts, self.odd = [], []
        return out

    def _whole(self, text: str) -> int:
        n = self.first.get(text)
        return self._add(self.first, text, text, 0) if n is None else n

    def split(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        head, parts = parts[0], parts[1:]
        after = self.after
        got = np.fromiter(map(after.get, parts, repeat(-1)), np.int64, len(parts))
        for i in np.flatnonzero(got < 0).tolist():
            p = parts[i]
            n = after.get(p)
            got[i] = self._add(after, p, " " + p, _blank_ends(p)) if n is None else n
        f = self.flags[got]
        ends = 2 if head and head[-1].isspace() else 0
        if ends or f.any():
            f = np.append(np.uint8(ends), f)
            if ((f[:-1] & 2) & ((f[1:] & 1) << 1)).any():
                return np.array([self._whole(text)], np.int64)
        return np.append(self._whole(head), got) if head else got

    def split_all(self, texts: pa.Array) -> list[np.ndarray]:
        """``split`` of each text, where equal parts of the texts are looked up once; null and empty texts have no chunks."""
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        index, parts = np.asarray(coded.indices), coded.dictionary.to_pylist()
        ends = np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
        starts = np.append(0, ends[:-1])
        inner = np.ones(len(index), bool)
        inner[starts] = False  # the heads, which no space is before
        after, got = self.after, np.full(len(parts), -1)
        for i in np.flatnonzero(np.bincount(index[inner], minlength=len(parts))).tolist():
            p = parts[i]
            n = after.get(p)
            got[i] = self._add(after, p, " " + p, _blank_ends(p)) if n is None else n
        heads = [parts[i] for i in index[starts].tolist()]
        numbers = got[index]
        odd = np.zeros(len(index), bool)
        odd[inner] = self.flags[numbers[inner]] > 0
        odd[starts] = [h[-1:].isspace() for h in heads]
        odd = np.logical_or.reduceat(odd, starts)
        out = []
        for k, (a, b, head) in enumerate(zip(starts.tolist(), ends.tolist(), heads, strict=True)):
            if odd[k]:
                out.append(self.split(texts[k].as_py()))
            elif head:
                numbers[a] = self._whole(head)
                out.append(numbers[a:b])
            else:
                out.append(numbers[a + 1 : b])
        return out


class Ragged:
    """Growing list of integer arrays in one flat array."""

    def __init__(self, dtype=np.int32):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n = 0

    def extend(self, arrays: list) -> None:
        lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
        flat = np.fromiter((x for a in arrays for x in a), self.flat.dtype, int(lengths.sum()))
        self.extend_flat(flat, lengths)

    def extend_flat(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.used += len(flat)
        self.n += len(lengths)

    def put(self, at: int, values) -> None:
        """Replace array number ``at``."""
        values = np.asarray(values, self.flat.dtype)
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(values)] = values
        self.starts[at], self.lengths[at] = self.used, len(values)
        self.used += len(values)

    def sums(self, index: np.ndarray, parts: list) -> np.ndarray:
        """Items of each part of ``index``, which is the parts joined."""
        ends = np.append(0, np.cumsum(self.lengths[index]))[np.cumsum([0, *map(len, parts)])]
        return np.diff(ends)

    def gather(self, index: np.ndarray) -> np.ndarray:
        lengths = self.lengths[index]
        total = int(lengths.sum())
        shift = self.starts[index] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(total)]
