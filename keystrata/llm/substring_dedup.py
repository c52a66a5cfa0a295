"""Operator 4: substring dedup by minimiser groups of fixed windows.

They replace prefix-partitioned suffix trees: passages of one fixed length need
no tree depths or maximal repeats.

A window is ``window`` consecutive words. Suffixes of all texts are split into
groups by prefix: the group of a suffix is the least ``gram``-word prefix hash
within its first window, so that equal windows meet in one group whatever their
texts are, and only about one position in thirteen names a group. Groups that
only one text has are pruned. In each other group the suffixes are sorted word by word,
which lays out the subtree's leaves in order; an internal node at depth
``window`` is a run of neighbours that share that many words, a repeat. Groups
of over ``group_rows`` members are grouped by hashes of whole windows, for which the smallest id is all that counts.

Edge cases: null and empty texts have no words and keep none. Rows without an
id neither serve as a source nor lose words. Exact copies are judged by digest:
a copy with a larger id loses all its windows. Rows that repeat both id and text
are judged alike; equal ids with different texts do not remove from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, persist, text_class
from .words import batch_words, gram_hashes, grouped, mix, signed, sliding_min, within_texts

WINDOW = 50
GROUP_ROWS = 2000


def anchors(words: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, prefix hash, first and last window start of each group entry of joined texts.

    An entry is a run of windows with the same least prefix, of ``window`` at most.
    """
    starts, text = within_texts(sizes, window)
    if not len(starts):
        return text, np.zeros(0, np.uint64), starts, starts
    least = sliding_min(gram_hashes(words, gram), window - gram + 1)[starts]
    at = starts - (np.cumsum(sizes) - sizes)[text]
    new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
    run = np.flatnonzero(new)
    since = np.arange(len(new)) - np.repeat(run, np.diff(np.append(run, len(new))))
    first = np.flatnonzero(since % window == 0)
    last = np.append(first[1:], len(new)) - 1
    return text[first], least[first], at[first], at[last]


def _prefixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batch):
        text, h, lo, hi = anchors(*batch_words(batch.column(2).to_pylist()), window, gram)
        take = pa.array(text)
        return {"id": batch.column(0).take(take), "cls": batch.column(1).take(take), "prefix": signed(h), "lo": lo, "hi": hi}

    return map_arrow(docs, run, "id long, cls long, prefix long, lo long, hi long", "text")


def _subtrees(rows: DataFrame, window: int) -> DataFrame:
    """Repeated windows within groups: ``id, cls, lo, mask`` from ``prefix, id, cls, lo, n, words``."""

    def nodes(table: pa.Table):
        number: dict[bytes, int] = {}
        texts = [t.split() for t in table.column(5).cast(pa.binary()).to_pylist()]
        flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        windows = sizes - window + 1
        member = np.repeat(np.arange(len(texts)), windows)
        offset = np.arange(len(member)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(np.cumsum(sizes) - sizes, windows) + offset
        leaves = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, window)[starts])
        order = np.argsort(leaves.view(np.dtype((np.void, leaves.shape[1] * 4))).ravel(), kind="stable")
        deep = np.ones(len(order), bool)  # a new node starts here
        for i in range(1, len(order), 100_000):
            a = order[i - 1 : i + 100_000]
            deep[i : i + len(a) - 1] = (leaves[a[1:]] != leaves[a[:-1]]).any(1)
        ids = np.asarray(table.column(1))
        of = ids[member[order]]
        first = np.flatnonzero(deep)
        least = np.minimum.reduceat(of, first)
        hit = order[of > np.repeat(least, np.diff(np.append(first, len(order))))]
        if not len(hit):
            return
        mask = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(mask, member[hit], np.int64(1) << offset[hit])
        k = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(np.asarray(table.column(2))[k]), pa.array(np.asarray(table.column(3))[k]), pa.array(mask[k])], names=["id", "cls", "lo", "mask"])

    return rows.mapInArrow(lambda batches: grouped(batches, 1, 3000, nodes), "id long, cls long, lo long, mask long")


def repeats(df: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id, cls, copy, marks``: which texts repeat, and where their repeated windows start.

    ``cls`` is a 64-bit digest of the text; a ``copy`` repeats a whole text of a smaller id.
    """
    if not 2 <= window <= 62:
        raise ValueError("windows of 2 to 62 words fit the masks")
    gram = window // 2
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_class(F.col(text)).alias("full"), F.col(text).alias("text")).where("id IS NOT NULL")
    docs = docs.select("id", "full", F.conv(F.hex(F.substring("full", 1, 7)), 16, 10).cast("long").alias("cls"), "text")
    first = docs.groupBy("full").agg(F.min("id").alias("least"))
    copies = docs.select("id", "cls", "full").join(first, "full").where("id > least").select("id", "cls").distinct()
    prefixes = persist(_prefixes(docs.select("id", "cls", "text"), window, gram), "prefixes")
    groups = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("prefix", "n")
    shared = prefixes.join(groups, "prefix").join(copies, ["id", "cls"], "left_anti")
    of_text = shared.groupBy("id", "cls").agg(F.collect_list(F.struct("prefix", "lo", "hi", "n")).alias("at"))

    def cut(batch):
        rows = []
        for key, cls, at, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            words = t.encode().split()
            for a in at:
                w = b" ".join(words[a["lo"] : a["hi"] + window])
                rows.append((a["prefix"], key, cls, a["lo"], a["n"], w.decode()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return dict(zip(("prefix", "id", "cls", "lo", "n", "words"), map(list, cols), strict=True))

    suffixes = persist(map_arrow(of_text.join(docs.select("id", "cls", "text"), ["id", "cls"]).select("id", "cls", "at", "text"), cut, "prefix long, id long, cls long, lo long, n long, words string", "text"), "suffixes")
    few = suffixes.where(F.col("n") <= group_rows)
    found = _subtrees(few.repartition("prefix").sortWithinPartitions("prefix"), window)
    # over-full groups: prefixes as long as the window
    whole = suffixes.where(F.col("n") > group_rows)

    def longer(batch):
        words, sizes = batch_words(batch.column(5).to_pylist())
        starts, row = within_texts(sizes, window)
        k = starts - (np.cumsum(sizes) - sizes)[row]
        take = pa.array(row)
        cols = {name: batch.column(i).take(take) for i, name in ((1, "id"), (2, "cls"), (3, "lo"))}
        return cols | {"k": k, "a": signed(gram_hashes(words, window))[starts], "b": signed(gram_hashes(mix(words + np.uint64(1)), window))[starts]}

    windows = map_arrow(whole, longer, "id long, cls long, lo long, k long, a long, b long")
    # a table of its own, so that the join's two sides are plain reads and a hot window can be split
    least = persist(windows.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("a", "b", "least"), "windows")
    late = windows.join(least, ["a", "b"]).where("id > least").groupBy("id", "cls", "lo").agg(F.bit_or(F.expr("shiftleft(1L, cast(k as int))")).alias("mask"))
    marks = found.unionByName(late).groupBy("id", "cls").agg(F.collect_list(F.struct("lo", "mask")).alias("marks"))
    return marks.join(copies.withColumn("copy", F.lit(True)), ["id", "cls"], "full").select("id", "cls", F.coalesce("copy", F.lit(False)).alias("copy"), "marks")


def _kept(words: list[bytes], copy: bool | None, marks, window: int) -> np.ndarray:
    n = len(words)
    if copy and n >= window:
        return np.zeros(n, bool)
    cover = np.zeros(n + 1, np.int64)
    for m in marks or ():
        mask, at = m["mask"], m["lo"]
        while mask:  # a run of set bits at a time
            low = (mask & -mask).bit_length() - 1
            run = (~(mask >> low) & ((mask >> low) + 1)).bit_length() - 1
            cover[at + low] += 1
            cover[at + low + run - 1 + window] -= 1
            mask &= ~(((1 << run) - 1) << low)
    return np.cumsum(cover[:n]) == 0


def substring_dedup(df: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id", group_rows: int = GROUP_ROWS, digest: bool = False) -> DataFrame:
    """The table without its repeated words, or with ``digest`` the digest columns.

    Texts that lose words become their other words, joined by single spaces;
    texts that lose none stay as they are.
    """
    info = repeats(df, window, text, id_col, group_rows)
    keep = [F.col(c) for c in df.columns]
    docs = df.select(F.struct(*([F.col(id_col)] if digest else keep)).alias("_row"), F.col(text).alias("_text"), F.col(id_col).cast("long").alias("id"), F.conv(F.hex(F.substring(text_class(F.col(text)), 1, 7)), 16, 10).cast("long").alias("cls"))
    src = docs.join(info, ["id", "cls"], "left").select("_row", "_text", "copy", "marks")

    def run(batch):
        n, removed, out = [], [], []
        for t, copy, marks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            words = (t or "").encode().split()
            mask = _kept(words, copy, marks, window)
            kept = b" ".join(w for w, k in zip(words, mask.tolist(), strict=True) if k)
            gone = len(words) - int(mask.sum())
            n.append(len(words))
            removed.append(gone)
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode() if gone else t)
        return {"_row": batch.column(0), "n_words": n, "n_removed": removed, "out": out}

    row = dict(src.dtypes)["_row"]
    got = map_arrow(src, run, f"_row {row}, n_words long, n_removed long, out string", "_text")
    if digest:
        return got.select(f"_row.{id_col}", "n_words", "n_removed", F.col("out").alias("kept_sha256"))
    return got.select(*(F.col("out").alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in df.columns))


def op4_substring(df: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` for every document."""
    return substring_dedup(df, window, text, id_col, group_rows, digest=True)
