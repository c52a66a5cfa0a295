"""Operator 3: n-gram Jaccard join by MinHash banding.

Equal texts are one class with its smallest id. Classes whose band hashes meet
are candidates; their full n-gram sets are compared. Candidates are gathered by
their connected component of shared bands: components of over ``block`` members
are split into blocks, and each pair of blocks is a group of its own, so no task
holds an unbounded group and no pair becomes a row. A group counts links and
returns a spanning forest of them.

N-grams are ``n`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged); a
shorter text has one n-gram, all its words. Edge cases: null and empty texts and
texts of white space only have no n-gram and link with nothing. Rows without an
id come back unlinked. Equal rows are copies of each other. Rows that share an
id with different texts are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, persist, runs, text_class
from .graph import connected_components
from .words import WordHashes, batch_words, gram_hashes, grouped, mix, signed, within_texts

NGRAM, THRESHOLD, RECALL, ROWS, BLOCK = 5, 0.8, 0.9999, 5, 256


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows that a pair at the threshold shares one of with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def text_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's n-grams, with repeats; of all its words if they are fewer."""
    return gram_hashes(words, min(n, len(words))) if len(words) else np.zeros(0, np.uint64)


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    factors = np.random.default_rng(3).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batch):
        words, n_words = batch_words(batch.column(2).to_pylist())
        at, text = within_texts(n_words, n)
        flat = gram_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)
        sizes = np.bincount(text, minlength=len(n_words))
        first = np.cumsum(n_words) - n_words
        short = np.flatnonzero((n_words > 0) & (n_words < n))  # one n-gram: all their words
        if len(short):
            flat = np.insert(flat, (np.cumsum(sizes) - sizes)[short], [text_grams(words[first[i] : first[i] + n_words[i]], n)[0] for i in short])
            sizes[short] = 1
        some = np.flatnonzero(sizes)
        starts = np.cumsum(sizes[some]) - sizes[some]
        out = np.zeros((len(some), bands), np.uint64)
        if len(some):
            for b in range(bands):
                acc = np.full(len(some), b + 1, np.uint64)
                for r in range(rows):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * factors[b * rows + r], starts))
                out[:, b] = acc
        offsets = np.zeros(len(n_words) + 1, np.int32)
        offsets[some + 1] = bands
        col = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), pa.array(signed(out.ravel())))
        return {"id": batch.column(0), "full": batch.column(1), "bands": col}

    return map_arrow(docs, run, "id long, full binary, bands array<long>", "text")


def _compare(threshold: float):
    """Links within sorted groups of ``group, own, other, block, id, copies, grams``."""

    def groups(table: pa.Table):
        cols = [np.asarray(table.column(k)) for k in range(5)]
        copies = np.asarray(table.column(5))
        grams = table.column(6).to_pylist()
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for c in cols[:3]:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(change), table.num_rows)
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            _, once = np.unique(cols[4][a:b], return_index=True)
            at = a + once
            if len(at) < 2:
                continue
            sets = [np.frombuffer(grams[i], np.uint64) for i in at]
            sizes = np.array([len(s) for s in sets], np.float64)
            flat = np.concatenate(sets)
            member = np.repeat(np.arange(len(at)), sizes.astype(np.int64))
            order = np.argsort(flat, kind="stable")
            cut = runs(flat[order])
            n = np.diff(cut)
            shared = np.repeat(n > 1, n)
            column = np.repeat(np.cumsum(n > 1) - 1, n)[shared]
            row = member[order][shared]
            both = np.zeros((len(at), len(at)), np.float32)
            for lo in range(0, int((n > 1).sum()), 8192):
                left, right = np.searchsorted(column, [lo, lo + 8192])
                m = np.zeros((len(at), 8192), np.float32)
                m[row[left:right], column[left:right] - lo] = 1
                both += m @ m.T
            linked = both * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
            np.fill_diagonal(linked, False)
            if cols[1][a] != cols[2][a]:  # two blocks: only pairs across them
                mine = cols[3][at]
                linked &= mine[:, None] != mine[None, :]
            links = linked @ copies[at].astype(np.float64)
            ids, root = cols[4][at], np.arange(len(at))
            while True:  # ids are sorted, so the least index is the least id
                least = np.minimum(root, np.where(linked, root[None, :], len(at)).min(1))
                if (least == root).all():
                    break
                root = least
            some = np.flatnonzero(linked.any(1))
            out.append((ids[some], links[some].astype(np.int64), ids[root[some]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "links", "root"])

    return groups


def jaccard_groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``id_col, class_id, n_links, kept``, one row a document.

    ``class_id`` is the smallest id reachable by links; ``n_links`` counts the
    other rows with the same text or one at least ``threshold`` similar.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_class(F.col(text)).alias("full"), F.col(text).alias("text"))
    signed_docs = persist(_signatures(docs, n, bands_for(threshold, recall, rows), rows), "signatures")
    classes = persist(signed_docs.where("id IS NOT NULL AND size(bands) > 0").groupBy("full").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("rep", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("band", "least")
    maybe = connected_components(entries.join(shared, "band").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    maybe = persist(maybe, "candidates")
    sizes = maybe.groupBy("component").agg(F.count("*").alias("size"))
    members = maybe.join(sizes, "component").join(classes.select(F.col("rep").alias("id"), "full", "copies"), "id")
    members = members.select("full", "id", "component", "copies", F.ceil(F.col("size") / block).cast("long").alias("blocks"))
    found = members.join(docs.select("full", "id", "text"), ["full", "id"]).select("component", "id", "copies", "blocks", "text")

    def grams(batch):
        hashes, out = WordHashes(), []
        for c, i, k, blocks, t in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            g = np.unique(text_grams(hashes(t.encode().split()), n)).tobytes()
            own = int(mix(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(blocks))
            out.extend((c, min(own, j), max(own, j), own, i, k, g) for j in range(blocks))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        return dict(zip(("component", "a", "b", "own", "id", "copies", "grams"), map(list, cols), strict=True))

    sets = map_arrow(found, grams, "component long, a long, b long, own long, id long, copies long, grams binary", "text", 2 << 20)
    groups = _compare(threshold)
    linked = sets.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(lambda batches: grouped(batches, 3, 600, groups), "id long, links long, root long")
    linked = persist(linked, "linked")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(linked.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = classes.select("full", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("full", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed_docs.select("id", F.when(F.col("id").isNotNull() & (F.size("bands") > 0), F.col("full")).alias("full")).join(known, "full", "left")
    class_id = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("id"), F.lit(True)).alias("kept"))


def op3_jaccard(df: DataFrame, **options) -> DataFrame:
    """The join with its default parameters; see :func:`jaccard_groups`."""
    return jaccard_groups(df, **options)
