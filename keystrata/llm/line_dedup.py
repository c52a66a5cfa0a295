"""Operator 7: line dedup by a segment-partition edit join.

Two lines are alike if at most ``edits`` insertions, deletions and
replacements of characters turn one into the other. If a line is cut into
one more segment than its edits, any line alike holds one of them unchanged, near its
place: lines are indexed by (length, segment number, segment), and probe the
indexes of their own length and the ``edits`` lengths below. Pairs that meet are
verified with a banded bit-parallel edit distance. A line goes if an equal or
alike line comes before it, by (id, line number); links are not followed
further. Lines are compared without the white space at their ends; empty ones
stay. Lines of under ``min_chars`` characters are alike at fewer edits, in
proportion to the shorter line's length: of 24 characters on at 2 edits, of 12
on at 1, shorter ones only if they are equal.

Equal lines are one, with their first place. Keys that over ``few`` lines share
are split into blocks, each pair of blocks a group of its own. Candidate texts
are found again through a bitmap of fixed size that only spares work.

Edge cases: null and empty texts stay as they are, with no line and one line.
Rows without an id neither remove nor lose lines. Rows that repeat both id and
text keep the same lines. A text that loses all lines becomes empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, persist, text_class
from .words import grouped

EDITS, MIN_CHARS, FEW, BLOCK = 2, 24, 64, 256
BITMAP_WORDS = 1 << 17
#: Candidate pairs that are made at once.
PAIRS = 1 << 18


# -- edit distance -----------------------------------------------------------


def within(a: str, b: str, k: int) -> bool:
    """Whether at most ``k`` edits turn ``a`` into ``b``.

    Bit vectors hold the 2k + 1 rows around the diagonal; a column is a few
    operations on small integers.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : n - j]
    m, n = len(a), len(b)
    if not n:
        return m <= k
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    width = 2 * k + 1
    full = (1 << width) - 1
    vp, vn, score = full & ~((1 << (k + 1)) - 1), 0, 0  # column 0: rows 1 to k rise
    for j in range(1, n + 1):
        shift = j - k - 1
        p = places.get(b[j - 1], 0)
        p = (p >> shift if shift >= 0 else p << -shift) & full
        vp, vn = (vp >> 1) | (1 << (width - 1)), vn >> 1
        d = ((((p & vp) + vp) ^ vp) | p | vn) & full
        hp, hn = (vn | ~(d | vp)) & full, d & vp
        score += not (d >> k) & 1
        hp, hn = ((hp << 1) | 1) & full, (hn << 1) & full
        vp, vn = (hn | ~(d | hp)) & full, hp & d
        if score > 2 * k:
            return False
    for i in range(m - n):
        score += (vp >> (k + 1 + i) & 1) - (vn >> (k + 1 + i) & 1)
    return score <= k


# -- segments ----------------------------------------------------------------


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the ``edits`` + 1 segments; the last ones may be a character longer."""
    parts = edits + 1
    size, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


def allowed(length: int, edits: int, min_chars: int) -> int:
    """The edits at which a line is alike one of ``length`` that is no longer."""
    return min(edits, edits * length // max(1, min_chars))


def alike(a: str, b: str, edits: int, min_chars: int) -> bool:
    return within(a, b, allowed(min(len(a), len(b)), edits, min_chars))


def probes(length: int, edits: int, min_chars: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, place, size) that a line of ``length`` looks up.

    For each segment only the places that leave enough edits on either side.
    """
    out = []
    for gap in range(edits + 1):
        k = allowed(length - gap, edits, min_chars)
        if not k or gap > k:  # equal lines need no index
            continue
        for i, (p, n) in enumerate(segments(length - gap, k)):
            low = max(0, p - i, p + gap - (k - i))
            high = min(length - n, p + i, p + gap + (k - i))
            out.extend((length - gap, i, at, n) for at in range(low, high + 1))
    return out


def line_key(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode())
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def long_lines(text: str | None, min_chars: int):
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= min_chars:
            yield i, line


class Keys:
    """Segment keys of lines; plans are kept by length."""

    def __init__(self, edits: int, min_chars: int):
        self.edits, self.min_chars = edits, min_chars
        self.plans: dict[int, tuple[list, list]] = {}

    def __call__(self, line: str) -> tuple[list[int], int]:
        """Keys, those that are also index entries first, and how many these are."""
        n = len(line)
        plan = self.plans.get(n)
        if plan is None:
            k = allowed(n, self.edits, self.min_chars)
            own = [(n, i, p, s) for i, (p, s) in enumerate(segments(n, k))] if k else []
            rest = [q for q in probes(n, self.edits, self.min_chars) if q not in own]
            if len(self.plans) > 20_000:
                self.plans.clear()
            plan = self.plans[n] = ([(m * 16 + i, p, p + s) for m, i, p, s in own + rest], len(own))
        digest = xxhash.xxh64_intdigest
        if line.isascii():
            data = line.encode()
            return [digest(data[a:b], seed) for seed, a, b in plan[0]], plan[1]
        return [digest(line[a:b].encode(), seed) for seed, a, b in plan[0]], plan[1]


# -- the join ----------------------------------------------------------------


def _entries(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``key, line, indexed``: segment entries of the distinct lines of each batch."""

    def run(batch):
        keys, out, ids, n, own, seen = Keys(edits, min_chars), [], [], [], [], set()
        for t in batch.column(0).to_pylist():
            for _, line in long_lines(t, 1):
                if line not in seen:
                    seen.add(line)
                    k, indexed = keys(line)
                    out.extend(k)
                    ids.append(line_key(line)[0])
                    n.append(len(k))
                    own.append(indexed)
        n, own = np.array(n, np.int64), np.array(own, np.int64)
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return {"key": np.array(out, np.uint64).view(np.int64), "line": np.repeat(np.array(ids, np.int64), n), "indexed": at < np.repeat(own, n)}

    return map_arrow(docs.select("text"), run, "key long, line long, indexed boolean", "text")


def _meet(entries: DataFrame, few: int) -> DataFrame:
    """Candidate pairs ``a, b`` of lines under one key; of keys with over ``few`` lines the entries (``b`` null)."""

    def emit(key, line, indexed):
        order = np.lexsort((line, key))
        key, line, indexed = key[order], line[order], indexed[order]
        new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))
        first = np.flatnonzero(new)
        if len(first):
            indexed = np.logical_or.reduceat(indexed, first)
        key, line = key[first], line[first]
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
        size = np.diff(cut)
        some = np.flatnonzero(size > 1)
        for s in np.unique(size[some]):
            at = cut[:-1][some[size[some] == s]]
            if s > few:
                rows = (at[:, None] + np.arange(s)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(line[rows]), pa.nulls(len(rows), pa.int64()), pa.array(key[rows])], names=["a", "b", "key"])
                continue
            i, j = np.triu_indices(s, 1)
            step = max(1, PAIRS // len(i))
            for k in range(0, len(at), step):
                x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                ok = indexed[x] | indexed[y]
                x, y = x[ok], y[ok]
                yield pa.RecordBatch.from_arrays([pa.array(line[x]), pa.array(line[y]), pa.array(key[x])], names=["a", "b", "key"])

    def run(batches):
        held: list[tuple] = []
        n = 0
        hot = None  # a key whose group is passed on without being held
        for batch in batches:
            cols = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).astype(bool)]
            if not len(batch):
                continue
            if hot is not None:
                m = int(np.searchsorted(cols[0] != hot, True)) if (cols[0] != hot).any() else len(batch)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[1][:m]), pa.nulls(m, pa.int64()), pa.array(cols[0][:m])], names=["a", "b", "key"])
                if m == len(batch):
                    continue
                cols, hot = [c[m:] for c in cols], None
            held.append(tuple(cols))
            n += len(cols[0])
            if n < 400_000:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if n - cut > 200_000:  # one key fills what is held
                hot = cols[0][-1]
                yield from emit(*(c[:cut] for c in cols))
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][cut:]), pa.nulls(n - cut, pa.int64()), pa.array(cols[0][cut:])], names=["a", "b", "key"])
                held, n = [], 0
                continue
            yield from emit(*(c[:cut] for c in cols))
            held = [tuple(c[cut:] for c in cols)]
            n = len(held[0][0])
        if n:
            yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, low, text`` of the wanted lines (``line``), each once."""
    bit = F.pmod("line", F.lit(BITMAP_WORDS * 64).cast("long"))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(line, {BITMAP_WORDS * 64}L) & 63 as int))")).alias("bits")).toArrow()  # BITMAP_WORDS rows at most
    bitmap = np.zeros(BITMAP_WORDS, np.int64)
    bitmap[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))

    def run(batch):
        rows = {}
        for t in batch.column(0).to_pylist():
            for _, line in long_lines(t, 1):
                if line not in rows:
                    high, low = line_key(line)
                    at = high % (BITMAP_WORDS * 64)
                    rows[line] = (high, low, line) if int(bitmap[at >> 6]) >> (at & 63) & 1 else None
        cols = list(zip(*filter(None, rows.values()), strict=True)) or [[]] * 3
        return dict(zip(("line", "low", "text"), map(list, cols), strict=True))

    found = map_arrow(docs.select("text"), run, "line long, low long, text string", "text")
    return found.groupBy("line", "low").agg(F.first("text").alias("text")).join(wanted, "line", "left_semi")


def _verify_pairs(pairs: DataFrame, texts: DataFrame, edits: int, min_chars: int) -> DataFrame:
    x = texts.select(F.col("line").alias("a"), F.col("low").alias("a_low"), F.col("text").alias("a_text"))
    y = texts.select(F.col("line").alias("b"), F.col("low").alias("b_low"), F.col("text").alias("b_text"))

    def run(batch):
        ok = [alike(s, t, edits, min_chars) for s, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        return batch.filter(pa.array(ok, pa.bool_())).select([0, 1, 2, 3])

    both = pairs.join(x, "a").join(y, "b").select("a", "a_low", "b", "b_low", "a_text", "b_text")
    return map_arrow(both, run, "a long, a_low long, b long, b_low long")


def _verify_blocks(hot: DataFrame, texts: DataFrame, firsts: DataFrame, edits: int, min_chars: int, block: int) -> DataFrame:
    """``line, low, before``: the first place of an alike line under a crowded key, if it is earlier."""
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    place = F.struct("first.id", "first.at")
    rows = hot.join(sizes, "key").join(texts, "line").join(firsts.select("line", "low", "first"), ["line", "low"]).withColumn("own", F.pmod(F.xxhash64("line"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "line", "low", place["id"].alias("id"), place["at"].alias("at"), "text")

    def compare(table: pa.Table):
        cols = table.select(range(8)).to_pandas()
        text = table.column(8).to_pylist()
        out = []
        for (_, x, y), g in cols.groupby(["key", "x", "y"], sort=False):
            order = g.sort_values(["id", "at"]).index.tolist()
            own, line = cols["own"].to_numpy(), cols["line"].to_numpy()
            for q, j in enumerate(order):  # the earliest alike line before it
                s = text[j]
                for i in order[:q]:
                    if (x == y or own[i] != own[j]) and line[i] != line[j] and alike(text[i], s, edits, min_chars):
                        out.append((line[j], cols["low"][j], cols["id"][i], cols["at"][i]))
                        break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], names=["line", "low", "id", "at"])

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lambda it: grouped(it, 3, 2000, compare), "line long, low long, id long, at long").select("line", "low", F.struct("id", "at").alias("before"))


def removed_lines(df: DataFrame, text: str, id_col: str, edits: int, min_chars: int, few: int, block: int) -> DataFrame:
    """``id, cls, lines``: numbers of the lines that go, by id and text digest."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), _cls(F.col(text)).alias("cls"), F.col(text).alias("text")).where("id IS NOT NULL")

    def occur(batch):
        rows = []
        for i, c, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows.extend((*line_key(line), i, c, at) for at, line in long_lines(t, 1))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return dict(zip(("line", "low", "id", "cls", "at"), map(list, cols), strict=True))

    occurs = persist(map_arrow(docs, occur, "line long, low long, id long, cls long, at long", "text"), "lines")
    firsts = occurs.groupBy("line", "low").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n"))
    firsts = persist(firsts, "firsts")
    met = persist(_meet(_entries(docs, edits, min_chars), few), "met")
    pairs = met.where("b IS NOT NULL").select("a", "b").distinct()
    hot = met.where("b IS NULL").select("key", F.col("a").alias("line")).distinct()
    wanted = met.select(F.col("a").alias("line")).unionByName(met.where("b IS NOT NULL").select(F.col("b").alias("line"))).distinct()
    texts = persist(_texts(docs, wanted), "texts")
    links = persist(_verify_pairs(pairs, texts, edits, min_chars), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("b_low").alias("a_low"), F.col("a").alias("b"), F.col("a_low").alias("b_low")))
    other = firsts.select(F.col("line").alias("b"), F.col("low").alias("b_low"), F.col("first").alias("before"))
    near = both.join(other, ["b", "b_low"]).select(F.col("a").alias("line"), F.col("a_low").alias("low"), "before")
    near = near.unionByName(_verify_blocks(hot, texts, firsts, edits, min_chars, block)).groupBy("line", "low").agg(F.min("before").alias("before"))
    judged = firsts.join(near, ["line", "low"], "left").where("n > 1 OR before < first").select("line", "low", "first", (F.coalesce(F.col("before") < F.col("first"), F.lit(False))).alias("all"))
    late = occurs.join(judged, ["line", "low"]).where(F.col("all") | (F.col("id") > F.col("first.id")) | (F.col("at") > F.col("first.at")))
    return late.groupBy("id", "cls").agg(F.collect_set("at").alias("lines"))


def _cls(text):
    return F.conv(F.hex(F.substring(text_class(text), 1, 7)), 16, 10).cast("long")


def line_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, few: int = FEW, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """The table without the lines that repeat, or with ``digest`` the digest columns."""
    gone = removed_lines(df, text, id_col, edits, min_chars, few, block)
    keep = [F.col(id_col)] if digest else [F.col(c) for c in df.columns if c != text]  # texts travel once, not in the row as well
    src = df.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"), F.col(id_col).cast("long").alias("id"), _cls(F.col(text)).alias("cls"))
    src = src.join(gone, ["id", "cls"], "left").select("_row", "_text", "lines")

    def run(batch):
        n, removed, out = [], [], []
        for t, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows = [] if t is None else t.split("\n")
            drop = set(lines or ())
            kept = "\n".join(r for i, r in enumerate(rows) if i not in drop)
            n.append(len(rows))
            removed.append(len(drop))
            out.append(hashlib.sha256(kept.encode()).hexdigest() if digest else kept if drop else t)
        return {"_row": batch.column(0), "n_lines": n, "n_removed": removed, "out": out}

    got = map_arrow(src, run, f"_row {dict(src.dtypes)['_row']}, n_lines long, n_removed long, out string", "_text")
    if digest:
        return got.select(f"_row.{id_col}", "n_lines", "n_removed", F.col("out").alias("kept_sha256"))
    return got.select(*(F.col("out").alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in df.columns))


def op7_lines(df: DataFrame, **options) -> DataFrame:
    """``id_col, n_lines, n_removed, kept_sha256`` for every document."""
    return line_dedup(df, digest=True, **options)
