"""Operator 6: best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens; full pieces fill a
sequence each. The other pieces are packed by their lengths alone: the driver
holds a count for each length below the capacity, however many documents there
are. Bin completion takes the largest piece that is left, enumerates the
undominated fillings around it, of any number of pieces, applies a filling to as
many bins as the counts allow, then to fewer, and prunes branches whose waste bound reaches the incumbent, which
best-fit decreasing gives first. Pieces of one length are interchangeable; they
are ranked in parallel by (length, salt) and find their place by rank.

Edge cases: null and empty texts hold the end id alone. A document of exactly
``capacity`` tokens is one full piece. Texts of any length are cut, the first
piece being the shorter one. Repeated rows are packed each; ties in rank, of
equal pieces, may swap places. Further columns have no influence. An empty table gives no rows. The search ends at a proven optimum
or after ``nodes`` steps, with the best packing so far; all pieces are packed
in any case.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import Chunks, Ragged
from .common import map_arrow, persist

CAPACITY = 2048
END = 0
#: Pieces of one length that are ranked in one group, about.
RANKED = 50_000
#: Chunks that a worker keeps from task to task; it lives on, and shares the executor's memory with others.
CACHE_CHUNKS = 800_000
Pattern = tuple[int, ...]


# -- packing of counts -------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts of lengths: patterns and how often each."""
    room: dict[int, list[tuple[Pattern, int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fit = min((r for r in room if r >= size), default=None)
            if fit is None:
                each = capacity // size
                bins, rest = divmod(left, each)
                if bins:
                    room.setdefault(capacity - each * size, []).append(((size,) * each, bins))
                if rest:
                    room.setdefault(capacity - rest * size, []).append(((size,) * rest, 1))
                break
            pattern, bins = room[fit].pop()
            if not room[fit]:
                del room[fit]
            each = min(fit // size, left)
            take = min(bins, left // each)
            if take < bins:
                room.setdefault(fit, []).append((pattern, bins - take))
            room.setdefault(fit - each * size, []).append((pattern + (size,) * each, take))
            left -= take * each
    return [x for group in room.values() for x in group]


def _dominated(filling: Pattern, slack: int, have: int) -> bool:
    """Whether a piece that is not used could stand for some of the filling's and leave it no emptier.

    ``have`` has a bit for each length of which a piece is left over.
    """
    one, more = 0, 0  # sums of single pieces, and of several
    for v in filling:
        more |= (more | one) << v
        one |= 1 << v
    if have & more:
        return True
    sums = more | one
    for _ in range(slack):
        sums <<= 1
        if have & sums:
            return True
    return False


def fillings(n: np.ndarray, room: int):
    """All fillings of ``room``, the fullest first, and for each whether it is undominated.

    Depth first over the distinct lengths, the largest first; sets of the sums
    that the lengths from each one on can still make lead past dead ends. The
    sets are made anew after each filling, so that waiting searches hold none.
    """
    sizes = np.flatnonzero(n[: room + 1])[::-1].tolist()
    most = [min(int(n[v]), room // v) for v in sizes]
    mask = (1 << (room + 1)) - 1

    def sums():
        out = [1] * (len(sizes) + 1)
        for i in range(len(sizes) - 1, -1, -1):
            s, left, step = out[i + 1], most[i], 1
            while left:
                step = min(step, left)
                s |= (s << sizes[i] * step) & mask
                left -= step
                step *= 2
            out[i] = s
        return out

    can = sums()
    have = sum(1 << v for v in sizes)
    for total in range(room, -1, -1):
        if not can[0] >> total & 1:
            continue
        stack = [(0, total, ())]  # next length, tokens to fill, (length, pieces) so far
        while stack:
            i, left, chosen = stack.pop()
            if left:
                if can is None:
                    can = sums()
                while sizes[i] > left:
                    i += 1
                v = sizes[i]
                for k in range(min(most[i], left // v) + 1):  # the most pieces on top
                    if can[i + 1] >> (left - k * v) & 1:
                        stack.append((i + 1, left - k * v, (*chosen, (v, k)) if k else chosen))
                continue
            filling = tuple(v for v, k in chosen for _ in range(k))
            over = have & ~sum(1 << v for v, k in chosen if k == n[v])
            can = None
            yield filling, not _dominated(filling, room - total, over)
        if can is None:
            can = sums()


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 3_000) -> list[tuple[Pattern, int]]:
    """A packing of all pieces into as few bins as the search finds in ``nodes`` steps.

    A step takes one more filling around the largest piece. It is applied to as
    many bins as the counts allow, then to fewer.
    """
    counts = {k: v for k, v in counts.items() if v}
    best = best_fit(counts, capacity)
    bins = sum(k for _, k in best)
    total = sum(k * v for k, v in counts.items())
    bound = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    n = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        n[k] = v

    def branches(n, left, chain, used):
        big = int(np.flatnonzero(n)[-1])
        rest = n.copy()
        rest[big] -= 1
        for filling, good in fillings(rest, capacity - big):
            pattern = (big, *filling)
            if not good:
                yield None
                continue
            need: dict[int, int] = {}
            for v in pattern:
                need[v] = need.get(v, 0) + 1
            for times in range(min(int(n[v]) // k for v, k in need.items()), 0, -1):
                m = n.copy()
                for v, k in need.items():
                    m[v] -= k * times
                yield m, left - times * sum(pattern), (chain, pattern, times), used + times

    stack = [branches(n, total, (), 0)] if total else []
    while stack and bins > bound and nodes > 0:
        nodes -= 1
        state = next(stack[-1], ())
        if state == ():
            stack.pop()
            continue
        if state is None:
            continue
        _, left, chain, used = state
        if used + -(-left // capacity) >= bins:  # the waste so far is too much
            continue
        if not left:
            bins, best = used, _unchain(chain)
            continue
        stack.append(branches(*state))
    return best


def _unchain(chain) -> list[tuple[Pattern, int]]:
    out = []
    while chain:
        chain, pattern, times = chain
        out.append((pattern, times))
    return out


def places(packing: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, times in packing:
        offset = 0
        for size in pattern:
            at = used.get(size, 0)
            rows.append((size, at, at + times, sequence, offset))
            used[size] = at + times
            offset += size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# -- pieces of documents -----------------------------------------------------


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@cache
def _piece_bytes(path: str) -> np.ndarray:
    """Bytes of each id's piece; the vocabulary writes a byte as a character."""
    vocab = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, k in vocab.items():
        out[k] = len(token)
    return out


def encode_chunks(chunks: list[str], odd: list[int], path: str, out: Ragged) -> None:
    """Append the ids of each chunk to ``out``.

    Chunks that begin with one space and end without white space are encoded
    together, which a cut before such a space allows, and parted by bytes; the
    ``odd`` ones alone.
    """
    tokenizer, size = _tokenizer(path), _piece_bytes(path)
    base, plain = out.n, list(chunks)
    for i in odd:
        plain[i] = ""
    for a in range(0, len(plain), 2000):
        part = plain[a : a + 2000]
        ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))
        places = np.append(0, np.cumsum(size[ids]))
        cut = np.searchsorted(places, ends)
        if not (places[cut] == ends).all():
            raise ValueError("chunks do not end with tokens")
        out.extend_flat(ids, np.diff(cut, prepend=0))
    for a in range(0, len(odd), 5000):
        for i, e in zip(odd[a : a + 5000], tokenizer.encode_batch_fast([chunks[i] for i in odd[a : a + 5000]], add_special_tokens=False), strict=True):
            out.put(base + i, np.array(e.ids, np.uint32))


_CACHE: dict[str, tuple[Chunks, Ragged]] = {}


def token_ids(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of each; those of chunks are kept, a bounded number of them."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    chunks, ids = _CACHE.setdefault(path, (Chunks(), Ragged(np.uint32)))
    if len(chunks) > CACHE_CHUNKS:
        chunks.clear()
        _CACHE[path] = chunks, ids = chunks, Ragged(np.uint32)
    parts = [chunks.split(t) if t else np.zeros(0, np.int64) for t in texts]
    encode_chunks(*chunks.drain_with_odd(), path, ids)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return ids.gather(flat), ids.sums(flat, parts)


PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, capacity: int, text: str, id_col: str) -> DataFrame:
    def run(batch):
        rows, take, at = [], [], 0
        flat, counts = token_ids(batch.column(1).to_pylist(), path)
        data, end = memoryview(flat.astype("<u4", copy=False)).cast("B"), np.array([END], "<u4").tobytes()
        for k, n in enumerate((counts + 1).tolist()):
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                crc = zlib.crc32(data[4 * (at + a) : 4 * (at + min(b, n - 1))])
                rows.append((p, a, b - a, zlib.crc32(end, crc) if b == n else crc))
                take.append(k)
            at += n - 1
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return {id_col: batch.column(0).take(take)} | dict(zip(("piece", "start", "length", "ids_crc32"), map(list, cols), strict=True))

    return map_arrow(df.select(id_col, text), run, f"{id_col} {dict(df.dtypes)[id_col]}, {PIECES}", text, 2 << 20)


def op6_pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    import pyarrow as pa

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    cut = persist(pieces(df, path, capacity, text, id_col), "pieces")
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}  # at most capacity rows
    # the pieces of a common length are ranked in as many groups as there are RANKED of them
    salts = np.array([-(-counts.get(n, 0) // RANKED) for n in range(capacity + 1)], np.int64)
    groups = F.get(F.array(*map(F.lit, np.maximum(salts, 1).tolist())), F.col("length").cast("int"))
    part = part.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), groups).cast("int"))
    first = np.cumsum(salts) - salts
    sizes = np.zeros(int(salts.sum()) + 1, np.int64)
    for r in part.groupBy("length", "_salt").count().collect():  # a row a group
        sizes[first[r["length"]] + r["_salt"]] = r["count"]
    before = np.cumsum(sizes) - sizes
    before -= np.repeat(before[first], np.append(salts[:-1], salts[-1] + 1)) if len(before) else 0
    table = places(bin_completion(counts, capacity))
    ends = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batch):
        size, salt, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in (3, 5, 6))
        rank = rank - 1 + before[first[size] + salt]
        row = table[np.searchsorted(ends, size * (1 << 44) + rank, "right") - 1] if len(size) else np.zeros((0, 5), np.int64)
        extra = [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = part.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "start", "ids_crc32")))
    placed = map_arrow(ranked, run, f"{id_col} {dict(df.dtypes)[id_col]}, {PIECES}, sequence_id long, offset long")
    return full.unionByName(placed)
