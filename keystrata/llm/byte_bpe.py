"""Operator 2: byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern. The distinct words of each block of
documents go through a Spark higher-order fold: the state is the list of token
ids and the ranks of neighbouring pairs; each step merges the leftmost pair of
least rank. Pair ranks come from a literal map, a sparse matrix whose rows are
laid over each other so that a look-up takes constant time; a token's rank is its id. Decoding joins the binary pieces
of the ids.

The most frequent runs of letters of the whole corpus, behind a space, are
encoded once and broadcast (``LISTED`` words of at most ``LISTED_BYTES`` bytes).
All other words are encoded once for each task, or each ``HELD`` words that a
task meets; a task's rows are blocks of bounded bytes that hold only words that
are new, so no step needs the whole vocabulary of the corpus. The list only
spares work: a word has the same ids either way.

Edge cases: null and empty texts give no ids and the digests of nothing. Words
of over ``LONG`` bytes are merged with a heap, as the fold takes a step for
each byte. Repeated rows are encoded alike. Lone surrogates cannot occur in
Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks, Ragged
from .common import arrow_schema, discard, persist, slices

LONG = 512
BLOCK_CHARS = 2 << 20
LISTED, LISTED_BYTES, HELD = 200_000, 64, 250_000
NO_PAIR = 65536
FRONT = NO_PAIR << 32 | 0xFFFF  # before the first token: merges with nothing


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def rank_table(path: str) -> tuple[tuple, tuple, tuple, tuple]:
    """Numbers of the 256 bytes; where each left number's row starts; the rows, laid over each other; pieces in hex.

    A token's number is its rank plus 1. The pair ``l, r`` is at ``starts[l] + r``
    as ``l * 65536 + merged``; a place no pair takes holds 0.
    """
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    if size > 65534:
        raise ValueError("the packed table takes ranks below 65534")
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.setdefault(left + 1, []).append((right + 1, rank + 1))
    total = sum(map(len, rows.values()))
    table, free = np.zeros(0, np.int64), np.ones(0, bool)
    starts = np.zeros(size + 1, np.int64)
    rng = np.random.default_rng(2)
    span = 4 * total + 1
    for left in sorted(rows, key=lambda k: -len(rows[k])):  # full rows first
        right, merged = np.array(rows[left], np.int64).T
        while True:
            if len(free) < span + size + 1:
                more = span + size + 1 - len(free)
                table, free = np.concatenate([table, np.zeros(more, np.int64)]), np.concatenate([free, np.ones(more, bool)])
            for _ in range(64):
                at = rng.integers(0, span, 256)
                for r in right:
                    at = at[free[at + r]]
                    if not len(at):
                        break
                if len(at):
                    break
            if len(at):
                break
            span += total
        starts[left] = at[0]
        table[at[0] + right] = left * 65536 + merged
        free[at[0] + right] = False
    pieces = [""] * size
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    first = tuple(ranks[bytes([i])] + 1 for i in range(256))
    return first, tuple(starts.tolist()), tuple(table.tolist()), tuple(pieces)


def _literal(values, kind: str) -> Column:
    """An array literal; the cast of a constant string is folded once, on the driver."""
    out = F.split(F.lit(",".join(map(str, values))), ",")
    return out if kind == "string" else out.cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _fold(words: Column, path: str, begin: bool) -> Column:
    """The states that ranked merges end with; ``begin``: words are byte values, and not states yet.

    A state is one number a token, after ``FRONT``: the number that its pair with
    the next token merges to (``NO_PAIR`` if none), its first byte's place and its
    own number, 16 bits each of the latter two. The least of the state is hence
    the leftmost pair of least rank, and a place never changes. An entry of the
    table XOR the left number's bits is the merged number if the pair is in the
    vocabulary and at least 65536 otherwise.
    """
    first, starts, table, _ = rank_table(path)
    big = lambda n: F.lit(n).cast("bigint")
    rest, low, middle, half, none = F.lit(1 << 20), big(0xFFFF), big(0xFFFF0000), big(0xFFFFFFFF), big(NO_PAIR)

    def fold(word: Column, starts: Column, table: Column) -> Column:
        def pair(left: Column, right: Column) -> Column:
            found = F.get(table, F.get(starts, left.cast("int")) + right.cast("int"))
            return F.least(F.shiftleft(left, 16).bitwiseXOR(found), none)  # nulls do not count

        def start(word: Column) -> Column:
            ids = F.transform(word, lambda b: F.get(_literal(first, "bigint"), b))
            return _let(ids, lambda x: F.concat(F.array(big(FRONT)), F.transform(x, lambda v, i: F.shiftleft(pair(v, F.get(x, i + 1)), 32) + F.shiftleft(i, 16) + v)))

        def step(state: Column, _: Column) -> Column:
            def merge(m: Column, i: Column) -> Column:
                new, before = F.shiftright(m, 32), F.get(state, i - 2)
                left = F.shiftleft(pair(before.bitwiseAND(low), new), 32) + before.bitwiseAND(half)
                return F.concat(
                    F.slice(state, 1, i - 2),
                    F.array(left, F.shiftleft(pair(new, F.get(state, i + 1).bitwiseAND(low)), 32) + m.bitwiseAND(middle) + new),
                    F.slice(state, i + 2, rest),
                )

            return _let(F.array_min(state), lambda m: F.when(m < NO_PAIR << 32, _let(F.array_position(state, m).cast("int"), lambda i: merge(m, i))).otherwise(state))

        # a word of n bytes takes n - 1 merges at most
        return _let(start(word), lambda s: F.aggregate(F.slice(s, 3, rest), s, step)) if begin else F.aggregate(F.slice(word, 3, rest), word, step)

    # the tables are bound once, so that a plan holds each of them once
    return _let(_literal(starts, "int"), lambda s: _let(_literal(table, "bigint"), lambda t: F.transform(words, lambda w: fold(w, s, t))))


def encode_words(words: Column, path: str) -> Column:
    """Token ids of each word; ``words`` is an array of arrays of byte values."""
    ids = lambda s: F.transform(F.slice(s, 2, F.lit(1 << 20)), lambda v: (v.bitwiseAND(F.lit(0xFFFF).cast("bigint")) - 1).cast("int"))
    return F.transform(_fold(words, path, True), ids)


def encode_states(states: Column, path: str) -> Column:
    """The states that states of :func:`first_states` end with; :func:`ids_of` reads them."""
    return _fold(states, path, False)


def decode_states(states: Column, path: str) -> Column:
    """The bytes of all tokens of an array of states, joined; ``FRONT`` has no piece, and nulls are left out."""
    pieces = _literal(("", *rank_table(path)[3]), "string")
    number = lambda v: v.bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("int")
    return F.unhex(F.array_join(F.transform(F.flatten(states), lambda v: F.get(pieces, number(v))), ""))


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: their pieces, joined."""
    pieces = _literal(rank_table(path)[3], "string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long word, by a heap of pairs."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n):
        push(i)
    alive = [True] * n
    while heap:
        _, i, e, f = heapq.heappop(heap)
        if not alive[i] or end[i] != e or nxt[i] >= n or end[nxt[i]] != f:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = f, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Listed:
    """Frequent words by hash, with their ids and decoded bytes, all in flat arrays."""

    def __init__(self, words: pa.Array, ids: pa.Array, pieces: pa.Array):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        take = pa.array(order)
        self.hashes = hashes[order]
        self.flat, self.lengths = _flat(words.take(take))
        ids = ids.take(take)
        self.ids, self.n_ids = np.asarray(ids.flatten()).astype(np.uint32), np.asarray(ids.value_lengths()).astype(np.uint8)
        self.pieces, self.n_bytes = _flat(pieces.take(take))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the list, or -1. Hashes find a word, its bytes prove it."""
        out = np.full(len(words), -1, np.int32)
        if not len(self) or not words:
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        n = np.fromiter(map(len, words), np.int64, len(words))
        hit = np.flatnonzero((self.hashes[at] == h) & (self.lengths[at] == n))
        if not len(hit):
            return out
        starts = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[at[hit]]
        n = n[hit]
        first = np.cumsum(n) - n
        own = np.frombuffer(b"".join([words[k] for k in hit.tolist()]), np.uint8)
        same = np.logical_and.reduceat(own == self.flat[np.repeat(starts - first, n) + np.arange(len(own))], first)
        out[hit[same]] = at[hit[same]]
        return out


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and the length of each value."""
    values = pa.concat_arrays([values.cast(pa.binary())])
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends).astype(np.uint8)


def frequent_words(df: DataFrame, text: str, path: str, listed: int) -> Listed:
    """The most frequent words of letters alone between spaces, each behind a space.

    All words are counted; those whose count is at least a power of 2 ** (1 / 8)
    are listed, the least such power for which they are ``listed`` at most.
    """
    words = df.select(F.explode(F.split(F.col(text), " ")).alias("w")).groupBy("w").agg(F.floor(8 * F.log2(F.count("*"))).cast("int").alias("step"))
    counts = persist(words.where((F.octet_length("w") < LISTED_BYTES) & F.col("w").rlike("^\\p{L}+$")), "words")
    least, room = 1 << 30, listed
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # 512 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    word = F.concat(F.lit(" "), "w")
    byte = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
    found = counts.where(F.col("step") >= least).repartition(64, "w").select(word.alias("word"), F.get(encode_words(F.array(byte), path), 0).alias("ids"))
    got = found.select("word", "ids", decode_ids(F.col("ids"), path).alias("piece")).toArrow().combine_chunks()  # listed rows at most
    discard(counts)
    cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
    return Listed(cols[0].cast(pa.binary()), cols[1], cols[2])


def byte_pairs(path: str) -> np.ndarray:
    """What the states of two neighbouring bytes begin with: the merged number and the left one; of the last byte in column 256."""
    first, starts, table, _ = (np.array(x) if k < 3 else x for k, x in enumerate(rank_table(path)))
    merged = np.minimum((first << 16)[:, None] ^ table[starts[first][:, None] + first], NO_PAIR)
    return (np.column_stack([merged, np.full(256, NO_PAIR)]) << 32) + first[:, None]


def first_states(words: list[bytes], pairs: np.ndarray) -> pa.ListArray:
    """The state of each word before its merges, by :func:`byte_pairs`."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.cumsum(lengths)
    right = np.append(flat[1:], 256)[: len(flat)]
    right[ends[lengths > 0] - 1] = 256
    states = pairs[flat, right] + (np.arange(len(flat)) - np.repeat(ends - lengths, lengths) << 16)
    out = np.full(len(flat) + len(words), FRONT)
    out[np.arange(len(flat)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = states
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends + np.arange(1, len(words) + 1)).astype(np.int32)), pa.array(out))


def ids_of(states: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of words by their last states, and how many each word has."""
    flat, lengths = np.asarray(states.flatten()), np.asarray(states.value_lengths()).astype(np.int64)
    token = np.ones(len(flat), bool)
    token[np.cumsum(lengths) - lengths] = False
    return ((flat[token] & 0xFFFF) - 1).astype(np.uint32), lengths - 1


def blocks(df: DataFrame, pattern: str, path: str, listed: Listed) -> DataFrame:
    """Rows of documents with their new words: ``keys, sizes, index, before, words, longs``.

    ``index`` numbers the listed words first, then the others that the task has met.
    ``before`` is how many of the latter earlier rows of the task hold; it is 0
    where numbering starts anew, which bounds the memory.
    """
    column, pairs = df.columns[1], byte_pairs(path)

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        state = None
        for whole in batches:
            for batch in slices(whole, column, BLOCK_CHARS):
                if state is None or len(state[0]) > HELD:
                    state = [Chunks(), {}, Ragged(), np.zeros(0, np.int32)]
                yield block(batch, find, state)

    def block(batch, find, state):
        chunks, numbers, of_chunk, place = state
        parts, words = [], []
        parts.extend(chunks.split_all(batch.column(1)))
        found = list(map(find, chunks.drain()))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        found = list(chain.from_iterable(found))
        number = np.fromiter(map(numbers.get, found, repeat(-1)), np.int32, len(found))
        for i in np.flatnonzero(number < 0).tolist():
            w = found[i]
            k = numbers.get(w)
            if k is None:
                k = numbers[w] = len(numbers)
                words.append(w.encode())
            number[i] = k
        of_chunk.extend_flat(number, lengths)
        del found
        at = listed.find(words)
        new = np.flatnonzero(at < 0)
        before = int((place >= len(listed)).sum())
        at[new] = len(listed) + before + np.arange(len(new))
        place = state[3] = np.concatenate([place, at])
        words = [words[k] for k in new.tolist()]
        flat = np.concatenate(parts)
        index, sizes = place[of_chunk.gather(flat)], of_chunk.sums(flat, parts)
        ranks, longs = None, []
        for k, w in enumerate(words):
            if len(w) > LONG:
                ranks = ranks or read_ranks(path)
                longs.append({"word": k, "ids": merge_long(w, ranks)})
                words[k] = b""
        cols = {
            "keys": pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0)),
            "sizes": [sizes.tolist()],
            "index": [index.tobytes()],
            "before": [before],
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), first_states(words, pairs)),
            "longs": [longs],
        }
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(arrow, cols.values(), strict=True)], schema=arrow)

    kind = f"keys array<{df.dtypes[0][1]}>, sizes array<int>, index binary, before long, words array<array<bigint>>, longs array<struct<word:int,ids:array<int>>>"
    target, arrow = arrow_schema(df.sparkSession, kind)
    return df.mapInArrow(run, target)


def _parts(index: np.ndarray, cuts: np.ndarray, limit: int):
    """The words of some texts at a time, about ``limit``, and where the texts end among them."""
    first = done = 0
    for last in [*(np.flatnonzero(np.diff(cuts // limit)) + 1).tolist(), len(cuts)]:
        if last > first:
            part = cuts[first:last]
            yield index[done : part[-1]], part - done
            first, done = last, int(part[-1])


def _digests(flat: np.ndarray, lengths: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Items and SHA-256 of each text, whose words end at ``cuts``."""
    ends = np.append(0, np.cumsum(lengths))[cuts]
    starts, data = np.append(0, ends[:-1]), memoryview(flat).cast("B")
    each = flat.itemsize
    return ends - starts, [hashlib.sha256(data[each * a : each * b]).hexdigest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def op2_bpe(df: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", id_col: str = "doc_id", listed: int = LISTED) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` for every text."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    top = frequent_words(df, text, path, listed)
    found = blocks(df.select(id_col, text), pattern, path, top)
    found = found.select("keys", "sizes", "index", "before", encode_states(F.col("words"), path).alias("states"), "longs")
    found = found.select("*", decode_states(F.col("states"), path).alias("pieces"), F.transform("longs", lambda x: decode_ids(x["ids"], path)).alias("long_pieces"))
    kind = f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    target, arrow = arrow_schema(df.sparkSession, kind)
    piece_bytes = np.array([len(p) // 2 for p in rank_table(path)[3]])

    def run(batches):
        of_word = of_bytes = None
        for batch in batches:
            for r in range(len(batch)):
                keys, sizes, index, before, states, longs, pieces, long_pieces = (batch.column(c)[r] for c in range(8))
                if before.as_py() == 0:
                    of_word, of_bytes = Ragged(np.uint32), Ragged(np.uint8)
                    of_word.extend_flat(top.ids, top.n_ids.astype(np.int64))
                    of_bytes.extend_flat(top.pieces, top.n_bytes.astype(np.int64))
                first = of_word.n
                if first != len(top) + before.as_py():
                    raise RuntimeError("a row refers to words that this task has not met")
                ids, lengths = ids_of(states.values)
                of_word.extend_flat(ids, lengths)
                ends = np.append(0, np.cumsum(piece_bytes[ids]))[np.append(0, np.cumsum(lengths))]
                of_bytes.extend_flat(np.frombuffer(pieces.as_py(), np.uint8), np.diff(ends))
                for x, p in zip(longs.as_py(), long_pieces.as_py(), strict=True):
                    of_word.put(first + x["word"], x["ids"])
                    of_bytes.put(first + x["word"], np.frombuffer(p, np.uint8))
                index = np.frombuffer(index.as_py(), np.int32)
                cuts = np.cumsum(sizes.as_py())
                n, ids_sha, sha = [], [], []
                for words, part in _parts(index, cuts, 1 << 15):
                    count, digests = _digests(of_word.gather(words).astype("<u4", copy=False), of_word.lengths[words], part)
                    n += count.tolist()
                    ids_sha += digests
                    sha += _digests(of_bytes.gather(words), of_bytes.lengths[words], part)[1]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(sha)], schema=arrow)

    return found.mapInArrow(run, target)
