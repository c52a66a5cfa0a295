"""Operator 10: scoring by a log-bilinear language model.

Tokens are the lower-cased (A-Z) words of a text and an end. Counts of all
tokens come from all training documents. The model's symbols are the most
frequent words, as many as the square root of the training tokens, the end, and
buckets of the other words by their last bytes.

The vectors of the two words before a token, each times its position's matrix,
are summed to one prediction. Its products with the output vectors score all
symbols; symbols fall into classes by frequency, so that a probability is that
of the class times that within the class, each a softmax over a matrix product
and hence exactly normalised. A word of a bucket takes its add-one share of the
bucket's count, so all probabilities of a context sum to one.

Training is noise-contrastive estimation in numpy with noise words sampled from
the unigram distribution. It takes every training token once, however many there
are: each round, tasks take stochastic steps over their part of a slice of the documents, and their
parameters are averaged, weighted by how often a task met a symbol. What a task
returns is a row for each symbol that it met.

Edge cases: null and empty texts are an end alone. Rows without an id are not
held out. Without training documents both scores come from V = N = 0. Equal
texts have equal base scores, and scores that differ by the rounding of single
precision at most; repeated rows count as often as they occur. Words of
any length count; those of over ``LONGEST`` bytes are never model words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, persist, slices
from .language_id import held_out

BUCKETS, LISTED, LONGEST, HELD = 64, 300_000, 64, 400_000
DIMENSIONS, NOISE, BATCH, ROUNDS, RATE = 20, 32, 2048, 2, 0.05
END = b""


def tokens(text: str | None) -> list[bytes]:
    """The words in lower case, then the end."""
    return [*(text or "").encode().lower().split(), END]


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def key_of(word: bytes) -> bytes:
    """What a word is counted and joined by: itself, or behind a space, which no word holds, the digest of a long one."""
    return word if len(word) <= LONGEST else b" " + xxhash.xxh3_128_digest(word)


def model_size(total: int) -> int:
    """Model words for so many training tokens: their square root, as far as words are listed."""
    return min(LISTED, math.isqrt(total))


class Lexicon:
    """The most frequent tokens with counts, and the model's symbol of each.

    Symbols: model words from 0, then the end, then the buckets. Other words are
    looked up by a join.
    """

    def __init__(self, listed: list[tuple[bytes, int]], end: int, total: int, distinct: int):
        listed = [(w, n) for w, n in listed if w != END]
        self.of = {w: i for i, w in enumerate([END, *(w for w, _ in listed)])}
        self.count = np.array([end, *(n for _, n in listed)], np.int64)
        self.model = min(model_size(total), len(listed))
        self.end = self.model
        self.size = self.model + 1 + BUCKETS
        self.symbol = np.array([self.end, *range(self.model), *(self.model + 1 + bucket(w) for w, _ in listed[self.model :])], np.int32)
        self.total, self.distinct = total, distinct

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Symbols, numbers in the list (-1: not there), and the words not there."""
        index = np.fromiter(map(self.of.get, words, repeat(-1)), np.int32, len(words))
        symbols = self.symbol[index]
        at = np.flatnonzero(index < 0)
        late = [words[i] for i in at.tolist()]
        if late:
            symbols[at] = [self.model + 1 + bucket(w) for w in late]
        return symbols, index, Counter(late)

    def contexts(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Targets of all texts in one array, and the symbols one and two places before; ``size`` is the start."""
        flat = np.concatenate(symbols)
        starts = np.cumsum([0, *map(len, symbols[:-1])])
        before = np.empty((2, len(flat)), np.int32)
        for lag in (1, 2):
            before[lag - 1, lag:] = flat[:-lag]
            for k in range(lag):
                at = starts[starts + k < len(flat)] + k
                before[lag - 1, at] = self.size
        return flat, before


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """``key, bucket, n`` over all rows."""

    def rows(n):
        words = list(n)
        cols = [list(map(key_of, words)), list(map(bucket, words)), list(n.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(arrow, cols, strict=True)], schema=arrow)

    def run(batches):
        n: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, text):
                for t in batch.column(0).to_pylist():
                    n.update(tokens(t))
                if len(n) > HELD:
                    yield rows(n)
                    n.clear()
        yield rows(n)

    target, arrow = arrow_schema(docs.sparkSession, "key binary, bucket int, n long")
    return docs.select(text).mapInArrow(run, target).groupBy("key", "bucket").agg(F.sum("n").alias("n"))


def read_lexicon(counts: DataFrame) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """The lexicon; tokens and distinct words of each bucket."""
    counts = counts.withColumn("step", F.floor(8 * F.log2("n")).cast("int"))
    short = (F.length("key") > 0) & (F.substring("key", 1, 1) != F.lit(bytearray(b" ")))
    rows = counts.groupBy("step", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(short, 1)).alias("short"), F.sum(F.when(F.length("key") == 0, F.col("n"))).alias("end")).collect()  # 512 steps by BUCKETS at most
    least, room = 1 << 30, LISTED
    for step in sorted({r.step for r in rows}, reverse=True):
        room -= sum(r.short for r in rows if r.step == step)
        if room < 0:
            break
        least = step
    listed = counts.where((F.col("step") >= least) & short).select("key", "n").toArrow()  # LISTED rows at most
    listed = sorted(zip(listed.column(0).to_pylist(), listed.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    lexicon = Lexicon(listed, sum(r.end or 0 for r in rows), sum(r.n for r in rows), sum(r.v for r in rows))
    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        n[r.bucket] += r.n
        v[r.bucket] += r.v
    for w, k in [*listed[: lexicon.model], *([(END, int(lexicon.count[0]))] if lexicon.count[0] else [])]:
        n[bucket(w)] -= k
        v[bucket(w)] -= 1
    return lexicon, n, v


class Model:
    """Parameters, and the classes of the symbols.

    Words and the end are in classes by falling frequency, about as many as the
    square root of the words, with equal shares of the square roots of counts;
    each bucket is a class of its own. ``place`` gives a symbol's output row, by
    class; ``first`` where a class starts.
    """

    def __init__(self, counts: np.ndarray, seed: int = 10):
        size = len(counts)
        words = size - BUCKETS
        unigram = np.maximum(counts, 0) + 0.1
        self.unigram = unigram / unigram.sum()
        order = np.argsort(-counts[:words], kind="stable")
        mass = np.cumsum(np.sqrt(unigram[order]))
        n = max(1, math.isqrt(words))
        label = np.minimum((mass - np.sqrt(unigram[order]) / 2) * n // mass[-1], n - 1).astype(np.int64)
        label = np.unique(label, return_inverse=True)[1]
        self.words = int(label[-1]) + 1  # classes of words
        self.place = np.empty(size, np.int64)
        self.place[order] = np.arange(words)
        self.place[words:] = np.arange(words, size)
        self.of = np.empty(size, np.int64)
        self.of[order] = label
        self.of[words:] = self.words + np.arange(BUCKETS)
        self.first = np.append(np.searchsorted(label, np.arange(self.words)), words)
        self.of_place = np.concatenate([label, self.words + np.arange(BUCKETS)])
        by_class = np.bincount(self.of, weights=self.unigram)
        by_place = np.empty(size)
        by_place[self.place] = self.unigram
        rng = np.random.default_rng(seed)
        near = lambda rows: rng.normal(0, 0.1, (rows, DIMENSIONS))
        # the last column of outputs is the bias
        self.params = {
            "r": np.column_stack([near(size + 1), np.zeros(size + 1)]),
            "t": np.column_stack([near(size) * 0.1, np.log(by_place)]),
            "c": np.column_stack([near(len(by_class)) * 0.1, np.log(by_class)]),
            "m": np.column_stack([np.concatenate([np.eye(DIMENSIONS)] * 2) * 0.7, np.zeros(2 * DIMENSIONS)]),
        }
        self.noise = {"t": by_place, "c": by_class}

    def single(self) -> dict[str, np.ndarray]:
        """The parameters in single precision, with contexts already transformed by position."""
        r, m = self.params["r"][:, :-1], self.params["m"][:, :-1]
        out = {"one": r @ m[:DIMENSIONS], "two": r @ m[DIMENSIONS:]}
        # contexts end in halves, so that a prediction ends in 1, which meets the bias
        for k in ("one", "two"):
            out[k] = np.column_stack([out[k], np.full(len(r), 0.5)])
        for k in "tc":
            out[k] = np.ascontiguousarray(self.params[k].T)
        return {k: v.astype(np.float32) for k, v in out.items()}

    def log_probs(self, targets: np.ndarray, before: np.ndarray, p: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Natural logarithms of the probabilities of the targets' symbols.

        One prediction a token, the sum of its transformed contexts, goes through
        two matrix products: with all classes, and with its class's symbols.
        """
        p = p or self.single()
        q = p["one"].take(before[0], axis=0)
        q += p["two"].take(before[1], axis=0)
        out = np.empty(len(targets), np.float32)
        kind, place = self.of[targets], self.place[targets]
        for at in range(0, len(q), 4096):
            out[at : at + 4096] = _log_softmax(q[at : at + 4096] @ p["c"], kind[at : at + 4096])
        order = np.argsort(kind.astype(np.int16 if len(self.first) < 32_000 else np.int32), kind="stable")
        cut = np.searchsorted(kind[order], np.arange(self.words + 1))
        q, place, inner = q.take(order, axis=0), place[order], np.zeros(len(q), np.float32)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, b = self.first[k], self.first[k + 1]
            step = max(64, (1 << 20) // (b - a))
            for at in range(cut[k], cut[k + 1], step) if b - a > 1 else ():
                rows = slice(at, min(at + step, cut[k + 1]))
                inner[rows] = _log_softmax(q[rows] @ p["t"][:, a:b], place[rows] - a)
        out[order] += inner
        return out.astype(np.float64)


def _log_softmax(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = s[np.arange(len(s)), at]
    top = float(s.max())
    if top > 60 or float(own.min()) < -60:  # beyond what single precision takes
        top = s.max(1)
        return own - top - np.log(np.exp(s - top[:, None]).sum(1))
    return own - np.log(np.exp(s, out=s).sum(1))


class Trainer:
    """Stochastic steps over batches, from a model's parameters; what changed, and how often a row was met."""

    def __init__(self, model: Model, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in model.params.items()}
        self.sums = {k: np.full(v.shape, 1.0, np.float32) for k, v in self.p.items()}
        self.met = {k: np.zeros(len(v)) for k, v in self.p.items()}
        self.cdf = {k: np.cumsum(v) for k, v in model.noise.items()}
        self.base = {k: np.log(NOISE * v).astype(np.float32) for k, v in model.noise.items()}

    def _head(self, name: str, rows: np.ndarray, q: np.ndarray, back: np.ndarray) -> None:
        """Contrast the true rows of an output with sampled noise; adds to the gradient of the prediction.

        The last column of ``q`` is 1 and meets the bias.
        """
        p, cdf, base = self.p[name], self.cdf[name], self.base[name]
        noise = np.minimum(np.searchsorted(cdf, self.rng.random(NOISE) * cdf[-1]), len(cdf) - 1)
        w, n = p.take(rows, axis=0), p.take(noise, axis=0)
        # how far the true word and the noise are from what they are, by the model
        true = _inverse(np.einsum("ij,ij->i", q, w) - base[rows])[:, None]
        false = q @ -n.T
        false += base[noise]
        _inverse(false)
        w *= true
        back += w
        back -= false @ n
        grad = np.empty((len(rows) + NOISE, DIMENSIONS + 1), np.float32)
        np.multiply(true, q, out=grad[: len(rows)])
        np.negative(false.T @ q, out=grad[len(rows) :])
        self._update(name, np.concatenate([rows, noise]), grad)
        self.met[name] += np.bincount(rows, minlength=len(p))

    def step(self, targets: np.ndarray, before: np.ndarray) -> None:
        d, n, m = DIMENSIONS, len(targets), self.p["m"]
        both = before.ravel()
        x = self.p["r"].take(both, axis=0)[:, :-1]
        q = x[:n] @ m[:d] + x[n:] @ m[d:]
        q[:, -1] = 1
        back = np.zeros_like(q)
        self._head("t", self.model.place[targets], q, back)
        self._head("c", self.model.of[targets], q, back)
        back[:, -1] = 0
        grad = np.zeros((2 * n, d + 1), np.float32)
        grad[:n, :-1] = back @ m[:d].T
        grad[n:, :-1] = back @ m[d:].T
        self._update("r", both, grad)
        self.met["r"] += np.bincount(both, minlength=len(self.p["r"]))
        self._apply("m", np.arange(2 * d), np.concatenate([x[:n].T @ back, x[n:].T @ back]))
        self.met["m"] += n

    def _update(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.uint16) if len(self.p[name]) <= 65536 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        self._apply(name, rows[first], np.add.reduceat(grad.take(order, axis=0), first, axis=0))

    def _apply(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        sums = self.sums[name].take(rows, axis=0)
        sums += grad * grad
        self.sums[name][rows] = sums
        grad *= RATE
        grad /= np.sqrt(sums, out=sums)
        grad += self.p[name].take(rows, axis=0)
        self.p[name][rows] = grad

    def changes(self):
        """``name, row, met`` and what to add to the row, times ``met``."""
        for name, met in self.met.items():
            rows = np.flatnonzero(met)
            yield name, rows, met[rows], (self.p[name][rows] - self.model.params[name][rows]) * met[rows, None]


def _inverse(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e ** x), in place."""
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train_round(read: DataFrame, lexicon: Lexicon, model: Model, seed: int) -> None:
    """One round over all rows of ``read(symbols)``; the model's parameters become the averages."""
    names, width = list(model.params), DIMENSIONS + 1

    def run(batches):
        trainer, rng = Trainer(model, seed), np.random.default_rng(seed)
        for whole in batches:
            for batch in slices(whole, "symbols", 1 << 20):
                targets, before = lexicon.contexts(_unpack(batch.column(0)))
                order = rng.permutation(len(targets))
                for at in range(0, len(order), BATCH):
                    some = order[at : at + BATCH]
                    trainer.step(targets[some], before.take(some, axis=1))
        for name, rows, met, add in trainer.changes():
            cols = [pa.array(np.full(len(rows), names.index(name), np.int32)), pa.array(rows.astype(np.int64)), pa.array(met), *(pa.array(add[:, k].astype(np.float64)) for k in range(width))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    values = [f"v{k}" for k in range(width)]
    target, arrow = arrow_schema(read.sparkSession, "name int, row long, met double, " + ", ".join(f"{v} double" for v in values))
    found = read.select("symbols").mapInArrow(run, target).groupBy("name", "row").agg(*(F.sum(v).alias(v) for v in ("met", *values)))
    table = found.toArrow()  # a row a symbol and parameter: as many as the model has
    name, row = np.asarray(table.column("name")), np.asarray(table.column("row"))
    add = np.column_stack([np.asarray(table.column(v)) for v in values]) / np.asarray(table.column("met"))[:, None]
    for k, param in enumerate(names):
        model.params[param][row[name == k]] += add[name == k]


def train(read: DataFrame, lexicon: Lexicon, in_bucket: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of all rows of ``read(symbols)``; every round takes its own slice of them."""
    model = Model(np.concatenate([lexicon.count[1 : lexicon.model + 1], lexicon.count[:1], in_bucket]))
    if lexicon.total:
        for r in range(rounds):
            train_round(read.where(F.pmod(F.xxhash64("symbols"), F.lit(rounds)) == r), lexicon, model, r)
    return model


def _unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in column.to_pylist()]


def read_documents(docs: DataFrame, lexicon: Lexicon, in_bucket: np.ndarray, kinds: np.ndarray) -> DataFrame:
    """``row, id, held_out, symbols``, counts and what needs no model, one row a document.

    ``share`` is what the words of buckets add to the score, but for those that
    are not listed: these are in ``rest``.
    """
    logs = np.log10((lexicon.count + 1) / (lexicon.total + lexicon.distinct + 1))
    share = np.zeros(len(lexicon.count))
    rare = lexicon.symbol > lexicon.end
    per_bucket = in_bucket + kinds + 1
    share[rare] = np.log10((lexicon.count[rare] + 1) / per_bucket[lexicon.symbol[rare] - lexicon.end - 1])
    by_bucket = np.log10(per_bucket)
    entry = pa.struct([("key", pa.binary()), ("n", pa.int64())])

    def run(batch):
        out, n, known, base, shares, keys, times, ends = [], [], [], [], [], [], [], [0]
        for t in batch.column(3).to_pylist():
            symbols, index, late = lexicon.read(tokens(t))
            listed = index[index >= 0] if late else index
            out.append(symbols.astype(np.int32, copy=False).tobytes())
            n.append(len(symbols))
            known.append(int((lexicon.count[listed] > 0).sum()))
            base.append(float(logs[listed].sum()))
            shares.append(float(share[listed].sum()) - math.fsum(k * by_bucket[bucket(w)] for w, k in late.items()))
            late = sorted((key_of(w), k) for w, k in late.items())
            keys.extend(w for w, _ in late)
            times.extend(k for _, k in late)
            ends.append(len(keys))
        rest = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(times, pa.int64())], fields=list(entry))
        rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
        return {"row": batch.column(0), "id": batch.column(1), "held_out": batch.column(2), "symbols": out, "n_tokens": n, "n_known": known, "base": base, "share": shares, "rest": rest}

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    return map_arrow(keyed, run, f"row long, id {dict(docs.dtypes)['id']}, held_out boolean, symbols binary, n_tokens long, n_known long, base double, share double, rest array<struct<key:binary,n:long>>", "text", 2 << 20)


def op10_lm(df: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    docs = df.select(F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text).alias("text"))
    training = docs.where(~F.col("held_out"))
    counts = persist(count_tokens(training, "text"), "counts")
    lexicon, in_bucket, kinds = read_lexicon(counts)
    read = persist(read_documents(docs, lexicon, in_bucket, kinds), "symbols")
    model = train(read.where(~F.col("held_out")), lexicon, in_bucket)
    single, end = model.single(), lexicon.total + lexicon.distinct + 1

    def run(batch):
        symbols = _unpack(batch.column(1))
        if not symbols:
            return None
        p = model.log_probs(*lexicon.contexts(symbols), single) / math.log(10)
        starts = np.cumsum([0, *map(len, symbols)])
        return {"row": batch.column(0), "score": np.array([p[a:b].sum() for a, b in zip(starts, starts[1:], strict=False)])}

    scored = map_arrow(read.select("row", "symbols"), run, "row long, score double", "symbols", 1 << 20)
    rest = read.select("row", F.explode("rest").alias("r")).select("row", "r.key", F.col("r.n").alias("k")).join(counts.select("key", "n"), "key", "left")
    late = rest.select("row", F.when(F.col("n") > 0, F.col("k")).alias("known"), (F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(end))).alias("base"), (F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("score"))
    first = read.select("row", "n_known", "base", "share")
    parts = first.select("row", F.col("n_known").alias("known"), "base", F.col("share").alias("score"))
    parts = parts.unionByName(late).unionByName(scored.select("row", F.lit(None).cast("long").alias("known"), F.lit(None).cast("double").alias("base"), "score"))
    sums = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "base", "score")))
    return read.select("row", "id", "held_out", "n_tokens").join(sums, "row").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), F.round("base", 9).alias("base_score"), F.round("score", 6).alias("score")
    )
