"""Operator 9: language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds the first
letter's vector rolled twice, the second's rolled once and the third's. A
text bundles (adds) its trigrams; a language bundles the texts of its training
documents, each with length 1. The language whose prototype has the largest
cosine with the text wins, ties going to the smaller name.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text where nothing could be learned. Null languages are not learned.
Scores are cosines cut at 0. Sums are of integers, hence the same in any order.
Texts of any length are read whole. Repeated rows are learned as often as they
occur and predicted alike; an empty table gives no rows; columns besides the
three named have no influence, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

DIMENSIONS = 512
LETTERS = 48
MAX_LANGUAGES = 2000
FLOOR, LEAST = 0.09, 64
_SCALE = 1 << 20


@cache
def _symbols() -> np.ndarray:
    """A symbol for each code point: 0 for no letter, 1 to 26 for a to z, others hashed."""
    points = np.arange(0x110000, dtype=np.uint64)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    out = np.where(letter, 27 + ((points * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(LETTERS - 27), 0).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


@cache
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Bound vectors of the first two letters of a trigram, and those of the third."""
    base = np.random.default_rng(9).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
    first, second = np.roll(base, 2, 1), np.roll(base, 1, 1)
    return (first[:, None, :] * second[None, :, :]).reshape(LETTERS * LETTERS, DIMENSIONS), base


def letters(text: str | None) -> int:
    return int(np.count_nonzero(_symbols()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]))


def profile(text: str | None) -> np.ndarray | None:
    """The text's bundle with length 1; None without any letter."""
    s = _symbols()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 3:
        return None
    grams = (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]
    if len(grams) > 20_000:
        n = np.bincount(grams, minlength=LETTERS**3)
        grams = np.flatnonzero(n)
        n = n[grams]
    else:
        grams, n = np.unique(grams, return_counts=True)
    pairs, base = _vectors()
    total = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(grams), 4096):
        g = grams[at : at + 4096]
        total += n[at : at + 4096].astype(np.float32) @ (pairs[g // LETTERS] * base[g % LETTERS]).astype(np.float32)
    length = float(np.sqrt(total @ total))
    return total / length if length else total


def fit(df: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Names and prototypes (rows of length 1) from all rows of ``df``."""

    def run(batch):
        sums: dict[str, np.ndarray] = {}
        for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = profile(t)
            if p is not None:
                sums[g] = sums.get(g, 0) + np.rint(p * _SCALE).astype(np.int64)
        return {"lang": list(sums), "v": [v.tolist() for v in sums.values()]}

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    sums = map_arrow(rows, run, "lang string, v array<long>", text).select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    table = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v")).orderBy("lang").take(MAX_LANGUAGES + 1)
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    protos = np.array([r.v for r in table], np.float64).reshape(len(table), DIMENSIONS)
    return [r.lang for r in table], protos / np.maximum(np.sqrt((protos * protos).sum(1, keepdims=True)), 1e-9)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def predict(df: DataFrame, text: str, names: list[str], protos: np.ndarray) -> DataFrame:
    """The columns of ``df``, ``lang_pred`` and ``score``."""
    keep = df.columns
    at = keep.index(text)

    def run(batch):
        pred, score = [], []
        for t in batch.column(at).to_pylist():
            p = profile(t) if names else None
            cos = protos @ p if p is not None else None
            k = int(np.argmax(cos)) if cos is not None else 0
            pred.append("und" if cos is None else names[k])
            score.append(0.0 if cos is None else float(min(1.0, max(0.0, cos[k]))))
        return {c: batch.column(i) for i, c in enumerate(keep)} | {"lang_pred": pred, "score": score}

    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + ["lang_pred string", "score double"])
    return map_arrow(df, run, schema, text)


def keep_languages(df: DataFrame, text: str = "text", lang: str = "lang", floor: float = FLOOR, least: int = LEAST) -> DataFrame:
    """The rows of ``df`` in which a language is found, with its columns.

    Profiles are learned from all rows with a language. A text without a letter
    goes, and so does one of at least ``least`` letters whose best cosine is below
    ``floor``, which is twice what unrelated profiles have by chance. Shorter texts
    say too little for that and stay. Where nothing could be learned, every text
    with a letter stays.
    """
    names, protos = fit(df, text, lang)
    at = df.columns.index(text)

    def run(batch):
        keep = []
        for t in batch.column(at).to_pylist():
            p = profile(t)
            keep.append(p is not None and (not names or letters(t) < least or float((protos @ p).max()) >= floor))
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(df, run, df.schema, text)


def op9_language(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every document."""
    names, protos = fit(df.where(~held_out(id_col, folds, fold)), text, lang)
    out = predict(df.select(id_col, text), text, names, protos)
    return out.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "lang_pred", "score")
