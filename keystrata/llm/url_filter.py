"""Operator 5: URL filters by rules, word segmentation and naive Bayes.

Rules (host, path prefix) decide first; the longest rule that fits wins. For
the other urls, host and path labels are split into words by unigram Viterbi
segmentation (listed words that others make up are no words), and a multinomial naive Bayes model, learned from the urls that
rules decide, scores the words.

Edge cases: a null url or one without ``://`` has an empty host and path, no
rule, and the verdict of the model's prior. Without any url that a rule
decides, the verdict is ``allow``. Repeated rows are judged alike. All letter
runs of all urls are words with counts, and naive Bayes counts them all. The
``listed`` most frequent are held in memory and broadcast; the rest is met by
joins, with the same results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, persist

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LISTED = 50_000
UNKNOWN = "<unk>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; nulls where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


class Segmenter:
    """Viterbi segmentation by word counts; runs outside the words are one unknown word.

    Holds the listed words; ``late`` gives the others that a run holds.
    """

    def __init__(self, listed: dict[str, int], total: int, lengths: list[int]):
        self.listed, self.total, self.lengths = listed, max(1, total), sorted(lengths, reverse=True)

    def others(self, run: str) -> set[str]:
        """Parts of the run, as long as some word, that are not listed."""
        parts = {run[i : i + n] for n in self.lengths for i in range(len(run) - n + 1)}
        return {x for x in parts if x not in self.listed}

    def compound(self, word: str, late: dict[str, int]) -> bool:
        """Whether other words of at least three letters make up the word."""
        reach = {0}
        for j in range(3, len(word) + 1):
            for n in self.lengths:
                if 3 <= n <= j and n < len(word) and j - n in reach and (word[j - n : j] in self.listed or word[j - n : j] in late):
                    reach.add(j)
                    break
        return len(word) in reach

    def split(self, run: str, late: dict[str, int]) -> list[str]:
        best, back = [0.0], [0]
        unknown = -math.log(self.total) - 10.0
        for j in range(1, len(run) + 1):
            score, at = best[j - 1] + unknown, -(j - 1) - 1
            for n in self.lengths:
                if n > j:
                    continue
                k = self.listed.get(run[j - n : j]) or late.get(run[j - n : j])
                if k and best[j - n] + math.log(k / self.total) > score:
                    score, at = best[j - n] + math.log(k / self.total), j - n
            best.append(score)
            back.append(at)
        out, j = [], len(run)
        while j:
            i = back[j]
            if i < 0:
                i = -i - 1
                if not out or out[-1] != UNKNOWN:
                    out.append(UNKNOWN)
            else:
                out.append(run[i:j])
            j = i
        return out[::-1]


def _met(left: DataFrame, right: DataFrame, key: str, order: str, listed: int) -> DataFrame:
    """The inner join by ``key``, unique in ``right``; its ``listed`` rows of most ``order`` are broadcast."""
    top = right.orderBy(F.desc(order), key).limit(listed)
    if right.count() <= listed:
        return left.join(F.broadcast(right), key)
    top = persist(top, "top")
    rest = left.join(F.broadcast(top.select(key)), key, "left_anti").join(right, key)
    return left.join(F.broadcast(top), key).unionByName(rest)


def _runs(part: str) -> Column:
    return F.regexp_extract_all(F.lower(part), F.lit("([a-z]+)"))


def split_runs(counts: DataFrame, listed: int) -> DataFrame:
    """``run, n, words``: the words of each distinct run of letters."""
    size = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lengths = [r[0] for r in counts.select(F.length("run")).distinct().collect()]
    known = Segmenter({r.run: r.n for r in counts.orderBy(F.desc("n"), "run").limit(listed).collect()}, size[1], lengths)

    def others(batch):
        pairs = [(r, x) for r in batch.column(0).to_pylist() for x in sorted(known.others(r))]
        return {"run": [r for r, _ in pairs], "part": [x for _, x in pairs]}

    late = None
    if size[0] > listed:
        late = map_arrow(counts.select("run"), others, "run string, part string").join(counts.select(F.col("run").alias("part"), F.col("n").alias("k")), "part")
        late = persist(late.select("run", "part", "k"), "parts")

    def with_late(parts):
        if parts is None:
            return counts.select("run", "n", F.lit(None).cast("array<struct<part:string,k:bigint>>").alias("late"))
        return counts.join(parts.groupBy("run").agg(F.collect_list(F.struct("part", "k")).alias("late")), "run", "left").select("run", "n", "late")

    def read(batch):
        for r, late in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            yield r, {x["part"]: x["k"] for x in late or ()}

    def simple(batch):
        return {"run": batch.column(0), "n": batch.column(1), "simple": [not known.compound(r, x) for r, x in read(batch)]}

    words = persist(map_arrow(with_late(late), simple, "run string, n long, simple boolean"), "words").where("simple")
    top = counts.orderBy(F.desc("n"), "run").limit(listed)
    model = Segmenter({r.run: r.n for r in words.join(top.select("run"), "run", "left_semi").collect()}, size[1], lengths)
    late = None if late is None else late.join(words.select(F.col("run").alias("part")), "part", "left_semi")

    def split(batch):
        return {"run": batch.column(0), "n": batch.column(1), "words": [model.split(r, x) for r, x in read(batch)]}

    return persist(map_arrow(with_late(late), split, "run string, n long, words array<string>"), "splits")


def op5_urls(df: DataFrame, url: str = "url", id_col: str = "page_id", rules=RULES, listed: int = LISTED) -> DataFrame:
    """``id_col, host, path, rule, verdict, words, log_odds``: every url judged."""
    urls = df.select(F.col(id_col).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    urls = persist(urls.select(F.monotonically_increasing_id().alias("row"), "*", rule.alias("rule"), verdict.alias("ruled")), "urls")
    # host words are marked, so that the two parts are scored apart
    found = [F.arrays_zip(F.array_repeat(F.lit(m), F.size(x)).alias("mark"), x.alias("run")) for m, x in (("h:", _runs("host")), ("p:", _runs("path")))]
    runs = urls.select("row", F.posexplode(F.concat(*found)).alias("pos", "r")).select("row", "pos", "r.mark", "r.run")
    counts = persist(runs.groupBy("run").agg(F.count("*").alias("n")), "runs")
    split = _met(runs, split_runs(counts, listed), "run", "n", listed)
    split = split.select("row", "pos", F.transform("words", lambda w: F.concat("mark", w)).alias("words")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w"))
    none = F.array().cast("array<string>")
    urls = persist(urls.join(split.select("row", F.flatten(F.transform("w", lambda x: x["words"])).alias("words")), "row", "left").withColumn("words", F.coalesce("words", none)), "split")

    # naive Bayes with add-one smoothing over verdicts, from all urls that rules decide
    docs = {r.ruled: r["count"] for r in urls.where("ruled IS NOT NULL").groupBy("ruled").count().collect()}
    of = {v: F.coalesce(F.sum((F.col("ruled") == v).cast("long")), F.lit(0)) for v in ("block", "allow")}
    seen = urls.where("ruled IS NOT NULL").select("ruled", F.explode("words").alias("word")).groupBy("word").agg(*(c.alias(v) for v, c in of.items()))
    seen = persist(seen.withColumn("n", F.col("block") + F.col("allow")), "bayes")
    if len(docs) < 2:  # a verdict was never seen
        odds = F.lit(1.0 if "block" in docs else -1.0)
    else:
        t = seen.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in of)).first()
        unseen = math.log(t.allow + t.v + 1) - math.log(t.block + t.v + 1)
        gain = F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0)
        gains = _met(urls.select("row", F.explode("words").alias("word")), seen.select("word", "n", gain.alias("gain")), "word", "n", listed)
        gains = gains.groupBy("row").agg(F.array_sort(F.collect_list("gain")).alias("gains"))  # summed in order, so that equal urls have equal odds
        urls = urls.join(gains, "row", "left")
        odds = F.lit(math.log(docs["block"]) - math.log(docs["allow"])) + F.size("words") * unseen + F.coalesce(F.aggregate("gains", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    out = urls.withColumn("log_odds", odds)
    judged = F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select(F.col("key").alias(id_col), "host", "path", "rule", judged.alias("verdict"), F.concat_ws(" ", "words").alias("words"), "log_odds")
