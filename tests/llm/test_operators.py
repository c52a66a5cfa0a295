"""The training-data operators against brute force, on small tables with edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keystrata.llm import bilinear_lm, byte_bpe, cover_tree, jaccard_join, language_id, line_dedup, media_ogg, packing, substring_dedup, url_filter

#: Names that operators use inside, to clash with.
EXTRA = ("id", "cls", "key", "_row")


def texts():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [make(r.randint(60, 200)) for _ in range(12)]
    out = base + [base[0], base[0], base[1] + " tail word", "lead " + base[2]]
    out += [" ".join(base[3].split()[10:75]) + " " + make(30), make(20) + "\n" + base[4][:180] + "\n" + make(15)]
    lines = [make(12) for _ in range(6)]
    out += ["\n".join(lines), "\n".join(x[:5] + "Z" + x[6:] for x in lines), "\n".join([lines[0], "short", lines[0], lines[1] + "!"])]
    out += [None, "", " \n\t ", "a b", "a\tb", "x " * 120, "q" * 1500, "it's 12³ ½ é日本語\n \n  don't!!  ", "word " * 3000]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i, x, ("en", "de", None)[i % 3]) for i, x in enumerate(t)]
    return [*out, (None, t[3], "en"), (200, t[5], "de"), (200, t[5], "de")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in EXTRA:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_text(rows, key):
    return next(t for k, t, _ in rows if k == key)


def collected(df, *cols):
    return sorted((tuple(-1 if v is None else v for v in (r[c] for c in cols)) for r in df.collect()), key=repr)


def test_ogg(docs, rows, nothing, spark):
    got = collected(media_ogg.op1_ogg(docs), "doc_id", "n_bytes", "payload_sha256", "tail_crc32")
    expected = []
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (576 * max(1, -(-len(b) // 576)) - len(b))
        expected.append((-1 if i is None else i, len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(expected, key=repr)
    assert media_ogg.op1_ogg(nothing).count() == 0
    # packets across pages, two interleaved streams, a broken page, noise between pages
    a = media_ogg.page_of(1, 0, 0, b"\xff", b"x" * 255, 2) + media_ogg.page(2, 0, 5, [b"other"], 2) + b"noise" + media_ogg.page_of(1, 1, 9, b"\x05", b"y" * 5, 1)
    s = media_ogg.demux(a)
    assert s[1]["packets"] == [b"x" * 255 + b"y" * 5] and s[2]["packets"] == [b"other"] and media_ogg.packet_times(s[1], 3)[-1] == 3.0
    broken = bytearray(a)
    broken[40] ^= 1
    s = media_ogg.demux(bytes(broken))
    assert s[None]["bad_pages"] == 1 and s[1]["packets"] == [] and s[2]["packets"] == [b"other"]
    broken[14] ^= 1  # a damaged serial number makes no stream
    assert set(media_ogg.demux(bytes(broken))) == {None, 1, 2}
    timed = media_ogg.page(1, 0, 4, [b"a", b"b"], 2) + media_ogg.page(1, 3, 10, [b"c"])
    s = media_ogg.demux(timed)[1]
    assert media_ogg.packet_times(s, 2) == [1.0, 2.0, 5.0] and s["lost"] == 2
    packets = media_ogg.streams_table(media_ogg.encode(spark.createDataFrame([(1, "hello")], "doc_id long, text string"))).collect()
    assert {p.serial for p in packets} == {media_ogg.SAMPLES, media_ogg.NOTES}
    assert max(p.end for p in packets if p.serial == media_ogg.SAMPLES) == 576 / 8000


def test_bpe(docs, rows, nothing):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t, _ in rows:
        ids = tk.encode_ordinary(t or "")
        expected.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collected(byte_bpe.op2_bpe(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert byte_bpe.op2_bpe(nothing).count() == 0


def test_cuts_agree_with_the_pattern():
    import regex

    from keystrata.llm.chunks import Chunks

    find, r = regex.compile(public_tokenizers.PATTERN).findall, random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab1 \n\t\u00a0'!  ") for _ in range(r.randint(0, 14)))
        c = Chunks()
        index = c.split(t) if t else []
        new = c.drain()
        assert [w for i in index for w in find(new[i])] == find(t), repr(t)


def test_split_all_agrees_with_split():
    import pyarrow as pa

    from keystrata.llm.chunks import Chunks

    r = random.Random(2)
    texts = ["".join(r.choice("abab1 \n\t\u00a0'!  ") for _ in range(r.randint(0, 14))) for _ in range(2000)] + [None, "", " ", "a", " a"]
    one, all_, out = Chunks(), Chunks(), []
    for at in range(0, len(texts), 300):
        out += all_.split_all(pa.array(texts[at : at + 300], pa.string()))
    expected = [one.split(t) if t else [] for t in texts]
    a, b = one.drain(), all_.drain()
    assert [[a[i] for i in x] for x in expected] == [[b[i] for i in x] for x in out] and all_.split_all(pa.array([], pa.string())) == []


def test_bpe_states_of_python_and_spark(spark):
    """The fold ends alike from states that a Python worker begins and from those that Spark begins."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = random.Random(5)
    words = [b"", b"a", b" the", "\u00e9\u00f1\u6f22".encode(), b"aaaaaaaa", *(bytes(r.choice(b" etaoinshrd\xc3\xa9") for _ in range(r.randint(1, 40))) for _ in range(200))]
    states = byte_bpe.first_states(words, byte_bpe.byte_pairs(path))
    df = spark.createDataFrame([([list(w) for w in words], states.to_pylist())], "words array<array<int>>, states array<array<bigint>>")
    df = df.select(byte_bpe.encode_words(F.col("words"), path).alias("ids"), byte_bpe.encode_states(F.col("states"), path).alias("states"))
    got = df.select("ids", "states", byte_bpe.decode_states(F.col("states"), path).alias("pieces")).toArrow().combine_chunks()
    ids, lengths = byte_bpe.ids_of(got["states"].chunk(0).flatten())
    expected = [byte_bpe.merge_long(w, byte_bpe.read_ranks(path)) for w in words]
    assert got["ids"].to_pylist()[0] == expected
    assert lengths.tolist() == list(map(len, expected)) and ids.tolist() == [x for e in expected for x in e]
    assert got["pieces"][0].as_py() == b"".join(words)


@pytest.mark.parametrize("listed", [0, 1])
def test_bpe_without_the_list(docs, listed):
    """Words have the same ids from the list and from a block."""
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert collected(byte_bpe.op2_bpe(docs, listed=listed), *cols) == collected(byte_bpe.op2_bpe(docs), *cols)


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard(docs, rows, nothing, block):
    grams = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").encode().split() for _, t, _ in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        if None not in (rows[a][0], rows[b][0]) and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k if k is not None else -1), k if k is not None else -1)
    expected = [(-1 if k is None else k, least[root(i)], links[i]) for i, (k, _, _) in enumerate(rows)]
    assert collected(jaccard_join.op3_jaccard(docs, block=block), "doc_id", "class_id", "n_links") == sorted(expected, key=repr)
    if block == 2:
        assert jaccard_join.op3_jaccard(nothing).count() == 0


@pytest.mark.parametrize("group_rows", [2000, 1])
def test_substring(docs, rows, nothing, group_rows):
    words = [((t or "").encode().split()) for _, t, _ in rows]
    first = {}
    for (k, _, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 49) if k is not None else ():
            g = tuple(w[i : i + 50])
            first[g] = min(first.get(g, k), k)
    expected = []
    for (k, _, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - 49) if k is not None else ():
            if first[tuple(w[i : i + 50])] < k:
                keep[i : i + 50] = [False] * 50
        expected.append((-1 if k is None else k, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest()))
    assert collected(substring_dedup.op4_substring(docs, group_rows=group_rows), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    assert sum(e[2] for e in expected) > 300
    if group_rows == 1:
        assert substring_dedup.op4_substring(nothing).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/x", "https://www.example.com/en/1?q", "ftp://x.net/es/", "http://x.net/fr/#f", "http://x.org/en/1", "http://com", "http://com/", "no scheme", None, "", "x://notcom.com?/en/", "http://spam-farm.org/es/3", "http://spamfarm.org/es/3"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'c' AS key", "'h' AS host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.words) for r in url_filter.op5_urls(df).collect()}
    assert [got[i][:3] for i in range(11)] == [("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("x.net", "/es/", "net/es/"), ("x.net", "/fr/", "net/fr/"), ("x.org", "/en/1", None), ("com", "", None), ("com", "/", "com/"), ("", "", None), ("", "", None), ("", "", None), ("notcom.com", "", None)]
    assert [got[i][3] for i in (0, 1, 2, 3, 6)] == ["block", "allow", "block", "block", "allow"]
    assert got[12][4].startswith("h:spam h:farm") and {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_filter.op5_urls(df.limit(0)).count() == 0


def test_urls_against_brute_force(spark):
    """Naive Bayes in plain Python over the words that segmentation gives; repeated rows and very long urls."""
    r = random.Random(11)
    names = ["spam", "farm", "news", "site", "page", "cats", "dogs", "blog"]
    urls = [f"http://{r.choice(names)}{r.choice(names)}.{r.choice(['net', 'com', 'org'])}/{r.choice(['es', 'en', 'fr'])}/{r.choice(names)}" for _ in range(150)]
    urls += [urls[0], urls[0], "http://long.org/" + "spamfarm/" * 3000, None, "x"]
    got = url_filter.op5_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'c' AS words", "'d' AS row")).collect()
    assert len(got) == len(urls)
    words = {g.page_id: g.words.split() for g in got}
    ruled = {g.page_id: g.verdict for g in got if g.rule}
    counts = {v: Counter(w for k, x in ruled.items() if x == v for w in words[k]) for v in ("block", "allow")}
    docs, seen = Counter(ruled.values()), set(counts["block"]) | set(counts["allow"])
    size = {v: sum(counts[v].values()) + len(seen) + 1 for v in counts}
    for g in got:
        if not g.rule:
            odds = math.log(docs["block"] / docs["allow"]) + sum(math.log((counts["block"][w] + 1) / size["block"]) - math.log((counts["allow"][w] + 1) / size["allow"]) for w in words[g.page_id])
            assert math.isclose(odds, g.log_odds, rel_tol=1e-9, abs_tol=1e-9) and g.verdict == ("block" if odds > 0 else "allow")
    assert {g.verdict for g in got if not g.rule} == {"allow", "block"}
    assert all("h:spam" in words[k] for k, u in enumerate(urls) if u and u.startswith("http://spam"))
    assert len({(g.verdict, g.log_odds) for g in got if g.page_id in (0, 150, 151)}) == 1


def test_urls_keep_all_words(spark):
    long = "abcdefghijklmnopqrstuvwxyzabcd"
    words = ["spam", "farm", "news", "site", "page", "rare", "other"]
    urls = [f"http://{a}.{b}/{c}" for n, a in enumerate(words) for b in ("net", "com", "org") for c in ("es/" + a * (n % 2), "en/" + words[n - 1], "fr/" + a + words[n - 1])]
    urls += [f"http://x.net/es/{long}", f"http://x.org/{long}", f"http://x.org/{long}spam", "http://x.org/spamrarefarm", "http://x.org/zq1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [{r.page_id: (r.verdict, r.words, r.log_odds) for r in url_filter.op5_urls(df, listed=k).collect()} for k in (50_000, 3, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(urls)
    at = len(urls) - 5
    assert [got[0][at + i][1].split()[2:] for i in range(4)] == [["p:es", f"p:{long}"], [f"p:{long}"], [f"p:{long}", "p:spam"], ["p:spam", "p:rare", "p:farm"]]


@pytest.mark.parametrize("ranked", [50_000, 2])
def test_packing(docs, rows, nothing, ranked, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", ranked)  # pieces of one length in many groups
    t = packing._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for k, text, _ in rows:
        ids[k].append(np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    got, places = packing.op6_pack(docs, capacity=256).collect(), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.length == 256 or r.piece == 0
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in got) == total and len(places) <= -(-total // 256) + 1
    assert packing.op6_pack(nothing).count() == 0


def test_bin_completion_is_exact_on_small_cases():
    r = random.Random(5)

    def best(items, capacity):
        out = len(items)

        def go(i, bins):
            nonlocal out
            if len(bins) >= out:
                return
            if i == len(items):
                out = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= capacity:
                    bins[j] += items[i]
                    go(i + 1, bins)
                    bins[j] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return out

    for _ in range(40):
        items = sorted((r.randint(3, 20) for _ in range(8)), reverse=True)
        packed = packing.bin_completion(dict(Counter(items)), 24)
        assert sum(k for _, k in packed) <= best(items, 24) + 0
        assert Counter(v for p, k in packed for v in p for _ in range(k)) == Counter(items)


def test_bin_completion_proves_optima():
    def best(items, capacity):
        least = {0: (1, 0)}  # set of packed pieces: bins and the level of the last
        for m in range(1 << len(items)):
            bins, level = least[m]
            for i, size in enumerate(items):
                if not m >> i & 1:
                    new = (bins, level + size) if level + size <= capacity else (bins + 1, size)
                    least[m | 1 << i] = min(new, least.get(m | 1 << i, (99, 0)))
        return least[(1 << len(items)) - 1][0]

    assert sum(k for _, k in packing.bin_completion(Counter([2, 5, 6, 6, 8, 9, 10, 10, 11, 11, 12]), 30)) == 3
    r = random.Random(1)
    for _ in range(400):
        capacity = r.choice([24, 30, 50])
        items = [r.randint(2, capacity // 2) for _ in range(r.randint(7, 10))]
        assert sum(k for _, k in packing.bin_completion(Counter(items), capacity)) == best(items, capacity), (capacity, items)


def test_fillings_of_many_pieces():
    assert sum(k for _, k in packing.bin_completion({410: 1500, 409: 1000})) == 500
    r = random.Random(7)
    for _ in range(60):
        items, room = sorted((r.randint(1, 9) for _ in range(7)), reverse=True), 24
        n = np.bincount(items, minlength=room + 1)
        found = list(packing.fillings(n, room))
        every = {c for k in range(8) for c in combinations(items, k) if sum(c) <= room}
        assert {f for f, _ in found} == every and len(found) == len(every)
        assert [sum(f) for f, _ in found] == sorted(map(sum, every), reverse=True)
        for f, good in found:
            over = list((Counter(items) - Counter(f)).elements())
            parts = [c for k in range(1, len(f) + 1) for c in combinations(f, k)]
            assert good != any(sum(c) <= x <= sum(c) + room - sum(f) and c != (x,) for x in over for c in parts) if f else True


def test_edit_distance():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(6)
    for _ in range(5000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        for k in (1, 2, 3):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


@pytest.mark.parametrize("few", [64, 1])
def test_lines(docs, rows, nothing, few):
    first = {}
    for k, t, _ in rows:
        for at, line in line_dedup.long_lines(t, 24) if k is not None else ():
            first[line] = min(first.get(line, (k, at)), (k, at))
    late = {a for a in first for b in first if first[b] < first[a] and line_dedup.within(a, b, 2)}
    expected = []
    for k, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        gone = {at for at, x in line_dedup.long_lines(t, 24) if x in late or first[x] != (k, at)} if k is not None else set()
        expected.append((-1 if k is None else k, len(lines), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest()))
    assert late
    assert collected(line_dedup.op7_lines(docs, few=few, block=2), "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    if few == 1:
        assert line_dedup.op7_lines(nothing).count() == 0


@pytest.mark.parametrize("few", [64, 1])
def test_short_lines(spark, few):
    r = random.Random(9)
    lines = ["".join(r.choice("ab") for _ in range(n)) for n in range(1, 12) for _ in range(3)]
    for n in (11, 12, 13, 17, 22, 23, 24, 25, 26):
        x = "".join(r.choice("abcdefgh") for _ in range(n))
        lines += [x, x[:3] + "Z" + x[4:], x[:5] + x[6:], "Z" + x, "ZY" + x, x[:-2], x[2:7] + "Q" + x[7:]]
    r.shuffle(lines)
    rows = [(i, "\n".join([*lines[3 * i : 3 * i + 3], "", " page ", "page"])) for i in range(len(lines) // 3 + 1)]
    first = {}
    for k, t in rows:
        for at, line in enumerate(map(str.strip, t.split("\n"))):
            first.setdefault(line, (k, at))
    near = lambda a, b: line_dedup.within(a, b, min(2, min(len(a), len(b)) // 12))
    late = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    expected = []
    for k, t in rows:
        kept = [x for at, x in enumerate(t.split("\n")) if not x.strip() or x.strip() not in late and first[x.strip()] == (k, at)]
        expected.append((k, t.count("\n") + 1, t.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sum(len(x) < 24 for x in late) > 10
    got = collected(line_dedup.op7_lines(spark.createDataFrame(rows, "doc_id long, text string"), few=few, block=2), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == sorted(expected, key=repr)


def test_texts_travel_once(spark, monkeypatch):
    seen, whole = [], line_dedup.map_arrow
    monkeypatch.setattr(line_dedup, "map_arrow", lambda df, *a, **k: seen.append(df.schema) or whole(df, *a, **k))
    line = "a line of more than twenty-four characters"
    df = spark.createDataFrame([("x", 1, line + "\nanother", 0), ("y", 2, "first\n" + line, 1)], "source string, doc_id long, text string, n long")
    out = line_dedup.line_dedup(df)
    assert seen[-1]["_row"].dataType.names == ["source", "doc_id", "n"]
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [("x", 1, line + "\nanother", 0), ("y", 2, "first", 1)]


@pytest.mark.parametrize("block", [None, 60, 9])
def test_embeddings(spark, block):
    r = np.random.default_rng(0)
    base = r.normal(size=(30, 16))
    rows = [(3 * i, (base[i % 30] + r.normal(size=16) * [0.02, 0.15, 0.3][i % 3]).tolist()) for i in range(300)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16), (9005, []), (9006, rows[0][1]), (9007, rows[0][1][:8]), (9008, rows[1][1][:8]), (None, [1.0] * 16)]
    good = [(i, cover_tree._unit(v)) for i, v in rows]
    good = [(i, u) for i, u in good if u is not None and i is not None]
    linked = np.array([[len(u) == len(v) and u @ v >= 0.95 for _, v in good] for _, u in good])
    np.fill_diagonal(linked, False)
    root = np.array([i for i, _ in good])
    count = dict(zip(root.tolist(), linked.sum(1).tolist(), strict=True))
    ids = root.tolist()
    while not (root == (least := np.minimum(root, np.where(linked, root[None, :], 1 << 60).min(1)))).all():
        root = least
    component = dict(zip(ids, root.tolist(), strict=True))
    expected = [(-1 if i is None else i, count.get(i, 0), -1 if i is None else component.get(i, i)) for i, _ in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS dims")
    assert collected(cover_tree.op8_embeddings(df, block=block), "vec_id", "n_links", "component_id") == sorted(expected, key=repr)
    if block == 60:
        assert cover_tree.op8_embeddings(df.limit(0)).count() == 0
        again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
        assert collected(cover_tree.op8_embeddings(again), "vec_id", "component_id") == [(1, 1), (1, 1), (2, 1), (3, 1)]  # rows of one id are one vector


def test_vectors_visit_only_nodes_in_reach(spark):
    """With ten times the clusters, vectors are sent to no more blocks each."""
    r = np.random.default_rng(5)
    sent = []
    for n in (20, 200):
        x = r.normal(size=(n, 32))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        units = np.concatenate([c + r.normal(size=(40, 32)) * 0.005 for c in x])
        units /= np.sqrt((units * units).sum(1, keepdims=True))
        top = cover_tree.Top(units[r.permutation(len(units))], n)
        far = top.distances(units)
        for node in range(len(top.points)):
            mine = far.argmin(1) == node
            top.cover(node, far.min(1)[mine].max(), int(mine.sum()), 1000)
        reached = top.reached(units, math.sqrt(0.1))
        linked = units @ units.T >= 0.95
        assert all(reached[i, far[j].argmin()] for i, j in zip(*np.nonzero(linked), strict=True))
        sent.append(reached.sum(1).mean())
    assert sent[1] < 2 * sent[0] < 6


def test_language(spark, nothing):
    r = random.Random(8)
    parts = {"en": ["the", "ing", "and", "tion", "er"], "de": ["sch", "ung", "der", "ein", "ich"], "es": ["cion", "que", "ado", "los", "ar"]}
    rows = []
    for i in range(240):
        g = ("en", "de", "es")[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 3))) for _ in range(40)), g))
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 !!", "es"), (903, "the and", None)]
    got = {x.doc_id: x for x in language_id.op9_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, x in got.items() if x.held_out} == set(held)
    known = {i: g for i, _, g in rows[:240]}
    assert sum(got[i].lang_pred == known[i] for i in held if i in known) >= 0.97 * sum(i in known for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= x.score <= 1 for x in got.values())
    assert language_id.op9_language(nothing).count() == 0


def test_language_against_brute_force(spark):
    """Also with repeated rows, ties, long texts and clashing columns."""
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts())] + [(300, "qqq qqq", "aa"), (300, "qqq qqq", "aa"), (302, "qqq qqq", "bb"), (303, "ab " * 40_000, "en")]
    _, base = language_id._vectors()
    symbols = language_id._symbols()

    def profile(text):
        s = [int(symbols[ord(c)]) for c in (text or "").lower()]
        s = [0, *s, 0]
        s = [x for i, x in enumerate(s) if i == 0 or x or s[i - 1]]
        grams = Counter(zip(s, s[1:], s[2:], strict=False))
        if not grams:
            return None
        v = sum(n * (np.roll(base[a], 2).astype(float) * np.roll(base[b], 1) * base[c]) for (a, b, c), n in grams.items())
        return v / np.sqrt(v @ v) if v.any() else v

    def is_held(k):
        return zlib.crc32(str(k).encode()) % 4 == 2

    sums = defaultdict(lambda: 0)
    for k, t, g in rows:
        p = profile(t)
        if p is not None and g is not None and not is_held(k):
            sums[g] = sums[g] + np.rint(p * (1 << 20))
    names = sorted(sums)
    protos = np.array([sums[g] / np.sqrt(sums[g] @ sums[g]) for g in names])
    expected = []
    for k, t, _ in rows:
        p = profile(t)
        cos = None if p is None else protos @ p
        expected.append((k, is_held(k), "und" if cos is None else names[int(np.argmax(cos.round(9)))], 0.0 if cos is None else round(min(1, max(0, cos.max())), 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "'y' AS held_out").repartition(3)
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 5)) for r in language_id.op9_language(df).collect()]
    assert sorted(got) == sorted(expected)
    assert {e[2] for e in expected if e[0] >= 300} >= {"aa"}  # equal prototypes: the smaller name
    kept = language_id.keep_languages(df.withColumn("row", F.lit(1)))
    assert kept.columns == [*df.columns, "row"] and kept.where("text IS NULL OR text = ''").isEmpty()


def test_lm(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(bilinear_lm, "LISTED", 100)
    counts = Counter()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    for k, t, _ in rows:
        if not held(k):
            counts.update(bilinear_lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for k, t, _ in rows:
        w = bilinear_lm.tokens(t)
        expected.append((-1 if k is None else k, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = bilinear_lm.op10_lm(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score < 0 and r.held_out == held(r.doc_id) for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[rows_text(rows, r.doc_id)].add((r.base_score, r.score))
    for same in by_text.values():  # up to single precision
        assert len({b for b, _ in same}) == 1 and np.ptp([x for _, x in same]) <= 1e-5 * max(1, *(-x for _, x in same))
    assert bilinear_lm.op10_lm(nothing).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(1, 1000, 200), rng.integers(0, 50, bilinear_lm.BUCKETS)]).astype(float)
    model = bilinear_lm.Model(counts)
    for name, p in model.params.items():
        p += rng.normal(0, 0.3, p.shape)
    size = len(counts)
    assert sorted(model.place) == list(range(size)) and (model.of_place[model.place] == model.of).all()
    for context in ((3, 7), (size, size), (size - 1, 0)):
        before = np.tile(np.array(context, np.int32)[:, None], (1, size))
        assert np.isclose(np.exp(model.log_probs(np.arange(size), before)).sum(), 1, atol=1e-4)


def test_lm_learns_from_both_contexts():
    """Tokens depend on the sum of the two before them; sampled noise is enough to find that."""
    rng = np.random.default_rng(2)
    words, n = 12, 60_000
    seq = rng.integers(0, words, n)
    for i in range(2, n):
        if rng.random() < 0.8:
            seq[i] = (3 * (seq[i - 1] % 3) + seq[i - 2] % 3) % words
    counts = np.concatenate([np.bincount(seq, minlength=words), [1], np.zeros(bilinear_lm.BUCKETS)]).astype(float)
    model = bilinear_lm.Model(counts)
    before = np.stack([np.roll(seq, 1), np.roll(seq, 2)]).astype(np.int32)
    was = model.log_probs(seq, before).mean()
    trainer = bilinear_lm.Trainer(model, 0)
    for _ in range(8):
        for at in range(2, n, 500):
            trainer.step(seq[at : at + 500], before[:, at : at + 500])
    for name, rows, met, add in trainer.changes():
        model.params[name][rows] += add / met[:, None]
    assert model.log_probs(seq, before).mean() > was + 0.6


def test_lm_gains_on_held_out_texts(spark):
    r = random.Random(3)
    after = {w: r.sample(range(400), 4) for w in range(400)}
    rows = []
    for i in range(600):
        w, words = r.randrange(400), []
        for _ in range(150):
            w = r.choice(after[w]) if r.random() < 0.9 else r.randrange(400)
            words.append(f"w{w}")
        rows.append((i, " ".join(words)))
    got = bilinear_lm.op10_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.2 * got[2]


def test_lm_takes_every_token_once_at_any_size(spark):
    """What a round learns from texts does not depend on how many tokens the corpus has."""
    r = np.random.default_rng(4)
    texts = [r.integers(0, 9, 500).astype(np.int32) for _ in range(8)]
    read = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "symbols binary").coalesce(1)
    got = []
    for total in (1_000, 100_000_000):
        lexicon = bilinear_lm.Lexicon([(b"w%d" % i, 500) for i in range(9)], 8, 4508, 10)
        model = bilinear_lm.Model(np.append(np.full(9, 500.0), np.zeros(1 + bilinear_lm.BUCKETS)))
        start, lexicon.total = model.params["t"].copy(), total
        bilinear_lm.train_round(read, lexicon, model, 0)
        assert not np.array_equal(model.params["t"], start)
        got.append(model.params)
    assert all(np.array_equal(got[0][k], got[1][k]) for k in got[0])


class _Rows(np.ndarray):
    """An array that refuses to be read by an array of row numbers, which costs more than ``take``."""

    def __getitem__(self, key):
        assert not any(isinstance(k, np.ndarray) for k in (key if isinstance(key, tuple) else (key,)))
        return np.asarray(self)[key]


def test_lm_takes_rows_in_training():
    rng = np.random.default_rng(1)
    model = bilinear_lm.Model(rng.integers(1, 100, 500 + bilinear_lm.BUCKETS).astype(float))
    plain, guarded = bilinear_lm.Trainer(model, 3), bilinear_lm.Trainer(model, 3)
    guarded.p, guarded.sums = ({k: v.view(_Rows) for k, v in x.items()} for x in (guarded.p, guarded.sums))
    for _ in range(3):
        targets, before = rng.integers(0, 500, 256), rng.integers(0, 500, (2, 256))
        plain.step(targets, before)
        guarded.step(targets, before)
    assert all(np.array_equal(plain.p[k], np.asarray(guarded.p[k])) for k in plain.p)


def test_pipeline(spark, docs, rows):
    out = docs.select("doc_id", "text", "lang")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == ["doc_id", "text", "lang"]
        out = spark.createDataFrame(out.collect(), "doc_id long, text string, lang string")
        kept.append({r.doc_id: r.text for r in out.collect()})
    letters = {k for k, t, _ in rows if t and any(c.isalpha() for c in t)}
    # two long texts of one word are like no language learned
    assert set(kept[0]) == letters - {26, 29} and set(kept[1]) == set(kept[0])
    assert kept[1][12] == kept[1][13] == "" and kept[1][0]  # copies of document 0 lose their line
    assert kept[1].keys() - kept[2].keys() == {14, 15, 25}  # near copies of 1 and 2, the words of 24
    packed = corpus_pipeline.STAGES[-1][1](spark, out, "").collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_pipeline_of_nothing_and_of_clashing_columns(spark, nothing, docs):
    out = nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == nothing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:  # columns that operators name inside are carried along
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.where("id <> 'x' OR cls <> 'x' OR key <> 'x' OR _row <> 'x'").isEmpty(), name


def test_pipeline_without_languages(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()] == [1]
