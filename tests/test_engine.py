"""The key-value engine: views, keyspace, compaction, codecs."""

import bisect
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from keystrata import config
from keystrata.functions import bloom, codecs
from keystrata.keyspace import Keyspace
from keystrata.operators import membership, view
from keystrata.plans import compaction
from keystrata.sources.manifest import Run, Version
from keystrata.streaming import ingest

LOG = "key binary, value binary, op string, seq long"


def log(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), o, s) for k, v, o, s in rows], LOG)


def keyspace(spark, tmp_path, **options):
    return Keyspace(spark, config.Config(str(tmp_path / "ks"), auto_compact=False, **options))


def items(ks):
    return {bytes(r["key"]): bytes(r["value"]) for r in ks.items().collect()}


def test_order_and_newest(spark):
    keys = [b"", b"a", b"a\0", b"\x7f", b"\x80", b"\xff", b"\xff" * 101]
    rows = [(k, b"old", "P", i) for i, k in enumerate(keys)] + [(k, b"new", "P", 100 + i) for i, k in enumerate(keys)]
    got = view.range_scan(log(spark, rows)).collect()
    assert [bytes(r["key"]) for r in got] == keys and {bytes(r["value"]) for r in got} == {b"new"}


def test_range_is_half_open_and_pushed_down(spark, tmp_path):
    rows = [(b"key%03d" % i, b"v", "P", i) for i in range(100)]
    df = log(spark, rows)
    assert view.range_scan(df, bytearray(b"key020"), bytearray(b"key030")).count() == 10
    assert view.range_scan(df, bytearray(b"key020"), bytearray(b"key030"), end_inclusive=True).count() == 11
    df.write.parquet(str(tmp_path / "log"))
    plan = view.range_scan(spark.read.parquet(str(tmp_path / "log")), bytearray(b"key020"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan


def test_tombstones_hide_after_flush(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    ks.put("key1", "value1")
    ks.put("key2", "value2")
    ks.flush()
    ks.delete("key1")
    ks.flush()
    assert ks.get("key1") is None and ks.get("key2") == b"value2" and items(ks) == {b"key2": b"value2"}


def test_reopen_keeps_numbers_and_staged_rows(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    ks.put("a", "1")
    ks.flush()
    ks.put("b", "2")  # staged only
    again = keyspace(spark, tmp_path)
    assert items(again) == {b"a": b"1", b"b": b"2"}
    again.put("a", "3")
    again.flush()
    third = keyspace(spark, tmp_path)
    assert items(third) == {b"a": b"3", b"b": b"2"}
    assert len({r.run_id for r in third.version.runs}) == len(third.version.runs) == 2


def test_empty_values(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    ks.put("a", "")
    assert ks.get("a") is None
    ks = Keyspace(spark, config.Config(str(tmp_path / "other"), empty_is_tombstone=False, auto_compact=False))
    ks.put("a", "")
    assert ks.get("a") == b""


def test_batches(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    twice = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, pos int")
    with pytest.raises(ValueError):
        ks.write_batch(twice)
    ks.write_batch(twice, "pos")
    assert ks.get("k") == b"2"


def test_model(spark, tmp_path):
    r, model = random.Random(7), {}
    ks = keyspace(spark, tmp_path)
    for step in range(6):
        rows = []
        for pos in range(12):
            k = b"k%02d" % r.randrange(15)
            v = None if r.random() < 0.3 else b"v%d-%d" % (step, pos)
            rows.append((bytearray(k), None if v is None else bytearray(v), "D" if v is None else "P", pos))
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        ks.write_batch(spark.createDataFrame(rows, "key binary, value binary, op string, pos int"), "pos")
        if step % 2:
            ks.flush()
        if step in (3, 5):
            assert ks.compact(force=True)
        if step == 4:
            ks = keyspace(spark, tmp_path)
        assert items(ks) == model, step
    before = items(ks)
    ks.vacuum()
    assert items(ks) == before


def test_compaction_keeps_deep_keys_and_drops_tombstones_at_the_bottom(spark):
    rows = log(spark, [(b"a", b"old", "P", 1), (b"b", b"deep", "P", 2), (b"a", None, "D", 3)])
    assert {bytes(r["key"]): r["op"] for r in compaction.merge(rows, False).collect()} == {b"a": "D", b"b": "P"}
    assert [bytes(r["key"]) for r in compaction.merge(rows, True).collect()] == [b"b"]


def test_pick():
    run = lambda i, level, a, b: Run(i, level, f"p{i}", 1, 10, a.encode().hex(), b.encode().hex(), 1, 1)
    v = Version(runs=tuple(run(i, 0, "a", "m") for i in range(4)) + (run(9, 1, "b", "c"), run(10, 1, "x", "z"), run(11, 2, "a", "b")))
    job = compaction.pick(v, config.Config())
    assert [r.run_id for r in job.inputs] == [0, 1, 2, 3, 9] and job.target == 1 and not job.bottom
    assert compaction.pick(Version(), config.Config(), force=True) is None


def test_corrupt_run_raises(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    ks.put("a", "1")
    ks.flush()
    import glob

    for f in glob.glob(f"{ks.version.runs[0].path}/part-*"):
        with open(f, "wb") as out:
            out.write(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        Keyspace(spark, ks.config).get("a")


def test_seek_neighbours_and_multi_get(spark):
    df = log(spark, [(b"k%03d" % (2 * i), b"v", "P", i) for i in range(50)]).select(F.decode("key", "UTF-8").alias("key"), "value", "op", "seq")
    got = {r["probe"]: r["key"] for r in view.seek(df, spark.createDataFrame([("k000",), ("k011",), ("k099",)], "probe string")).collect()}
    assert got == {"k000": "k000", "k011": "k012", "k099": None}
    n = {r["key"]: (r["prev_key"], r["next_key"]) for r in view.neighbours(df).collect()}
    assert n["k010"] == ("k008", "k012") and n["k000"][0] is None and n["k098"][1] is None


def test_bloom(spark):
    assert [(bloom.bits_per_key(p), bloom.hash_count(bloom.bits_per_key(p))) for p in (0.1, 0.01, 0.001)] == [(6, 4), (13, 9), (20, 13)]
    keys = spark.range(2000).select(F.format_string("key%05d", "id").alias("key"))
    members = keys.limit(1000)
    sketch = membership.sketch_for(spark, members, 1000, 0.01)
    assert sketch.might_contain(members).count() == 1000
    others = spark.range(1000).select(F.format_string("nonexistent%05d", "id").alias("key"))
    assert sketch.might_contain(others).count() < 50
    assert 0 < sketch.fill_ratio().first()[0] < 0.7


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 1 << 40]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")

    def leb(n):
        out = ""
        while True:
            out += f"{n & 127 | (128 if n > 127 else 0):02X}"
            n >>= 7
            if not n:
                return out

    assert [r[0] for r in df.select(codecs.varint_hex(F.col("n"))).collect()] == [leb(n) for n in numbers]
    assert [r[0] for r in df.select(codecs.varint_decode(codecs.varint_hex(F.col("n")))).collect()] == numbers
    texts = spark.createDataFrame([("", "run_12.sst"), ("é", "x"), (None, None)], "t string, f string")
    assert [r[0] for r in texts.select(codecs.byte_sum(F.col("t"))).collect()] == [0, 0xC3 + 0xA9, None]
    assert [r[0] for r in texts.select(codecs.file_number(F.col("f"))).collect()] == [12, None, None]
    assert df.select(codecs.human_size(F.col("n"))).collect()[4][0] == "300.00 B"


def test_config():
    c = config.Config("/tmp/x/")
    assert c.path == "/tmp/x" and [c.level_max_bytes(n) // config.MB for n in range(3)] == [4, 40, 400]
    assert [c.level_file_bytes(n) // config.MB for n in range(4)] == [1, 1, 10, 100]
    with pytest.warns(UserWarning):
        assert config.Config.from_dict({"bloom_fpr": 0.5, "odd": 1}).bloom_fpr == 0.5
    assert not config.range_scans().bloom and math.isclose(config.point_lookup().bloom_fpr, 0.001)


def test_varint_query_keeps_large_keys(spark, tmp_path):
    from keystrata import catalog

    numbers = [0, 127, 128, 2097151, 2097152, 1 << 40, (1 << 63) - 1]
    spark.createDataFrame([(n,) for n in numbers], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: bytes.fromhex(r.varint) for r in catalog.QUERIES["kv_varint"](spark, str(tmp_path)).collect()}
    assert set(got) == set(numbers)
    for n, b in got.items():
        assert sum((x & 127) << 7 * i for i, x in enumerate(b)) == n
        assert all(x > 127 for x in b[:-1]) and b[-1] < 128 and len(b) == max(1, -(-n.bit_length() // 7))


def test_shared_prefix_has_no_limit(spark, tmp_path):
    from os.path import commonprefix

    from keystrata import catalog

    pairs = [("", ""), ("a", ""), ("ab", "abc"), ("abc", "abc"), ("éé日x", "éé日y"), ("𝄞a", "𝄞b"), ("x" * 5000 + "a", "x" * 5000 + "b"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(codecs.shared_prefix(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [len(commonprefix([a, b])) if a is not None else 0 for a, b in pairs]
    urls = sorted(f"https://h.example/{'deep/' * n}{i}" for n in (1, 20, 300) for i in range(7))
    spark.createDataFrame([(u,) for u in urls], "url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.key: r.shared for r in catalog.QUERIES["kv_shared_prefix"](spark, str(tmp_path)).collect()}
    assert got == {u: 0 if i % 16 == 0 else len(commonprefix([u, urls[i - 1]])) for i, u in enumerate(urls)}
    assert max(got.values()) > 1000


def test_cli(spark, tmp_path):
    import io

    from keystrata.cli import Shell

    out = io.StringIO()
    shell = Shell(spark, out)
    for line in (f"open {tmp_path}/cli", "PUT a hello world", "get a", "scan --limit 5", "delete a", "get a", "info", "exit"):
        shell.onecmd(line)
    said = out.getvalue()
    assert "hello world" in said and "not found" in said and "1 rows" in said


def test_stream_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "P", 1), ("b", "2", "P", 2), ("a", "3", "P", 3), ("b", None, "D", 4)], "key string, value string, op string, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    ks = keyspace(spark, tmp_path)
    ingest.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ks, str(tmp_path / "cp")).awaitTermination()
    assert items(ks) == {b"a": b"3"}


def test_queries_have_oracles():
    import __spark_entry__ as entry

    missing = {n for n in entry.queries() if n.startswith(("kv_", "ks_", "stream_"))} - set(entry.oracle_sql())
    assert not missing


@pytest.fixture(scope="module")
def wide(spark):
    n = 120_000
    df = spark.range(n).select(F.format_string("%016x", F.xxhash64("id")).alias("key"), F.repeat(F.lit("v"), (F.col("id") % 40).cast("int")).alias("value"), F.lit("P").alias("op"), F.col("id").alias("seq"))
    return df.repartition(16).cache()


def test_parts_of_many_keys(spark, wide):
    rows = sorted(compaction.split_runs(wide, 65_536).select("key", "value", "part").collect())
    done = 0
    for r in rows:
        assert r.part == done // 65_536
        done += len(r.key) + len(r.value) + 8
    assert len(rows) == 120_000


def test_seek_and_neighbours_of_many_keys(spark, wide):
    keys = sorted(r.key for r in wide.select("key").collect())
    probes = spark.range(30_000).select(F.format_string("%016x", F.xxhash64("id", F.lit(3))).alias("probe")).unionByName(wide.limit(50).select(F.col("key").alias("probe"))).unionByName(spark.createDataFrame([("",), ("zz",)], "probe string"))
    for r in view.seek(wide, probes).collect():
        at = bisect.bisect_left(keys, r.probe)
        assert r.key == (keys[at] if at < len(keys) else None)
    for at, r in enumerate(sorted(view.neighbours(wide).collect(), key=lambda r: r.key)):
        assert r.prev_key == (keys[at - 1] if at else None) and r.next_key == (keys[at + 1] if at + 1 < len(keys) else None)
    assert view.seek(wide.limit(0), probes).where("key IS NOT NULL").isEmpty() and view.neighbours(wide.limit(0)).isEmpty()


def test_compaction_cuts_by_ranges(spark, wide, tmp_path):
    ks = keyspace(spark, tmp_path, base_file_bytes=1 << 20)
    ks.write_batch(wide.select("key", "value"))
    ks.flush()
    assert ks.compact(force=True)
    runs = ks.version.level(1)
    assert len(runs) > 3 and all(a.max_key < b.min_key for a, b in zip(runs, runs[1:], strict=False)) and sum(r.rows for r in runs) == 117_000  # empty values are tombstones
    low = wide.where("value <> ''").agg(F.min("key")).first()[0]
    assert ks.get(low) is not None and len(ks.log(low.encode(), low.encode()).inputFiles()) < len(runs)
    ks.vacuum()
    assert ks.items().count() == 117_000


def test_input_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    keyspace(spark, tmp_path).write_batch(spark.range(100).selectExpr("string(id) AS key", "'v' AS value").mapInArrow(count, "key string, value string"))
    assert seen.value == 100


def test_stream_batches_are_written_once(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    old, new = (spark.createDataFrame([("k", v)], "key string, value string") for v in ("old", "new"))
    assert ks.write_batch(old, stream=("s", 0)) and ks.write_batch(new, stream=("s", 1))
    assert not ks.write_batch(old, stream=("s", 0)) and ks.get("k") == b"new"
    ks = Keyspace(spark, ks.config)  # staged batches keep their names
    assert not ks.write_batch(old, stream=("s", 1)) and ks.write_batch(old, stream=("t", 0))
    ks.flush()
    ks = Keyspace(spark, ks.config)  # and so does the manifest
    assert not ks.write_batch(new, stream=("t", 0)) and ks.get("k") == b"old"


def test_damaged_log(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    for k in "abc":
        ks.put(k, k)
    folder = tmp_path / "ks" / "log"
    for part in (folder / "batch=1").glob("*.parquet"):
        part.write_bytes(b"PAR1 broken")
    (folder / ".leftover").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        Keyspace(spark, ks.config)
    again = Keyspace(spark, config.Config(ks.config.path, auto_compact=False, skip_damaged_log=True))
    assert items(again) == {b"b": b"b", b"c": b"c"}
    shutil.rmtree(folder / "batch=2")
    assert items(Keyspace(spark, config.Config(ks.config.path, auto_compact=False, skip_damaged_log=True))) == {}  # nothing after a lost batch


def test_cursor(spark, tmp_path):
    ks = keyspace(spark, tmp_path)
    assert not ks.cursor().seek_to_first()
    ks.write_batch(spark.createDataFrame([(f"k{i:02}", f"v{i}") for i in range(25)], "key string, value string"))
    ks.delete("k07")
    c = ks.cursor(page=4)
    expected = [(f"k{i:02}".encode(), f"v{i}".encode()) for i in range(25) if i != 7]
    assert list(c) == expected and not c.valid()
    assert c.seek("k07") and c.key() == b"k08" and c.prev() and c.key() == b"k06"
    back, more = [], c.seek_to_last()
    while more:
        back.append((c.key(), c.value()))
        more = c.prev()
    assert back == expected[::-1]
    with pytest.raises(ValueError):
        c.key()


def test_filter_bytes(spark):
    members = spark.range(500).selectExpr("string(id) AS key")
    sketch = membership.sketch_for(spark, members, 500, 0.01)
    data = sketch.to_bytes()
    assert repr(membership.Sketch.from_bytes(spark, data)) == repr(sketch) and membership.Sketch.from_bytes(spark, data).to_bytes() == data
    for cut in (17, 100, len(data)):
        assert membership.Sketch.from_bytes(spark, data[:cut]).might_contain(members).count() == 500
    others = spark.range(10_000, 20_000).selectExpr("string(id) AS key", "id", "1 AS word")
    hits = sketch.might_contain(others)
    assert hits.columns == others.columns and hits.count() < 300 and sketch.grow(members).might_contain(others).count() < hits.count() + 1
    for bad in (b"", b"\0" * 16):
        with pytest.raises(ValueError):
            membership.Sketch.from_bytes(spark, bad)


def test_late_events(spark, tmp_path):
    """Rows behind the watermark are dropped; windows are given out once it has passed."""
    for i, rows in enumerate([["2024-01-01 00:10", "2024-01-01 05:00"], ["2024-01-01 08:00"], ["2024-01-01 00:20", "2024-01-01 12:00"]]):
        spark.createDataFrame([(t, "a") for t in rows], "t string, key string").selectExpr("to_timestamp(t) AS ts", "key").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema("ts timestamp, key string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ingest.run_to_table(ingest.windows(source, "1 hour", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "check"), "append")
    assert sorted((str(r.start)[11:13], r.n) for r in got.collect()) == [("00", 1), ("05", 1), ("08", 1)]


def test_staged_batches_of_any_size_stay_staged(spark, tmp_path):
    from keystrata import catalog, catalog_keyspace  # noqa: F401  (adds its queries)

    kind = "e" * (2 << 20)  # three batches of 4 MB, which is what a keyspace stages by default
    spark.createDataFrame([(i, i, kind) for i in range(6)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    r = catalog.QUERIES["ks_staged"](spark, str(tmp_path)).first()
    assert r.asDict() == {"n_rows": 6, "bytes": 6 * (8 + len(kind)), "was_empty": False, "is_empty": True, "left_over": 0}


def test_pages_that_share_a_url(spark, tmp_path):
    from keystrata import catalog

    pages = [(1, "https://blog.x/a"), (2, "https://blog.x/b"), (3, "https://blog.x/a"), (4, "https://shop.x/a"), (5, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in catalog.QUERIES["kv_prefix"](spark, str(tmp_path)).collect()]
    assert got == [("https://blog.x/a", 1), ("https://blog.x/a", 3), ("https://blog.x/b", 2)]
    rows = [(b"\xffa", b"1", "P", 1), (b"\xffa", b"2", "P", 2), (b"\xffb", None, "D", 3), (b"b", b"4", "P", 4)]
    assert [bytes(r.value) for r in view.prefix_scan(log(spark, rows), b"\xff", every=True).collect()] == [b"1", b"2"]
    assert [bytes(r.value) for r in view.prefix_scan(log(spark, rows), b"\xff").collect()] == [b"2"]
