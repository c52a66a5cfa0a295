"""Queries that run through a keyspace on disk: batches, flushes, compactions, recovery, streams, the shell.

Each writes the event log as three batches to a fresh keyspace in the shared
folder. Sequence numbers are the keyspace's own, so results show keys and values.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .catalog import _KV, _LATEST, _LEVEL, _LIVE, _ZONES, HIGH, LOW, event_log, levelled, query, table, zones
from .config import Config
from .functions import codecs
from .keyspace import Keyspace
from .operators import membership, view
from .plans import compaction
from .schema import encode_fixed
from .sources.manifest import Run, Version
from .sources.runs import read_runs
from .streaming import ingest


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local session without one gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """The event log in three parts by write order."""
    log = event_log(spark, d).select("key", "value", "op", "seq")
    n = log.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    return [log.where(F.expr(f"seq * 3 div {n}") == k) for k in range(3)]


def loaded(spark: SparkSession, d: str, flushes: int = 3, **options) -> Keyspace:
    """Three batches, of which exactly the first ``flushes`` became runs: no batch is flushed for its size."""
    ks = Keyspace(spark, Config(scratch(spark, "keyspace"), auto_compact=False, memtable_bytes=1 << 62, **options))
    for k, part in enumerate(batches(spark, d)):
        ks.write_batch(part, order_by="seq")
        if k < flushes:
            ks.flush()
    return ks


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*(codecs.decode_text(F.col(c)).alias(c) if t == "binary" else c for c, t in df.dtypes))


_PARTS = f"""{_KV}, parts AS (SELECT *, CAST(seq * 3 // (SELECT max(event_id) + 1 FROM events) AS BIGINT) AS part FROM kv)"""
_ITEMS = f"WITH {_LIVE} SELECT key, value FROM live"


@query("ks_items", _ITEMS)
def _(spark, d):
    return as_text(loaded(spark, d).items())


@query("ks_recover", _ITEMS)
def _(spark, d):
    path = loaded(spark, d, flushes=2).config.path
    return as_text(Keyspace(spark, Config(path, auto_compact=False)).items())


@query("ks_multi_get", f"WITH {_LIVE}, keys AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) SELECT keys.key, value FROM keys LEFT JOIN live USING (key)")
def _(spark, d):
    keys = table(spark, d, "customer").select(F.encode(encode_fixed(F.col("c_custkey")), "UTF-8").alias("key")).distinct()
    return as_text(loaded(spark, d, flushes=2).multi_get(keys))


@query("ks_get", f"WITH {_LIVE} SELECT k.key, value FROM (VALUES ('00000003'), ('00000042'), ('00000077'), ('absent')) k(key) LEFT JOIN live USING (key)")
def _(spark, d):
    ks = loaded(spark, d)
    found = [(k, None if (v := ks.get(k)) is None else v.decode()) for k in ("00000003", "00000042", "00000077", "absent")]
    return spark.createDataFrame(found, "key string, value string")


@query("ks_range", f"WITH {_LIVE} SELECT key, value FROM live WHERE key >= '{LOW}' AND key < '{HIGH}'")
def _(spark, d):
    ks = loaded(spark, d, base_file_bytes=512)
    ks.compact(force=True)
    return as_text(ks.range(LOW, HIGH))


@query("ks_prefix_limit", f"WITH {_LIVE} SELECT key, value FROM live WHERE starts_with(key, '0000001') ORDER BY key LIMIT 7")
def _(spark, d):
    return as_text(loaded(spark, d).prefix("0000001", limit=7))


@query("ks_snapshot", f"WITH {_PARTS} SELECT key, value FROM (SELECT * FROM parts WHERE part <= 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 'P'")
def _(spark, d):
    ks = loaded(spark, d)
    ks.compact(force=True)
    return as_text(ks.snapshot(2))


@query("ks_runs", f"WITH {_PARTS} SELECT part + 1 AS run_id, CAST(0 AS BIGINT) AS level, count(DISTINCT key) AS n_rows, min(key) AS min_key, max(key) AS max_key FROM parts GROUP BY part")
def _(spark, d):
    runs = loaded(spark, d).version.runs
    return spark.createDataFrame([(r.run_id, r.level, r.rows, bytes.fromhex(r.min_key).decode(), bytes.fromhex(r.max_key).decode()) for r in runs], "run_id long, level long, n_rows long, min_key string, max_key string")


@query("ks_compacted_log", f"WITH {_LIVE} SELECT key, value, op, CAST(1 AS BIGINT) AS level FROM live")
def _(spark, d):
    ks = loaded(spark, d, base_file_bytes=512)
    ks.compact(force=True)
    return as_text(ks.log()).select("key", "value", "op", F.lit(max(r.level for r in ks.version.runs)).cast("bigint").alias("level"))


@query("ks_compacted_ranges", f"WITH {_LIVE} SELECT CAST(1 AS BIGINT) AS level, count(*) AS n_rows, true AS several, CAST(0 AS BIGINT) AS overlapping FROM live")
def _(spark, d):
    ks = loaded(spark, d, base_file_bytes=256)
    ks.compact(force=True)
    runs = ks.version.level(1)
    meet = sum(a.max_key >= b.min_key for a, b in zip(runs, runs[1:], strict=False))
    return spark.createDataFrame([(1, sum(r.rows for r in runs), len(runs) > 1, meet)], "level long, n_rows long, several boolean, overlapping long")


@query("ks_tombstones_kept", f"WITH {_PARTS}, a AS (SELECT * FROM parts WHERE part = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), b AS (SELECT * FROM parts WHERE part >= 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, op, CAST(CASE WHEN src = 0 THEN 2 ELSE 1 END AS BIGINT) AS level FROM (SELECT key, op, 0 AS src FROM a WHERE op = 'P' UNION ALL SELECT key, op, 1 FROM b)")
def _(spark, d):
    """The first part goes down to level 2; tombstones of the others stay above it at level 1."""
    first, second, third = batches(spark, d)
    ks = Keyspace(spark, Config(scratch(spark, "keyspace"), auto_compact=False))
    ks.write_batch(first, order_by="seq")
    ks.flush()
    ks.compact(level=0)
    ks.compact(level=1)
    for part in (second, third):
        ks.write_batch(part, order_by="seq")
        ks.flush()
    ks.compact(level=0)
    rows = [read_runs(spark, ks.version.level(n)).select("key", "op", F.lit(n).cast("bigint").alias("level")) for n in (1, 2)]
    return as_text(rows[0].unionByName(rows[1]))


@query("ks_deleted", f"WITH {_LATEST} SELECT key FROM latest WHERE op = 'D'")
def _(spark, d):
    return as_text(loaded(spark, d).deleted()).select("key")


@query("ks_seek", f"WITH {_LIVE}, probes AS (SELECT DISTINCT lpad(CAST(s_suppkey * 7 AS VARCHAR), 8, '0') AS probe FROM supplier) SELECT probe, (SELECT min(key) FROM live WHERE key >= probe) AS key FROM probes")
def _(spark, d):
    probes = table(spark, d, "supplier").select(F.encode(encode_fixed(F.col("s_suppkey") * 7), "UTF-8").alias("probe")).distinct()
    return as_text(loaded(spark, d).seek(probes))


@query("ks_neighbours", f"WITH {_LIVE} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def _(spark, d):
    return as_text(loaded(spark, d).neighbours())


@query("ks_first_last", f"WITH {_LIVE} SELECT min(key) AS first_key, arg_min(value, key) AS first_value, max(key) AS last_key, arg_max(value, key) AS last_value FROM live")
def _(spark, d):
    return as_text(loaded(spark, d).first_last())


@query(
    "ks_cursor",
    f"""WITH {_LIVE}, fore AS (SELECT key, value, row_number() OVER (ORDER BY key) AS step FROM live WHERE key >= '{LOW}' ORDER BY key LIMIT 25),
    back AS (SELECT key, value, -row_number() OVER (ORDER BY key DESC) AS step FROM live ORDER BY key DESC LIMIT 25) SELECT * FROM fore UNION ALL SELECT * FROM back""",
)
def _(spark, d):
    cursor, rows = loaded(spark, d).cursor(page=10), []
    more = cursor.seek(LOW)
    while more and len(rows) < 25:
        rows.append((cursor.key().decode(), cursor.value().decode(), len(rows) + 1))
        more = cursor.next()
    n, more = 0, cursor.seek_to_last()
    while more and n < 25:
        n += 1
        rows.append((cursor.key().decode(), cursor.value().decode(), -n))
        more = cursor.prev()
    return spark.createDataFrame(rows, "key string, value string, step long")


@query("ks_delete_batch", f"WITH {_LIVE} SELECT key, value FROM live WHERE key NOT IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer WHERE c_custkey % 3 = 0)")
def _(spark, d):
    ks = loaded(spark, d)
    ks.delete_batch(table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.encode(encode_fixed(F.col("c_custkey")), "UTF-8").alias("key")))
    return as_text(ks.items())


@query("ks_info", f"WITH {_PARTS}, kept AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY part, key ORDER BY seq DESC) = 1) SELECT CAST(3 AS BIGINT) AS version, CAST(3 AS BIGINT) AS runs, CAST(sum(strlen(key) + CASE WHEN op = 'P' THEN strlen(value) ELSE 0 END + 8) AS BIGINT) AS bytes, CAST(sum(strlen(key) + CASE WHEN op = 'P' THEN strlen(value) ELSE 0 END + 8) AS DOUBLE) / 3 AS mean_bytes, CAST(0 AS BIGINT) AS staged_batches FROM kept")
def _(spark, d):
    info = loaded(spark, d).info()
    return spark.createDataFrame([tuple(info[k] for k in ("version", "runs", "bytes", "mean_bytes", "staged_batches"))], "version long, runs long, bytes long, mean_bytes double, staged_batches long")


@query("ks_vacuum", f"WITH {_LIVE} SELECT CAST(3 AS BIGINT) AS runs_gone, CAST(3 AS BIGINT) AS batches_gone, count(*) AS n_rows FROM live")
def _(spark, d):
    ks = loaded(spark, d)
    ks.compact(force=True)
    gone = [p.rsplit("/", 1)[-1] for p in ks.vacuum()]
    return ks.items().agg(F.lit(sum(p.startswith("run_id=") for p in gone)).cast("bigint").alias("runs_gone"), F.lit(sum(p.startswith("batch=") for p in gone)).cast("bigint").alias("batches_gone"), F.count("*").alias("n_rows"))


@query("ks_staged", f"WITH {_KV} SELECT count(*) AS n_rows, CAST(sum(strlen(key) + CASE WHEN op = 'P' THEN strlen(value) ELSE 0 END) AS BIGINT) AS bytes, false AS was_empty, true AS is_empty, CAST(0 AS BIGINT) AS left_over FROM kv")
def _(spark, d):
    ks = loaded(spark, d, flushes=0)
    rows, size, was = ks.staged().count(), ks.staged_bytes(), ks.is_staged_empty()
    ks.clear_staged()
    return ks.items().agg(F.lit(rows).cast("bigint").alias("n_rows"), F.lit(size).cast("bigint").alias("bytes"), F.lit(was).alias("was_empty"), F.lit(ks.is_staged_empty()).alias("is_empty"), F.count("*").alias("left_over"))


@query("ks_manifest_files", "SELECT lpad(CAST(v AS VARCHAR), 12, '0') || '.json' AS name, CAST(v AS BIGINT) AS runs FROM range(1, 4) t(v)")
def _(spark, d):
    m = loaded(spark, d).manifest
    return spark.createDataFrame([(name, len(m.read(int(name[:-5])).runs)) for name in m.names(m.path, ".json")], "name string, runs long")


@query("ks_stream", _ITEMS)
def _(spark, d):
    """The stream is replayed from its start after a later write, which it must not undo."""
    schema = table(spark, d, "events").schema
    ks = Keyspace(spark, Config(scratch(spark, "keyspace"), auto_compact=False))
    for _ in range(2):
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        log = events.select(encode_fixed(F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("event_id").alias("seq"))
        ingest.ingest(log, ks, scratch(spark, "checkpoint"), name="events").awaitTermination()
        ks.flush()
    return as_text(ks.items())


_HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"


@query("stream_windows", f"SELECT {_HOUR} AS start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = ingest.windows(_events(spark, d), "1 hour", by="event_type")
    return _table(spark, rows.select(_text("start"), "key", "n"))


@query("stream_sliding", "SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(h AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start, event_type AS key, count(*) AS n FROM events, range(2) t(h) GROUP BY 1, 2")
def _(spark, d):
    rows = ingest.windows(_events(spark, d), "2 hours", "1 hour", by="event_type")
    return _table(spark, rows.select(_text("start"), "key", "n"))


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id AS key, count(*) AS n FROM s GROUP BY user_id, session""",
)
def _(spark, d):
    rows = ingest.sessions(_events(spark, d), "3 hours", by="user_id")
    return _table(spark, rows.select(_text("start"), "key", "n"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _text(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def _table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return ingest.run_to_table(rows, scratch(spark, "windows"), scratch(spark, "checkpoint"))


@query("kv_rollup", f"WITH {_KV} SELECT value, op, count(*) AS n, max(seq) AS last_seq FROM kv GROUP BY ROLLUP (op, value)")
def _(spark, d):
    log = event_log(spark, d).select("op", F.coalesce("value", F.lit("error")).alias("value"), "seq")
    return log.rollup("op", "value").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("kv_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def _(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


# -- compaction decisions ------------------------------------------------------

#: The limits that the level queries of the catalog state: level 0 holds 4 runs or 4096 bytes.
_SMALL = Config("memory", base_file_bytes=1024, level0_trigger=4)


def version_of(spark: SparkSession, d: str) -> Version:
    """The event runs as a manifest version; one row a run comes to the driver."""
    rows = levelled(zones(spark, d)).collect()
    runs = [Run(r["run_id"], r["level"], "", r["n_rows"], r["bytes"], r["min_key"].encode().hex(), r["max_key"].encode().hex(), 0, 0) for r in rows]
    return Version(1, runs=tuple(sorted(runs, key=lambda r: r.run_id)))


_PICK = "SELECT run_id, level FROM chosen UNION ALL SELECT run_id, level FROM leveled, span WHERE level = {next} AND min_key <= high AND max_key >= low"


def _pick(level: int, order: str, limit: int) -> str:
    return f"""WITH {_ZONES}, leveled AS (SELECT *, {_LEVEL} AS level FROM zones), chosen AS (SELECT * FROM leveled WHERE level = {level} ORDER BY {order} LIMIT {limit}),
    span AS (SELECT min(min_key) AS low, max(max_key) AS high FROM chosen) {_PICK.format(next=level + 1)}"""


def _picked(spark, d, level):
    job = compaction.pick(version_of(spark, d), _SMALL, level)
    return spark.createDataFrame([(r.run_id, r.level) for r in job.inputs] if job else [], "run_id long, level int")


@query("kv_pick_l0", _pick(0, "run_id", 4))
def _(spark, d):
    return _picked(spark, d, 0)


@query("kv_pick_l1", _pick(1, "min_key, run_id", 1))
def _(spark, d):
    return _picked(spark, d, 1)


@query(
    "kv_level_stats",
    f"""WITH {_ZONES}, levels AS (SELECT {_LEVEL} AS level, count(*) AS runs, CAST(sum(bytes) AS BIGINT) AS bytes FROM zones GROUP BY 1)
    SELECT CAST(level AS INTEGER) AS level, runs, bytes, CAST(4096 * pow(10, level) AS BIGINT) AS max_bytes, CASE WHEN level = 0 THEN runs >= 4 ELSE bytes > 4096 * pow(10, level) END AS needs_compaction FROM levels""",
)
def _(spark, d):
    v = version_of(spark, d)
    due = compaction.needed(v, _SMALL)
    rows = [(n, len(v.level(n)), v.bytes_at(n), compaction.level_limit(_SMALL, n), n in due) for n in range(_SMALL.levels) if v.level(n)]
    return spark.createDataFrame(rows, "level int, runs long, bytes long, max_bytes long, needs_compaction boolean")


# -- filters -------------------------------------------------------------------


def _filter_sql(bits: int, hashes: int, tail: str) -> str:
    part = lambda k, at: f"CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), {at}, 8) AS BIGINT)"
    return f"""WITH pos AS (SELECT DISTINCT ({part('doc_id', 1)} + i * {part('doc_id', 9)}) % {bits} AS bit FROM labels, range({hashes}) t(i)),
    asked AS (SELECT doc_id, ({part('doc_id', 1)} + i * {part('doc_id', 9)}) % {bits} AS bit FROM documents, range({hashes}) t(i)) {tail}"""


_EACH, _HASHES = 13, 9  # bits a key and hashes at a rate of 0.01
_HITS = "SELECT doc_id FROM asked LEFT JOIN pos USING (bit) GROUP BY doc_id HAVING count(*) = count(pos.bit)"


def _sketch(spark, d):
    return membership.sketch_for(spark, table(spark, d, "labels").select("doc_id"), 100_000, 0.01, "doc_id")


@query("kv_bloom_sketch", _filter_sql(100_000 * _EACH, _HASHES, _HITS))
def _(spark, d):
    return _sketch(spark, d).might_contain(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("kv_bloom_bytes", _filter_sql(100_000 * _EACH, _HASHES, _HITS))
def _(spark, d):
    again = membership.Sketch.from_bytes(spark, _sketch(spark, d).to_bytes())
    return again.might_contain(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("kv_bloom_grow", _filter_sql(200_000 * _EACH, _HASHES, _HITS))
def _(spark, d):
    grown = _sketch(spark, d).grow(table(spark, d, "labels").select("doc_id"), "doc_id")
    return grown.might_contain(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("kv_bloom_fill", _filter_sql(100_000 * _EACH, _HASHES, f"SELECT CAST(count(*) AS DOUBLE) / {100_000.0 * _EACH}::DOUBLE AS fill, 'Sketch(bits_per_key={_EACH}, hashes={_HASHES}, bits={100_000 * _EACH}, keys=100000)' AS shown FROM pos"))
def _(spark, d):
    sketch = _sketch(spark, d)
    return sketch.fill_ratio().select("fill", F.lit(repr(sketch)).alias("shown"))


# -- codecs --------------------------------------------------------------------

_FRAME = "printf('%02X', CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) || lpad(printf('%X', event_id), 16, '0') || '00000008' || hex(encode(lpad(CAST(user_id AS VARCHAR), 8, '0'))) || CASE WHEN event_type = 'error' THEN '00000000' ELSE lpad(printf('%X', strlen(event_type)), 8, '0') || hex(encode(event_type)) END"


def _frames(spark, d):
    log = event_log(spark, d)
    return log.select("seq", codecs.entry_hex(F.when(F.col("op") == "D", 1).otherwise(0), F.col("seq"), F.encode("key", "UTF-8"), F.encode("value", "UTF-8")).alias("frame"))


@query("kv_entry_frame", f"SELECT event_id AS seq, {_FRAME} AS frame FROM events")
def _(spark, d):
    return _frames(spark, d)


@query("kv_entry_parse", f"WITH {_KV} SELECT CAST(CASE WHEN op = 'D' THEN 1 ELSE 0 END AS BIGINT) AS kind, seq, key, CASE WHEN op = 'P' THEN value END AS value FROM kv")
def _(spark, d):
    return as_text(_frames(spark, d).select(codecs.entry_parse(F.col("frame")).alias("e")).select("e.*"))


@query("kv_decode_text", "SELECT page_id, url AS strict, CASE WHEN page_id % 2 = 0 THEN url END AS checked, CASE WHEN page_id % 2 = 0 THEN url ELSE url || chr(65533) END AS mended FROM pages")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.encode("url", "UTF-8").alias("data"))
    broken = F.when(F.col("page_id") % 2 == 0, F.col("data")).otherwise(F.concat("data", F.lit(bytearray(b"\xff"))))
    return pages.select("page_id", codecs.decode_text(F.col("data")).alias("strict"), codecs.decode_text(broken, "null").alias("checked"), codecs.decode_text(broken, "replace").alias("mended"))


@query("kv_log_damage", f"WITH {_KV} SELECT key, CASE WHEN op = 'P' THEN value END AS value, op, seq FROM kv WHERE NOT (seq % 97 = 0 AND op = 'P')")
def _(spark, d):
    log = view.with_checksum(event_log(spark, d).select("key", "value", "op", "seq"))
    hurt = log.withColumn("value", F.when((F.col("seq") % 97 == 0) & (F.col("op") == "P"), F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    return view.intact(hurt)


# -- settings and shell --------------------------------------------------------


@query(
    "kv_presets",
    """SELECT * FROM (VALUES ('default', '/x', '/x/runs', '/x/log', 4194304::BIGINT, 4, 1048576::BIGINT, 0.01::DOUBLE), ('point_lookup', '/x', '/x/runs', '/x/log', 67108864, 4, 1048576, 0.001),
    ('heavy_writes', '/x', '/x/runs', '/x/log', 134217728, 8, 4194304, 0.01), ('range_scans', '/x', '/x/runs', '/x/log', 4194304, 4, 1048576, NULL), ('from_dict', '/x', '/x/runs', '/x/log', 10240, 2, 5120, 0.01)) t(name, path, data_path, log_path, memtable_bytes, level0_trigger, base_file_bytes, fpr)""",
)
def _(spark, d):
    made = {"default": Config("/x/"), "point_lookup": settings.point_lookup("/x/"), "heavy_writes": settings.heavy_writes("/x"), "range_scans": settings.range_scans("/x//"), "from_dict": Config.from_dict({"path": "/x", "memtable_bytes": 10240, "level0_trigger": 2, "base_file_bytes": 5120})}
    rows = [(n, c.path, c.data_path, c.log_path, c.memtable_bytes, c.level0_trigger, c.base_file_bytes, (c.bloom_options() or {}).get("fpr")) for n, c in made.items()]
    return spark.createDataFrame(rows, "name string, path string, data_path string, log_path string, memtable_bytes long, level0_trigger int, base_file_bytes long, fpr double")


_SHELL = (
    ("get a", "error: no keyspace is open"),
    ("open {path}", "opened {path}"),
    ("PUT a some value", "ok"),
    ("put b 2", "ok"),
    ("get a", "some value"),
    ("delete b", "ok"),
    ("get b", "not found"),
    ("flush", "ok"),
    ("put c 3", "ok"),
    ("scan --start a --end d --limit 5", "a\tsome value|c\t3|2 rows"),
    ("compact", "compacted"),
    ("info", "version: 2|runs: 1|bytes: 19|mean_bytes: 19.0|staged_batches: 1|levels: {1: 1}"),
    ("put", "error: put KEY VALUE"),
    ("close", "closed"),
    ("get a", "error: no keyspace is open"),
)


@query("kv_shell", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{line.split()[0]}', '{said}')" for i, (line, said) in enumerate(_SHELL)) + ") t(step, command, said)")
def _(spark, d):
    from .cli import Shell

    path, rows = scratch(spark, "shell"), []
    out = io.StringIO()
    shell = Shell(spark, out)
    for i, (line, _) in enumerate(_SHELL):
        out.seek(0)
        out.truncate()
        shell.onecmd(line.replace("{path}", path))
        rows.append((i, line.split()[0], "|".join(out.getvalue().splitlines()).replace(path, "{path}")))
    return spark.createDataFrame(pa.table({"step": pa.array([r[0] for r in rows], pa.int32()), "command": [r[1] for r in rows], "said": [r[2] for r in rows]}))
