"""An interactive shell: ``python -m keystrata.cli [path]``."""

from __future__ import annotations

import cmd
import shlex
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .keyspace import Keyspace


def as_text(b: bytes) -> str:
    return bytes(b).decode("utf-8", "replace")


class Shell(cmd.Cmd):
    prompt = "keystrata> "

    def __init__(self, spark: SparkSession, stdout=None):
        super().__init__(stdout=stdout)
        self.spark, self.ks = spark, None

    def say(self, *words) -> None:
        print(*words, file=self.stdout)

    def onecmd(self, line: str) -> bool:
        verb, _, rest = line.strip().partition(" ")
        try:
            return bool(super().onecmd(f"{verb.lower()} {rest}".strip()))
        except (ValueError, TypeError) as e:
            self.say(f"error: {e}")
            return False

    def emptyline(self) -> bool:
        return False

    def _need(self) -> Keyspace:
        if self.ks is None:
            raise ValueError("no keyspace is open")
        return self.ks

    def do_open(self, path: str) -> None:
        """open PATH: open or create a keyspace"""
        self.do_close("")
        self.ks = Keyspace(self.spark, Config(path or "./keyspace"))
        self.say(f"opened {self.ks.config.path}")

    def do_close(self, _: str) -> None:
        """close: flush and close"""
        if self.ks is not None:
            self.ks.close()
            self.ks = None
            self.say("closed")

    def do_put(self, line: str) -> None:
        """put KEY VALUE: write a value, which may hold spaces"""
        key, _, value = line.partition(" ")
        if not key or not value:
            raise ValueError("put KEY VALUE")
        self._need().put(key, value)
        self.say("ok")

    def do_get(self, key: str) -> None:
        """get KEY"""
        value = self._need().get(key.strip())
        self.say("not found" if value is None else as_text(value))

    def do_delete(self, key: str) -> None:
        """delete KEY"""
        self._need().delete(key.strip())
        self.say("ok")

    def do_scan(self, line: str) -> None:
        """scan [--start K] [--end K] [--limit N]: rows in key order, ten by default"""
        words = shlex.split(line)
        args = dict(zip(words[::2], words[1::2], strict=True))
        rows = self._need().range(args.get("--start"), args.get("--end"), int(args.get("--limit", 10))).collect()
        for r in rows:
            self.say(f"{as_text(r['key'])}\t{as_text(r['value'])}")
        self.say(f"{len(rows)} rows")

    def do_flush(self, _: str) -> None:
        """flush: staged writes become a run"""
        self._need().flush()
        self.say("ok")

    def do_compact(self, _: str) -> None:
        """compact: merge one level into the next"""
        self.say("compacted" if self._need().compact(force=True) else "nothing to compact")

    def do_info(self, _: str) -> None:
        """info: runs, bytes and version"""
        for k, v in self._need().info().items():
            self.say(f"{k}: {v}")

    def do_benchmark(self, line: str) -> None:
        """benchmark [N] [BYTES]: N puts in one batch, then N gets in one lookup"""
        words = line.split()
        n, size = int(words[0]) if words else 10_000, int(words[1]) if len(words) > 1 else 100
        ks, keys = self._need(), self.spark.range(n).select(F.format_string("bench-%08d", "id").alias("key"))
        began = time.time()
        ks.write_batch(keys.withColumn("value", F.lit("x" * size)))
        put = time.time() - began
        began = time.time()
        hits = ks.multi_get(keys.select(F.encode("key", "UTF-8").alias("key"))).where("value IS NOT NULL").count()
        got = time.time() - began
        self.say(f"put: {n / put:.0f} a second; get: {n / got:.0f} a second; hits: {hits}/{n}")

    def do_exit(self, _: str) -> bool:
        """exit: close and leave"""
        self.do_close("")
        return True

    do_quit = do_EOF = do_exit


def main(argv: list[str] | None = None) -> None:
    args = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("keystrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shell = Shell(spark)
    shell.do_open(args[0] if args else "./keyspace")
    shell.cmdloop()


if __name__ == "__main__":
    main()
