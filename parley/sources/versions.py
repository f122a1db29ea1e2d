"""Tables that are published together: folders that never change, and a pointer that is written last.

A scope (a day's company run, say) has a folder for each version, and a small file that names the current one with the
paths and row counts of its tables. A reader takes the pointer once and reads the files it names, however often the
scope is published meanwhile. A run that dies leaves a folder that no pointer names: the old version stays whole. A
new version may name files of an older one, so a table that did not change is not written again.

Bucketed tables are cut by a hash of their key; a merge writes only the buckets that hold touched keys, and the pointer
names the old files of all others. Several tables merged together become visible in one step.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
POINTER = "_current.json"


class Files:
    """Small files and folders through Hadoop's file system, so that any store will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def text(self, path: str) -> str | None:
        where, store = self._at(path)
        if not store.exists(where):
            return None
        stream = store.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Written aside and renamed over the old file, in one step where the store can do that."""
        where, store = self._at(f"{path}.{uuid.uuid4().hex}")
        where, target = store.makeQualified(where), store.makeQualified(self._at(path)[0])
        stream = store.create(where, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        over = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf).rename(where, target, over)

    def remove(self, path: str) -> None:
        where, store = self._at(path)
        store.delete(where, True)

    def folders(self, path: str) -> list[str]:
        where, store = self._at(path)
        return sorted(x.getPath().getName() for x in store.listStatus(where) if x.isDirectory()) if store.exists(where) else []


@dataclass(frozen=True)
class Version:
    """What one pointer names: table -> its files (one folder, or one for each bucket) and rows."""

    number: int
    name: str
    tables: dict[str, dict] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def rows(self, table: str) -> int:
        return self.tables[table]["rows"] if table in self.tables else 0

    def paths(self, table: str) -> list[str]:
        return list(self.tables.get(table, {}).get("paths", {}).values())


@dataclass(frozen=True)
class Scope:
    """One unit of publishing, at ``path``. ``keep``: so many versions stay, for readers that hold an old one."""

    spark: SparkSession
    path: str
    keep: int = 2

    def current(self) -> Version | None:
        text = Files(self.spark).text(f"{self.path}/{POINTER}")
        return None if text is None else Version(**json.loads(text))

    def read(self, version: Version | None, table: str, schema: str) -> DataFrame:
        """The table as of this version, empty where it has none."""
        paths = version.paths(table) if version else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def draft(self) -> Draft:
        return Draft(self, self.current())


class Draft:
    """A version in the making: nothing of it is seen before publish()."""

    def __init__(self, scope: Scope, old: Version | None):
        self.scope, self.old = scope, old
        self.number = old.number + 1 if old else 1
        self.name = f"{self.number:08d}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, dict] = {}
        self.stages: list[tuple[str, int, float]] = []  # table, rows and seconds of each write

    @property
    def folder(self) -> str:
        return f"{self.scope.path}/{self.name}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Writes the table and reads it back: what follows stands on files, not on a plan that a lost executor would run again. Counts in passing."""
        path, seen, began = f"{self.folder}/{table}", Observation(), time.monotonic()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.tables[table] = {"paths": {"": path}, "rows": seen.get["rows"]}
        self.stages.append((table, seen.get["rows"], time.monotonic() - began))
        return self.scope.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """These tables were steps on the way and are not published; their files go."""
        for t in tables:
            for path in self.tables.pop(t)["paths"].values():
                Files(self.scope.spark).remove(path)

    def keep(self, *tables: str) -> None:
        """These tables are the old version's, not written again."""
        self.tables |= {t: self.old.tables[t] for t in tables if self.old and t in self.old.tables}

    def merge(self, table: str, rows: DataFrame, schema: str, keys: Sequence[str], merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> None:
        """Puts ``rows`` into a bucketed table: merged(old, new) gives the touched buckets' rows, all other files stay as they are.

        The number of buckets is fixed by the first merge. The rows are written aside first, as they are read several
        times. Only bucket numbers come to the driver.
        """
        aside = f"{self.folder}/{table}-in"
        rows.write.parquet(aside)
        rows = self.scope.spark.read.schema(rows.schema).parquet(aside)
        had = (self.old.tables.get(table) if self.old else None) or {"paths": {}, "rows": 0, "buckets": buckets}
        n = had["buckets"]
        number = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        touched = sorted(r[0] for r in rows.select(number).distinct().collect())
        old_paths = [had["paths"][str(b)] for b in touched if str(b) in had["paths"]]
        old = self.scope.spark.read.schema(schema).parquet(*old_paths) if old_paths else self.scope.spark.createDataFrame([], schema)
        path = f"{self.folder}/{table}"
        counts = {}
        if touched:
            merged(old, rows).withColumn(BUCKET, number).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)
            written = self.scope.spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)
            counts = {r[BUCKET]: r["count"] for r in written.groupBy(BUCKET).count().collect()}
        Files(self.scope.spark).remove(aside)
        each = {b: x for b, x in had.get("each", {}).items() if int(b) not in touched} | {str(b): c for b, c in counts.items()}
        paths = {b: p for b, p in had["paths"].items() if int(b) not in touched} | {str(b): f"{path}/{BUCKET}={b}" for b in counts}
        self.tables[table] = {"paths": paths, "rows": sum(each.values()), "buckets": n, "each": each}

    def made(self, **info) -> Version:
        """What is in the draft so far, for its maker to read."""
        return Version(self.number, self.name, dict(self.tables), info)

    def publish(self, **info) -> Version:
        """Names this version the current one, then drops what no version in keeping needs."""
        made = self.made(**info)
        Files(self.scope.spark).replace(f"{self.scope.path}/{POINTER}", json.dumps(made.__dict__))
        self._expire(made)
        return made

    def _expire(self, made: Version) -> None:
        files = Files(self.scope.spark)
        used = {self.folder_of(p) for t in made.tables.values() for p in t["paths"].values()}
        used |= {self.folder_of(p) for t in (self.old.tables if self.old and self.scope.keep > 1 else {}).values() for p in t["paths"].values()}
        for name in files.folders(self.scope.path):
            if name[:8].isdigit() and int(name[:8]) <= self.number - self.scope.keep and name not in used:
                files.remove(f"{self.scope.path}/{name}")

    def folder_of(self, path: str) -> str:
        return path[len(self.scope.path) + 1 :].split("/")[0]


def union_of(scopes: Iterable[tuple[Scope, Version | None]], table: str, spark: SparkSession, schema: str) -> DataFrame:
    """One table of many scopes, each as of its version, in one scan."""
    paths = [p for _, v in scopes if v for p in v.paths(table)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def changes_of(before: Version | None, after: Version) -> Mapping[str, list[str]]:
    """Of each table, the files that ``after`` has and ``before`` had not."""
    old = {p for t in (before.tables if before else {}).values() for p in t["paths"].values()}
    return {name: sorted(p for p in t["paths"].values() if p not in old) for name, t in after.tables.items()}
