"""Sources that Spark has no reader for, as Python data sources: a paged roster service, and a log in shards.

A department is a partition of the roster, a shard one of the log; each is read by a task of its own, which a lost
executor repeats. Equality filters are pushed to the side that can apply them: departments that are not asked for are not
called, and a shard gets its day as a condition.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from parley.settings import DEFAULTS
from parley.sources.readers import LOG_SCHEMA


class RosterError(RuntimeError):
    """A department's roster that could not be read whole."""


def _may_pass(fault: Exception) -> bool:
    if isinstance(fault, urllib.error.HTTPError):
        return fault.code >= 500 or fault.code == 429
    return isinstance(fault, (urllib.error.URLError, TimeoutError, ConnectionError))


def fetched(url: str, body: dict, token: str | None, timeout: float) -> dict:
    """One request: a JSON object there, a JSON object back."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head, method="POST"), timeout=timeout) as answer:
        return json.load(answer)


def roster_of(department: str, page: Callable[[int], dict], size: int, most_pages: int, attempts: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """All managers of a department, each once, in the order they came. Any page that cannot be read fails the department.

    A busy service (429), an error on its side (5xx) and a broken connection are tried again, after pauses that double;
    every other answer is final.
    """
    seen: dict[str, None] = {}
    for number in range(1, most_pages + 1):
        for attempt in range(attempts):
            try:
                got = page(number)
                break
            except Exception as e:
                if not _may_pass(e) or attempt == attempts - 1:
                    raise RosterError(f"department {department}, page {number}: {e}") from e
                sleep(pause * 2**attempt)
        total, ids = got.get("total"), got.get("manager_ids")
        if not isinstance(total, int) or not isinstance(ids, list):
            raise RosterError(f"department {department}, page {number}: neither total nor manager_ids")
        seen |= dict.fromkeys(s for s in (str(i).strip() for i in ids) if s)
        if not ids or number * size >= total:
            return list(seen)
    raise RosterError(f"department {department} has more than {most_pages} pages")


class _Department(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


def _pushed(filters: list[Filter], column: str) -> tuple[list[str] | None, Iterable[Filter]]:
    """The values that filters on ``column`` leave (None: all), and the filters that remain for Spark."""
    wanted: list[str] | None = None
    rest = []
    for f in filters:
        values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
        if values is None or f.attribute != (column,):
            rest.append(f)
        else:
            wanted = [str(v) for v in values if wanted is None or str(v) in wanted]
    return wanted, rest


class RosterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.departments: list[str] = json.loads(options["departments"])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        wanted, rest = _pushed(filters, "department")
        if wanted is not None:
            self.departments = [d for d in self.departments if d in wanted]
        return rest

    def partitions(self) -> list[_Department]:
        return [_Department(d) for d in dict.fromkeys(self.departments)] or [_Department("")]

    def read(self, partition: _Department) -> Iterator[tuple]:
        if not partition.value:
            return
        o = self.options
        size = int(o.get("page_size", 500))

        def page(number: int) -> dict:
            return fetched(o["url"], {"department_id": partition.value, "page": number, "page_size": size}, o.get("token"), float(o.get("timeout", 10)))

        for manager in roster_of(partition.value, page, size, int(o.get("max_pages", 200)), int(o.get("attempts", 3)), float(o.get("pause", 1))):
            yield partition.value, manager


class RosterSource(DataSource):
    """Format ``roster``: options url, departments (a JSON array), token, page_size, max_pages, attempts, pause, timeout."""

    @classmethod
    def name(cls) -> str:
        return "roster"

    def schema(self) -> str:
        return "department string, manager string"

    def reader(self, schema: T.StructType) -> RosterReader:
        return RosterReader(dict(self.options))


class _Shard(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class ShardReader(DataSourceReader):
    """One partition a shard. ``day`` and ``type`` are pushed into each shard's own filter."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options, self.equal = schema, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("create_date",), ("msg_type",)) and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = str(f.value)
            else:
                yield f

    def partitions(self) -> list[_Shard]:
        return [_Shard(k) for k in range(1, int(self.options.get("shards", DEFAULTS.shard_count)) + 1)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        if "connect" in self.options:
            return self._rows(partition.value)
        return self._files(partition.value)

    def _rows(self, shard: int) -> Iterator[tuple]:
        """From a database: ``connect`` names a function (module:function) that opens a connection, ``table`` has {} for the shard."""
        module, function = self.options["connect"].split(":")
        link = getattr(importlib.import_module(module), function)(*json.loads(self.options.get("arguments", "[]")))
        try:
            cursor = link.cursor()
            where = " AND ".join(f"{c} = ?" for c in self.equal)
            cursor.execute(f"SELECT {', '.join(self.schema.names)} FROM {self.options['table'].format(shard)}{f' WHERE {where}' if where else ''}", tuple(self.equal.values()))
            while rows := cursor.fetchmany(int(self.options.get("fetch", 2000))):
                yield from map(tuple, rows)
        finally:
            link.close()

    def _files(self, shard: int) -> Iterator[pa.RecordBatch]:
        """From Parquet files below ``path``/shard=K; a shard without a folder is empty."""
        import pyarrow.dataset as ds
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        store, inner = fs.FileSystem.from_uri(f"{self.options['path']}/shard={shard}")
        if store.get_file_info(inner).type == fs.FileType.NotFound:
            return
        condition = None
        for column, value in self.equal.items():
            condition = (ds.field(column) == value) if condition is None else condition & (ds.field(column) == value)
        kind = to_arrow_schema(self.schema)
        for batch in ds.dataset(inner, filesystem=store, format="parquet", exclude_invalid_files=False).to_batches(columns=self.schema.names, filter=condition, batch_size=8192):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kind, strict=True)], schema=kind)


class ShardSource(DataSource):
    """Format ``message_shards``: options shards, and path or connect, arguments, table, fetch."""

    @classmethod
    def name(cls) -> str:
        return "message_shards"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, with filters pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RosterSource)
    spark.dataSource.register(ShardSource)


def read_roster(spark: SparkSession, url: str, departments: Iterable[str], **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("roster").options(url=url, departments=json.dumps(list(departments)), **options).load()


def read_shards(spark: SparkSession, schema: str = LOG_SCHEMA, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("message_shards").schema(schema).options(**options).load()
