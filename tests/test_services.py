"""The roster service and the sharded log through Spark's reader."""

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_plans import chat

from parley.functions.hashing import shard_number
from parley.sources import readers, services

PEOPLE = {"A": ["m1", "m2", "m2", "m3", " m4 "], "B": ["m2"], "C": [], "slow": ["x"], "gone": ["y"], "odd": []}


@pytest.fixture(scope="module")
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body["department_id"], body["page"], self.headers.get("Authorization")))
            name, first = body["department_id"], (body["page"] - 1) * body["page_size"]
            tries = sum(a[:2] == (name, body["page"]) for a in asked)
            status = 503 if name == "slow" and tries == 1 else 429 if name == "slow" and tries == 2 else 404 if name == "gone" else 500 if name == "down" else 200
            answer = {"total": "many"} if name == "odd" else {"total": len(PEOPLE.get(name, [])), "manager_ids": PEOPLE.get(name, [])[first : first + body["page_size"]]}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/", asked
    server.shutdown()


def test_rosters_by_pages(spark, service):
    url, asked = service
    rows = services.read_roster(spark, url, ["A", "B", "C", "slow"], page_size="2", pause="0.01", token="t")
    got = {}
    for r in rows.collect():
        got.setdefault(r.department, []).append(r.manager)
    assert got == {"A": ["m1", "m2", "m3", "m4"], "B": ["m2"], "slow": ["x"]}
    assert {a[2] for a in asked} == {"Bearer t"} and [a[1] for a in asked if a[0] == "A"] == [1, 2, 3]
    assert rows.rdd.getNumPartitions() == 4


def test_departments_that_are_not_asked_for_are_not_called(spark, service):
    url, asked = service
    asked.clear()
    rows = services.read_roster(spark, url, ["A", "B", "gone"])
    assert [r.manager for r in rows.where("department = 'B'").collect()] == ["m2"] and {a[0] for a in asked} == {"B"}
    assert rows.where(F.col("department").isin("B", "C")).count() == 1 and {a[0] for a in asked} == {"B"}
    assert rows.where("department = 'nobody'").count() == 0


@pytest.mark.parametrize("name, calls", [("gone", 1), ("down", 3), ("odd", 1)])
def test_a_page_that_fails_fails_the_department(spark, service, name, calls):
    url, asked = service
    asked.clear()
    with pytest.raises(Exception, match=f"department {name}, page 1"):
        services.read_roster(spark, url, [name], pause="0.01").collect()
    assert len(asked) == calls
    with pytest.raises(services.RosterError, match="more than 2 pages"):
        services.roster_of("d", lambda n: {"total": 99, "manager_ids": [n]}, 1, 2, 1, 0)


def test_shards_of_a_database_and_of_files(spark, tmp_path):
    log = chat(spark, (18, 19)).withColumn("shard", shard_number(F.col("from_user"), 5))
    columns = [c for c in log.columns if c != "shard"]
    path = str(tmp_path / "log.db")
    with sqlite3.connect(path) as link:
        for k in range(1, 6):
            link.execute(f"CREATE TABLE log_{k} ({', '.join(columns)})")
            rows = log.where(F.col("shard") == k).select(*(F.col(c).cast("string") if c == "msg_time" else F.col(c) for c in columns)).collect()
            link.executemany(f"INSERT INTO log_{k} VALUES ({', '.join('?' * len(columns))})", [tuple(r) for r in rows])
    schema = ", ".join(f"{f.name} {'string' if f.name == 'msg_time' else f.dataType.simpleString()}" for f in log.schema.fields if f.name != "shard")
    found = services.read_shards(spark, schema, shards="5", connect="sqlite3:connect", arguments=json.dumps([path]), table="log_{}", fetch="7")
    assert found.count() == log.count() and found.rdd.getNumPartitions() == 5
    want = readers.customer_messages(log, "2026-08-18").select("id", "staff", "customer", "content").collect()
    day = readers.customer_messages(found.withColumn("msg_time", F.to_timestamp("msg_time")), "2026-08-18")
    assert sorted(day.select("id", "staff", "customer", "content").collect()) == sorted(want)
    log.write.partitionBy("shard").parquet(f"file://{tmp_path}/files")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields if f.name != "shard")
    files = services.read_shards(spark, schema, shards="6", path=f"file://{tmp_path}/files")
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, log.drop("shard").collect()))
    assert sorted(readers.customer_messages(files, "2026-08-18").select("id", "staff", "customer", "content").collect()) == sorted(want)


def test_filters_reach_the_shards():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    reader = services.ShardReader(StructType(), {})
    left = list(reader.pushFilters([EqualTo(("create_date",), "2026-08-18"), EqualTo(("msg_type",), "text"), GreaterThan(("id",), 3), EqualTo(("create_date",), "x")]))
    assert reader.equal == {"create_date": "2026-08-18", "msg_type": "text"} and len(left) == 2
