"""Ledger schemas, project tables, calls over HTTP, children and lookups."""

import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from pelorus.functions.numbers import utc_now
from pelorus.operators import ledger_tables as tables
from pelorus.plans.figure import Figure, use_style
from pelorus.plans.limits import HostCoordinator
from pelorus.sources.http import caller, fetch


def test_project_tables(spark, tmp_path):
    name, schema, defaults = tables.project_table("weather", "http_request_groups", {"city": str, "retries": (int, 3), "note": str | None})
    assert name == "weather_http_request_groups" and defaults == {"retries": 3}
    assert {f.name: (f.dataType.simpleString(), f.nullable) for f in schema} == {
        "http_request_group_id": ("string", False), "created_at_utc": ("timestamp_ntz", True), "created_by_class": ("string", True), "city": ("string", False), "retries": ("bigint", False), "note": ("string", True),
    }
    assert "created_by_class" not in tables.project_table("w", "llm_requests_extra")[1].names
    with pytest.raises(ValueError):
        tables.project_table("w", "http_request_groups", {"created_at_utc": str})
    row = tables.with_defaults(spark.createDataFrame([("g", "Aa")], "http_request_group_id string, city string"), schema, defaults).first()
    assert (row.retries, row.note, row.city) == (3, None, "Aa")
    made = {"http_requests": tables.HTTP_REQUESTS, "groups": schema}
    tables.create_tables(spark, str(tmp_path), made)
    spark.createDataFrame([Row(a=1)]).write.mode("overwrite").parquet(str(tmp_path / "groups"))
    tables.create_tables(spark, str(tmp_path), made)  # existing ones stay
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 1 and spark.read.parquet(str(tmp_path / "http_requests")).columns == tables.HTTP_REQUESTS.names
    tables.create_tables(spark, str(tmp_path), made, replace=True)
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 0
    tables.drop_tables(spark, str(tmp_path), ["groups"])
    assert not (tmp_path / "groups").exists()


def test_children_lookup_flatten(spark):
    tasks = spark.createDataFrame([("t", [("read", "x"), ("write", "y")]), ("u", [])], "agent_task_id string, calls array<struct<tool:string,input:string>>")
    calls = tables.children(tasks, "agent_task_id", F.col("calls"), "call_id").collect()
    assert [(c.agent_task_id, c.place, c.tool) for c in sorted(calls, key=lambda c: c.place)] == [("t", 0, "read"), ("t", 1, "write")] and len({c.call_id for c in calls}) == 2
    dimension = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    assert {r.name for r in tables.lookup(spark.createDataFrame([(1,), (2,), (2,)], "k int"), dimension, "k").collect()} == {"one", "two"}
    with pytest.raises(PySparkException, match="unknown k: 3"):
        tables.lookup(spark.createDataFrame([(3,)], "k int"), dimension, "k").collect()
    nested = spark.createDataFrame([(1, ("a", 2))], "i int, model struct<id:string,size:int>")
    flat = tables.flattened(nested, "model", "model_")
    assert flat.columns == ["i", "model_id", "model_size"] and tables.gathered(flat, "model", ["id", "size"], "model_").collect() == nested.collect()


class Handler(BaseHTTPRequestHandler):
    seen: list = []
    statuses: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
        self.seen.append((self.path, self.headers.get("X-Key"), body))
        self.send_response(self.statuses.pop(0) if self.statuses else 200)
        self.end_headers()
        self.wfile.write(b"ok\xff")

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Handler.seen, Handler.statuses = [], []
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_calls(server):
    Handler.statuses = [404]
    answer = fetch("post", f"{server}/a", {"X-Other": "1"}, "hällo", {"X-Key": "secret"})
    assert answer["response_status"] == 404 and answer["response_body_text"] == "ok�" and answer["response_size"] == 3 and answer["latency"] >= 0
    assert Handler.seen == [("/a", "secret", "hällo".encode())] and "secret" not in json.dumps(answer, default=str)
    Handler.statuses = [503, 200]
    waits = []
    call = caller({"X-Key": "s"}, HostCoordinator(base=0.01, sleep=waits.append))
    assert call(Row(request_method="POST", request_url=f"{server}/b", request_headers=None, request_body=None))["response_status"] == 200 and len(waits) == 1
    with pytest.raises(ValueError):
        fetch("GET", "file:///etc/passwd")
    with pytest.raises(OSError):
        fetch("GET", "http://127.0.0.1:9/", timeout=2)


def test_time_and_styles(spark):
    fixed = datetime(2026, 1, 2, 3, 4, 5)
    row = spark.range(1).select(utc_now(fixed).alias("a"), utc_now().alias("b")).first()
    assert row.a == fixed and abs((row.b - datetime.now(timezone.utc).replace(tzinfo=None)).total_seconds()) < 600
    with pytest.raises(KeyError):
        use_style("nonsense")
    assert Figure.kinds == ("png", "pdf", "svg")
