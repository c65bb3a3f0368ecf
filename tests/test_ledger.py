"""Ledger states, resume and retry, limits, lanes, order of objects, draining a stream."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.operators import checks, ledger
from pelorus.plans import dag, waves
from pelorus.plans.limits import GaveUp, HostCoordinator, RateLimiter, is_outage
from pelorus.plans.objects import CheckFailedError, Format, Table, Version
from pelorus.sources.files import attachments, write_each
from pelorus.streaming.drain import drain, windowed_counts

MAIN = Version("main")
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("http_request_id", T.StringType()), ("request_url", T.StringType()), ("response_status", T.IntegerType()), ("requested_at_utc", T.StringType()), ("superseded_by_id", T.StringType()))])


class Requests(waves.Ledger):
    id, supported_versions, kind, schema = "requests", (MAIN,), ledger.HTTP, SCHEMA
    response_columns, rate, wave_rows = ("response_status", "requested_at_utc"), 10_000.0, 3
    answers: dict = {}

    def populate(self):
        return self.spark.createDataFrame([(f"r{k}", f"u{k}", None, None, None) for k in range(5)], self.schema)

    def call(self, request):
        self.calls.append(request.request_url)
        status = self.answers.get(request.request_url, [200])
        status = status.pop(0) if len(status) > 1 else status[0]
        if isinstance(status, Exception):
            raise status
        return {"response_status": status, "requested_at_utc": "now"}


def make(spark, tmp_path, answers, **kw):
    r = Requests(spark, MAIN, str(tmp_path))
    r.calls, r.answers, r.rows_checks = [], answers, ()
    r.make(**kw)
    return r


def test_fresh_resume_complete_and_retry(spark, tmp_path):
    r = make(spark, tmp_path, {"u1": [500], "u2": [OSError("down")]})
    assert sorted(r.calls) == [f"u{k}" for k in range(5)]
    states = {x.http_request_id: x.response_status for x in r.states().collect()}
    assert states == {"r0": 200, "r1": 500, "r2": None, "r3": 200, "r4": 200}
    r = make(spark, tmp_path, {})  # resumes the one that raised; the failed one needs retries
    assert r.calls == ["u2"]
    r = make(spark, tmp_path, {})
    assert r.calls == []
    r = make(spark, tmp_path, {"u1": [503, 200]}, retries=3)
    assert r.calls == ["u1", "u1"]
    rows = {x.http_request_id: x for x in r.states().collect()}
    chain = ["r1"]
    while rows[chain[-1]].superseded_by_id:
        chain.append(rows[chain[-1]].superseded_by_id)
    assert [rows[c].response_status for c in chain] == [500, 503, 200] and r.current().count() == 5
    r.compact()
    assert {x.http_request_id: x.response_status for x in r.states().collect()} == {k: v.response_status for k, v in rows.items()}
    checks.MinRequests(5).run(r)
    checks.MaxFailureRate(frac=0.0).run(r)
    with pytest.raises(CheckFailedError):
        checks.MinRequests(6).run(r)


def test_compaction_survives_a_crash(spark, tmp_path):
    r = make(spark, tmp_path, {})
    want = {x.http_request_id: x.response_status for x in r.states().collect()}
    log, old, aside = r.path(), f"{r.path()}.old", f"{r.path()}.compact"
    r.states().select(*r.log_schema.names).write.parquet(aside)
    r.storage.rename(log, old)  # and then it crashed: the old log is whole
    assert {x.http_request_id: x.response_status for x in r.states().collect()} == want and r.storage.exists(log)
    r.compact()
    assert {x.http_request_id: x.response_status for x in r.states().collect()} == want and not r.storage.exists(old) and not r.storage.exists(aside)
    assert r.log().count() == 5


def test_errors_and_empty_ledgers(spark, tmp_path):
    r = make(spark, tmp_path, {"u1": [OSError("down")]})
    assert [x.http_request_id for x in r.log().where("event = 'error'").collect()] == ["r1"]

    class Nothing(Requests):
        id = "nothing"

        def populate(self):
            return self.spark.createDataFrame([], self.schema)

    none = Nothing(spark, MAIN, str(tmp_path))
    none.make(retries=2)
    assert none.states().count() == 0 and none.summary() == {"total": 0, "failed": 0, "errors": "none"}


def test_interrupted_agent_tasks_run_again(spark, tmp_path):
    from pelorus.operators.ledger_tables import AGENT_TASKS, with_defaults

    class Agents(waves.AgentLedger):
        id, supported_versions, schema, rate = "agents", (MAIN,), AGENT_TASKS, 1e6

        def populate(self):
            return with_defaults(self.spark.createDataFrame([("a", "one"), ("b", None)], "agent_task_id string, task_prompt string"), self.schema, {})

        def call(self, request):
            if request.task_prompt is None:
                raise ValueError
            return {"final_response": "done", "messages": [("assistant", "done")]}

    a = Agents(spark, MAIN, str(tmp_path))
    a._append(a.populate(), "populate")
    a._append(a.states().withColumn("started_at_utc", F.lit("2024-01-01").cast("timestamp_ntz")), "start")  # and then it crashed
    a.execute()
    rows = {x.agent_task_id: x for x in a.states().collect()}
    assert not rows["a"].is_error and rows["a"].final_response == "done" and rows["b"].is_error and rows["b"].error_message == "ValueError"
    assert [(m.agent_task_id, m.content) for m in a.child("messages").collect()] == [("a", "done")] and a.child("tool_calls").count() == 0
    assert a.retry() is not None and a.current().count() == 2


def test_predicates_on_unknown_status(spark):
    df = spark.createDataFrame([("a", 200, "t", None), ("b", 500, "t", None), ("c", None, None, None), ("d", 404, "t", "b"), ("e", None, "t", None)], "http_request_id string, response_status int, requested_at_utc string, superseded_by_id string")

    def ids(x):
        return {r.http_request_id for r in x.collect()}

    assert ids(ledger.failed(df, ledger.HTTP)) == {"b"} and ids(df.where(ledger.HTTP.not_ok())) == {"b", "c", "d", "e"} and ids(ledger.pending(df, ledger.HTTP)) == {"c"} and ids(ledger.current(df)) == {"a", "b", "c", "e"}
    grouped = df.withColumn("g", F.when(F.col("http_request_id") < "c", "one").otherwise("two"))
    assert ids(ledger.failed(grouped, ledger.HTTP, ("g", "one"))) == {"b"} and ids(ledger.pending(grouped, ledger.HTTP, ("g", "one"))) == set() and ids(ledger.pending(grouped, ledger.HTTP, ("g", "two"))) == {"c"}
    row = ledger.failure_rate(df, ledger.HTTP).first()
    assert (row.total, row.failed) == (4, 1) and ledger.failure_rate(df.limit(0), ledger.HTTP).first().rate == 0.0
    assert ledger.error_breakdown(df).first()[0] == "no_status:2,http500:1" and ledger.error_breakdown(df.limit(0)).first()[0] == "none"
    assert [ledger.resume_branch(x, ledger.HTTP, n).first().branch for x, n in ((df.limit(0), 3), (df, 0), (df.where("http_request_id <> 'c'"), 0), (df.where("http_request_id <> 'c'"), 1))] == ["fresh", "resume", "complete", "resume"]
    once = ledger.supersede(df, ledger.HTTP, 1, ["response_status", "requested_at_utc"])
    twice = ledger.supersede(once, ledger.HTTP, 2, ["response_status", "requested_at_utc"])
    assert once.count() == 6 and twice.count() == 6 and ids(ledger.pending(once, ledger.HTTP)) - {"c"} == ids(once) - ids(df)


def test_fold_of_a_hot_key_with_ties(spark):
    log = spark.createDataFrame([("a", s, v, "x") for s in range(50) for v in (1, 2)] + [("b", 1, 9, "y"), (None, 3, 4, None)], "k string, seq long, v int, event string")
    got = {r.k: (r.seq, r.v) for r in ledger.fold(log, "k").collect()}
    assert got == {"a": (49, 2), "b": (1, 9), None: (3, 4)}


def test_lane_results(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 2, 7), ("a", 2, 6), ("b", 1, 1)], "lane string, step long, v int")
    assert {r.lane: r.steps for r in ledger.lane_results(df, "lane", "step", F.col("v")).collect()} == {"a": [[5], [], [6, 7]], "b": [[], [1]]}
    seen = waves.run_lanes(["x", "y"], lambda lane, step, before: None if (lane, step) == ("y", 0) else [f"{lane}{step}{len(before)}"], lambda items: [i.upper() for i in items], lambda _: False, 2)
    assert seen == {"x": [["X00"], ["X11"]], "y": [[], ["Y10"]]}


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 6))
        self.now += s


def test_limits():
    c = Clock()
    limiter = RateLimiter(0.5, 1.0, c, c.sleep)
    for _ in range(3):
        limiter.acquire()
    assert c.slept == [2.0, 2.0]
    h = HostCoordinator(0.2, clock=c, sleep=c.sleep, base=60, ceiling=200, max_outage=1000)
    assert [is_outage(s) for s in (200, 404, 500, 429, 502, 503, 504, None)] == [False] * 3 + [True] * 5 and [h.delay(k) for k in range(4)] == [60, 120, 200, 200]
    first, second = h.ready("a"), h.ready("a")
    assert c.slept[-1] == 0.2 and first == second
    assert h.report("a", first, 503) and h.report("a", second, 503)  # the second belongs to the same outage
    assert h.ready("b") == 0 and h.ready("a") == 1 and c.slept[-1] == 60.0
    assert not h.report("a", 1, 200) and h.ready("a") == 2
    h.report("a", 2, None)
    c.now += 2000
    with pytest.raises(GaveUp):
        h.ready("a")


@pytest.fixture
def registry():
    before = list(dag._registry)
    yield
    dag._registry[:] = before


class A(Table):
    id, supported_versions, formats, row_model = "a", (MAIN,), (Format.PARQUET, Format.JSONL), T.StructType([T.StructField("n", T.LongType())])

    def build(self):
        return self.spark.range(2).select(F.col("id").alias("n"))


class B(A):
    id = "b"

    def build(self):
        return A(self.spark, self.version, self.root).df


def test_order_lint_and_run(spark, tmp_path, registry):
    a, b = dag.asset(group="g")(A), dag.asset(deps=dag.AUTO, formats=(Format.JSONL,))(B)
    assert dag.ordered([b, a]) == [a, b] and dag.lint(b).is_clean and b in dag.registered(__name__)
    text = dag.manifest([b, a]).split("\n")
    assert text[0].split() == ["asset", "deps", "group", "formats", "kwargs"] and text[2].split() == ["b", "a", "-", "jsonl", "-"]
    made = dag.run(spark, [a, b], "main", root=str(tmp_path))
    assert made[1].df.count() == 2 and made[1].storage.exists(made[1].path(Format.JSONL))
    dag.run(spark, [a, b], "main", root=str(tmp_path))
    b.wiring = dag.Wiring((b,))
    with pytest.raises(ValueError, match="cycle"):
        dag.ordered([a, b])
    b.wiring = dag.Wiring(())
    assert dag.lint(b).missing == (A,)
    for act, error in (
        (lambda: dag.ordered([a, a]), ValueError), (lambda: dag.asset(deps=dag.AUTO)(A), ValueError), (lambda: dag.asset(deps=())(int), TypeError), (lambda: dag.asset(name="x"), ValueError),
        (lambda: dag.with_overrides([a], {a: {"nonsense": 1}}), ValueError), (lambda: dag.with_overrides([a], {b: {}}), ValueError), (lambda: dag.run(spark, [a], "other", root=str(tmp_path)), ValueError),
    ):
        with pytest.raises(error):
            act()


def test_drain_resumes_from_its_checkpoint(spark, tmp_path):
    source, seen, lock = str(tmp_path / "in"), [], threading.Lock()

    def handle(df, _):
        with lock:
            seen.extend(r.id for r in df.collect())

    spark.range(5).write.parquet(source)
    drain(spark, source, spark.range(1).schema, str(tmp_path / "cp"), handle)
    spark.range(5, 8).write.mode("append").parquet(source)
    drain(spark, source, spark.range(1).schema, str(tmp_path / "cp"), handle)
    assert sorted(seen) == list(range(8))
    events = spark.sql("SELECT timestamp_ntz'2025-01-01 10:15:00' AS ts, 'a' AS k UNION ALL SELECT timestamp_ntz'2025-01-01 10:59:00', 'a'")
    assert [r.n for r in windowed_counts(events, "ts", "k", "1 hour", "1 day").collect()] == [2]


def test_files_of_requests(spark, tmp_path):
    asked = spark.createDataFrame([("a", '["2", "9", "1"]'), ("b", None), ("c", "[]"), ("d", "nonsense")], "rid string, ids string")
    files = spark.createDataFrame([(1, "one"), (2, "two")], "fid int, name string")
    got = attachments(asked, files, id_col="rid", list_col="ids", file_id="fid").collect()
    assert [(r.rid, [f.name for f in r.files]) for r in got] == [("a", ["two", "one"])]
    write_each(spark.createDataFrame([("x/y", "1"), ("x/y", "2"), (None, "3"), ("z", None)], "n string, c string"), str(tmp_path / "out"), "n", "c")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"x_y.json": "2"}


def test_ok_aggregates_keep_the_bytes_of_rows_without_a_finite_latency(spark):
    rows = [(200, 10, 1.0), (200, 20, float("nan")), (200, 40, float("inf")), (200, 80, float("-inf")), (200, 160, None), (200, None, 3.0), (500, 320, 9.0), (None, 640, 9.0)]
    df = spark.createDataFrame(rows, "response_status int, response_size long, latency double")
    assert tuple(ledger.ok_aggregates(df).first()) == (310, 2.0)
    assert tuple(ledger.ok_aggregates(df.limit(0)).first()) == (0, 0.0)
