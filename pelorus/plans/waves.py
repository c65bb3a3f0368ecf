"""Executing a ledger's requests: waves of bounded size, retries, lanes of steps.

Calls have side effects and tasks may run twice, so by default a pool on the driver makes them under one exact rate
limit; :func:`map_requests` spreads calls that may be repeated over the executors.
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import islice
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.operators.ledger import (
    AGENT, HTTP, LLM, Kind, agent_totals, current, error_breakdown, failed, failure_rate, fold, model_statuses, most_common, ok_aggregates, pending, resume_branch, successor_id, successors,
)
from pelorus.operators.ledger_tables import AGENT_MESSAGES, AGENT_TOOL_CALLS
from pelorus.plans.journal import format_summary, logger
from pelorus.plans.limits import RateLimiter
from pelorus.plans.lineage import cut, scratch
from pelorus.plans.objects import DataObject, Format

Call = Callable[[Row], dict[str, Any]]


#: Calls per second by kind of request, and after how many calls progress is told.
RATES = {"http": 5.0, "llm": 1.0, "agent": 1.0}
PROGRESS = {"http": 100, "llm": 100, "agent": 10}
Group = tuple[str, Any]


@dataclass
class WaveResult:
    done: int = 0
    raised: Counter = field(default_factory=Counter)


class Ledger(DataObject):
    """A queue of requests and responses. Define ``populate`` (a DataFrame of requests) and ``call``.

    ``response_columns`` are what ``call`` returns; ``schema`` is the request's. A call that raises leaves its request
    pending and an ``error`` event in the log. One wave is one append, so a crash repeats at most ``wave_rows`` calls.
    One driver writes a ledger at a time.

    With ``steps`` the requests come in steps: ``populate_step`` gets the results of the step before, of all lanes at
    once (a lane is a column, its steps run in order), and retries belong to the step.
    """

    make_format = Format.PARQUET
    formats = (Format.PARQUET,)
    kind: ClassVar[Kind]
    schema: ClassVar[T.StructType]
    response_columns: ClassVar[Sequence[str]] = ()
    rate: ClassVar[float | None] = None
    period: ClassVar[float] = 1.0
    wave_rows: ClassVar[int] = 500
    workers: ClassVar[int] = 16
    steps: ClassVar[int] = 0
    step_column: ClassVar[str] = "step"

    def populate(self) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} must define populate")

    def populate_step(self, step: int, before: DataFrame | None) -> DataFrame | None:
        """Requests of a step from the current rows of the last step that had any; ``None`` skips the step."""
        raise NotImplementedError(f"{type(self).__name__} must define populate_step")

    def call(self, request: Row) -> dict[str, Any]:
        raise NotImplementedError(f"{type(self).__name__} must define call")

    # state

    @property
    def log_schema(self) -> T.StructType:
        return T.StructType([*self.schema, T.StructField("seq", T.LongType()), T.StructField("event", T.StringType())])

    def log(self) -> DataFrame:
        self._mend()
        if not self.storage.exists(self.path()):
            return self.spark.createDataFrame([], self.log_schema)
        return self.spark.read.schema(self.log_schema).parquet(self.path())

    def states(self) -> DataFrame:
        return fold(self.log(), self.kind.key)

    @property
    def df(self) -> DataFrame:
        return self.states()

    def current(self, group: Group | None = None) -> DataFrame:
        """Rows that no successor replaces, of all or of one group."""
        rows = current(self.states())
        return rows.where(F.col(group[0]) == group[1]) if group else rows

    def _append(self, df: DataFrame, event: str | None = None) -> None:
        """Add state rows under the next number; without ``event`` the rows bring their own."""
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        named = F.lit(event) if event else F.col("event")
        ready = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), F.lit(seq).cast("bigint").alias("seq"), named.alias("event"))
        ready.write.mode("append").parquet(self.path())

    def compact(self) -> None:
        """Rewrite the log as one state row per request. At any time either the old or the new log is whole: the old one
        is renamed, then the new one takes its place, and a crash in between is mended by the next reading."""
        self._mend()
        aside, old = f"{self.path()}.compact", f"{self.path()}.old"
        self.storage.delete(aside)
        self.storage.delete(old)
        self.states().select(*self.log_schema.names).write.parquet(aside)
        self.storage.rename(self.path(), old)
        self.storage.rename(aside, self.path())
        self.storage.delete(old)

    def _mend(self) -> None:
        old = f"{self.path()}.old"
        if not self.storage.exists(self.path()) and self.storage.exists(old):
            self.storage.rename(old, self.path())

    # running

    def make(self, replace: bool = False, retries: int = 0) -> Ledger:
        """Fresh, resumed or complete by what the ledger holds; then retries, README and checks."""
        began = time.time()
        if replace:
            self.delete()
        branch = resume_branch(self.states(), self.kind, retries).first()["branch"]
        if self.steps:
            self.make_graph(retries)
        else:
            if branch == "fresh":
                self._append(self.populate(), "populate")
            if branch != "complete":
                self._run(retries)
        summary = self.summary()
        took = time.time() - began
        logger.info(format_summary("make", {"branch": branch, **summary, "rps": f"{summary['total'] / max(took, 1e-9):.2f}", "path": self.path()}))
        self.write_readme()
        self.run_checks()
        return self

    def make_graph(self, retries: int = 0) -> Ledger:
        """All steps in order. A step that has rows already is not populated again, only run to its end."""
        before: DataFrame | None = None
        for step in range(self.steps):
            group = (self.step_column, step)
            if self.states().where(F.col(group[0]) == step).isEmpty():
                fresh = self.populate_step(step, before)
                if fresh is None or fresh.isEmpty():
                    continue
                self._append(fresh.withColumn(self.step_column, F.lit(step)), "populate")
            self._run(retries, group)
            before = self.current(group)
        return self

    def _run(self, retries: int, group: Group | None = None) -> None:
        self.execute(group=group)
        for _ in range(retries):
            if not self.retry(group):
                break

    def execute(self, limiter: RateLimiter | None = None, group: Group | None = None) -> WaveResult:
        """Call each pending request once, wave by wave. The log is folded once; the driver holds a bounded part of it."""
        result = WaveResult()
        limiter = limiter or RateLimiter(self.rate or RATES[self.kind.label], self.period)
        with scratch(self.spark):
            todo = cut(pending(self.states(), self.kind, group).select(*self.schema.names))
            parts = -(-todo.count() // 20_000)
            rows = (todo.repartition(parts) if parts > 1 else todo).toLocalIterator()
            while wave := list(islice(rows, self.wave_rows)):
                self._wave(wave, limiter, result)
        return result

    def _wave(self, rows: list[Row], limiter: RateLimiter, result: WaveResult) -> None:
        answers = []

        def one(row: Row) -> dict[str, Any]:
            limiter.acquire()
            return {**row.asDict(), **self.call(row)}

        with ThreadPoolExecutor(self.workers) as pool:
            running = {pool.submit(one, row): row for row in rows}
            for future in as_completed(running):
                if error := future.exception():
                    result.raised[type(error).__name__] += 1
                    answers.append({**running[future].asDict(), "event": "error"})
                else:
                    result.done += 1
                    answers.append({**future.result(), "event": "response"})
                self._tell(result)
        self._append_rows(answers)

    def _tell(self, result: WaveResult) -> None:
        n = result.done + result.raised.total()
        if n % PROGRESS[self.kind.label] == 0:
            logger.info("progress %s: %d called, %d raised", self.stem, n, result.raised.total())

    def _append_rows(self, rows: list[dict[str, Any]]) -> None:
        kind = T.StructType([*self.schema, T.StructField("event", T.StringType())])
        self._append(self.spark.createDataFrame([tuple(r.get(n) for n in kind.names) for r in rows], kind))

    def retry(self, group: Group | None = None) -> WaveResult | None:
        """Append successors of the failed rows and the marks on these, in one append; then call the successors."""
        bad = failed(self.states(), self.kind, group).select(*self.schema.names)
        if bad.isEmpty():
            return None
        attempt = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        with scratch(self.spark):
            marked = bad.withColumn("superseded_by_id", successor_id(F.col(self.kind.key), F.lit(attempt)))
            fresh = successors(bad, self.kind.key, attempt, self.response_columns)
            self._append(cut(marked.unionByName(fresh)), "supersede")
        return self.execute(group=group)

    def summary(self) -> dict[str, object]:
        """Total and failed requests, and by kind what its columns can tell."""
        states = self.states()
        row = failure_rate(states, self.kind).first()
        found: dict[str, object] = {"total": row["total"], "failed": row["failed"]}
        if self.kind.label == "http":
            if {"response_size", "latency"} <= set(states.columns):
                found |= ok_aggregates(states).first().asDict()
            found["errors"] = error_breakdown(states).first()[0]
        elif self.kind.label == "agent" and {"total_cost_usd", "num_turns", "duration_ms"} <= set(states.columns):
            totals = agent_totals(states).first().asDict()
            found |= {k: v for k, v in totals.items() if k != "total"}
        return found


class ModelLedger(Ledger):
    """Model requests that go out through a ledger of HTTP requests: ``http()``.

    ``requests`` makes the HTTP rows and ``answers`` reads the responses, both as DataFrames. An HTTP request's id follows
    from that of its model request, so a crash between the two appends repeats nothing: the row that is there already is
    linked by the next run. A call that raises leaves both rows pending.
    """

    kind = LLM
    response_columns = ("http_request_id", "response_text", "requested_at_utc")

    def http(self) -> Ledger:
        raise NotImplementedError(f"{type(self).__name__} must define http")

    def requests(self, rows: DataFrame) -> DataFrame:
        """HTTP requests for model requests; ``http_request_id`` and absent columns of the HTTP ledger are filled in."""
        raise NotImplementedError(f"{type(self).__name__} must define requests")

    def answers(self) -> Column:
        """The answer, from the model request's columns and ``response_status`` and ``response_body_text``."""
        raise NotImplementedError(f"{type(self).__name__} must define answers")

    def execute(self, limiter: RateLimiter | None = None, group: Group | None = None) -> WaveResult:
        http, key = self.http(), HTTP.key
        with scratch(self.spark):
            todo = cut(pending(self.states(), self.kind, group).select(*self.schema.names))
            linked = todo.withColumn(key, F.coalesce(key, F.sha2(F.concat(F.col(self.kind.key), F.lit("#http")), 256)))
            asked = self.requests(linked)
            wanted = asked.select(*((F.col(f.name) if f.name in asked.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in http.schema))
            fresh = cut(wanted.join(http.states().select(key), key, "left_anti"))
            if not fresh.isEmpty():
                http._append(fresh, "populate")
            if not todo.where(F.col(key).isNull()).isEmpty():
                self._append(linked.join(todo.where(F.col(key).isNull()).select(self.kind.key), self.kind.key, "left_semi"), "link")
            result = http.execute(limiter)
            done = http.states().where(F.col(HTTP.attempted).isNotNull()).select(key, F.col(HTTP.attempted).alias("_at"), "response_status", "response_body_text")
            read = linked.drop(self.kind.attempted, "response_text").join(done, key)
            ready = cut(read.withColumn("response_text", self.answers()).withColumnRenamed("_at", self.kind.attempted).select(*self.schema.names))
            if not ready.isEmpty():
                self._append(ready, "response")
        return result

    def orphans(self) -> DataFrame:
        """HTTP requests that no model request links to."""
        return self.http().states().join(self.states().select(HTTP.key), HTTP.key, "left_anti")

    def summary(self) -> dict[str, object]:
        labels = model_statuses(self.http().states(), self.states())
        return {**super().summary(), "statuses": most_common(labels, "label", "n").first()[0]}


class AgentLedger(Ledger):
    """Tasks for an agent. ``call`` returns ``final_response`` and may return ``num_turns``, ``total_cost_usd``,
    ``messages`` as (role, content) and ``tool_calls`` as (name, input, output, is_error).

    A task is marked as started before it runs. What it raises, or an answer that is no JSON although ``output_format``
    asks for it, is kept in the row as an error. Messages and tool calls go to tables beside the ledger, with ids that
    follow from task and place. Tasks that a crash left started and not completed run again.
    """

    kind = AGENT
    response_columns = ("started_at_utc", "completed_at_utc", "final_response", "num_turns", "duration_ms", "total_cost_usd", "is_error", "error_message")

    def execute(self, limiter: RateLimiter | None = None, group: Group | None = None) -> WaveResult:
        broken = self.states().where(F.col("started_at_utc").isNotNull() & F.col("completed_at_utc").isNull() & F.col("superseded_by_id").isNull())
        if not broken.isEmpty():
            with scratch(self.spark):
                self._append(cut(broken.withColumn("started_at_utc", F.lit(None))), "reset")
        return super().execute(limiter, group)

    def _wave(self, rows: list[Row], limiter: RateLimiter, result: WaveResult) -> None:
        started = [{**r.asDict(), "started_at_utc": self.now(), "event": "start"} for r in rows]
        self._append_rows(started)
        with ThreadPoolExecutor(self.workers) as pool:
            done = list(pool.map(lambda row: self._task(row, limiter), started))
        keep = {"messages": [], "tool_calls": []}
        for row in done:
            result.done += 1
            self._tell(result)
            for place, (role, content) in enumerate(row.pop("messages", ())):
                keep["messages"].append((f"{row[self.kind.key]}#m{place}", row[self.kind.key], place, role, content, row["completed_at_utc"]))
            for place, (name, given, output, is_error) in enumerate(row.pop("tool_calls", ())):
                keep["tool_calls"].append((f"{row[self.kind.key]}#t{place}", row[self.kind.key], place, name, given, output, is_error))
        for name, schema in (("messages", AGENT_MESSAGES), ("tool_calls", AGENT_TOOL_CALLS)):
            if keep[name]:
                self.spark.createDataFrame(keep[name], schema).write.mode("append").parquet(self.child_path(name))
        self._append_rows(done)

    @staticmethod
    def now() -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)

    def _task(self, row: dict[str, Any], limiter: RateLimiter) -> dict[str, Any]:
        limiter.acquire()
        began = time.monotonic()
        try:
            answer = {"is_error": False, **self.call(Row(**row))}
            if row.get("output_format") and not answer["is_error"] and (error := _no_json(answer.get("final_response"))):
                answer |= {"is_error": True, "error_message": error}
        except Exception as error:  # noqa: BLE001 - whatever a task raises is its result
            answer = {"is_error": True, "error_message": f"{type(error).__name__} {error}".strip()}
        return {**row, **answer, "completed_at_utc": self.now(), "duration_ms": int((time.monotonic() - began) * 1000), "event": "response"}

    def child_path(self, name: str) -> str:
        return f"{self.directory}/{self.stem}.{name}.parquet"

    def child(self, name: str) -> DataFrame:
        """``messages`` or ``tool_calls``, each once."""
        schema = {"messages": AGENT_MESSAGES, "tool_calls": AGENT_TOOL_CALLS}[name]
        if not self.storage.exists(self.child_path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.child_path(name)).dropDuplicates([schema.names[0]])


def _no_json(text: str | None) -> str | None:
    if not (text or "").strip():
        return "empty response"
    try:
        json.loads(text)
    except ValueError:
        return "response is not valid JSON"
    return None


def map_requests(df: DataFrame, call: Call, schema: T.StructType, rate: float, tasks: int) -> DataFrame:
    """Calls from the executors for requests that may be repeated; every task takes its share of the rate."""
    share = rate / tasks

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        limiter = RateLimiter(share)
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False):
                limiter.acquire()
                row = Row(**dict(zip(pdf.columns, values)))
                out.append({**row.asDict(), **call(row)})
            yield pd.DataFrame(out, columns=schema.names)

    return df.repartition(tasks).mapInPandas(run, schema)


def run_lanes(lanes: Sequence[str], populate: Callable[[str, int, list], list | None], execute: Callable[[list], list], not_ok: Callable[[Any], bool], steps: int, max_retries: int = 0) -> dict[str, list[list]]:
    """Lanes side by side, steps of a lane in order. Step k gets the results of step k - 1; ``None`` skips a step; failed
    items are executed again up to ``max_retries`` times. The result has an empty list for a skipped step."""

    def lane_results(lane: str) -> list[list]:
        results: list[list] = []
        before: list = []
        for step in range(steps):
            items = populate(lane, step, before)
            if items is None:
                results.append([])
                continue
            found = execute(items)
            for _ in range(max_retries):
                again = [x for x in found if not_ok(x)]
                if not again:
                    break
                found = [x for x in found if not not_ok(x)] + execute(again)
            results.append(found)
            before = found
        return results

    with ThreadPoolExecutor(max(1, len(lanes))) as pool:
        return dict(zip(lanes, pool.map(lane_results, lanes)))
