"""Request ledgers: append-only state rows, folded to the latest state of each request.

A ledger's log has the request's columns plus ``seq`` (the wave) and ``event``. A request is pending until attempted,
then done or failed; a failed one may be superseded by a successor. Nothing is ever updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """What the columns of a kind of request are called."""

    key: str
    attempted: str
    label: str

    def pending(self) -> Column:
        return F.col(self.attempted).isNull()

    def attempted_failed(self) -> Column:
        """Failed whether superseded or not; three-valued, so an unknown status is not failed."""
        if self.label == "http":
            return F.col("response_status") != 200
        if self.label == "llm":
            return F.col(self.attempted).isNotNull() & F.col("response_text").isNull()
        return F.col(self.attempted).isNotNull() & F.col("is_error")

    def failed(self) -> Column:
        return self.attempted_failed() & F.col("superseded_by_id").isNull()

    def ok(self) -> Column:
        """A known success: an unknown status is not one."""
        if self.label == "http":
            return F.col("response_status").eqNullSafe(200)
        if self.label == "llm":
            return F.col("response_text").isNotNull()
        return ~F.coalesce("is_error", F.lit(False))

    def not_ok(self) -> Column:
        """What a step retries: unlike :meth:`failed`, an unknown HTTP status counts."""
        if self.label == "http":
            return ~self.ok()
        return F.coalesce(self.attempted_failed(), F.lit(False))


HTTP = Kind("http_request_id", "requested_at_utc", "http")
LLM = Kind("llm_request_id", "requested_at_utc", "llm")
AGENT = Kind("agent_task_id", "started_at_utc", "agent")


def pending(df: DataFrame, kind: Kind, group: tuple[str, str] | None = None) -> DataFrame:
    """Requests not attempted yet, optionally of one group. Superseded ones are out."""
    found = df.where(kind.pending())
    found = found.where(F.col("superseded_by_id").isNull()) if "superseded_by_id" in df.columns else found
    return found.where(F.col(group[0]) == group[1]) if group else found


def failed(df: DataFrame, kind: Kind, group: tuple[str, str] | None = None) -> DataFrame:
    found = df.where(kind.failed())
    return found.where(F.col(group[0]) == group[1]) if group else found


def current(df: DataFrame) -> DataFrame:
    """Rows that no successor replaces."""
    return df.where(F.col("superseded_by_id").isNull())


def fold(log: DataFrame, key: str, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The latest state row of each key. States are merged before the shuffle, so a key with a third of all rows costs
    no more than others; that is worth the sort that ``max_by`` over a struct takes in each partition, since a join back
    on the latest number would shuffle every state of every key. Ties of ``order`` go to the greatest row; a null key is a key."""
    columns = [c for c in log.columns if c != key]
    state = F.struct(*(F.col(c).alias(c) for c in columns))
    latest = log.groupBy(key).agg(F.max_by(state, F.struct(*(F.col(c) for c in order), *(F.col(c) for c in columns if c not in order))).alias("_s"))
    return latest.select(key, *(F.col("_s")[c].alias(c) for c in columns))


def successor_id(key: Column, attempt: Column) -> Column:
    """A successor's id follows from the old id and the attempt, so a repeated task makes no second successor."""
    return F.sha2(F.concat_ws("#", key.cast("string"), attempt.cast("string")), 256)


def successors(failed_rows: DataFrame, key: str, attempt: int, cleared: Sequence[str]) -> DataFrame:
    """New pending rows for failed ones: same request, new id, response columns cleared."""
    by = {f.name: f.dataType for f in failed_rows.schema}
    return failed_rows.select(
        *(
            successor_id(F.col(c), F.lit(attempt)).alias(c) if c == key else F.lit(None).cast(by[c]).alias(c) if c in cleared or c == "superseded_by_id" else F.col(c)
            for c in failed_rows.columns
        )
    )


def supersede(df: DataFrame, kind: Kind, attempt: int, cleared: Sequence[str]) -> DataFrame:
    """The ledger after a retry: failed rows marked with their successors, and the successors, as one append."""
    marked = df.withColumn("superseded_by_id", F.when(F.coalesce(kind.failed(), F.lit(False)), successor_id(F.col(kind.key), F.lit(attempt))).otherwise(F.col("superseded_by_id").cast("string")))
    fresh = successors(failed(df, kind), kind.key, attempt, cleared).withColumn("superseded_by_id", F.lit(None).cast("string"))
    return marked.withColumn(kind.key, F.col(kind.key).cast("string")).unionByName(fresh)


def resume_branch(df: DataFrame, kind: Kind, retries: Column | int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """``fresh``, ``resume`` or ``complete`` of a ledger or its groups, from one aggregate."""
    tries = F.lit(retries) if isinstance(retries, int) else retries
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kind.pending()).alias("pending"), F.count_if(F.coalesce(kind.failed(), F.lit(False))).alias("failed")
    )
    branch = F.when(F.col("rows") == 0, "fresh").when((F.col("pending") > 0) | ((tries > 0) & (F.col("failed") > 0)), "resume").otherwise("complete")
    return counted.withColumn("branch", branch)


def status_histogram(df: DataFrame, status: str = "response_status") -> DataFrame:
    """Current requests per status, unknown included."""
    return current(df).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def ok_aggregates(df: DataFrame) -> DataFrame:
    """Bytes and mean latency of all rows with status 200, superseded or not; zeros without any. A latency that is NaN or
    infinite is left out of the mean only."""
    good = F.col("response_status") == 200
    finite = ~F.isnan("latency") & (F.abs("latency") < float("inf"))
    return df.agg(
        F.coalesce(F.sum(F.when(good, F.col("response_size"))), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.avg(F.when(good & finite, F.col("latency"))), F.lit(0.0)).alias("avg_latency_s"),
    )


def failure_rate(df: DataFrame, kind: Kind, groups: Sequence[str] = ()) -> DataFrame:
    """``(total, failed, rate)`` of the current rows; the rate of no rows is 0."""
    rows = current(df).groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(kind.failed(), F.lit(False))).alias("failed"))
    return rows.withColumn("rate", F.coalesce(F.try_divide("failed", "total"), F.lit(0.0)))


def most_common(counts: DataFrame, label: str, n: str, groups: Sequence[str] = ()) -> DataFrame:
    """``label:n,...`` by falling count, then label; ``none`` without rows. One label per row: labels are few, as statuses or error names are."""
    entry = F.struct((-F.col(n)).alias("neg"), F.col(label).alias("label"))
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["label"], F.lit(":"), (-e["neg"]).cast("string"))))
    return counts.groupBy(*groups).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit("none")).alias("most_common"))


def error_breakdown(df: DataFrame) -> DataFrame:
    """The current requests that are not ok, as ``http<status>:n`` or ``no_status:n``."""
    bad = current(df).where(~HTTP.ok()).groupBy(F.coalesce(F.concat(F.lit("http"), F.col("response_status").cast("string")), F.lit("no_status")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return most_common(bad, "label", "n")


def lane_results(df: DataFrame, lane: str, step: str, item: Column) -> DataFrame:
    """Per lane the items of its steps from 0 to the last, empty lists for missing steps: ``(lane, steps)``.

    Lists are collected per (lane, step) first; a lane's result is one value by definition, so it must fit a row.
    """
    by_step = df.groupBy(lane, step).agg(F.array_sort(F.collect_list(item)).alias("items"))
    pairs = by_step.groupBy(lane).agg(F.map_from_entries(F.collect_list(F.struct(F.col(step), F.col("items")))).alias("m"), F.max(step).alias("last"))
    empty = F.filter(F.element_at(F.map_values("m"), 1), lambda _: F.lit(False))
    return pairs.select(lane, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint")), lambda k: F.coalesce(F.try_element_at("m", k), empty)).alias("steps"))


def joined_statuses(http: DataFrame, llm: DataFrame) -> DataFrame:
    """Current model requests per status of their HTTP request; never sent ones are not in it."""
    return current(llm).select("http_request_id").join(http.select("http_request_id", "response_status"), "http_request_id").groupBy("response_status").agg(F.count(F.lit(1)).alias("n"))


def model_statuses(http: DataFrame, llm: DataFrame) -> DataFrame:
    """Current model requests by ``http<status>`` of their HTTP request; ``no_http`` where there is none or no status."""
    sent = current(llm).select("http_request_id").join(http.select("http_request_id", "response_status"), "http_request_id", "left")
    label = F.coalesce(F.concat(F.lit("http"), F.col("response_status").cast("string")), F.lit("no_http"))
    return sent.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def model_cost(llm: DataFrame, cost: Column) -> DataFrame:
    """One row: the cost of all answered model requests, superseded ones included; 0 without any."""
    return llm.agg(F.coalesce(F.sum(F.when(F.col("response_text").isNotNull(), cost)), F.lit(0.0)).alias("cost_usd"))


def ok_with_extra(df: DataFrame, kind: Kind, extra: DataFrame, key: str) -> DataFrame:
    """Successful requests with the project's extra columns; those without extra columns are left out."""
    return df.where(kind.ok()).join(extra, key)


def throughput(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row ``(total, seconds, rps)`` from the first start to the last end; no rate without a duration."""
    spent = F.timestamp_diff("MICROSECOND", F.min(start), F.max(end)) / 1e6
    return df.agg(F.count(F.lit(1)).alias("total"), spent.alias("seconds")).withColumn("rps", F.try_divide("total", "seconds"))


def agent_totals(df: DataFrame) -> DataFrame:
    return current(df).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("num_turns"), F.lit(0)).alias("turns"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
    )
