"""Queries of the engine's own operators over the tables of a data directory, with their SQL.

Every query reads its whole tables. A row that stands in a ledger table more than once is one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.functions import jsontext, numbers, text
from pelorus.operators import checks, ledger, ledger_tables
from pelorus.operators.asof import last_before
from pelorus.operators.ledger import AGENT, HTTP, LLM
from pelorus.plans.objects import Version
from pelorus.sources import files as file_sources
from pelorus.sources.sql import query
from pelorus.sources.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _http(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "http_requests").select("http_request_id", *columns).distinct()


def _llm(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "llm_requests").select("llm_request_id", *columns).distinct()


def _agent(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Tasks; the table holds no successors, so all are current."""
    return table(spark, d, "agent_tasks").select("agent_task_id", *columns).distinct().withColumn("superseded_by_id", F.lit(None).cast("string"))


# --- builds: SQL templates, projections, summaries


@_query("""SELECT l_returnflag, min(l_quantity) AS qty_min, round(avg(l_quantity), 6) AS qty_mean, max(l_quantity) AS qty_max, round(sum(l_extendedprice), 2) AS price_total
FROM lineitem GROUP BY l_returnflag""")
def build_group_summary(spark: SparkSession, d: str) -> DataFrame:
    sql = """SELECT l_returnflag, min(l_quantity) AS qty_min, round(avg(l_quantity), 6) AS qty_mean, max(l_quantity) AS qty_max, round(sum(l_extendedprice), 2) AS price_total
        FROM {lineitem} GROUP BY l_returnflag ORDER BY l_returnflag NULLS LAST;"""
    return query(spark, sql, frames={"lineitem": table(spark, d, "lineitem")})


_CITY = """WITH r AS (SELECT DISTINCT lower(trim(city)) AS city, ts_utc, CASE WHEN temp_c BETWEEN -95 AND 62 THEN temp_c END AS temp_c, precip_mm FROM {t})
SELECT city, min(temp_c) AS temp_min_c, round(avg(temp_c), 6) AS temp_mean_c, max(temp_c) AS temp_max_c, round(sum(precip_mm), 4) AS precip_total_mm FROM r GROUP BY city"""


@_query(_CITY.replace("{t}", "weather_hourly"))
def build_city_summary(spark: SparkSession, d: str) -> DataFrame:
    """All hours of each city; an unusable temperature is left out of the temperatures only."""
    return query(spark, _CITY, frames={"t": table(spark, d, "weather_hourly")})


@_query("""SELECT CAST(c1 AS BIGINT) AS widget_id, c2 AS name, CAST(c3 AS BIGINT) AS value FROM (VALUES (1, 'alpha', 10), (2, 'beta', 20), (3, 'gamma', 30)) AS t(c1, c2, c3) WHERE c1 > 0""")
def build_values_cast(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT c1::BIGINT AS widget_id, c2::STRING AS name, c3::BIGINT AS value FROM (VALUES (1, 'alpha', 10), (2, 'beta', 20), (3, 'gamma', :third)) AS t(c1, c2, c3) WHERE c1 > 0;"
    return query(spark, sql, {"third": 30})


@_query("SELECT r_name, 'extra' AS note, CAST(r_regionkey AS BIGINT) AS id FROM region")
def build_literal_projection(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, "SELECT r_name, :note AS note, r_regionkey::BIGINT AS id FROM {region}", {"note": "extra"}, {"region": table(spark, d, "region")})


@_query("""SELECT r_regionkey, key, value FROM (
  SELECT r_regionkey, 'name' AS key, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'id' AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region)""")
def unpivot_key_value(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT r_regionkey, key, value FROM (SELECT r_regionkey, r_name AS name, r_regionkey::STRING AS id FROM {region}) UNPIVOT (value FOR key IN (name, id))"
    return query(spark, sql, frames={"region": table(spark, d, "region")})


@_query("SELECT * FROM (VALUES ('id', 'main'), ('name', 'Main'), ('description', 'every city')) AS t(key, value)")
def version_key_value(spark: SparkSession, d: str) -> DataFrame:
    return Version("main", "Main", "every city").snapshot(spark)


# --- checks


@_query("SELECT count(*) AS n, count(*) >= 1 AS ok FROM orders")
def check_min_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a table, and whether the check of at least one row holds."""
    from pelorus.plans.objects import Table

    class Orders(Table):
        id, supported_versions, checks = "orders", (Version("main"),), (checks.MinRows(1),)

        @property
        def df(self) -> DataFrame:
            return table(spark, d, "orders")

    orders = Orders(spark, Version("main"), "/nowhere")
    try:
        orders.run_checks()
        ok = True
    except checks.CheckFailedError:
        ok = False
    return orders.df.agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.lit(ok))


@_query("SELECT count(*) AS rows, count(*) - count(response_status) AS response_status_nulls, count(*) - count(latency) AS latency_nulls, count(*) - count(request_url) AS request_url_nulls FROM http_requests")
def check_no_nulls(spark: SparkSession, d: str) -> DataFrame:
    return checks.null_counts(table(spark, d, "http_requests"), ["response_status", "latency", "request_url"])


@_query("SELECT count(*) AS groups, CAST(max(n) AS BIGINT) AS largest FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def check_unique(spark: SparkSession, d: str) -> DataFrame:
    return checks.largest_group(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT event_id FROM events WHERE event_id % 5 < 3 OR NOT coalesce(regexp_matches(props, '^\\{\"k\": -?[0-9]+\\}$'), false)")
def check_schema_matches(spark: SparkSession, d: str) -> DataFrame:
    """Events whose JSON is broken off, has another key or another type."""
    part = F.col("event_id") % 5
    text_ = F.when(part == 0, F.expr("left(props, length(props) - 1)")).when(part == 1, F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(part == 2, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    return table(spark, d, "events").where(~jsontext.matches_schema(text_, T.StructType([T.StructField("k", T.LongType(), False)]))).select("event_id")


@_query()
def check_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of the data directory itself."""
    return checks.file_metrics(file_sources.listing(spark, d), small=2000)


# --- ledgers

_H = "(SELECT DISTINCT http_request_id, http_request_group_id, response_status, response_size, latency, requested_at_utc, superseded_by_id FROM http_requests)"
_L = "(SELECT DISTINCT llm_request_id, http_request_id, response_text, requested_at_utc, superseded_by_id FROM llm_requests)"


@_query(f"SELECT http_request_id FROM {_H} WHERE requested_at_utc IS NULL AND superseded_by_id IS NULL")
def ledger_pending(spark: SparkSession, d: str) -> DataFrame:
    return ledger.pending(_http(spark, d, "requested_at_utc", "superseded_by_id"), HTTP).select("http_request_id")


@_query(f"SELECT http_request_group_id, count(*) AS n FROM {_H} WHERE requested_at_utc IS NULL AND superseded_by_id IS NULL GROUP BY http_request_group_id")
def ledger_pending_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _http(spark, d, "http_request_group_id", "requested_at_utc", "superseded_by_id")
    return ledger.pending(rows, HTTP).groupBy("http_request_group_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT http_request_id, response_status FROM {_H} WHERE response_status <> 200 AND superseded_by_id IS NULL")
def ledger_failed(spark: SparkSession, d: str) -> DataFrame:
    return ledger.failed(_http(spark, d, "response_status", "superseded_by_id"), HTTP).select("http_request_id", "response_status")


@_query(f"SELECT llm_request_id FROM {_L} WHERE requested_at_utc IS NOT NULL AND response_text IS NULL AND superseded_by_id IS NULL")
def ledger_failed_llm(spark: SparkSession, d: str) -> DataFrame:
    return ledger.failed(_llm(spark, d, "requested_at_utc", "response_text", "superseded_by_id"), LLM).select("llm_request_id")


@_query("SELECT DISTINCT agent_task_id FROM agent_tasks WHERE started_at_utc IS NOT NULL AND is_error")
def ledger_failed_agent(spark: SparkSession, d: str) -> DataFrame:
    return ledger.failed(_agent(spark, d, "started_at_utc", "is_error"), AGENT).select("agent_task_id")


@_query(f"SELECT http_request_id FROM {_H} WHERE response_status IS DISTINCT FROM 200")
def ledger_not_ok(spark: SparkSession, d: str) -> DataFrame:
    return _http(spark, d, "response_status").where(HTTP.not_ok()).select("http_request_id")


@_query(f"SELECT http_request_id FROM {_H} WHERE superseded_by_id IS NULL")
def ledger_current(spark: SparkSession, d: str) -> DataFrame:
    return ledger.current(_http(spark, d, "superseded_by_id")).select("http_request_id")


@_query(f"SELECT response_status, count(*) AS n FROM {_H} WHERE superseded_by_id IS NULL GROUP BY response_status")
def ledger_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ledger.status_histogram(_http(spark, d, "response_status", "superseded_by_id"))


@_query(f"SELECT CAST(coalesce(sum(response_size), 0) AS BIGINT) AS bytes_in, round(coalesce(avg(latency) FILTER (NOT isinf(coalesce(latency, 0)) AND NOT isnan(coalesce(latency, 0))), 0.0), 6) AS avg_latency_s FROM {_H} WHERE response_status = 200")
def ledger_ok_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ok_aggregates(_http(spark, d, "response_status", "response_size", "latency")).withColumn("avg_latency_s", F.round("avg_latency_s", 6))


@_query(f"""SELECT http_request_group_id, count(*) AS total, count(*) FILTER (response_status <> 200) AS failed, round(count(*) FILTER (response_status <> 200) / count(*), 9) AS rate
FROM {_H} WHERE superseded_by_id IS NULL GROUP BY http_request_group_id""")
def ledger_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _http(spark, d, "http_request_group_id", "response_status", "superseded_by_id")
    return ledger.failure_rate(rows, HTTP, ["http_request_group_id"]).withColumn("rate", F.round("rate", 9))


@_query(f"""SELECT http_request_group_id, count(*) AS rows, count(*) FILTER (requested_at_utc IS NULL) AS pending, count(*) FILTER (response_status <> 200 AND superseded_by_id IS NULL) AS failed,
CASE WHEN count(*) FILTER (requested_at_utc IS NULL) > 0 OR count(*) FILTER (response_status <> 200 AND superseded_by_id IS NULL) > 0 THEN 'resume' ELSE 'complete' END AS branch
FROM {_H} GROUP BY http_request_group_id""")
def ledger_resume_branch(spark: SparkSession, d: str) -> DataFrame:
    return ledger.resume_branch(_http(spark, d, "http_request_group_id", "requested_at_utc", "response_status", "superseded_by_id"), HTTP, 3, ["http_request_group_id"])


@_query(f"""WITH b AS (SELECT coalesce('http' || response_status, 'no_status') AS k, count(*) AS n FROM {_H} WHERE superseded_by_id IS NULL AND response_status IS DISTINCT FROM 200 GROUP BY 1)
SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) AS most_common FROM b""")
def ledger_error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return ledger.error_breakdown(_http(spark, d, "response_status", "superseded_by_id"))


@_query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def ledger_fold_latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.fold(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


@_query(f"""WITH h AS (SELECT http_request_id, response_status, requested_at_utc, superseded_by_id FROM {_H}), f AS (SELECT * FROM h WHERE response_status <> 200 AND superseded_by_id IS NULL)
SELECT h.http_request_id, h.response_status, h.requested_at_utc, coalesce(h.superseded_by_id, CASE WHEN f.http_request_id IS NOT NULL THEN sha256(h.http_request_id || '#1') END) AS superseded_by_id
FROM h LEFT JOIN f ON h.http_request_id = f.http_request_id
UNION ALL SELECT sha256(http_request_id || '#1'), CAST(NULL AS INT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM f""")
def ledger_supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    return ledger.supersede(_http(spark, d, "response_status", "requested_at_utc", "superseded_by_id"), HTTP, 1, ["response_status", "requested_at_utc"])


@_query("""WITH s AS (SELECT user_id, event_id % 4 AS step, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT user_id, max(step) AS last FROM s GROUP BY 1),
g AS (SELECT user_id, unnest(range(0, last + 1)) AS step FROM l)
SELECT g.user_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY g.step) AS sizes FROM g LEFT JOIN s ON g.user_id = s.user_id AND g.step = s.step GROUP BY g.user_id""")
def ledger_lane_collect(spark: SparkSession, d: str) -> DataFrame:
    lanes = ledger.lane_results(table(spark, d, "events").withColumn("step", F.col("event_id") % 4), "user_id", "step", F.col("event_id"))
    return lanes.select("user_id", F.concat_ws(",", F.transform("steps", lambda s: F.size(s).cast("string"))).alias("sizes"))


@_query(f"SELECT response_status, count(*) AS n FROM {_L} l JOIN {_H} h ON l.http_request_id = h.http_request_id WHERE l.superseded_by_id IS NULL GROUP BY response_status")
def ledger_join_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.joined_statuses(_http(spark, d, "response_status"), _llm(spark, d, "http_request_id", "superseded_by_id"))


@_query("""SELECT count(*) AS total, round(coalesce(sum(total_cost_usd), 0.0), 6) AS cost_usd, CAST(coalesce(sum(num_turns), 0) AS BIGINT) AS turns, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms
FROM (SELECT DISTINCT agent_task_id, total_cost_usd, num_turns, duration_ms FROM agent_tasks)""")
def ledger_agent_totals(spark: SparkSession, d: str) -> DataFrame:
    return ledger.agent_totals(_agent(spark, d, "total_cost_usd", "num_turns", "duration_ms")).withColumn("cost_usd", F.round("cost_usd", 6))


@_query(r"""WITH t AS (SELECT DISTINCT agent_task_id, error_message FROM agent_tasks)
SELECT coalesce(nullif(substr(regexp_split_to_array(regexp_replace(coalesce(error_message, ''), '^\s+|\s+$', '', 'g'), '\s+')[1], 1, 48), ''), 'Unknown') AS bucket, count(*) AS n FROM t GROUP BY 1""")
def error_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _agent(spark, d, "error_message").groupBy(text.first_token(F.col("error_message")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"""SELECT DISTINCT agent_task_id, regexp_replace(coalesce(final_response, ''), '^\s+|\s+$', '', 'g') AS narrative, coalesce(total_cost_usd, 0.0) AS cost_usd FROM agent_tasks WHERE is_error = false""")
def task_narratives(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "agent_tasks").where(~F.col("is_error"))
    return tasks.select("agent_task_id", text.strip(F.col("final_response")).alias("narrative"), numbers.or_zero(F.col("total_cost_usd")).alias("cost_usd")).distinct()


@_query("""SELECT DISTINCT llm_request_id, (length(coalesce(system_prompt, '')) + length(coalesce(user_prompt, '')))::DOUBLE / 4.0::DOUBLE * 1.1::DOUBLE * model_input_token_price_usd AS expected_cost_usd FROM llm_requests""")
def cost_forecast(spark: SparkSession, d: str) -> DataFrame:
    cost = numbers.expected_cost(F.col("model_input_token_price_usd"), F.col("system_prompt"), F.col("user_prompt"))
    return table(spark, d, "llm_requests").select("llm_request_id", cost.alias("expected_cost_usd")).distinct()


@_query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return ledger_tables.lookup(table(spark, d, "supplier"), nations, "s_nationkey").select("s_suppkey", "n_name")


@_query("""WITH q AS (SELECT DISTINCT doc_id, unnest([doc_id + 1, doc_id, -1]) AS file, unnest([0, 1, 2]) AS at FROM documents), f AS (SELECT DISTINCT doc_id, n_chars FROM documents)
SELECT q.doc_id, string_agg(f.doc_id || ':' || f.n_chars, ',' ORDER BY q.at) AS files FROM q JOIN f ON q.file = f.doc_id GROUP BY q.doc_id""")
def attachment_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    asked = docs.select("doc_id", jsontext.text_list(F.array(*(x.cast("string") for x in (F.col("doc_id") + 1, F.col("doc_id"), F.lit(-1))))).alias("ids"))
    found = file_sources.attachments(asked, docs, id_col="doc_id", list_col="ids", file_id="doc_id")
    return found.select("doc_id", F.concat_ws(",", F.transform("files", lambda f: F.concat(f["file"], F.lit(":"), f["n_chars"].cast("string")))).alias("files"))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def topk_event_types(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return query(spark, "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type LIMIT :k", {"k": 3}, {"events": table(spark, d, "events")})


# --- functions


@_query("SELECT CAST(i AS BIGINT) AS step, least(60.0::DOUBLE * pow(2.0, i), 3840.0::DOUBLE) AS delay_s FROM range(0, 12) AS t(i)")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(12).select(F.col("id").alias("step"), numbers.backoff(F.col("id"), 60, 3840).alias("delay_s"))


@_query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@_query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM part""")
def unslugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.unslugify(text.slugify(F.col("p_name"))).alias("title"))


@_query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_name, ' ', '_')), '_'), lambda w: upper(w[1:1]) || w[2:]), '') AS name FROM part""")
def snake_to_camel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.snake_to_camel(text.slugify(F.col("p_name"))).alias("name"))


_MEDIA = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MEDIA_TYPES.items())


@_query(f"""WITH n AS (SELECT DISTINCT http_request_id, request_url || CASE hash_mod WHEN 0 THEN '/map.PNG' WHEN 1 THEN '/doc.pdf' WHEN 2 THEN '/plain' ELSE '/x.tar' END AS name
  FROM (SELECT *, length(request_url) % 4 AS hash_mod FROM http_requests))
SELECT http_request_id, CASE lower(regexp_extract(name, '[^.]*$')) {_MEDIA} ELSE '{text.DEFAULT_MEDIA_TYPE}' END AS media_type FROM n""")
def media_type(spark: SparkSession, d: str) -> DataFrame:
    part = F.length("request_url") % 4
    tail = F.when(part == 0, "/map.PNG").when(part == 1, "/doc.pdf").when(part == 2, "/plain").when(part == 3, "/x.tar")
    tail = F.coalesce(tail, F.lit("/x.tar"))
    return _http(spark, d, "request_url").select("http_request_id", text.media_type(F.concat("request_url", tail)).alias("media_type"))


@_query("""SELECT DISTINCT http_request_id, CASE WHEN strlen(request_url) <= 30 THEN request_url ELSE substr(request_url, 1, 13) || '_' || substr(sha256(request_url), 1, 16) END AS safe FROM http_requests""")
def safe_path(spark: SparkSession, d: str) -> DataFrame:
    return _http(spark, d, "request_url").select("http_request_id", text.safe_path(F.col("request_url"), 30).alias("safe"))


@_query("SELECT doc_id, md5(text) AS digest FROM documents")
def content_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_md5(F.col("text")).alias("digest"))


@_query("SELECT doc_id, to_base64(encode(text)) AS encoded FROM documents")
def content_base64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_base64(F.col("text")).alias("encoded"))


@_query("SELECT DISTINCT http_request_id, lower(replace(http_request_id, '-', '')) AS hex FROM http_requests")
def normal_uuid(spark: SparkSession, d: str) -> DataFrame:
    return _http(spark, d).select("http_request_id", text.normal_uuid(F.col("http_request_id")).alias("hex"))


@_query("SELECT n_nationkey, 'https://api.example/v1?name=' || replace(n_name, ' ', '+') || '&hourly=temp%2Cprecip' AS url FROM nation")
def build_url(spark: SparkSession, d: str) -> DataFrame:
    url = text.url_with("https://api.example/v1", [("name", F.col("n_name")), ("hourly", F.lit("temp,precip"))])
    return table(spark, d, "nation").select("n_nationkey", url.alias("url"))


@_query("SELECT n_nationkey, 'Nation ' || n_name || ' has key ' || n_nationkey || '.' AS prompt FROM nation")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", text.render("Nation %s has key %d.", F.col("n_name"), F.col("n_nationkey")).alias("prompt"))


@_query("SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", text.markdown_row(F.col("n_name"), F.col("n_regionkey")).alias("line"))


@_query("SELECT DISTINCT agent_task_id, CAST(date_sub('millisecond', started_at_utc, completed_at_utc) AS BIGINT) AS ms FROM agent_tasks")
def task_duration_ms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_tasks").select("agent_task_id", numbers.duration_ms(F.col("started_at_utc"), F.col("completed_at_utc")).alias("ms")).distinct()


@_query("SELECT o_orderkey, date_trunc('minute', o_orderdate) AS at FROM orders")
def minute_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.minute_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("at"))


# --- JSON


@_query("SELECT event_id, '{\"k\": ' || regexp_extract(props, '-?[0-9]+') || '}' AS found FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    prose = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("The answer is "), "props", F.lit(", as asked.")))
    return table(spark, d, "events").select("event_id", jsontext.extract_object(prose).alias("found"))


def _bodies(spark: SparkSession, d: str, wrap: str) -> DataFrame:
    return table(spark, d, "agent_messages").where(F.col("content").isNotNull()).select("agent_message_id", F.expr(wrap).alias("body")).distinct()


_CONTENT = "SELECT DISTINCT agent_message_id, content AS answer FROM agent_messages WHERE content IS NOT NULL"


@_query(_CONTENT)
def parse_response_blocks(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d, "to_json(named_struct('content', array(named_struct('type', 'text', 'text', content), named_struct('type', 'tool', 'text', 'no'))))")
    return bodies.select("agent_message_id", jsontext.response_text(F.lit("blocks"), F.lit(200), F.col("body")).alias("answer"))


@_query(_CONTENT)
def parse_response_candidates(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d, "to_json(named_struct('candidates', array(named_struct('content', named_struct('parts', array(named_struct('text', content)))))))")
    return bodies.select("agent_message_id", jsontext.response_text(F.lit("candidates"), F.lit(200), F.col("body")).alias("answer"))


@_query(_CONTENT)
def parse_response_choices(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d, "to_json(named_struct('choices', array(named_struct('message', named_struct('content', content)))))")
    return bodies.select("agent_message_id", jsontext.response_text(F.lit("choices"), F.lit(200), F.col("body")).alias("answer"))


@_query("SELECT l_orderkey, count(*) - 1 AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def zip_shortest_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per order, which has a few lines: arrays of unequal length zipped; as many entries as the shorter one has."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"))
    zipped = lists.select("l_orderkey", F.explode(jsontext.zip_shortest({"a": F.col("a"), "b": F.slice("a", F.lit(2), F.size("a"))})).alias("z"))
    return zipped.groupBy("l_orderkey").agg(F.count("z.b").alias("n"))


# --- SQL that any build may use: the text goes through the engine's own source of SQL


def _sql_query(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register a SQL text with its tables; ``spark_sql`` where Spark spells it otherwise."""
    from pelorus.sources.sql import spark_text

    def run(spark: SparkSession, d: str) -> DataFrame:
        names = sorted({n for n in re.findall(r"\{(\w+)\}", sql)})
        return query(spark, spark_text(spark_sql or sql), frames={n: table(spark, d, n) for n in names})

    run.__name__ = name
    _query(re.sub(r"\{(\w+)\}", r"\1", sql))(run)


_sql_query(
    "sql_windows",
    """SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INT) AS rank,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders}""",
)
_sql_query(
    "sql_set_operations",
    """(SELECT c_nationkey AS k, 'both' AS side FROM {customer} INTERSECT SELECT s_nationkey, 'both' FROM {supplier})
UNION ALL (SELECT c_nationkey, 'customer' FROM {customer} EXCEPT SELECT s_nationkey, 'customer' FROM {supplier})""",
)
_sql_query(
    "sql_joins",
    """SELECT 'semi' AS kind, count(*) AS n FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})
UNION ALL SELECT 'anti', count(*) FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)
UNION ALL SELECT 'full', count(*) FROM {customer} c FULL JOIN {orders} o ON c.c_custkey = o.o_custkey""",
)
_sql_query("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql_query(
    "sql_pivot",
    "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM {events} GROUP BY user_id",
    """SELECT user_id, coalesce(click, 0) AS click, coalesce(error, 0) AS error
FROM (SELECT user_id, event_type, 1 AS one FROM {events}) PIVOT (count(one) FOR event_type IN ('click' AS click, 'error' AS error))""",
)


@_query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id))
  AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'click' AND (q.ts < e.ts OR (q.ts = e.ts AND q.event_id < e.event_id)))) AS last_click
FROM events e WHERE e.event_type = 'purchase'""")
def asof_last_click(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last click before it; users are split by days."""
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "ts", "event_type")
    found = last_before(rows, by="user_id", order=("ts", "event_id"), source=F.col("event_type") == "click", value=F.col("event_id"), span=F.to_date("ts"), name="last_click")
    return found.where(F.col("event_type") == "purchase").select("event_id", "last_click")


@_query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    from pelorus.streaming.drain import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
