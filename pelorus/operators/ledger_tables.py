"""Schemas of ledger tables, and factories of project tables beside them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.plans.schema import row_schema
from pelorus.plans.storage import Storage


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    """A struct of simple types from ``name type [not null], ...``; needs no session."""
    columns = [c.split() for c in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], not rest) for name, kind, *rest in columns])


_MODEL = "model_id string, model_api_id string, model_name string, model_provider string"
HTTP_REQUESTS = _schema(
    "http_request_id string not null, http_request_group_id string, http_request_extra_id string, request_url string, request_method string, request_headers string, request_body string, "
    "response_status int, response_headers string, response_body_text string, response_size bigint, latency double, created_at_utc timestamp_ntz, requested_at_utc timestamp_ntz, superseded_by_id string"
)
LLM_REQUESTS = _schema(
    f"llm_request_id string not null, llm_request_group_id string, llm_request_extra_id string, {_MODEL}, temperature double, effort string, system_prompt string, user_prompt string, attachments string, "
    "response_schema string, http_request_id string, response_text string, created_at_utc timestamp_ntz, requested_at_utc timestamp_ntz, superseded_by_id string"
)
AGENT_TASKS = _schema(
    f"agent_task_id string not null, agent_task_group_id string, agent_task_extra_id string, {_MODEL}, system_prompt string, task_prompt string, allowed_tools string, output_format string, max_turns bigint, "
    "created_at_utc timestamp_ntz, started_at_utc timestamp_ntz, completed_at_utc timestamp_ntz, final_response string, num_turns bigint, duration_ms bigint, total_cost_usd double, is_error boolean, "
    "error_message string, superseded_by_id string"
)
AGENT_TOOL_CALLS = _schema("agent_tool_call_id string not null, agent_task_id string, turn_number bigint, tool_name string, tool_input string, tool_output string, is_error boolean")
AGENT_MESSAGES = _schema("agent_message_id string not null, agent_task_id string, turn_number bigint, role string, content string, created_at_utc timestamp_ntz")
FILES = _schema("file_id string not null, relative_path string, md5 string, size bigint")


def project_table(prefix: str, kind: str, columns: Mapping[str, Any] | None = None) -> tuple[str, T.StructType, dict[str, Any]]:
    """Name, schema and defaults of a project's table beside a ledger, such as ``<prefix>_http_request_groups``.

    The key is ``<kind without its last s>_id``; ``created_at_utc`` is always there, ``created_by_class`` for groups. A
    column is a Python type, ``T | None`` or ``(type, default)``; a name that is taken raises ``ValueError``.
    """
    key = f"{kind.removesuffix('s')}_id"
    fields = [T.StructField(key, T.StringType(), False), T.StructField("created_at_utc", T.TimestampNTZType())]
    if kind.endswith("_groups"):
        fields.append(T.StructField("created_by_class", T.StringType()))
    taken, defaults = {f.name for f in fields}, {}
    for name, spec in (columns or {}).items():
        if name in taken:
            raise ValueError(f"{name} is a column of every such table")
        declared, *default = spec if isinstance(spec, tuple) else (spec,)
        holder = type("Row", (), {"__annotations__": {name: declared}, "model_fields": {name: None}})
        fields.append(row_schema(holder)[name])
        if default:
            defaults[name] = default[0]
    return f"{prefix}_{kind}", T.StructType(fields), defaults


def with_defaults(df: DataFrame, schema: T.StructType, defaults: Mapping[str, Any]) -> DataFrame:
    """``df`` in the schema's columns and types; absent ones get their default or null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def create_tables(spark: SparkSession, root: str, tables: Mapping[str, T.StructType], replace: bool = False) -> None:
    """Empty Parquet tables ``<root>/<name>``; existing ones stay unless ``replace``."""
    storage = Storage(spark)
    for name, schema in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        if replace:
            storage.delete(path)
        if not storage.exists(f"{path}/_SUCCESS"):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def drop_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    for name in names:
        Storage(spark).delete(f"{root.rstrip('/')}/{name}")


def children(df: DataFrame, key: str, items: Column, child_id: str) -> DataFrame:
    """One row per struct of an array column, with the parent's key, the place and an id that follows from both."""
    rows = df.select(F.col(key), F.posexplode(items).alias("place", "_item"))
    return rows.select(F.sha2(F.concat_ws("#", F.col(key).cast("string"), F.col("place").cast("string")), 256).alias(child_id), key, F.col("place").cast("bigint").alias("place"), "_item.*")


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``df`` with the dimension's columns; a key that the dimension lacks fails the job when its row is read."""
    marked = dimension.withColumn("_known", F.lit(True))
    joined = df.join(marked, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("_known", F.when(F.col("_known"), F.lit(True)).otherwise(missing.cast("boolean"))).where("_known").drop("_known")


def flattened(df: DataFrame, spec: str, prefix: str = "") -> DataFrame:
    """A struct column as columns of their own."""
    parts = df.schema[spec].dataType.names
    return df.select(*(c for c in df.columns if c != spec), *(F.col(spec)[p].alias(f"{prefix}{p}") for p in parts))


def gathered(df: DataFrame, spec: str, columns: list[str], prefix: str = "") -> DataFrame:
    """Columns back into one struct column."""
    return df.withColumn(spec, F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in columns))).drop(*(f"{prefix}{c}" for c in columns))
