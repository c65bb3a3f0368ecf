"""Queries of the text and model problems over the tables of a data directory, and their SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm.bpe import encode_corpus
from pelorus.llm.conversations import conversations, drop_reasons
from pelorus.llm.leakage import leaked_items
from pelorus.llm.pairs import pair_defects
from pelorus.llm.percentiles import compact_id, is_value, merge_counts, percentiles, quantised, text_of_id, value_counts
from pelorus.llm.readability import DEMANDING, reading_grades
from pelorus.sources.tables import table

#: Percentiles in ten thousandths.
PER_MYRIAD = (5000, 9000, 9500, 9900)
#: Binary digits kept after the leading one: reported values are below the true ones by less than 1 in 1024.
BITS = 10
#: Where the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabulary splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _requests(spark: SparkSession, directory: str, *columns: str, bits: int | None = None) -> DataFrame:
    """Requests with copies of a row taken once; numbers are cut to ``bits`` and times to days before the shuffle."""
    kept = []
    for c in columns:
        number = F.col(c).cast("double")
        if c == "requested_at_utc":
            kept.append(F.col(c).cast("date").alias("day"))
        elif c in ("latency", "response_size"):
            kept.append(F.when(is_value(number), quantised(number, bits)).alias(c))
        elif c == "http_request_group_id":
            kept.append(compact_id(F.col(c)).alias(c))
        else:
            kept.append(F.col(c))
    return table(spark, directory, "http_requests").select(compact_id(F.col("http_request_id")).alias("id"), *kept).distinct()


def p2_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """Percentiles of latency and size per status, group and day, within a relative error of 2**-10."""
    rows = _requests(spark, directory, "response_status", "http_request_group_id", "requested_at_utc", "latency", "response_size", bits=BITS)
    keys = {"status": F.col("response_status").cast("string").cast("binary"), "group": F.col("http_request_group_id"), "day": F.col("day").cast("string").cast("binary")}
    measures = ("latency", "response_size")

    def number(k: int) -> Column:  # names are put in place of numbers at the end
        return F.lit(k).cast("tinyint")

    values = rows.select(
        F.explode(F.array(*(F.struct(number(k).alias("dimension"), key.alias("key")) for k, key in enumerate(keys.values())))).alias("d"),
        F.array(*(F.struct(number(k).alias("measure"), F.col(m).alias("x")) for k, m in enumerate(measures))).alias("m"),
    ).select("d.dimension", "d.key", F.explode("m").alias("m")).select("dimension", "key", "m.measure", "m.x")
    groups = ["dimension", "key", "measure"]
    found = percentiles(value_counts(values, groups, "x"), groups, PER_MYRIAD)

    def named(names: Iterable[str], k: str) -> Column:
        return F.get(F.array(*map(F.lit, names)), F.col(k))

    key = F.when(F.col("dimension") == 1, text_of_id(F.col("key"))).otherwise(F.col("key").cast("string"))
    return found.select(named(keys, "dimension").alias("dimension"), key.alias("key"), named(measures, "measure").alias("measure"), "per_myriad", "total", "value")


def p2_error(spark: SparkSession, directory: str) -> DataFrame:
    """Percentiles of latency per status: the exact value, and whether the reported one lies within the stated error."""
    rows = _requests(spark, directory, "response_status", "latency")
    groups = ["response_status"]
    exact, near = (percentiles(value_counts(rows, groups, "latency", bits=b), groups, PER_MYRIAD) for b in (None, BITS))
    other = near.select(F.col("response_status").alias("_s"), F.col("per_myriad").alias("_q"), F.col("value").alias("_v"))
    both = exact.join(other, F.col("response_status").eqNullSafe(F.col("_s")) & (F.col("per_myriad") == F.col("_q")))
    within = F.abs(F.col("value") - F.col("_v")) <= F.abs("value") * 2.0**-BITS
    return both.select("response_status", "per_myriad", "value", within.alias("within"))


def p2_exact_by_status(spark: SparkSession, directory: str) -> DataFrame:
    """Exact percentiles of latency per status."""
    counts = value_counts(_requests(spark, directory, "response_status", "latency"), ["response_status"], "latency")
    return percentiles(counts, ["response_status"], PER_MYRIAD)


def p2_merged_days(spark: SparkSession, directory: str) -> DataFrame:
    """Percentiles of size per status from summaries of single days put together."""
    rows = _requests(spark, directory, "response_status", "requested_at_utc", "response_size", bits=BITS)
    by_day = value_counts(rows, ["day", "response_status"], "response_size")
    return percentiles(merge_counts(by_day, ["response_status"]), ["response_status"], PER_MYRIAD)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Requests whose response fails, with the defect."""
    asked = table(spark, directory, "llm_requests").where(F.col("requested_at_utc").isNotNull() & F.col("user_prompt").isNotNull())
    return pair_defects(asked, id_col="llm_request_id", prompt_col="user_prompt", response_col="response_text")


_MESSAGES = {"key": "agent_task_id", "turn": "turn_number", "role": "role", "content": "content"}


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Conversations to drop, with the reason."""
    return drop_reasons(table(spark, directory, "agent_messages"), **_MESSAGES)


def p5_conversations(spark: SparkSession, directory: str) -> DataFrame:
    """The messages of whole conversations."""
    return conversations(table(spark, directory, "agent_messages"), **_MESSAGES)


def p6_ids(spark: SparkSession, directory: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, directory, "documents"), id_col="doc_id", text_col="text", ranks_path=f"{tokenizers}/byte_bpe_50k.tiktoken", pattern=WORDS)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold wording of evaluation items."""
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items"), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text")


def p8_grades(spark: SparkSession, directory: str) -> DataFrame:
    """Reading grade of every document, null where it has none."""
    return reading_grades(table(spark, directory, "documents"), id_col="doc_id", text_col="text")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """English prose of reading level 4 or 5."""
    return p8_grades(spark, directory).where(F.col("grade") >= DEMANDING).select("doc_id")


def queries() -> dict:
    own = (p2_percentiles, p2_exact_by_status, p2_merged_days, p2_error, p3_found, p5_found, p5_conversations, p6_ids, p7_found, p8_found, p8_grades)
    return {q.__name__: q for q in own}


def _sql_cut(x: str) -> str:
    e = f"(floor(log2(abs({x}))) + CASE WHEN pow(2.0, floor(log2(abs({x}))) + 1) <= abs({x}) THEN 1 WHEN pow(2.0, floor(log2(abs({x})))) > abs({x}) THEN -1 ELSE 0 END)"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE sign({x}) * floor(abs({x}) / pow(2.0, {e} - {BITS})) * pow(2.0, {e} - {BITS}) END"


def _sql_percentiles(rows: str, groups: str, value: str) -> str:
    return f"""
WITH vals AS ({rows}),
counts AS (SELECT {groups}, {value} AS value, count(*) AS n FROM vals WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY {groups} ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {groups}) AS total FROM counts),
targets AS (SELECT unnest([{", ".join(map(str, PER_MYRIAD))}]) AS per_myriad)
SELECT {groups}, per_myriad::INT AS per_myriad, total::BIGINT AS total, min(value) AS value
FROM running, targets WHERE upto >= greatest(1, (total * per_myriad + 9999) // 10000) GROUP BY {groups}, per_myriad, total"""


_TURNS = r"""
WITH m AS (
  SELECT agent_task_id AS k, turn_number AS t, lower(regexp_replace(coalesce(role, ''), '^[\s\pZ\p{Cc}\p{Cf}]+|[\s\pZ\p{Cc}\p{Cf}]+$', '', 'g')) AS r,
    coalesce(regexp_matches(content, '[^\s\pZ\p{Cc}\p{Cf}]'), false) AS seen, content
  FROM agent_messages WHERE agent_task_id IS NOT NULL),
turns AS (
  SELECT k, t, min(r) AS a, max(r) AS z, bool_or(seen) AS seen, bool_or(seen AND r IN ('user', 'assistant')) AS spoken FROM m GROUP BY k, t),
steps AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t) AS pt, lag(z) OVER (PARTITION BY k ORDER BY t) AS p FROM turns),
checked AS (
  SELECT *, coalesce(a = z AND CASE WHEN t = 0 THEN a IN ('system', 'user') ELSE pt = t - 1 AND CASE p WHEN 'system' THEN a = 'user' WHEN 'user' THEN a = 'assistant'
    WHEN 'assistant' THEN a IN ('user', 'tool') WHEN 'tool' THEN a = 'assistant' ELSE false END END, false) AS ok FROM steps),
found AS (
  SELECT k AS agent_task_id, CASE WHEN NOT bool_or(spoken) THEN 'empty' WHEN NOT bool_and(ok) THEN 'broken'
    WHEN arg_max(z, t) <> 'assistant' OR bool_or(z = 'assistant' AND NOT seen) THEN 'no_reply' END AS reason
  FROM checked GROUP BY k)
"""


def oracle_sql() -> dict[str, str]:
    requests = "(SELECT DISTINCT http_request_id, response_status, http_request_group_id, requested_at_utc, latency, response_size FROM http_requests)"
    dims = {"status": "CAST(response_status AS VARCHAR)", "group": "http_request_group_id", "day": "strftime(requested_at_utc, '%Y-%m-%d')"}
    every = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {k} AS key, '{m}' AS measure, {m}::DOUBLE AS x FROM {requests}" for d, k in dims.items() for m in ("latency", "response_size"))
    return {
        "p2_percentiles": _sql_percentiles(every, "dimension, key, measure", _sql_cut("x")),
        "p2_exact_by_status": _sql_percentiles(f"SELECT response_status, latency AS x FROM {requests}", "response_status", "x"),
        "p2_error": f"SELECT response_status, per_myriad, value, true AS within FROM ({_sql_percentiles(f'SELECT response_status, latency AS x FROM {requests}', 'response_status', 'x')})",
        "p2_merged_days": _sql_percentiles(f"SELECT response_status, response_size::DOUBLE AS x FROM {requests}", "response_status", _sql_cut("x")),
        "p5_found": _TURNS + "SELECT agent_task_id, reason FROM found WHERE reason IS NOT NULL",
        "p5_conversations": _TURNS
        + r""", kept AS (
  SELECT DISTINCT k AS agent_task_id, t AS turn_number, r AS role, CASE WHEN seen THEN regexp_replace(content, '^[\s\pZ\p{Cc}]+|[\s\pZ\p{Cc}]+$', '', 'g') ELSE '' END AS content
  FROM m WHERE k NOT IN (SELECT agent_task_id FROM found WHERE reason IS NOT NULL))
SELECT agent_task_id, turn_number, row_number() OVER (PARTITION BY agent_task_id, turn_number ORDER BY content) AS message, role, content FROM kept""",
    }
