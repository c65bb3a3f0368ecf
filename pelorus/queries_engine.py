"""Queries that run objects, ledgers, sources and sinks from end to end, with SQL that says what must come out.

What they write goes to the session's shared folder and is deleted when the driver ends.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.functions import jsontext, numbers, text
from pelorus.operators import checks, ledger, ledger_tables
from pelorus.operators.ledger import AGENT, HTTP
from pelorus.plans import dag, report, schema, settings
from pelorus.plans.journal import format_summary
from pelorus.plans.lineage import ensure_checkpoint_dir
from pelorus.plans.objects import CheckFailedError, Document, Files, Format, SQLTable, Table, TableFrom, Version
from pelorus.plans.storage import Storage
from pelorus.plans.waves import AgentLedger, Ledger, ModelLedger
from pelorus.sources import files as file_sources
from pelorus.sources.http import caller
from pelorus.sources.sql import filled, query, spark_text
from pelorus.sources.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MAIN, OTHER = Version("main", "Main"), Version("other", "Other")


def _query(sql: str) -> Callable:
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def workspace(spark: SparkSession) -> str:
    """A fresh folder of the shared one, deleted when the driver ends."""
    shared = re.sub(r"^file:/+", "/", ensure_checkpoint_dir(spark))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared}/pelorus-queries/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def told(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    """What a check or a runner says, as rows ``(what, said)`` of text."""
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, said string")


def said(rows: list[tuple[str, object]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{str(v).replace(chr(39), chr(39) * 2)}')" for k, v in rows) + ") AS t(what, said)"


def outcome(f: Callable[[], object]) -> str:
    """``ok``, or the name and the text of what is raised."""
    try:
        f()
    except Exception as error:  # noqa: BLE001 - the error is what the query shows
        return f"{type(error).__name__}: {error}"
    return "ok"


# --- tables and their formats


@dataclass
class NationRow:
    n_nationkey: int
    n_name: str
    n_regionkey: int
    note: str | None


class Nations(Table):
    id, description, row_model, supported_versions, source = "nations", "Nations", NationRow, (MAIN, OTHER), ""
    checks = (checks.MinRows(1), checks.NoNulls("n_nationkey", "n_name"), checks.Unique("n_nationkey"))

    def build(self) -> DataFrame:
        rows = table(self.spark, self.source, "nation")
        return rows.select("n_nationkey", "n_name", "n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, 'say "so",\tor not').alias("note"))


class NationsByRegion(TableFrom):
    id, supported_versions, source = "nations_by_region", (MAIN, OTHER), ""
    row_model = T.StructType([T.StructField("n_regionkey", T.LongType()), T.StructField("n", T.LongType())])

    def sources(self):
        return (Nations(self.spark, self.version, self.root).df,)

    def transform(self, nations: DataFrame) -> DataFrame:
        return nations.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


class NationsFromTemplate(SQLTable):
    id, supported_versions = "nations_from_template", (MAIN,)
    row_model = T.StructType([T.StructField("n_name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("twice", T.LongType())])
    sql = "SELECT n_name, :version AS version, twice(n_nationkey) AS twice FROM {nations} WHERE n_regionkey < :most"

    def arguments(self):
        return {"version": self.version.id, "most": 3}

    def frames(self):
        return {"nations": Nations(self.spark, self.version, self.root).df}

    def setup(self, spark: SparkSession) -> None:
        """The hook: what the SQL text needs of the session."""
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(x BIGINT) RETURNS BIGINT RETURN x * 2")


def _nations(spark: SparkSession, d: str, root: str, version: Version = MAIN) -> Nations:
    made = Nations(spark, version, root)
    made.source = d
    made.make()
    return made


_NATIONS = "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'say \"so\",' || chr(9) || 'or not' END AS note FROM nation"


@_query(_NATIONS)
def table_made(spark: SparkSession, d: str) -> DataFrame:
    """A table through its gate and checks to Parquet, and read again."""
    return _nations(spark, d, workspace(spark)).df


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def table_from_tables(spark: SparkSession, d: str) -> DataFrame:
    root = workspace(spark)
    _nations(spark, d, root)
    return NationsByRegion(spark, MAIN, root).make().df


@_query("SELECT n_name, 'main' AS version, n_nationkey * 2 AS twice FROM nation WHERE n_regionkey < 3")
def table_from_template(spark: SparkSession, d: str) -> DataFrame:
    root = workspace(spark)
    _nations(spark, d, root)
    return NationsFromTemplate(spark, MAIN, root).make().df


def _back(spark: SparkSession, d: str, fmt: Format) -> tuple[str, T.StructType]:
    made = _nations(spark, d, workspace(spark))
    made.convert(fmt)
    return made.path(fmt), made.df.schema


@_query(_NATIONS)
def csv_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    path, kinds = _back(spark, d, Format.CSV)
    return spark.read.csv(path, schema=kinds, header=True, quote='"', escape='"', multiLine=True)


@_query(_NATIONS)
def tsv_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    path, kinds = _back(spark, d, Format.TSV)
    return file_sources.tsv(spark, path, kinds)


@_query(_NATIONS)
def json_lines_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    path, kinds = _back(spark, d, Format.JSONL)
    return spark.read.schema(kinds).json(path)


@_query(_NATIONS)
def json_array_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    path, kinds = _back(spark, d, Format.JSON)
    return spark.read.schema(kinds).json(path, multiLine=True)


@_query("SELECT n_nationkey, n_name FROM nation")
def rows_from_values(spark: SparkSession, d: str) -> DataFrame:
    """Rows made in Python with a declared schema (a dimension table, so small by nature)."""
    values = [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()]
    return file_sources.rows(spark, values, "n_nationkey bigint, n_name string")


_GATE = [
    ("wrong", "ValueError: Table does not match row schema NationRow: missing column 'n_name'; column 'n_regionkey' is string, expected bigint; unexpected column 'extra'"),
    ("written", False), ("missing", "['n_name']"), ("changed", "['n_regionkey']"), ("extra", "['extra']"),
]


@_query(said(_GATE))
def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    """A table whose columns differ from its row model is not written, and every difference is named."""
    wrong = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string"), F.lit(None).cast("string").alias("note"), F.lit(1).alias("extra"))
    made = Nations(spark, MAIN, workspace(spark))
    first = outcome(lambda: made.save(wrong))
    found = schema.schema_differences(wrong.schema, schema.row_schema(NationRow))
    names = {k: [re.search("'(.+?)'", x)[1] for x in found if re.match(v, x)] for k, v in (("missing", "missing"), ("changed", "column"), ("extra", "unexpected"))}
    return told(spark, [("wrong", first), ("written", made.exists()), *names.items()])


_LIFE = [
    ("unmade", "FileNotFoundError"), ("made", True), ("again", "FileExistsError"), ("replaced", "ok"), ("leftover", "ok"), ("convert twice", "FileExistsError"),
    ("no such format", "TypeError"), ("no such version", "ValueError"), ("deleted", False), ("deleted twice", "ok"),
]


@_query(said(_LIFE))
def table_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    made = Nations(spark, MAIN, workspace(spark))
    made.source = d

    def short(f: Callable) -> str:
        return outcome(f).split(":")[0]

    out = [("unmade", short(lambda: made.convert(Format.CSV))), ("made", made.make().exists()), ("again", short(made.make)), ("replaced", short(lambda: made.make(replace=True)))]
    made.storage.delete(f"{made.path()}/_SUCCESS")  # as a write that did not end leaves it
    out.append(("leftover", short(made.make)))
    made.convert(Format.CSV)
    out += [("convert twice", short(lambda: made.convert(Format.CSV))), ("no such format", short(lambda: made.convert("csv"))), ("no such version", short(lambda: Nations(spark, Version("none"))))]
    made.delete()
    out += [("deleted", made.exists()), ("deleted twice", short(made.delete))]
    return told(spark, out)


@_query("SELECT count(*) AS files, count(DISTINCT n_nationkey) AS keys FROM nation")
def table_readme(spark: SparkSession, d: str) -> DataFrame:
    """The README lies beside the table and names each column; counted are its rows and those of the table."""
    made = _nations(spark, d, workspace(spark))
    page = "\n".join(r.value for r in spark.read.text(made.readme_path).collect())  # one small page
    listed = sum(f"<td>{f.name}</td>" in page for f in made.df.schema)
    return made.df.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("n_nationkey").alias("keys")).where(F.lit(listed == 4))


# --- checks as objects run them


def _checked(obj: Table | Files | Ledger, *found: checks.BaseCheck) -> str:
    obj.checks = found
    return outcome(obj.run_checks)


@_query("""SELECT 'MinRows ' || k AS what, CASE WHEN n >= k THEN 'ok' ELSE 'CheckFailedError: MinRows: ' || n || ' rows, expected at least ' || k END AS said
FROM (SELECT count(*) AS n FROM orders), (VALUES (1), (100000000)) AS t(k)
UNION ALL SELECT 'NoNulls', CASE WHEN n = 0 THEN 'ok' ELSE 'CheckFailedError: NoNulls: response_status=' || n END FROM (SELECT count(*) - count(response_status) AS n FROM http_requests)
UNION ALL SELECT 'Unique', CASE WHEN n <= 1 THEN 'ok' ELSE 'CheckFailedError: Unique: a key of (l_orderkey) occurs ' || n || ' times' END FROM (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))
UNION ALL SELECT 'Unique pair', CASE WHEN n <= 1 THEN 'ok' ELSE 'CheckFailedError: Unique: a key of (l_orderkey, l_linenumber) occurs ' || n || ' times' END FROM (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))""")
def table_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of tables over whole tables, with what they say."""

    class Given(Table):
        id, supported_versions, given = "given", (MAIN,), ""

        @property
        def df(self) -> DataFrame:
            return table(self.spark, d, self.given)

    def run(name: str, check: checks.BaseCheck) -> str:
        obj = Given(spark, MAIN, "/nowhere")
        obj.given = name
        return _checked(obj, check)

    return told(
        spark,
        [(f"MinRows {k}", run("orders", checks.MinRows(k))) for k in (1, 100_000_000)]
        + [("NoNulls", run("http_requests", checks.NoNulls("response_status"))), ("Unique", run("lineitem", checks.Unique("l_orderkey"))), ("Unique pair", run("lineitem", checks.Unique("l_orderkey", "l_linenumber")))],
    )


class NationFiles(Files):
    id, supported_versions, source = "nation_files", (MAIN,), ""

    def write_files(self, directory: str) -> None:
        rows = table(self.spark, self.source, "nation")
        file_sources.write_each(rows.select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("name"), F.to_json(F.struct("n_nationkey", "n_name")).alias("content")), directory, "name", "content")


def _nation_files(spark: SparkSession, d: str) -> NationFiles:
    made = NationFiles(spark, MAIN, workspace(spark))
    made.source = d
    made.make()
    return made


_ONE_JSON = "'{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'"


@_query("SELECT n_nationkey, n_name, 'n_' || n_nationkey || '.json' AS file FROM nation")
def files_of_rows_read(spark: SparkSession, d: str) -> DataFrame:
    """One JSON file per row, and all of them read as documents."""
    found = file_sources.json_documents(spark, _nation_files(spark, d).path(), "n_nationkey bigint, n_name string")
    return found.select("n_nationkey", "n_name", F.substring_index("_path", "/", -1).alias("file"))


@_query(f"SELECT row_number() OVER (ORDER BY 'n_' || n_nationkey || '.json') AS at, 'n_' || n_nationkey || '.json' AS file, CAST(strlen({_ONE_JSON}) AS BIGINT) AS length FROM nation")
def files_listed(spark: SparkSession, d: str) -> DataFrame:
    """Files by path, with their sizes."""
    rows = file_sources.listing(spark, _nation_files(spark, d).path(), ordered=True).select(F.substring_index("path", "/", -1).alias("file"), "length").collect()
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "at bigint, file string, length bigint")


@_query(f"SELECT 'n_' || n_nationkey || '.json' AS relative_path, md5({_ONE_JSON}) AS md5, CAST(strlen({_ONE_JSON}) AS BIGINT) AS size FROM nation")
def files_registered(spark: SparkSession, d: str) -> DataFrame:
    root = _nation_files(spark, d).path()
    found = file_sources.contents(spark, root)
    return file_sources.registration(found.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), F.lit(root)).select("relative_path", "md5", "size")


def _unpacked(spark: SparkSession, made: NationFiles, fmt: Format) -> DataFrame:
    made.convert(fmt)
    path, rows = made.path(fmt), []
    if fmt is Format.ZIP:
        import zipfile

        with zipfile.ZipFile(path) as packed:
            rows = [(n, packed.read(n).decode()) for n in packed.namelist()]
    else:
        import tarfile

        import zstandard

        with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as plain, tarfile.open(fileobj=plain, mode="r|") as packed:
            rows = [(m.name, packed.extractfile(m).read().decode()) for m in packed]
    return spark.createDataFrame(rows, "name string, content string")


@_query(f"SELECT 'n_' || n_nationkey || '.json' AS name, {_ONE_JSON} AS content FROM nation")
def files_zipped(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(spark, _nation_files(spark, d), Format.ZIP)


@_query(f"SELECT 'n_' || n_nationkey || '.json' AS name, {_ONE_JSON} AS content FROM nation")
def files_tarred(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(spark, _nation_files(spark, d), Format.TAR_ZST)


@_query(f"""SELECT 'MinFiles 1' AS what, 'ok' AS said UNION ALL SELECT 'MinFiles 1000', 'CheckFailedError: MinFiles: ' || count(*) || ' files, expected at least 1000' FROM nation
UNION ALL SELECT 'NoEmptyFiles', 'ok' UNION ALL SELECT 'MinFileSize', 'CheckFailedError: ' || count(*) || ' files under 39 bytes' FROM nation WHERE strlen({_ONE_JSON}) < 39
UNION ALL SELECT 'SchemaMatches', 'ok' UNION ALL SELECT 'SchemaMatches other', 'CheckFailedError: SchemaMatches: ' || count(*) || ' files do not match NationRow' FROM nation
UNION ALL SELECT 'bytes', CAST(sum(strlen({_ONE_JSON})) AS VARCHAR) FROM nation""")
def files_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of files, with what they say; paths are left out."""

    @dataclass
    class Named:
        n_nationkey: int
        n_name: str

    made = _nation_files(spark, d)
    found = [(f"MinFiles {k}", _checked(made, checks.MinFiles(k))) for k in (1, 1000)] + [("NoEmptyFiles", _checked(made, checks.NoEmptyFiles()))]
    found.append(("MinFileSize", _checked(made, checks.MinFileSize(39)).replace("MinFileSize: ", "").split(", first")[0]))
    found += [("SchemaMatches", _checked(made, checks.SchemaMatches(Named))), ("SchemaMatches other", _checked(made, checks.SchemaMatches(NationRow)).split(", first")[0])]
    size = checks.file_metrics(file_sources.listing(spark, made.path())).first()
    return told(spark, [*found, ("bytes", size.bytes)])


# --- ledgers run to their end by calls made up here


def _sent(spark: SparkSession, d: str) -> DataFrame:
    """One request per supplier."""
    return table(spark, d, "supplier").select(F.format_string("s%06d", "s_suppkey").alias("http_request_id"), F.concat(F.lit("https://api.example/"), F.col("s_suppkey").cast("string")).alias("request_url"), F.lit("GET").alias("request_method"))


def _answer(method: str, url: str, headers: dict, body: str | None, secrets: dict | None) -> dict:
    key = int(url.rsplit("/", 1)[1].split("?")[0])
    return {"response_status": 500 if key % 7 == 0 else 200, "response_headers": "{}", "response_body_text": f"body {key}", "response_size": key * 10, "latency": key / 100, "requested_at_utc": datetime(2024, 1, 1)}


class Suppliers(Ledger):
    id, supported_versions, kind, schema = "suppliers", (MAIN,), HTTP, ledger_tables.HTTP_REQUESTS
    response_columns = ("response_status", "response_headers", "response_body_text", "response_size", "latency", "requested_at_utc")
    rate, wave_rows, source, get = 1e6, 2000, "", staticmethod(_answer)

    def populate(self) -> DataFrame:
        return ledger_tables.with_defaults(_sent(self.spark, self.source), self.schema, {})

    def call(self, request):
        return caller(secrets={"key": "x"}, get=self.get)(request)


def _suppliers(spark: SparkSession, d: str, root: str | None = None) -> Suppliers:
    made = Suppliers(spark, MAIN, root or workspace(spark))
    made.source = d
    return made


@_query("SELECT 'https://api.example/' || s_suppkey AS request_url, CASE WHEN s_suppkey % 7 = 0 THEN 500 ELSE 200 END AS response_status, CASE WHEN s_suppkey % 7 = 0 THEN 3 ELSE 1 END AS tries FROM supplier")
def ledger_run_with_retries(spark: SparkSession, d: str) -> DataFrame:
    """An HTTP ledger run to its end with two retries of what failed: each request's last status and tries."""
    made = _suppliers(spark, d)
    made.make(retries=2)
    return made.states().groupBy("request_url").agg(F.max("response_status").alias("response_status"), F.count(F.lit(1)).cast("int").alias("tries"))


@_query("""SELECT 'first' AS run, count(*) FILTER (s_suppkey % 5 <> 0) AS answered, count(*) FILTER (s_suppkey % 5 = 0) AS pending FROM supplier
UNION ALL SELECT 'second', count(*), 0 FROM supplier UNION ALL SELECT 'third', count(*), 0 FROM supplier""")
def ledger_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Calls that raise stay pending and are made by the next run; a complete ledger makes none, and a compacted one says the same."""
    root, out = workspace(spark), []

    def down(method: str, url: str, *rest: object) -> dict:
        if int(url.rsplit("/", 1)[1]) % 5 == 0:
            raise OSError("down")
        return _answer(method, url, *rest)

    for run, get in (("first", down), ("second", _answer), ("third", down)):
        made = _suppliers(spark, d, root)
        made.get = get
        made.make()
        if run == "second":
            made.compact()
        row = made.states().agg(F.count_if(F.col("requested_at_utc").isNotNull()), F.count_if(F.col("requested_at_utc").isNull())).first()
        out.append((run, *row))
    return spark.createDataFrame(out, "run string, answered bigint, pending bigint")


@_query("""SELECT 'total' AS what, CAST(count(*) AS VARCHAR) AS said FROM supplier UNION ALL SELECT 'failed', CAST(count(*) FILTER (s_suppkey % 7 = 0) AS VARCHAR) FROM supplier
UNION ALL SELECT 'bytes_in', CAST(coalesce(sum(s_suppkey * 10) FILTER (s_suppkey % 7 <> 0), 0) AS VARCHAR) FROM supplier
UNION ALL SELECT 'errors', coalesce('http500:' || nullif(count(*) FILTER (s_suppkey % 7 = 0), 0), 'none') FROM supplier
UNION ALL SELECT 'MinRequests', 'ok' UNION ALL SELECT 'MaxFailureRate', 'CheckFailedError: MaxFailureRate: ' || count(*) FILTER (s_suppkey % 7 = 0) || ' of ' || count(*) || ' failed, at most 0.01 may' FROM supplier""")
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    made = _suppliers(spark, d)
    made.make()
    found = made.summary()
    out = [(k, found[k]) for k in ("total", "failed", "bytes_in", "errors")]
    return told(spark, [*out, ("MinRequests", _checked(made, checks.MinRequests(5))), ("MaxFailureRate", _checked(made, checks.MaxFailureRate(frac=0.01)))])


class ModelCalls(Suppliers):
    id = "model_calls"

    def populate(self) -> DataFrame:
        raise AssertionError("requests come from the model ledger")


class NationModels(ModelLedger):
    id, supported_versions, schema, source = "nation_models", (MAIN,), ledger_tables.LLM_REQUESTS, ""

    def http(self) -> Ledger:
        made = ModelCalls(self.spark, MAIN, self.root)
        made.get = lambda method, url, headers, body, secrets: {**_answer(method, url, headers, body, secrets), "response_body_text": json.dumps({"choices": [{"message": {"content": f"About {json.loads(body)['prompt']}"}}]})}
        return made

    def populate(self) -> DataFrame:
        rows = table(self.spark, self.source, "nation").select(F.format_string("n%02d", "n_nationkey").alias("llm_request_id"), F.lit("choices").alias("model_provider"), F.col("n_nationkey").cast("string").alias("model_id"), F.col("n_name").alias("user_prompt"))
        return ledger_tables.with_defaults(rows, self.schema, {})

    def requests(self, rows: DataFrame) -> DataFrame:
        return rows.select("http_request_id", F.concat(F.lit("https://model.example/"), "model_id").alias("request_url"), F.lit("POST").alias("request_method"), jsontext.request_body(prompt=F.col("user_prompt")).alias("request_body"))

    def answers(self):
        return jsontext.response_text(F.col("model_provider"), F.col("response_status"), F.col("response_body_text"))


@_query("""SELECT n_name AS user_prompt, CASE WHEN n_nationkey % 7 <> 0 THEN 'About ' || n_name END AS response_text, CASE WHEN n_nationkey % 7 = 0 THEN 2 ELSE 1 END AS tries,
CASE WHEN n_nationkey % 7 = 0 THEN 500 ELSE 200 END AS response_status FROM nation""")
def model_ledger_run(spark: SparkSession, d: str) -> DataFrame:
    """Model requests through a ledger of HTTP requests, one retry of what failed, answers read from the bodies."""
    made = NationModels(spark, MAIN, workspace(spark))
    made.source = d
    made.make(retries=1)
    rows = made.states().join(made.http().states().select("http_request_id", "response_status"), "http_request_id")
    return rows.groupBy("user_prompt").agg(F.max("response_text").alias("response_text"), F.count(F.lit(1)).cast("int").alias("tries"), F.max("response_status").alias("response_status"))


@_query("SELECT 0::BIGINT AS orphans, CASE WHEN n_nationkey % 7 = 0 THEN 'http500' ELSE 'http200' END AS label, count(*) AS n FROM nation GROUP BY ALL")
def model_ledger_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Model requests by the status of their HTTP request, after a crash between the ledgers' appends: nothing is sent twice."""
    made = NationModels(spark, MAIN, workspace(spark))
    made.source = d
    made._append(made.populate(), "populate")
    linked = made.states().withColumn("http_request_id", F.sha2(F.concat("llm_request_id", F.lit("#http")), 256))
    made.http()._append(ledger_tables.with_defaults(made.requests(linked), ledger_tables.HTTP_REQUESTS, {}), "populate")  # and then it crashed
    made.make()
    return ledger.model_statuses(made.http().states(), made.states()).select(F.lit(made.orphans().count()).alias("orphans"), "label", "n")


class NationAgents(AgentLedger):
    id, supported_versions, schema, source, rate = "nation_agents", (MAIN,), ledger_tables.AGENT_TASKS, "", 1e6

    def populate(self) -> DataFrame:
        rows = table(self.spark, self.source, "nation").select(F.format_string("n%02d", "n_nationkey").alias("agent_task_id"), F.col("n_name").alias("task_prompt"), F.when(F.col("n_nationkey") % 4 == 0, "json").alias("output_format"))
        return ledger_tables.with_defaults(rows, self.schema, {})

    def call(self, request):
        key = int(request.agent_task_id[1:3]) if len(request.agent_task_id) == 3 else 0
        if key % 5 == 1:
            raise TimeoutError("too slow")
        prompt = request.task_prompt
        return {
            "final_response": json.dumps({"name": prompt}) if key % 8 == 0 else f"Done: {prompt}", "num_turns": 2, "total_cost_usd": 0.25,
            "messages": [("user", prompt), ("assistant", f"Done: {prompt}")], "tool_calls": [("look", prompt, "found", False)] if key % 3 == 0 else [],
        }


@_query("""SELECT n_name AS task_prompt, n_nationkey % 5 = 1 OR n_nationkey % 8 = 4 AS is_error, CASE WHEN n_nationkey % 5 = 1 THEN 'TimeoutError' WHEN n_nationkey % 8 = 4 THEN 'response' ELSE 'Unknown' END AS bucket,
CASE WHEN n_nationkey % 5 = 1 THEN 0 ELSE 2 END AS messages, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 <> 1 THEN 1 ELSE 0 END AS tool_calls FROM nation""")
def agent_ledger_run(spark: SparkSession, d: str) -> DataFrame:
    """Agent tasks: errors kept in the row, answers checked, messages and tool calls in tables beside."""
    made = NationAgents(spark, MAIN, workspace(spark))
    made.source = d
    made.make()
    counts = [made.child(name).groupBy("agent_task_id").agg(F.count(F.lit(1)).cast("int").alias(name)) for name in ("messages", "tool_calls")]
    rows = made.states().join(counts[0], "agent_task_id", "left").join(counts[1], "agent_task_id", "left")
    return rows.select("task_prompt", "is_error", text.first_token(F.col("error_message")).alias("bucket"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("messages", "tool_calls")))


class RegionGraph(Suppliers):
    """Step 0 asks about each region (a lane each), step 2 about the nations of those that were answered; step 1 is skipped."""

    id, steps = "region_graph", 3
    schema = T.StructType([*ledger_tables.HTTP_REQUESTS, T.StructField("step", T.IntegerType())])

    def populate_step(self, step: int, before: DataFrame | None) -> DataFrame | None:
        regions = table(self.spark, self.source, "region").select(F.col("r_regionkey").cast("string").alias("http_request_group_id"))
        if step == 0:
            rows = regions.select("http_request_group_id", F.concat(F.lit("region"), "http_request_group_id").alias("http_request_id"), F.concat(F.lit("https://api.example/"), "http_request_group_id").alias("request_url"))
        elif step == 1:
            return None
        else:
            answered = before.where("response_status = 200").select("http_request_group_id")
            nations = table(self.spark, self.source, "nation").select(F.col("n_regionkey").cast("string").alias("http_request_group_id"), F.col("n_nationkey").cast("string").alias("k"))
            rows = nations.join(answered, "http_request_group_id").select("http_request_group_id", F.concat(F.lit("nation"), "k").alias("http_request_id"), F.concat(F.lit("https://api.example/"), "k").alias("request_url"))
        return ledger_tables.with_defaults(rows, self.schema, {})


@_query("""WITH r AS (SELECT r_regionkey AS k FROM region), n AS (SELECT n_regionkey AS k, n_nationkey AS m FROM nation WHERE n_regionkey % 7 <> 0)
SELECT CAST(k AS VARCHAR) AS lane, 0 AS step, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS calls, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS answered FROM r
UNION ALL SELECT CAST(k AS VARCHAR), 2, CAST(sum(CASE WHEN m % 7 = 0 THEN 2 ELSE 1 END) AS INT), CAST(count(*) FILTER (m % 7 <> 0) AS INT) FROM n GROUP BY k""")
def ledger_graph_run(spark: SparkSession, d: str) -> DataFrame:
    """Lanes and steps bound to a ledger, with one retry within each step; made again, it makes no further call."""
    root = workspace(spark)
    for _ in range(2):
        made = RegionGraph(spark, MAIN, root)
        made.source = d
        if made.states().isEmpty():
            made.make(retries=1)
        else:
            made.make()
    rows = made.states()
    return rows.groupBy(F.col("http_request_group_id").alias("lane"), "step").agg(F.count(F.lit(1)).cast("int").alias("calls"), F.count_if(F.col("response_status") == 200).cast("int").alias("answered"))


# --- operators on ledgers' tables


_H = "(SELECT DISTINCT http_request_id, http_request_group_id, response_status, requested_at_utc, created_at_utc, superseded_by_id FROM http_requests)"


def _http(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "http_requests").select("http_request_id", *columns).distinct()


@_query(f"""WITH g AS (SELECT min(http_request_group_id) AS g FROM http_requests)
SELECT 'pending' AS scope, http_request_id FROM {_H}, g WHERE http_request_group_id = g AND requested_at_utc IS NULL AND superseded_by_id IS NULL
UNION ALL SELECT 'failed', http_request_id FROM {_H}, g WHERE http_request_group_id = g AND response_status <> 200 AND superseded_by_id IS NULL""")
def ledger_scope_of_a_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _http(spark, d, "http_request_group_id", "response_status", "requested_at_utc", "superseded_by_id")
    group = ("http_request_group_id", rows.agg(F.min("http_request_group_id")).first()[0])
    return ledger.pending(rows, HTTP, group).select(F.lit("pending").alias("scope"), "http_request_id").unionByName(ledger.failed(rows, HTTP, group).select(F.lit("failed").alias("scope"), "http_request_id"))


@_query("""WITH h AS (SELECT DISTINCT http_request_id, response_status FROM http_requests), l AS (SELECT DISTINCT llm_request_id, http_request_id, superseded_by_id FROM llm_requests)
SELECT coalesce('http' || response_status, 'no_http') AS label, count(*) AS n FROM l LEFT JOIN h ON l.http_request_id = h.http_request_id WHERE superseded_by_id IS NULL GROUP BY 1""")
def ledger_model_statuses(spark: SparkSession, d: str) -> DataFrame:
    return ledger.model_statuses(_http(spark, d, "response_status"), table(spark, d, "llm_requests").select("llm_request_id", "http_request_id", "superseded_by_id").distinct())


@_query("""WITH l AS (SELECT DISTINCT llm_request_id, system_prompt, user_prompt, model_input_token_price_usd, response_text FROM llm_requests)
SELECT round(coalesce(sum((length(coalesce(system_prompt, '')) + length(coalesce(user_prompt, '')))::DOUBLE / 4.0 * 1.1 * model_input_token_price_usd), 0.0), 6) AS cost_usd FROM l WHERE response_text IS NOT NULL""")
def ledger_model_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_requests").select("llm_request_id", "system_prompt", "user_prompt", "model_input_token_price_usd", "response_text").distinct()
    cost = numbers.expected_cost(F.col("model_input_token_price_usd"), F.col("system_prompt"), F.col("user_prompt"))
    return ledger.model_cost(rows, cost).select(F.round("cost_usd", 6).alias("cost_usd"))


@_query(f"SELECT DISTINCT h.http_request_id, l.llm_request_id, l.model_id FROM {_H} h JOIN llm_requests l ON h.http_request_id = l.http_request_id WHERE h.response_status = 200")
def http_with_extra(spark: SparkSession, d: str) -> DataFrame:
    """Successful HTTP requests with columns of the rows that extend them."""
    extra = table(spark, d, "llm_requests").select("http_request_id", "llm_request_id", "model_id").distinct()
    return ledger.ok_with_extra(_http(spark, d, "response_status"), HTTP, extra, "http_request_id").drop("response_status")


@_query(r"""SELECT DISTINCT t.agent_task_id, count(*) AS messages, any_value(regexp_replace(coalesce(t.final_response, ''), '^\s+|\s+$', '', 'g')) AS narrative
FROM (SELECT DISTINCT agent_task_id, final_response, is_error FROM agent_tasks) t JOIN (SELECT DISTINCT agent_task_id, agent_message_id FROM agent_messages) m ON t.agent_task_id = m.agent_task_id WHERE coalesce(is_error, false) = false GROUP BY t.agent_task_id""")
def tasks_with_extra(spark: SparkSession, d: str) -> DataFrame:
    """Tasks without an error with what belongs to them: their number of messages."""
    extra = table(spark, d, "agent_messages").select("agent_task_id", "agent_message_id").distinct().groupBy("agent_task_id").agg(F.count(F.lit(1)).alias("messages"))
    tasks = table(spark, d, "agent_tasks").select("agent_task_id", "final_response", "is_error").distinct()
    return ledger.ok_with_extra(tasks, AGENT, extra, "agent_task_id").select("agent_task_id", "messages", text.strip(F.col("final_response")).alias("narrative"))


@_query(f"SELECT count(*) AS total, round(count(*) / (date_sub('microsecond', min(created_at_utc), max(requested_at_utc)) / 1000000.0), 9) AS rps FROM {_H}")
def ledger_throughput(spark: SparkSession, d: str) -> DataFrame:
    rows = _http(spark, d, "created_at_utc", "requested_at_utc")
    return ledger.throughput(rows, "created_at_utc", "requested_at_utc").select("total", F.round("rps", 9).alias("rps"))


@_query(f"SELECT count(*) AS n FROM {_H} WHERE superseded_by_id IS NULL")
def ledger_count_of_current(spark: SparkSession, d: str) -> DataFrame:
    return ledger.current(_http(spark, d, "superseded_by_id")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_error_on_miss(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue lookup in which a key that the catalogue lacks fails the job."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    found = ledger_tables.lookup(ledger_tables.lookup(table(spark, d, "supplier"), nations, "s_nationkey"), regions, "n_regionkey")
    return found.select("s_suppkey", "n_name", "r_name")


@_query("SELECT p_partkey, word.at - 1 AS place, word.w AS word FROM (SELECT p_partkey, unnest(list_transform(string_split(p_name, ' '), lambda w, i: {'w': w, 'at': i})) AS word FROM part)")
def child_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a child table from arrays, with place and an id that follows from both."""
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word")))
    rows = ledger_tables.children(table(spark, d, "part"), "p_partkey", words, "part_word_id")
    return rows.where(F.length("part_word_id") == 64).select("p_partkey", "place", "word")


@_query("SELECT p_partkey, p_name, p_size FROM part")
def spec_flattened_and_gathered(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    spec = ledger_tables.gathered(parts, "spec", ["p_name", "p_size"])
    flat = ledger_tables.flattened(spec, "spec", "x_")
    return ledger_tables.flattened(ledger_tables.gathered(flat, "again", ["p_name", "p_size"], "x_"), "again")


@_query(said([("made", "['groups', 'requests']"), ("kept", 2), ("replaced", 0), ("defaults", "Row(request_id='a', created_at_utc=None, weight=5)"), ("dropped", "[]"), ("taken", "ValueError: created_at_utc is a column of every such table")]))
def project_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a project created, kept, replaced and dropped; the key, the default and the guard of names."""
    root = workspace(spark)
    name, kinds, defaults = ledger_tables.project_table("p", "requests", {"weight": (int, 5)})
    tables = {"requests": kinds, "groups": ledger_tables.project_table("p", "request_groups")[1]}
    storage = Storage(spark)

    def there() -> list[str]:
        return sorted(n for n in tables if storage.exists(f"{root}/{n}/_SUCCESS"))

    ledger_tables.create_tables(spark, root, tables)
    out = [("made", there())]
    row = ledger_tables.with_defaults(spark.createDataFrame([("a",), ("b",)], "request_id string"), kinds, defaults)
    row.write.mode("append").parquet(f"{root}/requests")
    ledger_tables.create_tables(spark, root, tables)
    out.append(("kept", spark.read.parquet(f"{root}/requests").count()))
    ledger_tables.create_tables(spark, root, tables, replace=True)
    out += [("replaced", spark.read.schema(kinds).parquet(f"{root}/requests").count()), ("defaults", row.where("request_id = 'a'").first())]
    ledger_tables.drop_tables(spark, root, list(tables))
    return told(spark, [*out, ("dropped", there()), ("taken", outcome(lambda: ledger_tables.project_table("p", "requests", {"created_at_utc": str})))])


# --- functions not shown elsewhere


@_query("SELECT o_orderkey, printf('%.2f', round(o_totalprice, 2)) AS price, CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE 'k/' || o_orderkey END AS path FROM orders")
def numbers_and_paths(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 2 == 0, F.lit("/root/m")).otherwise(F.concat(F.lit("/root/k/"), key))
    return table(spark, d, "orders").select("o_orderkey", text.fixed(F.round("o_totalprice", 2), 2).alias("price"), text.relative_to(path, F.lit("/root"), F.lit("/root/m")).alias("path"))


@_query("SELECT doc_id, text || chr(65533) AS decoded FROM documents WHERE text IS NOT NULL")
def bytes_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes with a byte that is no UTF-8 behind them, read again."""
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.decode_lossy(broken).alias("decoded"))


@_query("SELECT event_id, event_id % 3 = 0 AS ok, CASE event_id % 3 WHEN 1 THEN 'response is not valid JSON' WHEN 2 THEN 'empty response' END AS error FROM events")
def structured_outputs(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("event_id") % 3
    given = F.when(part == 0, F.col("props")).when(part == 1, F.expr("left(props, length(props) - 1)")).otherwise(F.lit("  "))
    return table(spark, d, "events").select("event_id", jsontext.is_json(given).alias("ok"), jsontext.structured_error(F.lit("{}"), given).alias("error"))


@_query("SELECT n_nationkey, 'two' AS a, n_name AS b, 'one' AS c FROM nation")
def headers_merged(spark: SparkSession, d: str) -> DataFrame:
    merged = jsontext.merge_headers(F.lit('{"A":"one","C":"one"}'), F.to_json(F.struct(F.lit("two").alias("A"), F.col("n_name").alias("B"))))
    return table(spark, d, "nation").select("n_nationkey", *(merged[k.upper()].alias(k) for k in "abc"))


@_query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"key\":' || n_nationkey || '}' AS body, len([n_name, 'x']) AS listed FROM nation")
def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = jsontext.request_body(name=F.col("n_name"), absent=F.lit(None).cast("string"), key=F.col("n_nationkey"))
    listed = jsontext.list_of_text(jsontext.text_list(F.array("n_name", F.lit("x"))))
    return table(spark, d, "nation").select("n_nationkey", body.alias("body"), F.size(listed).cast("bigint").alias("listed"))


_SMALL = [
    ("rate", "(1.0, 2.0)"), ("summary", "make_summary | rows=3 cols=2 path=/p"), ("closed", '{"type": "object", "properties": {"a": {"properties": {}, "additionalProperties": false}}, "additionalProperties": false}'),
    ("now", "2024-05-01 12:30:00"), ("sql", "SELECT CAST(`a b` AS STRING) FROM parquet.`p`"), ("filled", "SELECT 'it''s', 5"), ("template", "FileNotFoundError"), ("root", "RuntimeError: the warehouse root is not set"), ("document", "# 7 rows"),
]


@_query(said(_SMALL))
def driver_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the driver: rates, summary lines, closed schemas, a fixed time, SQL text, templates, settings."""
    from pelorus.sources.sql import template

    closed = jsontext.close_objects({"type": "object", "properties": {"a": {"properties": {}}}})
    now = spark.range(1).select(numbers.utc_now(datetime(2024, 5, 1, 12, 30)).alias("t")).first().t
    return told(
        spark,
        [
            ("rate", numbers.normal_rate(0.5, 1.0)), ("summary", format_summary("make", {"path": "/p", "rows": 3, "cols": 2})), ("closed", json.dumps(closed)), ("now", now),
            ("sql", spark_text("SELECT CAST(\"a b\" AS VARCHAR) FROM read_parquet('p');")), ("filled", filled("SELECT '{{ a }}', {{ b }}", {"a": "it's", "b": 5})),
            ("template", outcome(lambda: template("none.sql", "pelorus")).split(":")[0]), ("root", outcome(settings.Settings().require_root)), ("document", report.fill("# {{ n.rows }} rows", {"n": {"rows": 7}})),
        ],
    )


# --- documents, models, order of objects


class NationReport(Document):
    id, supported_versions, source = "nation_report", (MAIN,), ""
    template = "# Nations\n\n{{ table }}\n\n- {{ n }} in all"

    def data(self):
        rows = table(self.spark, self.source, "nation")
        return {"table": report.markdown_table(rows.select("n_nationkey", "n_name").orderBy("n_nationkey")), "n": rows.count()}


@_query("""SELECT 'md' AS kind, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT 'html', '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' FROM nation
UNION ALL SELECT 'md', '- ' || count(*) || ' in all' FROM nation UNION ALL SELECT 'html', '<li>' || count(*) || ' in all</li>' FROM nation
UNION ALL SELECT * FROM (VALUES ('md', '# Nations'), ('html', '<h1>Nations</h1>'), ('md', '| n_nationkey | n_name |'), ('html', '<tr><th>n_nationkey</th><th>n_name</th></tr>')) AS t""")
def documents_made(spark: SparkSession, d: str) -> DataFrame:
    """A report in Markdown and HTML, line by line."""
    made = NationReport(spark, MAIN, workspace(spark))
    made.source = d
    made.make()
    made.convert(Format.HTML)
    lines = [spark.read.text(made.path(f)).select(F.lit(f.value).alias("kind"), F.col("value").alias("line")) for f in (Format.MD, Format.HTML)]
    return lines[0].unionByName(lines[1]).where(F.col("line").rlike(r"^(# |\| [^-]|- \d|<h1|<tr|<li)"))


@_query("SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(o_totalprice), 4) AS mean FROM orders")
def model_saved_and_loaded(spark: SparkSession, d: str) -> DataFrame:
    """A fitted model saved and loaded: what it has learned is the mean of the column."""
    from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler

    from pelorus.plans.objects import Model

    rows = VectorAssembler(inputCols=["o_totalprice"], outputCol="x").transform(table(spark, d, "orders"))

    class Scale(Model):
        id, supported_versions, load_with = "scale", (MAIN,), StandardScalerModel.load

        def fit(self):
            return StandardScaler(inputCol="x", outputCol="y").fit(rows)

    mean = float(Scale(spark, MAIN, workspace(spark)).make().model.mean[0])
    return rows.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.round(F.lit(mean), 4).alias("mean"))


@dag.asset(group="places", formats=(Format.CSV,))
class GraphNations(Nations):
    id = "graph_nations"


@dag.asset(deps=(GraphNations,), group="places", owner="someone")
class GraphCounts(NationsByRegion):
    id = "graph_counts"

    def sources(self):
        return (GraphNations(self.spark, self.version, self.root).df,)


@_query("""SELECT version, n_regionkey, count(*) AS n FROM nation, (VALUES ('main'), ('other')) AS t(version) GROUP BY ALL""")
def graph_of_objects_made(spark: SparkSession, d: str) -> DataFrame:
    """Objects made in the order of their dependencies, for two versions in one run."""
    root, out = workspace(spark), None
    GraphNations.source = d
    for made in dag.run(spark, [GraphCounts, GraphNations], ("main", "other"), root=root):
        if isinstance(made, GraphCounts):
            rows = made.df.select(F.lit(made.version.id).alias("version"), "n_regionkey", "n")
            out = rows if out is None else out.unionByName(rows)
    return out


_ORDER = [
    ("order", "['graph_nations', 'graph_counts']"), ("missing", "['GraphNations']"), ("unused", "[]"), ("outside", "ValueError: GraphCounts depends on GraphNations, which is not in the set"), ("repeated", "ValueError: repeated: graph_nations"),
    ("reserved", "ValueError: reserved names: name"), ("unknown", "ValueError: unknown keys: colour"), ("manifest", "asset          deps           group   formats  kwargs"), ("partitions", "['main', 'other']"),
]


@_query(said(_ORDER))
def graph_of_objects(spark: SparkSession, d: str) -> DataFrame:
    """Order, dependencies found in the code against those declared, guards, manifest, versions as partitions."""
    plain = dag.Wiring(())
    seen = dag.lint(type("Plain", (GraphCounts,), {"wiring": plain, "sources": GraphCounts.sources, "__module__": __name__}))
    return told(
        spark,
        [
            ("order", [c.id for c in dag.ordered([GraphCounts, GraphNations])]), ("missing", [c.__name__ for c in seen.missing]), ("unused", [c.__name__ for c in dag.lint(GraphCounts).unused]),
            ("outside", outcome(lambda: dag.ordered([GraphCounts]))), ("repeated", outcome(lambda: dag.ordered([GraphNations, GraphNations]))), ("reserved", outcome(lambda: dag.asset(name="x"))),
            ("unknown", outcome(lambda: dag.with_overrides([GraphNations], {GraphNations: {"colour": 1}}))), ("manifest", dag.manifest([GraphCounts, GraphNations]).split("\n")[0]), ("partitions", dag.partitions([GraphCounts, GraphNations])),
        ],
    )


@_query("SELECT user_id, event_id FROM events")
def stream_drained(spark: SparkSession, d: str) -> DataFrame:
    """Files drained as a stream in two runs; the second finds nothing new, so each row comes once."""
    from pelorus.streaming.drain import drain

    root = workspace(spark)
    rows = table(spark, d, "events").select("user_id", "event_id")
    rows.write.parquet(f"{root}/in")
    for _ in range(2):
        drain(spark, f"{root}/in", rows.schema, f"{root}/state", lambda batch, n: batch.write.mode("append").parquet(f"{root}/out"))
    return spark.read.schema(rows.schema).parquet(f"{root}/out")
