"""Schema gate, lifecycle, conversions, checks and documents."""

import asyncio
import csv
import json
import tarfile
import zipfile
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from io import BytesIO
from pathlib import Path
from typing import Optional

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.operators import checks
from pelorus.plans.journal import format_summary
from pelorus.plans.objects import CheckFailedError, Document, Files, Format, ManualFiles, SQLTable, Table, TableFrom, Version
from pelorus.plans.report import fill, markdown_table
from pelorus.plans.schema import row_schema

MAIN = Version("main", "Main")


@dataclass
class Widget:
    widget_id: int
    name: str | None
    value: int = field(metadata={"title": "Value", "description": "how <many>", "units": "pieces"})


class Widgets(SQLTable):
    id, description, row_model, supported_versions = "widgets", "Widgets & more", Widget, (MAIN,)
    checks = (checks.MinRows(3), checks.NoNulls("widget_id"), checks.Unique("widget_id"))
    sql = "SELECT c1::INT AS widget_id, c2 AS name, c3::BIGINT AS value FROM (VALUES (1, 'alpha', 10), (2, 'be\"ta, x', 20), (3, NULL, :third)) AS t(c1, c2, c3);"

    def arguments(self):
        return {"third": 30}


class Bad(Widgets):
    id, sql = "bad", "SELECT 1 AS widget_id, 'x' AS unexpected_column, 'y' AS value"

    def arguments(self):
        return {}


class Doubled(TableFrom):
    id, row_model, supported_versions = "doubled", Widget, (MAIN,)

    def sources(self):
        return (Widgets(self.spark, self.version, self.root).df,)

    def transform(self, widgets):
        return widgets.withColumn("value", F.col("value") * 2)


def test_types_of_row_models():
    @dataclass
    class All:
        i: int
        f: float
        b: bool
        s: str
        by: bytes
        ts: datetime
        d: date
        dec: Decimal
        n: Optional[int]

    got = {f.name: (f.dataType.simpleString(), f.nullable) for f in row_schema(All)}
    assert got == {"i": ("bigint", False), "f": ("double", False), "b": ("boolean", False), "s": ("string", False), "by": ("binary", False), "ts": ("timestamp_ntz", False), "d": ("date", False), "dec": ("decimal(38,18)", False), "n": ("bigint", True)}

    @dataclass
    class Either:
        x: int | str

    @dataclass
    class Nested:
        x: list[int]

    for model, words in ((Either, "Cannot map Union"), (Nested, "No Spark mapping")):
        with pytest.raises(TypeError, match=words):
            row_schema(model)


def test_make_convert_delete(spark, tmp_path):
    w = Widgets(spark, MAIN, str(tmp_path))
    assert not w.exists()
    with pytest.raises(FileNotFoundError):
        w.convert(Format.CSV)
    w.make()
    assert w.exists() and w.path().endswith("widgets-main/widgets-main.parquet") and w.df.count() == 3
    assert dict(w.df.dtypes)["widget_id"] == "int"  # any width of integer, as it came
    with pytest.raises(FileExistsError):
        w.make()
    with pytest.raises(TypeError):
        w.convert("csv")
    w.convert()
    with pytest.raises(FileExistsError):
        w.convert(Format.CSV)
    w.convert(Format.CSV, replace=True)
    want = [(1, "alpha", 10), (2, 'be"ta, x', 20), (3, None, 30)]
    for fmt, sep in ((Format.CSV, ","), (Format.TSV, "\t")):
        rows = [r for p in Path(w.path(fmt)).glob("part-*") for r in list(csv.reader(p.open(), delimiter=sep))[1:]]
        assert sorted((int(a), b or None, int(c)) for a, b, c in rows) == want
    records = json.loads(Path(w.path(Format.JSON)).read_text())
    assert sorted(tuple(r.values()) for r in records) == want
    readme = Path(w.readme_path).read_text()
    assert "Widgets &amp; more" in readme and "how &lt;many&gt;" in readme and "<th>units</th>" in readme
    log = Path(w.log_path).read_text()
    assert "rows=3" in log and log.rstrip().endswith("end make widgets-main")
    Doubled(spark, MAIN, str(tmp_path)).make()
    assert Doubled(spark, MAIN, str(tmp_path)).df.agg(F.sum("value")).first()[0] == 120
    asyncio.run(w.amake(replace=True))
    w.delete()
    w.delete()
    assert not Path(w.directory).exists()
    with pytest.raises(ValueError):
        Widgets(spark, Version("other"), str(tmp_path))


def test_gate_names_every_difference_and_writes_nothing(spark, tmp_path):
    bad = Bad(spark, MAIN, str(tmp_path))
    with pytest.raises(ValueError, match="Widget: missing column 'name'; column 'value' is string, expected bigint; unexpected column 'unexpected_column'"):
        bad.make()
    assert not Path(bad.path()).exists() and not list(Path(bad.directory).glob("*.tmp-*"))
    with pytest.raises(ValueError):
        bad.save(spark.range(1).select(F.col("id").alias("widget_id"), F.lit(None).alias("name"), F.col("id").alias("value")))
    bad.save(spark.range(1), validate=False)
    assert bad.exists()


def test_an_unfinished_write_does_not_count(spark, tmp_path):
    w = Widgets(spark, MAIN, str(tmp_path))
    Path(w.path()).mkdir(parents=True)
    assert not w.exists()
    assert w.make().exists()


class Rows(Table):
    id, row_model, supported_versions = "rows", T.StructType([T.StructField("city", T.StringType()), T.StructField("n", T.LongType())]), (MAIN,)
    rows = ()

    def build(self):
        return self.spark.createDataFrame(list(self.rows), self.row_model)


def test_table_checks(spark, tmp_path):
    def run(rows, *used):
        kind = type("R", (Rows,), {"rows": rows, "checks": used})
        return kind(spark, MAIN, str(tmp_path)).make(replace=True)

    run([("A", 1), ("B", 2)], checks.MinRows(2), checks.NoNulls("city", "n"), checks.Unique("city"))
    run([], checks.Unique("city"), checks.NoNulls("n"))
    for rows, check in (
        ([("A", 1)], checks.MinRows(2)), ([("A", 1), (None, 2)], checks.NoNulls("city")), ([("A", 1), ("A", 2)], checks.Unique("city")), ([(None, 1), (None, 2)], checks.Unique("city")),
        ([("A", 1)], checks.NoNulls("missing")), ([("A", 1)], checks.Unique("missing")),
    ):
        with pytest.raises(CheckFailedError):
            run(rows, check)
        assert Rows(spark, MAIN, str(tmp_path)).exists()
    for make in (checks.NoNulls, checks.Unique, lambda: checks.MaxFailureRate(frac=2)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        run([("A", 1)], checks.MinFiles(1))
    with pytest.raises(NotImplementedError):
        run([("A", 1)], checks.MinRequests(1))


@dataclass
class Shape:
    x: int


class Some(Files):
    id, supported_versions = "some", (MAIN,)
    made = {"a.json": '{"x": 1}', "deep/b.JSON": '{"x": 2}'}

    def write_files(self, directory):
        for name, content in self.made.items():
            path = Path(directory, name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content)


def test_files_and_their_checks(spark, tmp_path):
    def run(made, *used):
        return type("S", (Some,), {"made": made, "checks": used})(spark, MAIN, str(tmp_path)).make(replace=True)

    s = run(Some.made, checks.MinFiles(2), checks.NoEmptyFiles(), checks.MinFileSize(3), checks.SchemaMatches(Shape))
    assert s.df.count() == 2
    s.convert()
    assert sorted(zipfile.ZipFile(s.path(Format.ZIP)).namelist()) == ["a.json", "deep/b.JSON"]
    import zstandard

    raw = zstandard.ZstdDecompressor().stream_reader(Path(s.path(Format.TAR_ZST)).read_bytes()).read()
    assert sorted(tarfile.open(fileobj=BytesIO(raw)).getnames()) == ["a.json", "deep/b.JSON"]
    for made, check in (({"a.json": '{"x": 1}'}, checks.MinFiles(2)), ({"e.txt": ""}, checks.NoEmptyFiles()), ({"a": "12"}, checks.MinFileSize(3)), ({"b.json": '{"y": 1}'}, checks.SchemaMatches(Shape)), ({}, checks.MinFiles(1))):
        with pytest.raises(CheckFailedError):
            run(made, check)


def test_manual_files(spark, tmp_path):
    class Kept(ManualFiles):
        id, supported_versions = "kept", (MAIN,)

    k = Kept(spark, MAIN, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        k.make()
    Path(k.path()).mkdir(parents=True)
    Path(k.path(), "x.txt").write_text("x")
    assert k.make(replace=True).exists() and k.convert() == []
    with pytest.raises(RuntimeError):
        k.delete()


def test_documents(spark, tmp_path):
    class Doc(Document):
        id, supported_versions, template = "doc", (MAIN,), "# {{ title }}\n\n{{ table }}\n\n- a < b\n"

        def data(self):
            return {"title": "Report", "table": markdown_table(self.spark.createDataFrame([("A", 1.5), ("B", None)], "city string, t double"))}

    d = Doc(spark, MAIN, str(tmp_path))
    d.make()
    assert "| A | 1.50 |" in Path(d.path()).read_text()
    d.convert(Format.HTML)
    html = Path(d.path(Format.HTML)).read_text()
    assert "<h1>Report</h1>" in html and "<td>A</td>" in html and "a &lt; b" in html
    with pytest.raises(KeyError):
        fill("{{ nothing }}", {})
    with pytest.raises(ValueError):
        markdown_table(spark.range(5), most=4)
    assert format_summary("make", {"path": "/x", "rows": 1}) == "make_summary | rows=1 path=/x"
