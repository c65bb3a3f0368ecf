"""Versioned pipeline steps with one lifecycle: make, convert, delete."""

from __future__ import annotations

import asyncio
import html
import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass
from enum import Enum
from pathlib import Path
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.plans import settings
from pelorus.plans.journal import format_summary, logger, object_log
from pelorus.plans.schema import assert_schema, row_schema
from pelorus.plans.storage import Storage


class CheckFailedError(Exception):
    """A quality check does not hold; the object's data stay where they are."""


@dataclass(frozen=True)
class Version:
    """One variant of an object; subclasses may add fields that builds read."""

    id: str
    name: str = ""
    description: str = ""

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """The version's fields as rows ``(key, value)`` of text."""
        return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in asdict(self).items()], "key string, value string")


class Format(str, Enum):
    PARQUET = "parquet"
    CSV = "csv"
    TSV = "tsv"
    JSON = "json"
    JSONL = "jsonl"
    FILES = "files"
    ZIP = "zip"
    TAR_ZST = "tar.zst"
    MD = "md"
    HTML = "html"
    MODEL = "model"


class BaseCheck:
    """A quality check; ``applies_to`` names the class of objects it is for."""

    applies_to: ClassVar[type | None] = None
    ledger_only: ClassVar[bool] = False

    @property
    def name(self) -> str:
        return type(self).__name__

    def require(self, obj: DataObject) -> None:
        if self.applies_to is not None and not isinstance(obj, self.applies_to):
            raise TypeError(f"{self.name} applies to {self.applies_to.__name__}, not to {type(obj).__name__}")

    def run(self, obj: DataObject) -> None:
        raise NotImplementedError


class DataObject:
    """A step of a pipeline. Subclasses set ``id``, ``make_format`` and ``supported_versions`` and define ``_make``."""

    id: ClassVar[str]
    description: ClassVar[str] = ""
    make_format: ClassVar[Format]
    supported_versions: ClassVar[Sequence[Version]] = ()
    formats: ClassVar[Sequence[Format]] = ()
    checks: ClassVar[Sequence[BaseCheck]] = ()
    rebuildable: ClassVar[bool] = True

    def __init__(self, spark: SparkSession, version: Version, root: str | None = None) -> None:
        if version not in self.supported_versions:
            raise ValueError(f"{type(self).__name__} does not support version {version.id!r}")
        self.spark, self.version, self._root = spark, version, root
        self.storage = Storage(spark)

    # names and places

    @property
    def stem(self) -> str:
        return f"{self.id}-{self.version.id}"

    @property
    def root(self) -> str:
        return (self._root or settings.current.require_root()).rstrip("/")

    @property
    def directory(self) -> str:
        return f"{self.root}/{self.stem}"

    def path(self, fmt: Format | None = None) -> str:
        return f"{self.directory}/{self.stem}.{(fmt or self.make_format).value}"

    @property
    def readme_path(self) -> str:
        return f"{self.directory}/{self.stem}.readme.html"

    @property
    def log_path(self) -> str | None:
        """The log lies beside the data on a local disk; elsewhere there is none."""
        return f"{self.directory}/{self.stem}.meta.log" if "://" not in self.directory else None

    def exists(self) -> bool:
        """Whether the master is there and whole: a directory that Spark wrote counts once it has its success marker."""
        path = self.path()
        return self.storage.exists(path) and (self.make_format is not Format.PARQUET or self.storage.exists(f"{path}/_SUCCESS"))

    # lifecycle

    def _make(self) -> dict[str, object]:
        """Write the master; return fields for the summary."""
        raise NotImplementedError

    def make(self, replace: bool = False) -> DataObject:
        """Build the master, then its README, then run the checks; a failed check leaves the data in place."""
        self._precondition(replace)
        with object_log(self.stem, self.log_path, "make"):
            began = time.time()
            fields = self._make() or {}
            _, size = self.storage.size(self.path())
            logger.info(format_summary("make", {"dur_s": f"{time.time() - began:.2f}", "bytes": size, **fields, "path": self.path()}))
            self.write_readme()
            self.run_checks()
        return self

    async def amake(self, replace: bool = False) -> DataObject:
        return await asyncio.to_thread(self.make, replace)

    def _precondition(self, replace: bool) -> None:
        if self.storage.exists(self.path()):
            if not self.exists():
                self.storage.delete(self.path())  # left over from a write that did not end
            elif not replace:
                raise FileExistsError(f"{self.path()} exists; use replace=True")
            else:
                self.delete()

    def run_checks(self) -> None:
        """All checks in order; the first that fails raises :class:`CheckFailedError`."""
        for check in self.checks:
            check.require(self)
            check.run(self)

    def convert(self, fmt: Format | None = None, replace: bool = False) -> list[str]:
        """Write the master in another format, or in all others. Nothing is written if a target exists already."""
        if not self.exists():
            raise FileNotFoundError(f"{self.path()} does not exist")
        if fmt is not None and not isinstance(fmt, Format):
            raise TypeError(f"{fmt!r} is no Format")
        targets = [f for f in ([fmt] if fmt else self.formats) if f is not self.make_format]
        for f in targets:
            if not hasattr(self, self._converter(f)):
                raise NotImplementedError(f"{type(self).__name__} has no conversion to {f.value}")
            if self.storage.exists(self.path(f)) and not replace:
                raise FileExistsError(f"{self.path(f)} exists; use replace=True")
        for f in targets:
            self.storage.delete(self.path(f))
            getattr(self, self._converter(f))(self.path(f))
        return [self.path(f) for f in targets]

    @staticmethod
    def _converter(fmt: Format) -> str:
        return f"_to_{fmt.value.replace('.', '_')}"

    def delete(self) -> None:
        """Remove the object's directory; nothing happens if there is none."""
        files, size = self.storage.size(self.directory)
        if files:
            logger.info(format_summary("delete", {"files": files, "bytes": size, "path": self.directory}))
        self.storage.delete(self.directory)

    def write_readme(self) -> None:
        self.storage.write_text(self.readme_path, self.readme())

    def readme(self) -> str:
        e = html.escape
        return f"<!doctype html>\n<title>{e(self.stem)}</title>\n<h1>{e(self.id)}</h1>\n<p>{e(self.description)}</p>\n<p>Version {e(self.version.id)}: {e(self.version.description or self.version.name)}</p>\n{self._readme_body()}"

    def _readme_body(self) -> str:
        return ""


class Table(DataObject):
    """A typed table, written whole. Define ``build`` (a DataFrame) or ``sql``; ``row_model`` gates the write."""

    make_format = Format.PARQUET
    formats = (Format.PARQUET, Format.CSV, Format.TSV, Format.JSON, Format.JSONL)
    row_model: ClassVar[type]
    validate: ClassVar[bool] = True
    partition_by: ClassVar[Sequence[str]] = ()

    def build(self) -> DataFrame:
        raise NotImplementedError

    @property
    def df(self) -> DataFrame:
        """The stored table, read lazily."""
        if not self.exists():
            raise FileNotFoundError(f"{self.path()} does not exist")
        return self.spark.read.parquet(self.path())

    def _make(self) -> dict[str, object]:
        return self.save(self.build())

    def save(self, df: DataFrame, validate: bool | None = None) -> dict[str, object]:
        """Gate on the analysed schema before any job, write to a side directory, rename. Rows are counted while writing."""
        if self.validate if validate is None else validate:
            assert_schema(df, self.row_model)
        from pyspark.sql import Observation

        seen, aside = Observation(), f"{self.path()}.tmp-{uuid.uuid4().hex}"
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        try:
            writer = observed.write
            (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(aside)
            self.storage.rename(aside, self.path())
        except BaseException:
            self.storage.delete(aside)
            raise
        return {"rows": seen.get["rows"], "cols": len(df.columns)}

    def _to_csv(self, path: str, sep: str = ",") -> None:
        """One directory of part files with a header each; quotes are doubled, times are plain."""
        options = {"header": "true", "sep": sep, "quote": '"', "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
        self.df.write.options(**options).csv(path)

    def _to_tsv(self, path: str) -> None:
        self._to_csv(path, "\t")

    def _to_jsonl(self, path: str) -> None:
        self.df.write.json(path, ignoreNullFields=False)

    def _to_json(self, path: str) -> None:
        """One array of records with nulls kept; rows stream through the driver one partition at a time."""
        if "://" in path:
            raise ValueError("the JSON array needs a local path; use jsonl elsewhere")
        with Path(path).open("w", encoding="utf-8") as out:
            out.write("[")
            for n, row in enumerate(self.df.toLocalIterator(prefetchPartitions=True)):
                out.write(("," if n else "") + "\n" + json.dumps(row.asDict(recursive=True), indent=2, default=str, ensure_ascii=False))
            out.write("\n]\n")

    def _readme_body(self) -> str:
        e, rows = html.escape, []
        fields = row_schema(self.row_model).fields
        units = any(f.metadata.get("units") for f in fields)
        for f in fields:
            cells = [f.name, f.dataType.simpleString(), f.metadata.get("title", ""), f.metadata.get("description", "")] + ([f.metadata.get("units", "")] if units else [])
            rows.append("<tr>" + "".join(f"<td>{e(str(c))}</td>" for c in cells) + "</tr>")
        head = "".join(f"<th>{h}</th>" for h in ["column", "type", "title", "description"] + (["units"] if units else []))
        return f"<table>\n<tr>{head}</tr>\n" + "\n".join(rows) + "\n</table>\n"


class SQLTable(Table):
    """A table from SQL text with named parameters and DataFrames, never by splicing values into the text."""

    sql: ClassVar[str]

    def arguments(self) -> dict[str, Any]:
        """Values of ``:name`` parameters."""
        return {}

    def frames(self) -> dict[str, DataFrame]:
        """DataFrames of ``{name}`` references."""
        return {}

    def setup(self, spark: SparkSession) -> None:
        """Register functions and views or set the session up before the SQL is read."""

    def build(self) -> DataFrame:
        from pelorus.sources.sql import query

        return query(self.spark, self.sql, self.arguments(), self.frames(), self.setup)


class TableFrom(Table):
    """A table from other objects' DataFrames."""

    def sources(self) -> Iterable[DataFrame]:
        raise NotImplementedError

    def transform(self, *frames: DataFrame) -> DataFrame:
        raise NotImplementedError

    def build(self) -> DataFrame:
        return self.transform(*self.sources())


class Files(DataObject):
    """A directory of any files. Define ``write_files(directory)``."""

    make_format = Format.FILES
    formats = (Format.FILES, Format.ZIP, Format.TAR_ZST)

    def write_files(self, directory: str) -> None:
        raise NotImplementedError

    def _make(self) -> dict[str, object]:
        if "://" not in self.path():
            Path(self.path()).mkdir(parents=True, exist_ok=True)
        self.write_files(self.path())
        return {"files": self.storage.size(self.path())[0]}

    @property
    def df(self) -> DataFrame:
        """``(path, length)`` of every file; contents are not read."""
        from pelorus.sources.files import listing

        return listing(self.spark, self.path())

    def _to_zip(self, path: str) -> None:
        from pelorus.sources.files import pack_zip

        pack_zip(self.path(), path)

    def _to_tar_zst(self, path: str) -> None:
        from pelorus.sources.files import pack_tar_zst

        pack_tar_zst(self.path(), path)


class ManualFiles(Files):
    """Files kept by hand: never built, replaced, converted or deleted."""

    rebuildable = False

    def make(self, replace: bool = False) -> DataObject:
        if replace:
            logger.warning("%s is kept by hand; replace is ignored", self.stem)
        if not self.storage.exists(self.path()):
            raise FileNotFoundError(f"put the files into {self.path()}")
        self.run_checks()
        return self

    def convert(self, fmt: Format | None = None, replace: bool = False) -> list[str]:
        logger.warning("%s is kept by hand; convert is ignored", self.stem)
        return []

    def delete(self) -> None:
        raise RuntimeError(f"{self.stem} is kept by hand and is not deleted")


class Document(DataObject):
    """Markdown from a template with ``{{ name }}`` places; ``data`` may collect small results."""

    make_format = Format.MD
    formats = (Format.MD, Format.HTML)
    template: ClassVar[str]

    def data(self) -> dict[str, object]:
        return {}

    def _make(self) -> dict[str, object]:
        from pelorus.plans.report import fill

        self.storage.write_text(self.path(), fill(self.template, self.data()))
        return {}

    def _to_html(self, path: str) -> None:
        from pelorus.plans.report import markdown_to_html

        text = "\n".join(r.value for r in self.spark.read.text(self.path()).collect())
        self.storage.write_text(path, markdown_to_html(text, self.stem))


class Model(DataObject):
    """A fitted pyspark.ml model, saved by its own writer."""

    make_format = Format.MODEL
    formats = (Format.MODEL,)
    load_with: ClassVar[Callable[[str], Any]]

    def fit(self) -> Any:
        raise NotImplementedError

    def _make(self) -> dict[str, object]:
        self.fit().write().overwrite().save(self.path())
        return {}

    @property
    def model(self) -> Any:
        return type(self).load_with(self.path())
