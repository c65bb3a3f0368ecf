"""Data-quality checks: as DataFrame metrics for tables of any size, and as checks of objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions.jsontext import matches_schema
from pelorus.operators.ledger import failure_rate
from pelorus.plans.objects import BaseCheck, CheckFailedError, DataObject, Files, Table
from pelorus.plans.schema import row_schema


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``rows`` and, per column, how many nulls; a single pass that reads these columns only. NaN is no null."""
    _known(df, columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns))


def largest_group(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(groups, largest)``: how often the most frequent key occurs, 0 in an empty table. Nulls are a value."""
    _known(df, columns)
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def file_metrics(files: DataFrame, small: int = 1) -> DataFrame:
    """One row over ``(path, length)``: files, bytes, empty ones and those under ``small`` bytes."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("length") == 0).alias("empty"),
        F.count_if(F.col("length") < small).alias("small"),
    )


def invalid_json(df: DataFrame, content: Column, model: type) -> DataFrame:
    """The rows whose text is no JSON object of the row model."""
    return df.where(~matches_schema(content, row_schema(model)))


def _known(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise CheckFailedError(f"unknown columns: {', '.join(missing)}")


class MinRows(BaseCheck):
    applies_to = Table

    def __init__(self, least: int) -> None:
        self.least = least

    def run(self, obj: DataObject) -> None:
        found = obj.df.limit(self.least).count()  # enough to know
        if found < self.least:
            raise CheckFailedError(f"MinRows: {found} rows, expected at least {self.least}")


class NoNulls(BaseCheck):
    applies_to = Table

    def __init__(self, *columns: str) -> None:
        if not columns:
            raise ValueError("NoNulls needs columns")
        self.columns = columns

    def run(self, obj: DataObject) -> None:
        row = null_counts(obj.df, self.columns).first()
        if bad := [f"{c}={row[f'{c}_nulls']}" for c in self.columns if row[f"{c}_nulls"]]:
            raise CheckFailedError(f"NoNulls: {', '.join(bad)}")


class Unique(BaseCheck):
    applies_to = Table

    def __init__(self, *columns: str) -> None:
        if not columns:
            raise ValueError("Unique needs columns")
        self.columns = columns

    def run(self, obj: DataObject) -> None:
        largest = largest_group(obj.df, self.columns).first()["largest"]
        if largest > 1:
            raise CheckFailedError(f"Unique: a key of ({', '.join(self.columns)}) occurs {largest} times")


class MinFiles(BaseCheck):
    applies_to = Files

    def __init__(self, least: int) -> None:
        self.least = least

    def run(self, obj: DataObject) -> None:
        found = obj.storage.size(obj.path())[0]
        if found < self.least:
            raise CheckFailedError(f"MinFiles: {found} files, expected at least {self.least}")


class MinFileSize(BaseCheck):
    applies_to = Files

    def __init__(self, least: int) -> None:
        self.least = least

    def run(self, obj: DataObject) -> None:
        small = [p for p, size in obj.storage.files(obj.path()) if size < self.least]
        if small:
            raise CheckFailedError(f"{self.name}: {len(small)} files under {self.least} bytes, first {min(small)}")


class NoEmptyFiles(MinFileSize):
    def __init__(self) -> None:
        super().__init__(1)


class SchemaMatches(BaseCheck):
    applies_to = Files

    def __init__(self, model: type) -> None:
        self.model = model

    def run(self, obj: DataObject) -> None:
        from pelorus.sources.files import contents

        files = contents(obj.spark, obj.path(), "*.[jJ][sS][oO][nN]")
        bad = invalid_json(files, F.col("content").cast("string"), self.model).select(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).first()
        if bad["n"]:
            raise CheckFailedError(f"SchemaMatches: {bad['n']} files do not match {self.model.__name__}, first {bad['first']}")


class MinRequests(BaseCheck):
    ledger_only = True

    def __init__(self, least: int) -> None:
        self.least = least

    def run(self, obj: DataObject) -> None:
        _need_ledger(self, obj)
        found = obj.current().limit(self.least).count()
        if found < self.least:
            raise CheckFailedError(f"MinRequests: {found} current requests, expected at least {self.least}")


class MaxFailureRate(BaseCheck):
    ledger_only = True

    def __init__(self, *, frac: float) -> None:
        if not 0 <= frac <= 1:
            raise ValueError("frac must lie in 0..1")
        self.frac = frac

    def run(self, obj: DataObject) -> None:
        _need_ledger(self, obj)
        row = failure_rate(obj.current(), obj.kind).first()
        if row["total"] and row["failed"] / row["total"] > self.frac:
            raise CheckFailedError(f"MaxFailureRate: {row['failed']} of {row['total']} failed, at most {self.frac:g} may")


def _need_ledger(check: BaseCheck, obj: DataObject) -> None:
    if not hasattr(obj, "current"):
        raise NotImplementedError(f"{check.name} is for ledgers")
