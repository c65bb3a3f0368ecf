"""SQL text as a source: named parameters, DataFrames by name, a setup hook, templates of a package."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import resources
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def template(name: str, package: str, subpath: str = "templates") -> str:
    """A text resource of a package; ``FileNotFoundError`` if there is none."""
    found = resources.files(package).joinpath(subpath, name)
    if not found.is_file():
        raise FileNotFoundError(f"no template {subpath}/{name} in {package}")
    return found.read_text(encoding="utf-8")


def query(spark: SparkSession, text: str, args: dict[str, Any] | None = None, frames: dict[str, DataFrame] | None = None, setup: Callable[[SparkSession], None] | None = None) -> DataFrame:
    """One SQL statement as a lazy DataFrame. ``:name`` takes a value of ``args``, ``{name}`` a DataFrame of ``frames``."""
    if setup is not None:
        setup(spark)
    return spark.sql(text.strip().rstrip(";"), args=args or None, **(frames or {}))


_PIECES = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
_READ = re.compile(r"\bread_parquet\s*\(\s*('(?:[^']|'')*')\s*\)", re.I)
#: Type names of analytical SQL that Spark spells otherwise.
_TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "HUGEINT": "DECIMAL(38,0)", "BLOB": "BINARY", "TIMESTAMP": "TIMESTAMP_NTZ", "INT8": "BIGINT", "INT4": "INT", "FLOAT8": "DOUBLE"}
_CAST = re.compile(rf"(::\s*|\bAS\s+)({'|'.join(_TYPES)})\b(?!\s*\()(?=\s*\)|[^\w(]|$)", re.I)


def spark_text(text: str) -> str:
    """SQL written for a single-node analytical database, in Spark's spelling: type names in casts, ``read_parquet('p')``,
    double-quoted names, the final semicolon. Strings and comments stay as they are. One statement only.

    Not rewritten, since results would differ by version: null order (say ``NULLS LAST``), integer sums (say ``CAST``).
    """

    def casts(part: str) -> str:
        return _CAST.sub(lambda m: m[1] + _TYPES[m[2].upper()] if m[1].startswith(":") or part[m.end() :].lstrip().startswith(")") else m[0], part)

    text = _READ.sub(lambda m: "parquet.`" + m[1][1:-1].replace("''", "'").replace("`", "``") + "`", text)
    out, at = [], 0
    for m in _PIECES.finditer(text):
        piece = m[0]
        if piece.startswith('"'):
            piece = "`" + piece[1:-1].replace('""', '"').replace("`", "``") + "`"
        out += [casts(text[at : m.start()]), piece]
        at = m.end()
    return "".join([*out, casts(text[at:])]).strip().rstrip(";").strip()


def filled(text: str, values: dict[str, Any]) -> str:
    """A template's ``{{ name }}`` places as SQL literals: inside quotes the escaped text, elsewhere a number, text, boolean
    or null. An unknown name raises ``KeyError``, another kind of value ``TypeError``."""

    def literal(value: Any, quoted: bool) -> str:
        if quoted:
            return str(value).replace("\\", "\\\\").replace("'", "''")
        if value is None or isinstance(value, bool):
            return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
        if isinstance(value, (int, float)):
            return repr(value)
        if isinstance(value, str):
            return "'" + literal(value, True) + "'"
        raise TypeError(f"no SQL literal for {type(value).__name__}")

    def place(m: re.Match) -> str:
        return literal(values[m[1]], text.count("'", 0, m.start()) % 2 == 1)

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", place, text)
