"""Files as tables, tables as files, and archives of directories."""

from __future__ import annotations

import re
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """``(path, length)`` of every regular file below ``path``, in any depth, ``ordered`` by path; contents are not read."""
    kind = "path string, length bigint"
    from pelorus.plans.storage import Storage

    if not Storage(spark).exists(path):
        return spark.createDataFrame([], kind)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    found = found.select("path", "length")
    return found.orderBy("path") if ordered else found


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of the files below ``path`` whose names fit ``pattern``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file, with ``_path`` of each."""
    return spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json", recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))


def tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A tab-separated resource with a header; rows without any value are left out."""
    read = spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', multiLine=True)
    return read.dropna("all")


def rows(spark: SparkSession, values: list, schema: T.StructType | str) -> DataFrame:
    """Rows made in Python, with a declared schema, so that an empty list has its columns."""
    return spark.createDataFrame(values, schema)


def registration(files: DataFrame, root: Column) -> DataFrame:
    """MD5, size and relative path of files ``(path, content)``."""
    return files.select("path", F.substr("path", F.length(root) + 2).alias("relative_path"), F.md5("content").alias("md5"), F.octet_length("content").cast("bigint").alias("size"))


def attachments(requests: DataFrame, files: DataFrame, *, id_col: str, list_col: str, file_id: str) -> DataFrame:
    """Each request with the files of its JSON list of ids, in the list's order: ``(id, files)``.

    Ids without a file are skipped; a request without list or files is left out. The join carries ids and file columns
    only; the lists themselves bound what is collected per request.
    """
    wanted = requests.select(F.col(id_col).alias("_id"), F.posexplode(F.from_json(list_col, "array<string>")).alias("_at", "_file"))
    others = [c for c in files.columns if c != file_id]
    known = files.select(F.col(file_id).cast("string").alias("_file"), *(F.col(c).alias(f"_f_{c}") for c in others))
    picked = F.struct(F.col("_at").alias("at"), F.col("_file").alias("file"), *(F.col(f"_f_{c}").alias(c) for c in others))
    matched = wanted.join(known, "_file")
    return matched.groupBy("_id").agg(F.array_sort(F.collect_list(picked)).alias("files")).select(F.col("_id").alias(id_col), "files")


def write_each(df: DataFrame, directory: str, name_col: str, content_col: str) -> None:
    """One file per row, ``<directory>/<name>.json``; of rows with one name the greatest content is kept.

    Written by the executors to a directory that all of them share.
    """
    kept = df.where(F.col(name_col).isNotNull() & F.col(content_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.max(content_col).alias("content"))

    def write(part: Iterator) -> None:
        Path(directory).mkdir(parents=True, exist_ok=True)
        for row in part:
            safe = re.sub(r"[/\\\0]", "_", row["name"])
            aside = Path(directory, f".{safe}.tmp")
            aside.write_text(row["content"], encoding="utf-8")
            aside.rename(Path(directory, f"{safe}.json"))

    kept.foreachPartition(write)


def _members(directory: str) -> list[Path]:
    return sorted(p for p in Path(directory).rglob("*") if p.is_file())


def pack_zip(directory: str, target: str) -> None:
    """A deflated ZIP of the regular files, with relative names."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in _members(directory):
            out.write(p, p.relative_to(directory).as_posix())


def pack_tar_zst(directory: str, target: str, level: int = 3) -> None:
    """A TAR stream through Zstandard; a broken write leaves no target behind."""
    import zstandard

    try:
        with open(target, "wb") as raw, zstandard.ZstdCompressor(level=level).stream_writer(raw) as packed, tarfile.open(fileobj=packed, mode="w|") as out:
            for p in _members(directory):
                out.add(p, p.relative_to(directory).as_posix(), recursive=False)
    except BaseException:
        Path(target).unlink(missing_ok=True)
        raise
