"""JSON in text columns: extraction from prose, reading of responses, zipping of arrays, validity."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A fenced block, and an object in braces whose members hold at most one level of objects.
_FENCED = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)
_BRACED = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")


def object_in(text: str | None) -> dict | None:
    """The JSON object in a text: the whole text, else the first fenced block, else the first object in braces with at
    most one level of nesting. Anything that is no object counts as no find; null and empty texts have none."""
    if not text:
        return None
    fenced = _FENCED.search(text)
    for candidate in (text, fenced and fenced[1], (found := _BRACED.search(text)) and found[0]):
        if candidate:
            try:
                value = json.loads(candidate.strip())
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict):
                return value
    return None


@F.pandas_udf(T.StringType())
def extract_object(text: pd.Series) -> pd.Series:
    """:func:`object_in` as a column: the object as JSON text with sorted keys, or null. Python's reading of JSON
    (last of repeated keys wins) is the point, so this one runs in Arrow batches outside the JVM."""
    return text.map(lambda t: None if (v := object_in(t)) is None else json.dumps(v, sort_keys=True, ensure_ascii=False))


_BLOCKS = "struct<content:array<struct<type:string,text:string>>>"
_CANDIDATES = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
_CHOICES = "struct<choices:array<struct<message:struct<content:string>>>>"


def text_of_blocks(body: Column) -> Column:
    """The joined texts of a body's content blocks of type text."""
    blocks = F.from_json(body, _BLOCKS)["content"]
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def text_of_candidates(body: Column) -> Column:
    """The joined texts of the first candidate's parts; empty without candidates."""
    found = F.from_json(body, _CANDIDATES)["candidates"]
    parts = F.get(found, F.lit(0))["content"]["parts"]
    return F.when(body.isNotNull(), F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), ""), F.lit("")))


def text_of_choices(body: Column) -> Column:
    """The first choice's message; empty without choices."""
    found = F.from_json(body, _CHOICES)["choices"]
    return F.when(body.isNotNull(), F.coalesce(F.get(found, F.lit(0))["message"]["content"], F.lit("")))


DIALECTS = {"blocks": text_of_blocks, "candidates": text_of_candidates, "choices": text_of_choices}


def response_text(dialect: Column, status: Column, body: Column) -> Column:
    """The answer in a response body by its dialect; null unless the status is 200 and there is a body."""
    chosen = F.lit(None).cast("string")
    for name, read in DIALECTS.items():
        chosen = F.when(dialect == name, read(body)).otherwise(chosen)
    return F.when((status == 200) & body.isNotNull(), chosen)


def request_body(**fields: Column) -> Column:
    """A JSON body of the given fields; null fields are left out."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def zip_shortest(arrays: dict[str, Column]) -> Column:
    """Parallel arrays as one array of structs, as long as the shortest; null if any is null."""
    n = F.least(*(F.size(a) for a in arrays.values())) if len(arrays) > 1 else F.size(next(iter(arrays.values())))
    return F.arrays_zip(*(F.slice(a, F.lit(1), n).alias(name) for name, a in arrays.items()))


def matches_schema(text: Column, schema: T.StructType) -> Column:
    """Whether a text is a JSON object with the schema's types and all its non-null fields. Null text: false."""
    wide = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema), T.StructField("_corrupt", T.StringType(), True)])
    parsed = F.from_json(text, wide, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    ok = parsed.isNotNull() & parsed["_corrupt"].isNull() & F.ltrim(F.coalesce(text, F.lit(""))).startswith("{")
    for f in schema:
        if not f.nullable:
            ok = ok & parsed[f.name].isNotNull()
    return F.coalesce(ok, F.lit(False))


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def structured_error(wanted: Column, response: Column) -> Column:
    """Why a response misses a wanted structured output, or null: nothing wanted is always fine."""
    return F.when(wanted.isNull(), F.lit(None)).when(F.coalesce(F.trim(response), F.lit("")) == "", F.lit("empty response")).when(~is_json(response), F.lit("response is not valid JSON"))


def text_list(items: Column) -> Column:
    return F.to_json(items)


def list_of_text(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def merge_headers(stored: Column, override: Column) -> Column:
    """Two JSON objects of headers as a map; the second wins. Null counts as empty."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(x, kind), F.create_map().cast(kind)) for x in (stored, override))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def close_objects(schema: dict) -> dict:
    """A JSON schema in which no object takes additional properties, at any depth. The input is not changed."""
    out = dict(schema)
    for key in ("properties", "$defs", "definitions"):
        if isinstance(out.get(key), dict):
            out[key] = {k: close_objects(v) if isinstance(v, dict) else v for k, v in out[key].items()}
    if isinstance(out.get("items"), dict):
        out["items"] = close_objects(out["items"])
    for key in ("anyOf", "allOf", "oneOf"):
        if isinstance(out.get(key), Sequence):
            out[key] = [close_objects(v) if isinstance(v, dict) else v for v in out[key]]
    if out.get("type") == "object" or "properties" in out:
        out["additionalProperties"] = False
    return out
