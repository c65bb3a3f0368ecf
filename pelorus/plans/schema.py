"""Declared row schemas and the gate that every table passes before it is written."""

from __future__ import annotations

import dataclasses
import types
import typing
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_PRIMITIVES: dict[type, T.DataType] = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    datetime: T.TimestampNTZType(),
    date: T.DateType(),
    Decimal: T.DecimalType(38, 18),
}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def _mapped(annotation: object) -> tuple[T.DataType, bool]:
    """Spark type and nullability of a Python annotation."""
    if typing.get_origin(annotation) is typing.Annotated:
        annotation = typing.get_args(annotation)[0]
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(rest) != 1:
            raise TypeError(f"Cannot map Union {annotation}: only one type or None is possible")
        return _mapped(rest[0])[0], True
    if annotation in _PRIMITIVES:
        return _PRIMITIVES[annotation], False
    raise TypeError(f"No Spark mapping for {annotation}")


def _metadata(field: object) -> dict:
    """Title, description and units of a pydantic or dataclass field."""
    if isinstance(field, dataclasses.Field):
        return {k: field.metadata[k] for k in ("title", "description", "units") if k in field.metadata}
    extra = getattr(field, "json_schema_extra", None)
    found = {"title": getattr(field, "title", None), "description": getattr(field, "description", None), "units": extra.get("units") if isinstance(extra, dict) else None}
    return {k: v for k, v in found.items() if v is not None}


def row_schema(model: type | T.StructType) -> T.StructType:
    """The StructType of a row model: a StructType, a dataclass, or a class with pydantic's ``model_fields``.

    Nested types, unions of several types and unknown types raise ``TypeError``. Titles, descriptions and units go to
    the fields' metadata.
    """
    if isinstance(model, T.StructType):
        return model
    hints = typing.get_type_hints(model, include_extras=True)
    if dataclasses.is_dataclass(model):
        declared = {f.name: f for f in dataclasses.fields(model)}
    elif hasattr(model, "model_fields"):
        declared = dict(model.model_fields)
    else:
        raise TypeError(f"{model!r} is no row model")
    fields = []
    for name, field in declared.items():
        kind, nullable = _mapped(hints[name])
        fields.append(T.StructField(name, kind, nullable, _metadata(field)))
    return T.StructType(fields)


def compatible(found: T.DataType, declared: T.DataType) -> bool:
    """Equal types, or any two integers, or any two floats."""
    return found == declared or any(isinstance(found, c) and isinstance(declared, c) for c in (_INTEGERS, _FLOATS))


def schema_differences(found: T.StructType, declared: T.StructType) -> list[str]:
    """All differences by name and type: missing columns, other types, unexpected columns. Order and nullability don't count."""
    have = {f.name: f.dataType for f in found}
    out = [f"missing column '{f.name}'" for f in declared if f.name not in have]
    out += [
        f"column '{f.name}' is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}" for f in declared if f.name in have and not compatible(have[f.name], f.dataType)
    ]
    return out + [f"unexpected column '{name}'" for name in sorted(set(have) - {f.name for f in declared})]


def assert_schema(df: DataFrame, model: type | T.StructType, name: str | None = None) -> DataFrame:
    """``df`` itself if its analysed schema fits the model; else one ``ValueError`` with every difference. No job runs."""
    if differences := schema_differences(df.schema, row_schema(model)):
        raise ValueError(f"Table does not match row schema {name or getattr(model, '__name__', 'of struct')}: {'; '.join(differences)}")
    return df
