"""Scalar functions against plain Python."""

import base64
import hashlib
import json
import random
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.functions import jsontext, numbers, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r.out for r in df.select("n", f(F.col("v")).alias("out")).orderBy("n").collect()]


def plain_safe(name, limit):
    data = name.encode()
    if len(data) <= limit:
        return name
    return data[: limit - 17].decode("utf-8", "ignore") + "_" + hashlib.sha256(data).hexdigest()[:16]


def test_safe_path(spark):
    rng = random.Random(1)
    names = ["short", "with space", "a" * 300, "b" * 300, "é" * 300, "日本" * 100, "👨‍🌾" * 40, ""] + ["".join(rng.choice("aé日👨") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    for limit in (30, 31, 32, 33, 255):
        assert column(spark, names, lambda c, n=limit: text.safe_path(c, n)) == [plain_safe(n, limit) for n in names]
    assert column(spark, [None, "x"], text.safe_path) == [None, "x"]
    with pytest.raises(ValueError):
        text.safe_path(F.lit("x"), 10)


def test_text(spark):
    assert column(spark, ["a.PDF", "b.x.png", "pdf", "", "c.", None], text.media_type) == ["application/pdf", "image/png", *[text.DEFAULT_MEDIA_TYPE] * 4]
    assert column(spark, [" a\n\t", None, "  "], text.strip) == ["a", "", ""]
    assert column(spark, ["New York", None], text.slugify) == ["new_york", None]
    assert column(spark, ["new_york"], text.unslugify) == ["New York"] and column(spark, ["a_bc_d"], text.snake_to_camel) == ["ABcD"]
    assert column(spark, ["Timeout after 3 s", "  x" + "y" * 60, "", " \n", None], text.first_token) == ["Timeout", "x" + "y" * 47, "Unknown", "Unknown", "Unknown"]
    assert column(spark, ["A-B-c", None], text.normal_uuid) == ["abc", None]
    long = "ä" * 200
    assert column(spark, [long, None], text.content_base64) == [base64.b64encode(long.encode()).decode(), None]
    assert column(spark, [long], text.content_md5) == [hashlib.md5(long.encode()).hexdigest()]
    assert column(spark, [b"ok\xff"], text.decode_lossy, "binary") == ["ok�"]
    url = column(spark, ["a b,c", None], lambda c: text.url_with("http://x", [("q", c), ("n", F.lit(1))]))
    assert url == [f"http://x?q={quote_plus('a b,c')}&n=1", "http://x?n=1"]
    assert column(spark, ["/r/a/b.txt", "/r/m"], lambda c: text.relative_to(c, F.lit("/r"), F.lit("/r/m"))) == ["a/b.txt", "."]


def test_numbers(spark):
    got = column(spark, ["abcd", None], lambda c: numbers.expected_cost(F.lit(0.5), c, c))
    assert got == [2.0 * 1.1 * 0.5, 0.0]
    assert column(spark, ["a"], lambda c: numbers.expected_cost(F.lit(None).cast("double"), c)) == [None]
    assert column(spark, [0, 3, 9], lambda c: numbers.backoff(c, 60, 3840), "int") == [60.0, 480.0, 3840.0]
    assert [str(x) for x in column(spark, ["2026-01-01T00:00", "nonsense", None], numbers.minute_timestamp)] == ["2026-01-01 00:00:00", "None", "None"]
    assert numbers.normal_rate(0.5, 1) == (1.0, 2.0) and numbers.normal_rate(3, 1) == (3, 1)
    with pytest.raises(ValueError):
        numbers.normal_rate(0, 1)


def test_json_objects_in_text(spark):
    cases = {
        None: None, "": None, '{"a": 1}': {"a": 1}, '{"a": {"b": 2}}': {"a": {"b": 2}}, '```json\n{"a": 1}\n```': {"a": 1}, 'x\n```\n{"b": 2}\n```\ny': {"b": 2}, 'It is {"a": {"b": 1}} here': {"a": {"b": 1}},
        "{bad": None, "none": None, '[{"a": 1}]': {"a": 1}, 'see {"a":{"b":{"c":1}}} there': {"b": {"c": 1}}, '{"a": 1, "a": 2}': {"a": 2}, "[1, 2]": None, "{} " * 3000: {},
    }
    got = column(spark, list(cases), jsontext.extract_object)
    assert [None if g is None else json.loads(g) for g in got] == list(cases.values())


def test_responses(spark):
    bodies = ['{"choices": [{"message": {"content": "hi"}}]}', '{"choices": []}', "nonsense", None]
    assert column(spark, bodies, jsontext.text_of_choices) == ["hi", "", "", None]
    assert column(spark, ['{"candidates": [{"content": {"parts": [{"text": "a"}, {"x": 1}, {"text": "b"}]}}]}', '{"candidates": []}'], jsontext.text_of_candidates) == ["ab", ""]
    assert column(spark, ['{"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}]}'], jsontext.text_of_blocks) == ["ab"]
    assert column(spark, bodies[:1], lambda c: jsontext.response_text(F.lit("choices"), F.lit(500), c)) == [None]
    assert column(spark, [None, "", "{}", "x"], lambda c: jsontext.structured_error(F.lit("{}"), c)) == ["empty response", "empty response", None, "response is not valid JSON"]


def test_arrays_schemas_headers(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a", "b"]), ([], ["a"]), (None, ["a"])], "x array<int>, y array<string>")
    got = [r.z for r in df.select(jsontext.zip_shortest({"x": F.col("x"), "y": F.col("y")}).alias("z")).collect()]
    assert [[tuple(p) for p in g] if g is not None else None for g in got] == [[(1, "a"), (2, "b")], [], None]
    schema = T.StructType([T.StructField("x", T.LongType(), False)])
    assert column(spark, ['{"x": 1}', '{"y": 1}', '{"x": "no"}', "[]", "", None, '{"x": null}'], lambda c: jsontext.matches_schema(c, schema)) == [True] + [False] * 6
    merged = column(spark, ['{"a": "1", "b": "2"}', None], lambda c: jsontext.merge_headers(c, F.lit('{"b": "3"}')))
    assert merged == [{"a": "1", "b": "3"}, {"b": "3"}]
    source = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {}}}}, "$defs": {"d": {"anyOf": [{"type": "object"}, {"type": "string"}]}}}
    closed = jsontext.close_objects(source)
    assert closed["additionalProperties"] is False and closed["properties"]["a"]["items"]["additionalProperties"] is False and closed["$defs"]["d"]["anyOf"][0]["additionalProperties"] is False and "additionalProperties" not in source
