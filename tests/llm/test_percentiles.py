"""Percentiles from cumulative counts against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pelorus.llm.percentiles import compact_id, merge_counts, percentiles, quantised, text_of_id, value_counts

SCHEMA = "g string, day int, x double, n long, value string, total string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", "t") for r in rows], SCHEMA)


def cut_to(x, bits):
    if x == 0:
        return 0.0
    step = 2.0 ** (math.frexp(abs(x))[1] - 1 - bits)
    return math.copysign(math.floor(abs(x) / step) * step, x)


def brute(rows, q, bits=None):
    by = {}
    for g, _, x in rows:
        if x is not None and math.isfinite(x):
            by.setdefault(g, []).append(x if bits is None else cut_to(x, bits))
    return {(g, p): (len(v), sorted(v)[max(-(-len(v) * p // 10000), 1) - 1]) for g, v in by.items() for p in q}


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(4), rng.choice([rng.lognormvariate(0, 4), -rng.random(), 0.0, 3.0, 8.0, 2.0**-30, None, math.nan, math.inf, -math.inf])) for _ in range(900)]
    return rows + [("one", 0, 5.0), ("none", 0, None)]


@pytest.mark.parametrize("bits", [None, 4])
def test_percentiles_equal_sorted_lists(spark, bits):
    rows, q = rows_of(1), (0, 1, 5000, 9000, 9999, 10000)
    got = percentiles(value_counts(frame(spark, rows), ["g"], "x", bits=bits), ["g"], q).collect()
    assert {(r.g, r.per_myriad): (r.total, r.value) for r in got} == brute(rows, q, bits)
    assert len(got) == len(brute(rows, q, bits))
    small = percentiles(value_counts(frame(spark, rows), ["g"], "x", bits=bits), ["g"], q, piece_bits=1, most_broadcast=0).collect()
    assert sorted(map(tuple, small), key=repr) == sorted(map(tuple, got), key=repr)


def test_days_put_together_equal_the_whole(spark):
    rows, q = rows_of(2), (5000, 9500)
    days = [value_counts(frame(spark, [r for r in rows if r[1] == d]), ["g"], "x", bits=10) for d in range(4)]
    union = days[0].unionByName(days[1]).unionByName(days[2]).unionByName(days[3])
    got = percentiles(merge_counts(union, ["g"]), ["g"], q).collect()
    assert {(r.g, r.per_myriad): (r.total, r.value) for r in got} == brute(rows, q, 10)


def test_error_bound(spark):
    rng = random.Random(3)
    xs = [rng.lognormvariate(0, 20) * rng.choice((1, -1)) for _ in range(500)] + [2.0**k for k in range(-40, 41)] + [0.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", quantised(F.col("x"), 10).alias("y")).collect():
        assert r.y == cut_to(r.x, 10) and abs(r.y) <= abs(r.x) and abs(r.x - r.y) <= abs(r.x) * 2**-10


def test_empty_table_and_no_values(spark):
    assert percentiles(value_counts(frame(spark, []), ["g"], "x"), ["g"], (5000,)).collect() == []
    assert percentiles(value_counts(frame(spark, [("a", 0, None)]), ["g"], "x"), ["g"], (5000,)).collect() == []


def test_compact_ids_stay_apart(spark):
    ids = ["0123abcd-0123-4567-89ab-0123456789ab", "0123abcd-0123-4567-89ab-0123456789ac", "0123ABCD-0123-4567-89AB-0123456789AB", "", "x", None]
    got = [r.c for r in spark.createDataFrame([(i,) for i in ids], "i string").select(compact_id(F.col("i")).alias("c")).collect()]
    assert [r.t for r in spark.createDataFrame([(i,) for i in ids], "i string").select(text_of_id(compact_id(F.col("i"))).alias("t")).collect()] == ids
    assert len({bytes(c) for c in got if c is not None}) == 5 and got[-1] is None and len(got[0]) == 16
