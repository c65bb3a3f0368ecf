"""The last earlier row that qualifies, against a plain walk."""

import random

from pyspark.sql import functions as F

from pelorus.operators.asof import last_before


def test_last_before(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("abbbbb"), rng.randrange(400), rng.random() < 0.3) for k in range(600)] + [(600, None, 5, True), (601, "alone", 9, False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "i int, k string, t int, s boolean, _v string")
    got = {r.i: r.found for r in last_before(df, by="k", order=("t", "i"), source=F.col("s"), value=F.col("i"), span=F.floor(F.col("t") / 20), name="found").collect()}
    want = {}
    for i, k, t, _ in rows:
        if k is not None:
            before = [(u, j) for j, m, u, s in rows if m == k and s and (u, j) < (t, i)]
            want[i] = max(before)[1] if before else None
    assert got == want
    assert last_before(df.limit(0), by="k", order=("t", "i"), source=F.col("s"), value=F.col("i"), span=F.col("t"), name="found").count() == 0
