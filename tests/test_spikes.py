"""Implausible readings against a plain walk over each source."""

import math
import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from pelorus.operators.spikes import flag_implausible

COLUMNS = {"id_col": "obs_id", "source_col": "city", "time_col": "ts_utc", "value_col": "temp_c"}
SCHEMA = "obs_id long, city string, ts_utc timestamp_ntz, temp_c double, _source string, _value double, reason string"
START = datetime(2024, 3, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], SCHEMA)


def found(df, **kw):
    return {(r.obs_id, r.reason) for r in flag_implausible(df, **COLUMNS, **kw).collect()}


def plain(rows, low=-95.0, high=62.0):
    """The definition, reading by reading."""
    out, by = set(), {}
    for i, city, ts, v in rows:
        if v is None or math.isnan(v):
            continue
        if not low <= v <= high:
            out.add((i, "bounds"))
        elif city is not None and ts is not None:
            by.setdefault(city.strip().lower(), {}).setdefault((ts, v), set()).add(i)
    for readings in by.values():
        keys = sorted(readings)
        v = [k[1] for k in keys]
        n = len(v)
        deviation = [abs(x - median(v[max(0, k - 3) : k + 4])) for k, x in enumerate(v)]
        bins = sorted(math.floor(x * 100 + 0.5) for x in deviation)
        scale = max(bins[(n + 1) // 2 - 1] * 0.01 * 1.4826, bins[-(-n * 19 // 20) - 1] * 0.01, 0.05)
        for k in range(n):
            off = -1.0
            for length in (1, 2, 3):
                for first in range(k - length + 1, k + 1):
                    if first >= 1 and first + length < n:
                        a, b = v[first - 1], v[first + length]
                        d = [v[first + j] - (a + (b - a) * (j + 1) / (length + 1)) for j in range(length)]
                        off = max(off, max(min(d), -max(d)) - abs(b - a))
            if off > 0 and deviation[k] > 2 * scale and off > 3.3 * scale:
                out |= {(i, "jump") for i in readings[keys[k]]}
        k = 0
        while k < n:
            end = k
            while end + 1 < n and v[end + 1] == v[k]:
                end += 1
            if end - k + 1 >= 12:
                out |= {(i, "stuck") for key in keys[k : end + 1] for i in readings[key]}
            k = end + 1
    return out


def series(seed, hours, city="Aa", first_id=0):
    rng, rows, level = random.Random(seed), [], 10.0
    for h in range(hours):
        level += rng.gauss(0, 0.2)
        rows.append([first_id + h, city, START + timedelta(hours=h), round(level + 4 * math.sin(h * math.pi / 12) + rng.gauss(0, 0.2), 1)])
    return rows


def test_faults_are_found_and_right_readings_are_not(spark):
    rows = series(1, 400)
    for h in (50, 51, 52):
        rows[h][3] += 25
    rows[100][3] = -273.0
    rows[101][3] = math.inf
    rows[130][3] -= 20
    for h in range(200, 214):
        rows[h][3] = rows[200][3]
    for h in range(300, 400):
        rows[h][3] += 15  # a level that stays
    for h in range(350, 356):
        rows[h][3] += 18  # longer than a moment
    got = found(frame(spark, rows))
    assert got == plain(rows)
    ids = {i for i, _ in got}
    assert ids == {50, 51, 52, 100, 101, 130, *range(200, 214)}


def test_blocks_and_spans_change_nothing(spark):
    rows = series(2, 600) + series(3, 90, "Bb", 1000)
    rng = random.Random(4)
    for k in rng.sample(range(5, 590), 25):
        rows[k][3] += rng.choice((-1, 1)) * rng.uniform(5, 40)
    for h in range(250, 290):
        rows[h][3] = 7.5
    want = plain(rows)
    rng.shuffle(rows)
    for block, span in ((8192, 1536), (40, 24), (64, 100)):
        assert found(frame(spark, rows), block=block, span_hours=span) == want


def test_nulls_copies_spellings_and_redelivery(spark):
    rows = series(5, 120)
    rows[60][3] += 30
    ts = rows[60][2]
    rows += [rows[60], [900, "  aA ", ts, rows[60][3]], [901, "Aa", ts + timedelta(minutes=1), None], [902, "Aa", None, 200.0], [903, None, ts, 99.0], [904, None, ts, 5.0], [None, "Aa", ts, math.nan], [905, "Aa", ts, math.nan]]
    rows = [r if r[0] is None or r[0] % 7 else [r[0], str(r[1]).upper() if r[1] else None, *r[2:]] for r in rows]
    assert found(frame(spark, rows)) == {(60, "jump"), (900, "jump"), (902, "bounds"), (903, "bounds")}


@pytest.mark.parametrize("rows", [[], [[1, "Aa", START, 3.0]], [[1, "Aa", START, None]]])
def test_empty_and_tiny_tables(spark, rows):
    assert found(frame(spark, rows)) == set()
