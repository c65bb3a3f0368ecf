"""Near locations against all pairs, and regions against a plain even-odd rule."""

import math
import random

import pytest

from pelorus.operators.proximity import near_pairs, near_places, place_of, points_in_regions

KW = {"id_col": "city_id", "lat_col": "latitude", "lon_col": "longitude"}
SCHEMA = "city_id long, latitude double, longitude double, _lat double, km double, _id_b string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2.0, "x") for r in rows], SCHEMA)


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def brute(rows, radius):
    ok = list({r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1] or r[2])})
    return {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and km(a, b) <= radius}


def pairs(spark, rows, radius=5.0, **kw):
    out = [(r.city_id_a, r.city_id_b) for r in near_pairs(frame(spark, rows), **KW, radius_km=radius, **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


def clusters(seed, n):
    rng = random.Random(seed)
    centres = [(89.99, 10), (-89.98, 0), (12, 180), (-40, -179.99), (0.01, 0.01), (51, 7), (70, 170)]
    rows = []
    for i in range(n):
        lat, lon = rng.choice(centres)
        lat, lon = lat + rng.gauss(0, 0.03), lon + rng.gauss(0, 0.03) / max(0.02, math.cos(math.radians(lat)))
        lat = max(-90.0, min(90.0, lat))
        rows.append((i, lat, (lon + 180) % 360 - 180))
    return rows


def test_all_pairs_at_poles_and_date_line(spark):
    rows = clusters(1, 260)
    assert pairs(spark, rows) == brute(rows, 5.0)
    assert pairs(spark, rows, 60.0) == brute(rows, 60.0)


def test_dense_cells_are_dealt_over_parts(spark):
    rows = clusters(2, 200)
    assert pairs(spark, rows, dense_cell=7) == brute(rows, 5.0)


def test_rows_without_a_place(spark):
    rows = [(1, 10.0, 10.0), (2, 10.0, 10.0), (2, 10.0, 10.0), (3, None, 10.0), (4, math.nan, 10.0), (5, 0.0, 0.0), (6, 0.0, 0.0), (7, 100.0, 10.0), (8, 10.0, 181.0), (None, 10.0, 10.0), (9, 10.0, math.nan), (10, 0.0, 0.001), (11, 10.0, math.inf)]
    assert pairs(spark, rows) == {(1, 2)}
    assert pairs(spark, []) == set()


def test_points_in_regions(spark):
    rng = random.Random(3)
    rings = {"a": [(0, 0), (0, 10), (10, 10), (10, 0)], "b": [(5, 5), (12, 3), (15, 15), (3, 12)], "flat": [(1, 1), (2, 2)]}
    regions = spark.createDataFrame([(k, [{"lat": float(p), "lon": float(q)} for p, q in v]) for k, v in rings.items()] * 2, "region string, ring array<struct<lat:double,lon:double>>")
    points = [(i, rng.uniform(-2, 18), rng.uniform(-2, 18)) for i in range(300)] + [(900, None, 3.0), (901, 0.0, 0.0)]

    def inside(lat, lon, ring):
        hits = 0
        for k, (p, q) in enumerate(ring):
            r, s = ring[(k + 1) % len(ring)]
            if (p > lat) != (r > lat) and lon < q + (lat - p) / (r - p) * (s - q):
                hits += 1
        return hits % 2 == 1 and len(ring) > 2

    want = {(i, k) for i, lat, lon in points if lat is not None and (lat or lon) for k, ring in rings.items() if inside(lat, lon, ring)}
    got = points_in_regions(frame(spark, points), regions, **KW, region_col="region", ring_col="ring", cell_deg=2.0)
    assert {(r.city_id, r.region) for r in got.collect()} == want


def test_equal_points_are_one_place(spark):
    rows = [(k, 10.0, 20.0) for k in range(10_000)] + [(10_000, 10.01, 20.0), (10_001, -10.0, 20.0), (10_002, None, 1.0)]
    df = spark.createDataFrame(rows, "i long, lat double, lon double")
    kw = {"id_col": "i", "lat_col": "lat", "lon_col": "lon"}
    assert place_of(df, **kw).count() == 10_002
    assert {tuple(r) for r in near_places(df, radius_km=5, dense_cell=3, **kw).collect()} == {(10.0, 20.0, 10_000, 1), (10.01, 20.0, 1, 10_000), (-10.0, 20.0, 1, 0)}
    assert near_places(df.limit(0), radius_km=5, **kw).count() == 0


def contains(ring, lat, lon):
    """Even-odd rule over a ring whose longitudes go on beyond 180."""
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


@pytest.mark.parametrize("deg", [0.5, 1.0, 7.5])
def test_regions_against_brute_force(spark, deg):
    rng = random.Random(int(deg * 10))
    rings = {"date line": [(10.0, 170.2), (12.5, 193.0), (-14.0, 191.5), (-5.5, 178.0), (-12.0, 169.0)], "box": [(20, 20), (20, 40), (30, 40), (30, 20)]}
    for k in range(4):  # stars about a centre, some far from convex
        y, x = rng.uniform(-60, 60), rng.uniform(-170, 170)
        rings[f"star{k}"] = [(y + math.sin(t * 0.3) * r, x + math.cos(t * 0.3) * r) for t in range(21) for r in [rng.uniform(1, 12)]]
    wrap = lambda x: (x + 180) % 360 - 180
    regions = [(n, [{"lat": float(y), "lon": wrap(float(x))} for y, x in ring]) for n, ring in rings.items()]
    regions += [("cap", [{"lat": 70.0, "lon": float(x)} for x in range(-180, 180, 30)]), ("south", [{"lat": -72.5, "lon": float(-x)} for x in range(-179, 180, 40)]), ("line", [{"lat": 1.0, "lon": 1.0}, {"lat": 2.0, "lon": 2.0}]), ("bad", [{"lat": None, "lon": 1.0}] * 4)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(1500)]
    for n, ring in rings.items():  # and many near the rings
        points += [(len(points) + j, y + rng.gauss(0, 2), wrap(x + rng.gauss(0, 2))) for j, (y, x) in enumerate(rng.choices(ring, k=150))]
    points = [p for p in points if abs(p[1]) <= 90] + [(99_999, 90.0, 5.0), (99_998, float("nan"), 0.0)]
    want = {(i, n) for i, y, x in points for n, ring in rings.items() if any(contains(ring, y, x + s) for s in (-360, 0, 360))}
    want |= {(i, "cap") for i, y, _ in points if y > 70} | {(i, "south") for i, y, _ in points if y < -72.5}
    kw = {"id_col": "i", "lat_col": "lat", "lon_col": "lon", "region_col": "name", "ring_col": "ring", "cell_deg": deg, "dense_cell": 40}
    places = spark.createDataFrame([(*p, "x") for p in points + points[:5]], "i long, lat double, lon double, name string")
    shapes = spark.createDataFrame(regions + regions[:1], "name string, ring array<struct<lat:double,lon:double>>")
    got = {tuple(r) for r in points_in_regions(places, shapes, **kw).collect()}
    assert got == want
    assert points_in_regions(places.limit(0), shapes, **kw).count() == 0 and points_in_regions(places, shapes.limit(0), **kw).count() == 0
