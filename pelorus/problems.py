"""Queries of the general training-data problems over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelorus.operators.proximity import near_pairs, near_places, points_in_regions
from pelorus.operators.spikes import flag_implausible
from pelorus.sources.tables import table


def p1_reasons(spark: SparkSession, directory: str) -> DataFrame:
    """Implausible readings of ``weather_hourly`` with the reason of each."""
    return flag_implausible(table(spark, directory, "weather_hourly"), id_col="obs_id", source_col="city", time_col="ts_utc", value_col="temp_c")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return p1_reasons(spark, directory).select("obs_id").distinct()


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of locations at most 5 km apart."""
    return near_pairs(table(spark, directory, "weather_cities"), id_col="city_id", lat_col="latitude", lon_col="longitude", radius_km=5.0).select("city_id_a", "city_id_b")


def p4_places(spark: SparkSession, directory: str) -> DataFrame:
    """Each place with its locations and how many others lie at most 5 km away."""
    return near_places(table(spark, directory, "weather_cities"), id_col="city_id", lat_col="latitude", lon_col="longitude", radius_km=5.0)


#: Made regions by name, as corners of latitude and longitude: a concave one, one over the date line, two caps that overlap it.
REGIONS = {
    "concave": [(-30.3, -20.1), (62.7, -15.2), (20.4, 12.9), (58.1, 61.3), (-28.6, 55.7)],
    "date_line": [(-41.2, 150.3), (44.6, 158.8), (39.1, -139.7), (-35.9, -128.4)],
    "north": [(50.5, float(x)) for x in range(-170, 190, 40)],
    "south": [(-33.25, float(-x)) for x in range(-170, 190, 40)],
}


def p4_regions(spark: SparkSession, directory: str) -> DataFrame:
    """The made regions that contain each location."""
    rings = spark.createDataFrame([(n, [{"lat": y, "lon": x} for y, x in ring]) for n, ring in REGIONS.items()], "region string, ring array<struct<lat:double,lon:double>>")
    return points_in_regions(table(spark, directory, "weather_cities"), rings, id_col="city_id", lat_col="latitude", lon_col="longitude", region_col="region", ring_col="ring", cell_deg=2.0)


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_reasons, p4_found, p4_places, p4_regions)}


_P1 = r"""
WITH raw AS (
  SELECT obs_id, lower(regexp_replace(city, '^[\s\pZ\pC]+|[\s\pZ\pC]+$', '', 'g')) AS c, ts_utc, temp_c
  FROM weather_hourly WHERE temp_c IS NOT NULL AND NOT isnan(temp_c)),
good AS (SELECT DISTINCT c, ts_utc, temp_c AS v FROM raw WHERE temp_c BETWEEN -95 AND 62 AND c IS NOT NULL AND ts_utc IS NOT NULL),
lagged AS (
  SELECT *, lag(v, 3) OVER w AS b3, lag(v, 2) OVER w AS b2, lag(v) OVER w AS b1, lead(v) OVER w AS a1, lead(v, 2) OVER w AS a2, lead(v, 3) OVER w AS a3,
    median(v) OVER (PARTITION BY c ORDER BY ts_utc, v ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m,
    row_number() OVER w AS rn, row_number() OVER (PARTITION BY c, v ORDER BY ts_utc) AS rv
  FROM good WINDOW w AS (PARTITION BY c ORDER BY ts_utc, v)),
parts AS (
  SELECT *, abs(v - m) AS dev, count(*) OVER (PARTITION BY c, v, rn - rv) AS run,
    [v - (b1 + a1) / 2] AS s1,
    [b1 - (b2 + (a1 - b2) * (1.0 / 3)), v - (b2 + (a1 - b2) * (2.0 / 3))] AS s2,
    [v - (b1 + (a2 - b1) * (1.0 / 3)), a1 - (b1 + (a2 - b1) * (2.0 / 3))] AS s3,
    [b2 - (b3 + (a1 - b3) * 0.25), b1 - (b3 + (a1 - b3) * 0.5), v - (b3 + (a1 - b3) * 0.75)] AS s4,
    [b1 - (b2 + (a2 - b2) * 0.25), v - (b2 + (a2 - b2) * 0.5), a1 - (b2 + (a2 - b2) * 0.75)] AS s5,
    [v - (b1 + (a3 - b1) * 0.25), a1 - (b1 + (a3 - b1) * 0.5), a2 - (b1 + (a3 - b1) * 0.75)] AS s6
  FROM lagged),
off AS (
  SELECT c, ts_utc, v, dev, run, greatest(
    CASE WHEN b1 IS NOT NULL AND a1 IS NOT NULL THEN greatest(list_min(s1), -list_max(s1)) - abs(a1 - b1) END,
    CASE WHEN b2 IS NOT NULL AND a1 IS NOT NULL THEN greatest(list_min(s2), -list_max(s2)) - abs(a1 - b2) END,
    CASE WHEN b1 IS NOT NULL AND a2 IS NOT NULL THEN greatest(list_min(s3), -list_max(s3)) - abs(a2 - b1) END,
    CASE WHEN b3 IS NOT NULL AND a1 IS NOT NULL THEN greatest(list_min(s4), -list_max(s4)) - abs(a1 - b3) END,
    CASE WHEN b2 IS NOT NULL AND a2 IS NOT NULL THEN greatest(list_min(s5), -list_max(s5)) - abs(a2 - b2) END,
    CASE WHEN b1 IS NOT NULL AND a3 IS NOT NULL THEN greatest(list_min(s6), -list_max(s6)) - abs(a3 - b1) END) AS off
  FROM parts),
bins AS (SELECT c, floor(dev * 100 + 0.5) AS bin, count(*) AS n FROM off GROUP BY 1, 2),
upto AS (SELECT c, bin, sum(n) OVER (PARTITION BY c ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY c) AS n FROM bins),
scales AS (
  SELECT c, greatest(min(CASE WHEN upto * 2 >= n THEN bin END) * 0.01::DOUBLE * 1.4826, min(CASE WHEN upto * 20 >= n * 19 THEN bin END) * 0.01::DOUBLE, 0.05) AS scale
  FROM upto GROUP BY c),
flagged AS (
  SELECT c, ts_utc, v, 'jump' AS reason FROM off JOIN scales USING (c) WHERE dev > scale * 2 AND off > scale * 3.3
  UNION ALL SELECT c, ts_utc, v, 'stuck' FROM off WHERE run >= 12),
found AS (
  SELECT obs_id, 'bounds' AS reason FROM raw WHERE NOT (temp_c BETWEEN -95 AND 62)
  UNION SELECT obs_id, reason FROM raw JOIN flagged ON raw.c = flagged.c AND raw.ts_utc = flagged.ts_utc AND raw.temp_c = flagged.v)
"""
_P4 = """
WITH p AS (
  SELECT DISTINCT city_id, latitude AS lat, longitude AS lon FROM weather_cities
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0))
SELECT a.city_id AS city_id_a, b.city_id AS city_id_b
FROM p a JOIN p b ON a.city_id < b.city_id AND abs(a.lat - b.lat) < 0.05
WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 5
"""


#: That a number is none is told by its text here, since the statistics of a file may hide it from isnan.
_PLACES = """
WITH p AS (
  SELECT DISTINCT city_id, latitude + 0.0 AS lat, longitude + 0.0 AS lon FROM weather_cities
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND CAST(latitude AS VARCHAR) <> 'nan' AND CAST(longitude AS VARCHAR) <> 'nan' AND NOT (latitude = 0 AND longitude = 0)),
q AS (SELECT lat, lon, count(*) AS n FROM p GROUP BY 1, 2)
SELECT a.lat AS latitude, a.lon AS longitude, a.n AS points, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS near
FROM q a LEFT JOIN q b ON NOT (a.lat = b.lat AND a.lon = b.lon) AND abs(a.lat - b.lat) < 0.05
  AND 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 5
GROUP BY a.lat, a.lon, a.n
"""


def _regions_sql() -> str:
    """Even-odd rule by every edge; the ring over the date line with longitudes from 0 to 360, the caps by latitude."""
    edges = []
    for name in ("concave", "date_line"):
        ring = [(y, x % 360 if name == "date_line" else x) for y, x in REGIONS[name]]
        edges += [f"('{name}', {y1}, {x1}, {y2}, {x2})" for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1])]
    return f"""
WITH p AS (
  SELECT DISTINCT city_id, latitude AS lat, longitude AS lon FROM weather_cities
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND CAST(latitude AS VARCHAR) <> 'nan' AND CAST(longitude AS VARCHAR) <> 'nan' AND NOT (latitude = 0 AND longitude = 0)),
e AS (SELECT region, y1::DOUBLE AS y1, x1::DOUBLE AS x1, y2::DOUBLE AS y2, x2::DOUBLE AS x2 FROM (VALUES {", ".join(edges)}) AS t(region, y1, x1, y2, x2)),
hits AS (
  SELECT city_id, lat, lon, region, count(*) AS n FROM p, e
  WHERE (y1 > lat) <> (y2 > lat) AND CASE WHEN region = 'date_line' AND lon < 0 THEN lon + 360 ELSE lon END < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) GROUP BY ALL)
SELECT DISTINCT city_id, region FROM hits WHERE n % 2 = 1
UNION SELECT city_id, 'north' FROM p WHERE lat > 50.5 UNION SELECT city_id, 'south' FROM p WHERE lat < -33.25"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT DISTINCT obs_id FROM found",
        "p1_reasons": _P1 + "SELECT obs_id, reason FROM found",
        "p4_found": _P4,
        "p4_places": _PLACES,
        "p4_regions": _regions_sql(),
    }
