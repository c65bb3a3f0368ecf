"""Points near other points, and points inside regions, anywhere on the globe.

Points become unit vectors; a grid over the three axes has cells of fixed size everywhere, so neither the poles nor
the date line need rules of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in km.
EARTH_KM = 6371.0088


def has_place(lat: Column, lon: Column) -> Column:
    """False for null, NaN and out-of-range coordinates and for the placeholder (0, 0)."""
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance of two points given in degrees."""
    half_lat, half_lon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _points(df: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    """``(_id, _lat, _lon)`` of rows with an id and a place, copies once; a negative zero is zero."""
    lat, lon = F.col("_lat"), F.col("_lon")
    found = df.select(F.col(id_col).alias("_id"), (F.col(lat_col).cast("double") + 0.0).alias("_lat"), (F.col(lon_col).cast("double") + 0.0).alias("_lon"))
    return found.where(F.col("_id").isNotNull() & has_place(lat, lon)).distinct()


def _near(points: DataFrame, radius_km: float, dense_cell: int) -> DataFrame:
    """Pairs of ``points`` (``_id, _lat, _lon`` and others) at most ``radius_km`` apart, each once: all columns with
    ``_a`` and ``_b`` behind, and ``km``.

    Each point has one home cell; its copy visits the few cells that a ball of the radius touches, and the two are
    joined on the cell. Cells with more than ``dense_cell`` home points (a third of all points may lie in one) have
    their home points dealt over as many parts, and the visitors copied to each part, so no task gets a whole dense cell.
    """
    chord = 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    cell, axes = 2 * chord, ("x", "y", "z")
    at = {"x": F.cos(F.radians("_lat")) * F.cos(F.radians("_lon")), "y": F.cos(F.radians("_lat")) * F.sin(F.radians("_lon")), "z": F.sin(F.radians("_lat"))}
    home = points.select(*(F.col(c).alias(f"{c}_b") for c in points.columns), *(F.floor(at[a] / cell).alias(f"_c{a}") for a in axes))
    visits = points.select(*(F.col(c).alias(f"{c}_a") for c in points.columns), *(at[a].alias(f"_{a}") for a in axes))
    for a in axes:
        low, high = F.floor((F.col(f"_{a}") - chord) / cell), F.floor((F.col(f"_{a}") + chord) / cell)
        visits = visits.withColumn(f"_c{a}", F.explode(F.sequence(low, high))).drop(f"_{a}")
    cells = [f"_c{a}" for a in axes]
    home, visits = _dealt(home, visits, cells, "_id_b", dense_cell)
    km = great_circle_km(F.col("_lat_a"), F.col("_lon_a"), F.col("_lat_b"), F.col("_lon_b"))
    # A pair meets once only: the second point is looked up in its one home cell.
    return visits.join(home, [*cells, "_part"]).where(F.col("_id_a") < F.col("_id_b")).withColumn("km", km).where(F.col("km") <= radius_km)


def _dealt(rows: DataFrame, others: DataFrame, cells: list[str], by: str, dense_cell: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` of cells with more than ``dense_cell`` of them dealt over parts, ``others`` copied to each part: ``_part``."""
    dense = (
        rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > dense_cell)
        .select(*cells, F.ceil(F.col("_n") / dense_cell).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    return (
        rows.join(dense, cells, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts"),
        others.join(dense, cells, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"),
    )


def near_pairs(df: DataFrame, *, id_col: str, lat_col: str, lon_col: str, radius_km: float, dense_cell: int = 4000) -> DataFrame:
    """Pairs of points at most ``radius_km`` apart: ``(id_a, id_b, km)`` with ``id_a < id_b``, each once.

    Every pair comes out, so n points at one place are n * (n - 1) / 2 rows; :func:`near_places` has one row per place
    instead. Copies of a row count once; rows without a place (:func:`has_place`) or id are in no pair. Two ids at the
    same place are a pair at distance 0. An empty table gives an empty result. Other columns are never read.
    """
    found = _near(_points(df, id_col, lat_col, lon_col), radius_km, dense_cell)
    return found.select(F.col("_id_a").alias(f"{id_col}_a"), F.col("_id_b").alias(f"{id_col}_b"), "km")


def place_of(df: DataFrame, *, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    """Membership ``(id, latitude, longitude)``: the place of each point, which its coordinates name. One row per id and
    place; points without a place are left out."""
    return _points(df, id_col, lat_col, lon_col).select(F.col("_id").alias(id_col), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"))


def near_places(df: DataFrame, *, id_col: str, lat_col: str, lon_col: str, radius_km: float, dense_cell: int = 4000) -> DataFrame:
    """One row per place (points of equal coordinates): ``(latitude, longitude, points, near)`` with the number of points
    there and of points at other places at most ``radius_km`` away; :func:`place_of` has the members.

    Only places are paired, so a million points at one place are one row. Copies and points without a place as in
    :func:`near_pairs`.
    """
    places = _points(df, id_col, lat_col, lon_col).groupBy("_lat", "_lon").agg(F.count(F.lit(1)).alias("_n"))
    named = places.select(F.struct("_lat", "_lon").alias("_id"), "_lat", "_lon", "_n")
    pairs = _near(named, radius_km, dense_cell)
    both = pairs.select(F.explode(F.array(F.struct(F.col("_id_a").alias("p"), F.col("_n_b").alias("n")), F.struct(F.col("_id_b").alias("p"), F.col("_n_a").alias("n")))).alias("_l"))
    links = both.groupBy(F.col("_l.p._lat").alias("_lat"), F.col("_l.p._lon").alias("_lon")).agg(F.sum("_l.n").alias("_near"))
    return places.join(links, ["_lat", "_lon"], "left").select(F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("_n").alias("points"), F.coalesce("_near", F.lit(0)).alias("near"))


#: Where in a cell its reference point lies: at places that no usual coordinates have.
_REF_Y, _REF_X = 0.5137, 0.4871


def _edges(regions: DataFrame, region_col: str, ring_col: str) -> DataFrame:
    """The edges of each ring ``(_region, _ring, _y1, _x1, _y2, _x2)``. Longitudes go on beyond 180 where a ring crosses
    the date line; a ring that goes around the globe is closed over the pole of its hemisphere."""
    fine = F.forall("_corners", lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-180, 180) & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"]), F.lit(False)))
    rings = (
        regions.select(F.col(region_col).alias("_region"), F.col(ring_col).alias("_corners"))
        .where(F.col("_region").isNotNull() & (F.size("_corners") >= 3) & fine)
        .withColumn("_ring", F.sha2(F.to_json(F.struct("_region", "_corners")), 256)).dropDuplicates(["_ring"])
    )
    corners = rings.select("_region", "_ring", F.posexplode("_corners").alias("_pos", "_p")).select("_region", "_ring", "_pos", F.col("_p.lat").cast("double").alias("_y"), F.col("_p.lon").cast("double").alias("_l"))
    order = Window.partitionBy("_ring").orderBy("_pos")
    every = Window.partitionBy("_ring")

    def turn(step: Column) -> Column:
        return F.when(step > 180, -360.0).when(step < -180, 360.0).otherwise(0.0)

    turned = (
        corners.withColumn("_turn", turn(F.col("_l") - F.coalesce(F.lag("_l").over(order), F.col("_l"))))
        .withColumn("_x", F.col("_l") + F.sum("_turn").over(order))
        .select(
            "_region", "_ring", "_y", "_x", F.lead("_y").over(order).alias("_ny"), F.lead("_x").over(order).alias("_nx"), F.min_by("_y", "_pos").over(every).alias("_fy"), F.min_by("_l", "_pos").over(every).alias("_fx"),
            (F.sum("_turn").over(every) + turn(F.min_by("_l", "_pos").over(every) - F.max_by("_l", "_pos").over(every))).alias("_total"), F.when(F.avg("_y").over(every) >= 0, 91.0).otherwise(-91.0).alias("_pole"),
        )
    )

    def edge(y1: object, x1: object, y2: object, x2: object) -> Column:
        return F.struct(*(F.col(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in (("_y1", y1), ("_x1", x1), ("_y2", y2), ("_x2", x2))))

    far = F.col("_fx") + F.col("_total")
    last = F.array(edge("_y", "_x", "_fy", far))
    over = F.concat(last, F.array(edge("_fy", far, "_pole", far), edge("_pole", far, "_pole", "_fx"), edge("_pole", "_fx", "_fy", "_fx")))
    found = F.when(F.col("_ny").isNotNull(), F.array(edge("_y", "_x", "_ny", "_nx"))).when(F.col("_total") == 0, last).otherwise(over)
    return turned.select("_region", "_ring", F.explode(found).alias("_e")).select("_region", "_ring", "_e.*")


def points_in_regions(points: DataFrame, regions: DataFrame, *, id_col: str, lat_col: str, lon_col: str, region_col: str, ring_col: str, cell_deg: float = 1.0, dense_cell: int = 4000) -> DataFrame:
    """The regions that contain each point: ``(id, region)``, each once.

    ``regions`` holds one ring of ``(lat, lon)`` structs per row, in degrees; a region may have several. Rings close
    themselves and may cross the date line (an edge goes the shorter way) or go around the globe (then the pole of the
    hemisphere in which the mean of its corners lies is inside). Edges are straight in degrees, the even-odd rule decides, and a point exactly
    on a border may come out on either side. Rings with fewer than three corners, or with one out of range, contain
    nothing. Points without a place are in no region; copies of a point or ring count once; empty tables give no row.

    Rings are cut up by a grid of ``cell_deg`` degrees: a cell holds the edges that touch it, and whether a point of
    reference in it lies inside. A point walks only the edges of its own cell, on the way from there; cells well inside
    have none. Cells with more than ``dense_cell`` points are dealt over parts.
    """
    around = round(360 / cell_deg)
    deg, eps = 360 / around, 1e-9
    edges = _edges(regions, region_col, ring_col)
    y1, x1, y2, x2 = (F.col(c) for c in ("_y1", "_x1", "_y2", "_x2"))

    def x_at(y: Column) -> Column:
        return F.when(y1 == y2, x1).otherwise(x1 + (y - y1) / (y2 - y1) * (x2 - x1))

    rows = edges.withColumn("_cy", F.explode(F.sequence(F.floor((F.least(y1, y2) - eps) / deg), F.floor((F.greatest(y1, y2) + eps) / deg))))
    low, high = F.greatest(F.col("_cy") * deg - eps, F.least(y1, y2)), F.least((F.col("_cy") + 1) * deg + eps, F.greatest(y1, y2))
    ends = [F.when(y1 == y2, x1).otherwise(x_at(low)), F.when(y1 == y2, x2).otherwise(x_at(high))]
    touched = rows.withColumn("_cx", F.explode(F.sequence(F.floor((F.least(*ends) - eps) / deg), F.floor((F.greatest(*ends) + eps) / deg))))
    ref_y = (F.col("_cy") + _REF_Y) * deg
    crossed = rows.where((y1 > ref_y) != (y2 > ref_y)).select("_region", "_ring", "_cy", (x_at(ref_y) / deg - _REF_X).alias("_at"))
    order = Window.partitionBy("_ring", "_cy").orderBy("_at")
    spans = crossed.select("*", F.row_number().over(order).alias("_k"), F.lead("_at").over(order).alias("_to")).where((F.col("_k") % 2 == 1) & (F.ceil("_at") < F.ceil("_to")))
    inside = spans.select("_region", "_ring", "_cy", F.explode(F.sequence(F.ceil("_at"), F.ceil("_to") - 1)).alias("_cx"))
    cells = (
        touched.select("_region", "_ring", "_cy", "_cx", F.struct(y1.alias("y1"), x1.alias("x1"), y2.alias("y2"), x2.alias("x2")).alias("_e"), F.lit(0).alias("_in"))
        .unionByName(inside.withColumn("_in", F.lit(1)), allowMissingColumns=True)
        .groupBy("_region", "_ring", "_cy", "_cx").agg(F.collect_list("_e").alias("_edges"), F.max("_in").alias("_in"))
        .select("_region", "_cy", "_cx", "_edges", "_in", F.pmod(F.col("_cx"), F.lit(around)).alias("_key"))
    )
    at = _points(points, id_col, lat_col, lon_col).select("_id", "_lat", "_lon", F.floor(F.col("_lat") / deg).alias("_cy"), F.floor(F.col("_lon") / deg).alias("_c0"))
    at, cells = _dealt(at.withColumn("_key", F.pmod(F.col("_c0"), F.lit(around))), cells, ["_cy", "_key"], "_id", dense_cell)
    met = at.join(cells, ["_cy", "_key", "_part"])
    lat, lon = F.col("_lat"), F.col("_lon") + (F.col("_cx") - F.col("_c0")) * deg
    ref_x = (F.col("_cx") + _REF_X) * deg

    def up(e: Column) -> Column:  # along the meridian of the reference point to the point's latitude
        y = e["y1"] + (ref_x - e["x1"]) / (e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
        return ((e["x1"] > ref_x) != (e["x2"] > ref_x)) & ((y > ref_y) != (y > lat))

    def along(e: Column) -> Column:  # and along this latitude to the point
        x = e["x1"] + (lat - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return ((e["y1"] > lat) != (e["y2"] > lat)) & ((x > ref_x) != (x > lon))

    changes = F.size(F.filter("_edges", up)) + F.size(F.filter("_edges", along))
    return met.where((F.col("_in") + changes) % 2 == 1).select(F.col("_id").alias(id_col), F.col("_region").alias(region_col)).distinct()
