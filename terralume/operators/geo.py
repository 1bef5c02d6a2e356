"""Coordinates, projection and nearest roads."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.functions.text import number
from terralume.schema import MATCHED_MAX_M, REVIEW_MAX_M

#: Segments that are broadcast at most; more go through the grid join.
BROADCAST_SEGMENTS = 100_000
CELL_M = 500.0


class RoadMatchingError(ValueError):
    pass


@dataclass(frozen=True)
class Rules:
    matched_max_distance_m: float = MATCHED_MAX_M
    review_max_distance_m: float = REVIEW_MAX_M

    def __post_init__(self):
        if not 0 <= self.matched_max_distance_m <= self.review_max_distance_m:
            raise RoadMatchingError("0 <= matched_max_distance_m <= review_max_distance_m is needed")


def utm_zone(longitude: float, latitude: float) -> tuple[int, bool]:
    """Zone number and whether it is a southern one."""
    return min(60, max(1, math.floor((longitude + 180) / 6) + 1)), latitude < 0


def utm_sql(lon: str, lat: str, zone: int, south: bool = False) -> tuple[str, str]:
    """Easting and northing (WGS84, Krueger series to the fourth order) as SQL that any engine with hyperbolic functions runs."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    d = lambda v: f"cast('{v!r}' as double)"
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {d(e)} * atanh({d(e)} * {s}))"
    turn = f"radians({lon} - {d(float(6 * zone - 183))})"
    xi = f"atan2({t}, cos({turn}))"
    eta = f"atanh(sin({turn}) / sqrt(1 + ({t}) * ({t})))"
    east = " + ".join([eta, *(f"{d(c)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(series, 1))])
    north = " + ".join([xi, *(f"{d(c)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(series, 1))])
    return f"({d(500000.0)} + {d(a)} * ({east}))", f"({d(1e7 if south else 0.0)} + {d(a)} * ({north}))"


def coordinate_states(points: DataFrame) -> DataFrame:
    """Add longitude, latitude (numbers, swapped if only that makes them valid), coordinate_swapped and coordinate_state.

    geometry_is_empty, if there, makes a point with coordinates an empty_geometry.
    """
    missing = [c for c in ("longitude", "latitude") if c not in points.columns]
    if missing:
        raise RoadMatchingError(f"missing columns: {', '.join(missing)}")
    kinds = dict(points.dtypes)
    value = lambda c: F.lit(None).cast("double") if kinds[c] == "boolean" else number(F.col(c), kinds[c])
    x = points.withColumns({"_lon": value("longitude"), "_lat": value("latitude")})
    ok = lambda a, b: a.between(-180.0, 180.0) & b.between(-90.0, 90.0)
    lon, lat = F.col("_lon"), F.col("_lat")
    swap = F.coalesce(~ok(lon, lat) & ok(lat, lon), F.lit(False))
    given = lon.isNotNull() & lat.isNotNull()
    empty = F.coalesce(F.col("geometry_is_empty"), F.lit(False)) if "geometry_is_empty" in points.columns else F.lit(False)
    state = F.when(~given | ~(ok(lon, lat) | swap), "invalid_coordinate").when(empty, "empty_geometry").otherwise("pending")
    x = x.withColumns({"coordinate_state": state, "coordinate_swapped": swap, "longitude": F.when(swap, lat).otherwise(lon), "latitude": F.when(swap, lon).otherwise(lat)})
    return x.drop("_lon", "_lat")


def road_table(features: DataFrame) -> DataFrame:
    """Roads (road_ord, properties map, parts) with road_id (first property that any road has of segment_id, road_id, osm_id; else the ordinal) and road_name."""
    keys = [r[0] for r in features.select(F.explode(F.map_keys("properties")).alias("k")).filter(F.col("k").isin("segment_id", "road_id", "osm_id")).distinct().collect()]
    first = next((k for k in ("segment_id", "road_id", "osm_id") if k in keys), None)
    road_id = F.col("properties")[first] if first else F.col("road_ord").cast("string")
    return features.select("road_ord", road_id.alias("road_id"), F.col("properties")["road_name"].alias("road_name"), "parts")


def segments(roads: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """One row for each segment of a road's parts: road_ord, road_id, road_name, x1, y1, x2, y2 in metres."""
    p = roads.select("road_ord", "road_id", "road_name", F.explode("parts").alias("part"))
    p = p.select("road_ord", "road_id", "road_name", F.explode(F.arrays_zip(F.slice("part", 1, F.size("part") - 1).alias("a"), F.slice("part", 2, F.size("part")).alias("b"))).alias("s")).select("road_ord", "road_id", "road_name", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    out = []
    for end, i in (("a", 1), ("b", 2)):
        e, n = utm_sql(f"{end}[0]", f"{end}[1]", zone, south)
        out += [F.expr(e).alias(f"x{i}"), F.expr(n).alias(f"y{i}")]
    return p.select("road_ord", "road_id", "road_name", *out)


def road_zone(roads: DataFrame) -> tuple[int, bool]:
    """The UTM zone of the middle of all roads' bounds."""
    v = roads.select(F.explode(F.flatten("parts")).alias("v")).agg(F.min(F.col("v")[0]), F.max(F.col("v")[0]), F.min(F.col("v")[1]), F.max(F.col("v")[1])).first()
    if v[0] is None:
        raise RoadMatchingError("no line geometry")
    return utm_zone((v[0] + v[1]) / 2, (v[2] + v[3]) / 2)


def _squared(x: Column, y: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / length))).otherwise(0.0)
    ex, ey = F.col("x1") + t * dx - x, F.col("y1") + t * dy - y
    return ex * ex + ey * ey


def _by_arrays(points: DataFrame, segs: pd.DataFrame) -> DataFrame:
    segs = segs.sort_values("road_ord", kind="stable")
    held = points.sparkSession.sparkContext.broadcast((segs["road_ord"].to_numpy(), *(segs[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))))

    def run(frames):
        ords, x1, y1, x2, y2 = held.value
        dx, dy = x2 - x1, y2 - y1
        length = np.where(dx * dx + dy * dy > 0, dx * dx + dy * dy, 1.0)
        step = max(1, 4_000_000 // max(1, len(ords)))
        for f in frames:
            best, far = np.empty(len(f), np.int64), np.empty(len(f))
            for i in range(0, len(f), step):
                x, y = f["x"].to_numpy()[i : i + step, None], f["y"].to_numpy()[i : i + step, None]
                t = np.clip(((x - x1) * dx + (y - y1) * dy) / length, 0, 1)
                d = np.hypot(x1 + t * dx - x, y1 + t * dy - y)
                j = d.argmin(axis=1)  # the lowest ordinal of equal ones
                best[i : i + step], far[i : i + step] = ords[j], d[np.arange(len(j)), j]
            yield pd.DataFrame({"_p": f["_p"], "road_ord": best, "distance": far})

    return points.mapInPandas(run, "_p long, road_ord long, distance double")


def _by_grid(points: DataFrame, segs: DataFrame, cell: float = CELL_M) -> DataFrame:
    """Cells that a segment comes within one cell of hold it; a point whose best is within a cell is done, the rest take cells four times as wide."""
    points, segs = points.persist(), segs.persist()  # projected once; every width of cells reads them
    done, left = [], points
    bounds = segs.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    p = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if bounds[0] is None or p[0] is None:
        return points.select("_p", F.lit(None).cast("long").alias("road_ord"), F.lit(None).cast("double").alias("distance")).limit(0)
    reach = max(max(bounds[1], p[1]) - min(bounds[0], p[0]), max(bounds[3], p[3]) - min(bounds[2], p[2])) * 1.5 + 1
    while True:
        at = lambda c: F.floor(F.col(c) / cell)
        span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell) - 1, F.floor(F.greatest(a, b) / cell) + 1))
        s = segs.withColumn("_i", span("x1", "x2")).withColumn("_j", span("y1", "y2"))
        near = left.withColumns({"_i": at("x"), "_j": at("y")}).join(s, ["_i", "_j"]).select("_p", F.struct(_squared(F.col("x"), F.col("y")).alias("d"), "road_ord").alias("b"))
        near = near.groupBy("_p").agg(F.min("b").alias("b")).select("_p", F.col("b.road_ord").alias("road_ord"), F.sqrt("b.d").alias("distance"))
        if cell >= reach:
            done.append(near)
            break
        near = near.filter(F.col("distance") <= cell).persist()
        done.append(near)
        left = left.join(near.select("_p"), "_p", "left_anti").persist()
        if not left.limit(1).count():
            break
        cell *= 4
    return reduce(DataFrame.unionByName, done)


def match_records(points: DataFrame, roads: DataFrame, rules: Rules = Rules(), grid: bool | None = None) -> DataFrame:
    """Points with coordinate_state, coordinate_swapped, matched_road_id, matched_road_name, match_distance_m and match_status.

    Every row stays one row. The nearest road counts at any distance, ties go to the lowest ordinal, and a
    nearest road without an id leaves the point unmatched. Roads: road_ord, road_id, road_name, parts.
    """
    zone = road_zone(roads)
    x = coordinate_states(points).withColumn("_p", F.col("_ordinal") if "_ordinal" in points.columns else F.monotonically_increasing_id())
    e, n = utm_sql("longitude", "latitude", *zone)
    eligible = x.filter(F.col("coordinate_state") == "pending").select("_p", F.expr(e).alias("x"), F.expr(n).alias("y"))
    segs = segments(roads, *zone).select("road_ord", "x1", "y1", "x2", "y2")
    if grid is None:
        grid = segs.limit(BROADCAST_SEGMENTS + 1).count() > BROADCAST_SEGMENTS
    best = _by_grid(eligible, segs) if grid else _by_arrays(eligible, segs.toPandas())
    named = best.join(roads.select("road_ord", "road_id", "road_name"), "road_ord")
    known = F.col("road_id").isNotNull()
    d = F.col("distance")
    status = F.when(~known, "unmatched").when(d <= rules.matched_max_distance_m, "matched").when(d <= rules.review_max_distance_m, "needs_review").otherwise("unmatched")
    named = named.select("_p", F.col("road_id").alias("matched_road_id"), F.when(known, F.col("road_name")).alias("matched_road_name"), F.when(known, F.round(d, 3)).alias("match_distance_m"), status.alias("_status"))
    out = x.join(named, "_p", "left").withColumn("match_status", F.coalesce("_status", "coordinate_state"))
    return out.drop("_p", "_status")
