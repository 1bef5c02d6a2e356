"""Deterministic labelled reports along reference roads."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Issue types, road classes with default speeds, metres in a degree.
ATTRIBUTE_ISSUES = ("missing_road_name", "road_class_anomaly", "direction_anomaly", "speed_limit_anomaly", "suspected_dead_end")
SPEEDS = {"motorway": 100, "trunk": 80, "primary": 60, "secondary": 50, "tertiary": 40, "residential": 30, "service": 20, "unclassified": 30}
METRES = 111_320.0


class ReferenceRoadError(ValueError):
    pass


def lon_scale(lat: Column) -> Column:
    return METRES * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))


def segment_length(a: Column, b: Column) -> Column:
    return F.hypot((b[0] - a[0]) * lon_scale((a[1] + b[1]) / 2), (b[1] - a[1]) * METRES)


def interpolate(lines: DataFrame) -> DataFrame:
    """lines (key, coordinates, ratio): lon, lat and segment_index at that share of the length; the last segment takes rounding.

    Lines without length fail the query, as do ratios outside 0 to 1.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.size("coordinates") - 2), lambda i: F.struct(i.alias("i"), F.get("coordinates", i).alias("a"), F.get("coordinates", i + 1).alias("b")))
    x = lines.select("key", "ratio", F.explode(pairs).alias("s")).select("key", "ratio", "s.*").withColumn("length", segment_length(F.col("a"), F.col("b")))
    w = Window.partitionBy("key")
    x = x.withColumns({"total": F.sum("length").over(w), "before": F.coalesce(F.sum("length").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "last": F.max("i").over(w)})
    bad = (F.col("total") <= 0) | ~F.col("ratio").between(0, 1)
    x = x.withColumn("total", F.when(bad, F.raise_error(F.lit("zero-length road, or a ratio outside 0 to 1")).cast("double")).otherwise(F.col("total")))
    target = F.col("ratio") * F.col("total")
    x = x.filter((target <= F.col("before") + F.col("length")) | (F.col("i") == F.col("last")))
    best = x.groupBy("key").agg(F.min_by(F.struct("i", "a", "b", "length", "before", "total", "ratio"), "i").alias("s")).select("key", "s.*")
    t = F.when(F.col("length") > 0, (F.col("ratio") * F.col("total") - F.col("before")) / F.col("length")).otherwise(0.0)
    at = lambda k: F.col("a")[k] + (F.col("b")[k] - F.col("a")[k]) * t
    return best.select("key", at(0).alias("lon"), at(1).alias("lat"), F.col("i").alias("segment_index"))


def offset(lon: Column, lat: Column, a: Column, b: Column, metres: Column) -> tuple[Column, Column]:
    """The point that many metres to the left of the segment's direction (right if negative)."""
    dx, dy = (b[0] - a[0]) * lon_scale(lat), (b[1] - a[1]) * METRES
    length = F.hypot(dx, dy)
    length = F.when(length > 0, length).otherwise(F.raise_error(F.lit("zero-length segment")).cast("double"))
    return lon - dy / length * metres / lon_scale(lat), lat + dx / length * metres / METRES


def issue_counts(count: int, issue_rate: float, offset_share: float) -> tuple[int, int]:
    """Issues, and point offsets among them."""
    if count < 1:
        raise ValueError("count must be 1 or more")
    if not (0 <= issue_rate <= 1 and 0 <= offset_share <= 1):
        raise ValueError("rates must be from 0 to 1")
    issues = round(count * issue_rate)
    return issues, round(issues * offset_share)


def schedule(spark: SparkSession, count: int, issue_rate: float, offset_share: float, seed: int) -> DataFrame:
    """index (from 1) and issue_type of every record; null: none. Shuffled by a hash of the seed."""
    issues, offsets = issue_counts(count, issue_rate, offset_share)
    i = F.col("id")
    names = F.array(*map(F.lit, ATTRIBUTE_ISSUES))
    kind = F.when(i < offsets, "point_offset").when(i < issues, F.element_at(names, ((i - offsets) % len(ATTRIBUTE_ISSUES) + 1).cast("int")))
    x = spark.range(count).select(i, kind.alias("issue_type"))
    return x.select("issue_type", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), i), i)).alias("index"))


def _unit(seed: int, what: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "index"), F.lit(1 << 40)) / F.lit(float(1 << 40))


def simulate(roads: DataFrame, count: int = 200, seed: int = 42, issue_rate: float = 0.7, offset_share: float = 0.2, offset_min_m: float = 15.0, offset_max_m: float = 40.0) -> DataFrame:
    """Records along roads (road_ord from 0, feature_id, properties map, coordinates), with audit labels; the same for a seed."""
    n = roads.count()
    if not n:
        raise ReferenceRoadError("no reference roads")
    if not 0 <= offset_min_m <= offset_max_m:
        raise ValueError("0 <= offset_min_m <= offset_max_m is needed")
    p = F.col("properties")
    full = lambda c: F.nullif(c, F.lit(""))
    x = schedule(roads.sparkSession, count, issue_rate, offset_share, seed).withColumn("road_ord", F.floor(_unit(seed, "road") * n))
    numbered = roads.withColumn("road_ord", F.row_number().over(Window.orderBy("road_ord")).cast("long") - 1)
    x = x.join(numbered, "road_ord")
    x = x.withColumn("original_road_id", F.coalesce(full(p["segment_id"]), full(p["osm_id"]), full("feature_id"), F.format_string("road_%06d", "road_ord")))
    first = _unit(seed, "end") < 0.5
    dead = F.coalesce(F.col("issue_type") == "suspected_dead_end", F.lit(False))
    ratio = F.when(dead, F.when(first, 0.0).otherwise(1.0)).otherwise(_unit(seed, "ratio"))
    placed = interpolate(x.select(F.col("index").alias("key"), "coordinates", ratio.alias("ratio")))
    x = x.join(placed.withColumnRenamed("key", "index"), "index")
    end = F.when(first, F.element_at("coordinates", 1)).otherwise(F.element_at("coordinates", -1))
    x = x.withColumns({"lon": F.when(dead, end[0]).otherwise(F.col("lon")), "lat": F.when(dead, end[1]).otherwise(F.col("lat"))})
    is_ = lambda k: F.coalesce(F.col("issue_type") == k, F.lit(False))
    metres = F.when(is_("point_offset"), (offset_min_m + _unit(seed, "metres") * (offset_max_m - offset_min_m)) * F.when(_unit(seed, "side") < 0.5, -1.0).otherwise(1.0)).otherwise(0.0)
    x = x.withColumn("offset_m", metres)
    a, b = F.get("coordinates", F.col("segment_index")), F.get("coordinates", F.col("segment_index") + 1)
    lon, lat = offset(F.col("lon"), F.col("lat"), a, b, F.col("offset_m"))
    moved = is_("point_offset")
    cls = F.lower(F.trim(p["road_class"]))
    cls = F.when(cls.isin(*SPEEDS), cls).otherwise("unclassified")
    speeds = F.create_map(*(F.lit(v) for kv in SPEEDS.items() for v in (kv[0], float(kv[1]))))
    speed = p["speed_limit"].try_cast("double")
    # What each issue is recorded as.
    errors = {"missing_road_name": "road_name_set_empty", "road_class_anomaly": "road_class_set_invalid", "direction_anomaly": "direction_set_invalid", "speed_limit_anomaly": "speed_limit_set_999", "suspected_dead_end": "point_moved_to_road_endpoint"}
    injected = F.lit("none")
    for k, v in errors.items():
        injected = F.when(is_(k), v).otherwise(injected)
    injected = F.when(moved, F.concat(F.lit("point_offset_m="), F.format_string("%.2f", "offset_m"))).otherwise(injected)
    when = F.timestamp_add("MINUTE", F.col("index") - 1, F.lit("2026-07-22").cast("timestamp_ntz"))
    return x.select(
        F.format_string("sim_%05d", "index").alias("record_id"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("report_time"),
        F.bround(F.when(moved, lon).otherwise(F.col("lon")), 7).alias("longitude"),
        F.bround(F.when(moved, lat).otherwise(F.col("lat")), 7).alias("latitude"),
        F.coalesce("issue_type", F.lit("normal_observation")).alias("issue_type"),
        F.lit("simulation").alias("source"),
        F.concat(F.lit("基于参考道路 "), "original_road_id", F.lit(" 生成的可验证模拟记录")).alias("description"),
        F.when(is_("missing_road_name"), "").otherwise(F.trim(F.coalesce(full(p["road_name"]), F.concat(F.lit("参考道路_"), "original_road_id")))).alias("road_name"),
        F.when(is_("road_class_anomaly"), "invalid_class").otherwise(cls).alias("road_class"),
        F.when(is_("direction_anomaly"), "invalid_direction").otherwise(F.coalesce(full(F.trim(p["direction"])), F.lit("two_way"))).alias("direction"),
        F.when(is_("speed_limit_anomaly"), 999.0).otherwise(F.when(speed > 0, speed).otherwise(speeds[cls])).alias("speed_limit"),
        F.trim(F.coalesce(full(p["region"]), F.lit("reference_area"))).alias("region"),
        F.col("issue_type").isNotNull().alias("expected_is_issue"),
        F.col("issue_type").alias("expected_issue_type"),
        "original_road_id",
        injected.alias("injected_error"),
        F.bround("lon", 7).alias("base_longitude"),
        F.bround("lat", 7).alias("base_latitude"),
        F.bround("offset_m", 2).alias("offset_m"),
    )


def main(args: list[str] | None = None) -> None:
    from terralume.sinks import write_csv, write_geojson
    from terralume.sources.files import simulation_roads

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--roads", required=True)
    p.add_argument("--csv", default="simulated_records.csv")
    p.add_argument("--geojson", default="simulated_records.geojson")
    for name, kind, value in (("count", int, 200), ("seed", int, 42), ("issue-rate", float, 0.7), ("offset-share", float, 0.2), ("offset-min-m", float, 15.0), ("offset-max-m", float, 40.0)):
        p.add_argument(f"--{name}", type=kind, default=value)
    a = vars(p.parse_args(args))
    spark = SparkSession.builder.getOrCreate()
    roads, csv, geojson = simulation_roads(spark, a.pop("roads")), a.pop("csv"), a.pop("geojson")
    records = simulate(roads, **a).orderBy("record_id")
    write_csv(records, csv)
    write_geojson(records, geojson)


if __name__ == "__main__":
    main()
