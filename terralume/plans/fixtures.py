"""Reports and roads derived from the test tables, by arithmetic that Spark and other SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unclassified")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports_sql(stamp: str) -> str:
    """SQL over events for the twelve text fields and _ordinal; stamp: ts as text."""
    return f"""select event_id as _ordinal,
    case when event_id % 41 = 0 then ' ' when event_id % 50 = 49 then concat(' E', cast(event_id - 1 as string)) else concat('E', cast(event_id as string)) end as record_id,
    case when event_id % 37 = 0 then 'not-a-date' else {stamp} end as report_time,
    case when event_id % 29 = 0 then 'east' when event_id % 31 = 0 then '181' else concat('116.4', lpad(cast((user_id * 7919 + event_id * 13) % 100000 as string), 5, '0')) end as longitude,
    concat('39.9', lpad(cast((user_id * 104729 + event_id * 17) % 100000 as string), 5, '0')) as latitude,
    case event_type when 'error' then 'point_offset' when 'click' then 'speed_limit_anomaly' when 'purchase' then 'suspected_dead_end' when 'view' then 'Normal' when 'signup' then 'missing_road_name' else event_type end as issue_type,
    'app' as source, concat('E', cast(event_id as string)) as description,
    case when event_id % 23 = 0 then '  ' else concat('region_', cast(user_id % 25 as string)) end as region,
    cast(null as string) as road_name,
    case event_id % 8 {" ".join(f"when {i} then '{c}'" for i, c in enumerate(CLASSES))} end as road_class,
    cast(null as string) as direction,
    case when event_id % 43 = 0 then '-1' else cast(event_id % 120 as string) end as speed_limit
    from events"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(reports_sql("date_format(ts, 'yyyy-MM-dd HH:mm:ss')").replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


ROADS_SQL = """select s_suppkey as k, s_name, 116.4e0 + cast((s_suppkey * 7919) % 1000 as double) / 10000e0 as lon, 39.9e0 + cast((s_suppkey * 104729) % 1000 as double) / 10000e0 as lat from supplier"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.sql(ROADS_SQL.replace("from supplier", "from {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    a, b = F.array("lon", "lat"), F.array(F.col("lon") + 0.02, F.col("lat") + 0.01)
    return x.select(F.col("k").cast("long").alias("road_ord"), F.col("k").cast("string").alias("road_id"), F.col("s_name").alias("road_name"), F.array(F.array(a, b)).alias("parts"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of several vertices: a nation's suppliers in the order of their keys."""
    x = spark.sql("select s_nationkey as key, s_suppkey as k, 116.4e0 + cast((s_suppkey * 7919) % 1000 as double) / 10000e0 as lon, 39.9e0 + cast((s_suppkey * 104729) % 1000 as double) / 10000e0 as lat from {supplier}", supplier=table(spark, sf_dir, "supplier"))
    x = x.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("v"))
    return x.filter(F.size("v") > 1).select("key", F.transform("v", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
