"""Queries that go through files, the store, the simulator and named SQL, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralume.functions.text import timestamp
from terralume.operators.geo import match_records, road_table, road_zone
from terralume.operators.simulate import ATTRIBUTE_ISSUES, simulate
from terralume.operators.validate import ORDINAL, validate
from terralume.plans.fixtures import reports, roads, table
from terralume.sinks import csv_bytes, workbook
from terralume.sources.files import ingest_bytes, read_legacy_csv
from terralume.sources.queries_file import named_queries, run_named
from terralume.store import initialize, persist_batch, tables

BATCH = "all"
NOW = dt.datetime(2026, 7, 22, 9)
NAMED = """
-- name: by_region
select region, count(*) as n, count_if(speed_limit = '-1') as below_zero from field_reports where issue_type = ? and source = 'app' group by region;
-- name: by_class
select road_class, count(*) as n from field_reports where issue_type = ? group by road_class
"""


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one in local mode without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="terralume-")
    return f"{root}/batches/{uuid.uuid4().hex}"


def _upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table to send as a file: all suppliers."""
    return table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("record_id"), F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") / 8.0).alias("eighths"), F.concat(F.lit("供应商, \""), "s_name", F.lit('"')).alias("description")).orderBy("record_id")


def uploaded_csv(spark, sf_dir):
    return ingest_bytes(spark, csv_bytes(_upload(spark, sf_dir).drop("eighths")), "SUPPLIERS.CSV")


def uploaded_xlsx(spark, sf_dir):
    df = _upload(spark, sf_dir)
    return ingest_bytes(spark, workbook({"data": (df.columns, [tuple(r) for r in df.toLocalIterator()])}), "suppliers.xlsx").withColumn("eighths", F.col("eighths").cast("double"))


def uploaded_legacy_csv(spark, sf_dir):
    x = _upload(spark, sf_dir).withColumn("nation", F.when(F.col("nation") == 3, "NA").otherwise(F.col("nation").cast("string"))).drop("eighths")
    return read_legacy_csv(spark, csv_bytes(x).decode("utf-8-sig").encode("gb18030")).select("record_id", "nation", "description")


def named_statement(spark, sf_dir):
    reports(spark, sf_dir).createOrReplaceTempView("field_reports")
    return run_named(spark, named_queries(NAMED, ("by_region", "by_class"))["by_region"], "point_offset")


def _stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    root = _folder(spark)
    initialize(spark, root)
    persist_batch(spark, root, "/uploads/events.csv", validate(reports(spark, sf_dir)), None, BATCH, NOW)
    return tables(spark, root)


def stored_batch(spark, sf_dir):
    return _stored(spark, sf_dir)["upload_batches"].select("batch_id", "source_name", "uploaded_at", "total_records", "valid_records", "rejected_records")


def stored_records(spark, sf_dir):
    return _stored(spark, sf_dir)["records"].select("record_key", "batch_id", "record_id", "longitude", "latitude", "issue_type", "region", "road_class", "speed_limit", "matched_road_id", "match_distance_m", "match_status", "created_at")


def stored_results(spark, sf_dir):
    raw = lambda f: F.get_json_object("raw_record_json", f"$.{f}").alias(f"raw_{f}")
    return _stored(spark, sf_dir)["validation_results"].select("validation_id", "batch_id", "record_id", "is_valid", "error_code", "error_message", raw("description"), raw("road_class"), raw("road_name"))


def stored_orders(spark, sf_dir):
    return _stored(spark, sf_dir)["issue_orders"].select("issue_order_id", "record_key", "record_id", "issue_type", "priority", "region", "status", "created_at")


def optional_fields_filled(spark, sf_dir):
    return validate(reports(spark, sf_dir).drop("road_name", "road_class", "direction", "speed_limit")).valid.select("record_id", "region", "road_name", "road_class", "direction", "speed_limit")


def zoned_times(spark, sf_dir):
    at = timestamp(F.concat("report_time", F.lit("+08:00")))
    return reports(spark, sf_dir).select(F.col(ORDINAL).alias("event_id"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("utc_time"))


def nearest_road_ties(spark, sf_dir):
    """Every road twice, the later one under another id, and every fifth without an id."""
    r = roads(spark, sf_dir)
    later = r.withColumns({"road_ord": F.col("road_ord") + (1 << 40), "road_id": F.lit("later")})
    r = r.withColumn("road_id", F.when(F.col("road_ord") % 5 > 0, F.col("road_id")))
    return match_records(validate(reports(spark, sf_dir)).valid, r.unionByName(later)).select("record_id", "matched_road_id", "matched_road_name", "match_distance_m", "match_status")


def road_identifiers(spark, sf_dir):
    """road_id comes before osm_id, also where a road has none."""
    name = F.create_map(F.lit("osm_id"), F.lit("x"), F.lit("road_name"), F.col("road_name"))
    own = F.when(F.col("road_ord") % 3 > 0, F.map_concat(name, F.create_map(F.lit("road_id"), F.concat(F.lit("r"), "road_id")))).otherwise(name)
    return road_table(roads(spark, sf_dir).select("road_ord", own.alias("properties"), "parts")).select("road_ord", "road_id", "road_name")


def road_utm_zone(spark, sf_dir):
    zone, south = road_zone(roads(spark, sf_dir))
    return spark.createDataFrame([(zone, south)], "zone int, south boolean")


def simulated_issues(spark, sf_dir):
    """What the simulator does to the records of each issue type."""
    p = F.create_map(F.lit("segment_id"), F.col("road_id"), F.lit("road_name"), F.col("road_name"), F.lit("road_class"), F.lit(" Primary "), F.lit("speed_limit"), F.lit("55"), F.lit("region"), F.lit("north"))
    r = roads(spark, sf_dir).select("road_ord", F.lit(None).cast("string").alias("feature_id"), p.alias("properties"), F.col("parts")[0].alias("coordinates"))
    x = simulate(r, 200, 42, 0.7, 0.2, 15.0, 40.0)
    far = F.abs("offset_m").between(15.0, 40.0)
    moved = (F.col("longitude") != F.col("base_longitude")) | (F.col("latitude") != F.col("base_latitude"))
    named = F.count_if(F.col("road_name") != "")
    return x.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("expected_is_issue").alias("issues"), F.count_if(far).alias("far"), F.count_if(moved).alias("moved"), named.alias("named"), F.max("road_class").alias("road_class"), F.max("direction").alias("direction"), F.max(F.col("speed_limit").cast("double")).alias("speed_limit"), F.max("region").alias("region"), F.max(F.regexp_replace("injected_error", "=.*", "")).alias("injected"))


def queries() -> dict:
    fs = (uploaded_csv, uploaded_xlsx, uploaded_legacy_csv, named_statement, stored_batch, stored_records, stored_results, stored_orders, optional_fields_filled, zoned_times, nearest_road_ties, road_identifiers, road_utm_zone, simulated_issues)
    return {f.__name__: f for f in fs}


def oracle_sql(raw: str, base: str, orders: str, near: str, status: str) -> dict[str, str]:
    """raw to status: the statements over derived reports that plans.queries.oracle_sql is made of."""
    upload = "select lpad(cast(s_suppkey as varchar), 8, '0') as record_id, cast(s_nationkey as bigint) as nation, s_suppkey / 8.0e0 as eighths, concat('供应商, \"', s_name, '\"') as description, cast(row_number() over (order by lpad(cast(s_suppkey as varchar), 8, '0')) - 1 as bigint) as _ordinal from supplier"
    sha = lambda kind: f"sha256(concat('{BATCH}|{kind}|', _ordinal))"
    at = "timestamp '2026-07-22 09:00:00' as created_at"
    n = {k: 23 if i < 2 else 22 for i, k in enumerate(ATTRIBUTE_ISSUES)}
    # issue type: records, issues, far, moved, named, class, direction, speed, injected
    does = {"normal_observation": (60, 0, 0, 0, 60, "primary", "two_way", 55, "none"), "point_offset": (28, 28, 28, 28, 28, "primary", "two_way", 55, "point_offset_m")}
    kinds = {"missing_road_name": (0, "primary", "two_way", 55, "road_name_set_empty"), "road_class_anomaly": (1, "invalid_class", "two_way", 55, "road_class_set_invalid"), "direction_anomaly": (1, "primary", "invalid_direction", 55, "direction_set_invalid"), "speed_limit_anomaly": (1, "primary", "two_way", 999, "speed_limit_set_999"), "suspected_dead_end": (1, "primary", "two_way", 55, "point_moved_to_road_endpoint")}
    does |= {k: (n[k], n[k], 0, 0, n[k] * v[0], *v[1:]) for k, v in kinds.items()}
    rows = ", ".join(f"('{k}', " + ", ".join(f"{x}::bigint" for x in v[:5]) + f", '{v[5]}', '{v[6]}', {v[7]}::double, 'north', '{v[8]}')" for k, v in does.items())
    without = base.replace("where error_code = ''", "where error_code in ('', 'invalid_speed_limit')")
    return {
        "uploaded_csv": f"select record_id, cast(nation as varchar) as nation, description, _ordinal from ({upload})",
        "uploaded_xlsx": f"select record_id, nation, eighths, description, _ordinal from ({upload})",
        "uploaded_legacy_csv": f"select record_id, cast(nullif(nation, 3) as varchar) as nation, description from ({upload})",
        "named_statement": f"with raw as ({raw}) select region, count(*) as n, count(*) filter (where speed_limit = '-1') as below_zero from raw where issue_type = 'point_offset' group by region",
        "stored_batch": f"{base} select '{BATCH}' as batch_id, 'events.csv' as source_name, timestamp '2026-07-22 09:00:00' as uploaded_at, count(*) as total_records, count(*) filter (where error_code = '') as valid_records, count(*) filter (where error_code <> '') as rejected_records from marked",
        "stored_records": f"{base} select {sha('record')} as record_key, '{BATCH}' as batch_id, record_id, longitude, latitude, issue_type, region, road_class, speed_limit, cast(null as varchar) as matched_road_id, cast(null as double) as match_distance_m, cast(null as varchar) as match_status, {at} from valid",
        "stored_results": f"{base} select case when error_code = '' then {sha('valid')} else {sha('rejected')} end as validation_id, '{BATCH}' as batch_id, case when error_code = '' then trim(record_id) else record_id end as record_id, error_code = '' as is_valid, nullif(error_code, '') as error_code, nullif(error_message, '') as error_message, description as raw_description, road_class as raw_road_class, road_name as raw_road_name from marked",
        "stored_orders": f"{base}{orders} select {sha('order')} as issue_order_id, {sha('record')} as record_key, record_id, issue_type, priority, region, status, {at} from orders",
        "optional_fields_filled": f"{without} select record_id, region, cast(null as varchar) as road_name, cast(null as varchar) as road_class, cast(null as varchar) as direction, cast(null as double) as speed_limit from valid",
        "zoned_times": f"with raw as ({raw}) select _ordinal as event_id, strftime(try_cast(report_time as timestamp) - interval 8 hour, '%Y-%m-%d %H:%M:%S') as utc_time from raw",
        "nearest_road_ties": f"{base}{near} select v.record_id, case when b.k % 5 > 0 then cast(b.k as varchar) end as matched_road_id, case when b.k % 5 > 0 then b.s_name end as matched_road_name, case when b.k % 5 > 0 then round(b.d, 3) end as match_distance_m, case when b.k % 5 = 0 then 'unmatched' else {status} end as match_status from valid v join best b using (_ordinal)",
        "road_identifiers": "select cast(s_suppkey as bigint) as road_ord, case when s_suppkey % 3 > 0 then concat('r', s_suppkey) end as road_id, s_name as road_name from supplier",
        "road_utm_zone": "select cast(floor(((min(116.4e0 + (s_suppkey * 7919 % 1000) / 1e4) + max(116.42e0 + (s_suppkey * 7919 % 1000) / 1e4)) / 2 + 180) / 6) + 1 as integer) as zone, false as south from supplier",
        "simulated_issues": f"select * from (values {rows}) t(issue_type, n, issues, far, moved, named, road_class, direction, speed_limit, region, injected)",
    }
