"""Queries over the derived reports and roads, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralume.functions.text import json_row
from terralume.operators.geo import coordinate_states, match_records, segments, utm_sql
from terralume.operators.legacy import validate_legacy
from terralume.operators.orders import has_issue, issue_orders as orders_of
from terralume.operators.orders import key, priority
from terralume.operators.simulate import ATTRIBUTE_ISSUES, interpolate, offset, schedule
from terralume.operators.validate import Validation, validate
from terralume.plans import report, stored
from terralume.plans.fixtures import ROADS_SQL, lines, reports, reports_sql, roads, table
from terralume.schema import HIGH, MATCHED_MAX_M, MEDIUM, REQUIRED_FIELDS, REVIEW_MAX_M, STANDARD_FIELDS, UNNAMED_REGION
from terralume.sinks import map_centre

BATCH = "all"
NOW = dt.datetime(2026, 7, 22, 9)
ZONE = 50


def _validated(spark: SparkSession, sf_dir: str) -> Validation:
    return validate(reports(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str, matched: bool = False) -> DataFrame:
    v = _validated(spark, sf_dir).valid
    none = {"matched_road_id": F.lit(None).cast("string"), "matched_road_name": F.lit(None).cast("string"), "match_distance_m": F.lit(None).cast("double"), "match_status": F.lit(None).cast("string")}
    v = match_records(v, roads(spark, sf_dir)) if matched else v.withColumns(none)
    return v.withColumns({"batch_id": F.lit(BATCH), "record_key": key(F.lit(BATCH), "record", F.col("_ordinal")), "created_at": F.lit(NOW).cast("timestamp_ntz")})


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _validated(spark, sf_dir).rejected
    return r.select(F.lpad(F.col("_ordinal").cast("string"), 20, "0").alias("validation_id"), F.lit(BATCH).alias("batch_id"), F.nullif(F.trim("record_id"), F.lit("")).alias("record_id"), F.lit(False).alias("is_valid"), "error_code", "error_message", json_row([F.col(f) for f in STANDARD_FIELDS]).alias("raw_record_json"), F.lit(NOW).cast("timestamp_ntz").alias("created_at"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _validated(spark, sf_dir).summary
    return s.select(F.lit(BATCH).alias("batch_id"), F.lit("events.csv").alias("source_name"), F.lit(NOW).cast("timestamp_ntz").alias("uploaded_at"), "total_records", "valid_records", "rejected_records")


def validated_reports(spark, sf_dir):
    return _validated(spark, sf_dir).annotated.select(F.col("_ordinal").alias("event_id"), "record_id", F.concat_ws(";", "error_codes").alias("error_code"), F.concat_ws("；", "error_messages").alias("error_message"))


def error_code_counts(spark, sf_dir):
    return _validated(spark, sf_dir).annotated.select(F.explode("error_codes").alias("error_code")).groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def validation_summary(spark, sf_dir):
    s = _validated(spark, sf_dir).summary
    return s.select("total_records", "valid_records", "rejected_records", "valid_rate", F.array_join(F.transform(F.array_sort(F.map_entries("error_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("error_counts"))


def missing_column_rejects(spark, sf_dir):
    return validate(reports(spark, sf_dir).select("record_id", "description", "_ordinal")).rejected.select("record_id", "description", "error_code", "error_message")


def duplicate_ids(spark, sf_dir):
    return _validated(spark, sf_dir).annotated.filter(F.array_contains("error_codes", "duplicate_record_id")).select(F.col("_v_record_id").alias("record_id"), F.col("_ordinal").alias("event_id"))


def valid_records(spark, sf_dir):
    v = _validated(spark, sf_dir).valid
    return v.select("record_id", F.date_format("report_time", "yyyy-MM-dd HH:mm:ss").alias("report_time"), "longitude", "latitude", "issue_type", "source", "description", "region", "road_name", "road_class", "direction", "speed_limit")


def issue_orders(spark, sf_dir):
    return orders_of(_records(spark, sf_dir)).select("record_id", "issue_type", "priority", "region", "status")


def data_overview(spark, sf_dir):
    return report.data_overview(_batches(spark, sf_dir), orders_of(_records(spark, sf_dir)), BATCH)


def issue_type_statistics(spark, sf_dir):
    return report.issue_type_statistics(orders_of(_records(spark, sf_dir)), BATCH)


def region_statistics(spark, sf_dir):
    return report.region_statistics(_records(spark, sf_dir), orders_of(_records(spark, sf_dir)), BATCH)


def region_statistics_unnamed(spark, sf_dir):
    """Over reports that weren't validated, so that blank regions occur."""
    r = reports(spark, sf_dir).withColumn("batch_id", F.lit(BATCH))
    return report.region_statistics(r, r.filter(has_issue(F.col("issue_type"))).withColumn("priority", priority(F.col("issue_type"))), BATCH)


def high_priority_issues(spark, sf_dir):
    return report.high_priority_issues(orders_of(_records(spark, sf_dir, True)), BATCH)


def error_details(spark, sf_dir):
    return report.error_details(_results(spark, sf_dir), BATCH).drop("原始记录(JSON)")


def utm_projection(spark, sf_dir):
    e, n = utm_sql("longitude", "latitude", ZONE)
    return _validated(spark, sf_dir).valid.select("record_id", F.round(F.expr(e), 3).alias("easting"), F.round(F.expr(n), 3).alias("northing"))


def nearest_road(spark, sf_dir):
    return match_records(_validated(spark, sf_dir).valid, roads(spark, sf_dir)).select("record_id", "matched_road_id", "matched_road_name", "match_distance_m", "match_status")


def nearest_road_grid(spark, sf_dir):
    return match_records(_validated(spark, sf_dir).valid, roads(spark, sf_dir), grid=True).select("record_id", "matched_road_id", "matched_road_name", "match_distance_m", "match_status")


def coordinate_state(spark, sf_dir):
    x = reports(spark, sf_dir).select("_ordinal", F.when(F.col("_ordinal") % 7 == 0, F.col("latitude")).otherwise(F.col("longitude")).alias("longitude"), F.when(F.col("_ordinal") % 7 == 0, F.col("longitude")).otherwise(F.col("latitude")).alias("latitude"), (F.col("_ordinal") % 11 == 0).alias("geometry_is_empty"))
    return coordinate_states(x).select(F.col("_ordinal").alias("event_id"), "longitude", "latitude", "coordinate_state", "coordinate_swapped")


def line_interpolation(spark, sf_dir):
    x = interpolate(lines(spark, sf_dir).withColumn("ratio", (F.col("key") % 11) / F.lit(10.0)))
    return x.select("key", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.col("segment_index").cast("long").alias("segment_index"))


def perpendicular_offset(spark, sf_dir):
    x = roads(spark, sf_dir).select("road_id", F.col("parts")[0][0].alias("a"), F.col("parts")[0][1].alias("b"), "road_ord")
    lon, lat = offset(F.col("a")[0], F.col("a")[1], F.col("a"), F.col("b"), (F.col("road_ord") % 40 - 20).cast("double"))
    return x.select("road_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def road_segments(spark, sf_dir):
    return segments(roads(spark, sf_dir), ZONE).select("road_id", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


def issue_schedule(spark, sf_dir):
    return schedule(spark, 200, 0.7, 0.2, 42).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def _legacy(spark, sf_dir):
    s = F.when(F.col("_ordinal") % 6 == 0, " HIGH ").when(F.col("_ordinal") % 6 == 1, "urgent").when(F.col("_ordinal") % 6 == 2, "").otherwise("low")
    x = reports(spark, sf_dir).select(F.col("record_id").alias("ID"), F.col("longitude").alias("Lon"), F.col("latitude").alias("lat"), s.alias("Severity"), F.col("report_time").alias("Reported-At"), "_ordinal")
    return validate_legacy(x)


def legacy_valid(spark, sf_dir):
    return _legacy(spark, sf_dir).valid


def legacy_errors(spark, sf_dir):
    return _legacy(spark, sf_dir).errors.select("source_row", "record_id", "severity", "error_codes", "error_messages")


def record_map_center(spark, sf_dir):
    c = map_centre(_validated(spark, sf_dir).valid)
    return c.select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


def queries() -> dict:
    fs = (validated_reports, error_code_counts, validation_summary, missing_column_rejects, duplicate_ids, valid_records, issue_orders, data_overview, issue_type_statistics, region_statistics, region_statistics_unnamed, high_priority_issues, error_details, utm_projection, nearest_road, nearest_road_grid, coordinate_state, line_interpolation, perpendicular_offset, road_segments, issue_schedule, legacy_valid, legacy_errors, record_map_center)
    return {f.__name__: f for f in fs} | stored.queries()


def oracle_sql() -> dict[str, str]:
    raw = reports_sql("strftime(ts, '%Y-%m-%d %H:%M:%S')")
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    num = lambda c: f"try_cast({c} as double)"
    rules = [(blank(f), f"missing_{f}", f"{f} 不能为空") for f in REQUIRED_FIELDS]
    rules.append((f"not {blank('record_id')} and dup > 1", "duplicate_record_id", "record_id 重复"))
    rules.append((f"not {blank('report_time')} and try_cast(report_time as timestamp) is null", "invalid_report_time", "report_time 不是有效日期时间"))
    for f, most in (("longitude", 180), ("latitude", 90)):
        rules.append((f"not {blank(f)} and {num(f)} is null", f"invalid_{f}", f"{f} 必须是数字"))
        rules.append((f"{num(f)} not between -{most} and {most}", f"{f}_out_of_range", f"{f} 超出范围"))
    rules.append((f"not {blank('speed_limit')} and coalesce({num('speed_limit')} < 0, true)", "invalid_speed_limit", "speed_limit 必须是非负数字"))
    joined = lambda sep, i: f"concat_ws('{sep}', " + ", ".join(f"case when {r[0]} then '{r[i]}' end" for r in rules) + ")"
    base = f"with raw as ({raw}), counted as (select *, count(*) over (partition by trim(record_id)) as dup from raw), marked as (select *, {joined(';', 1)} as error_code, {joined('；', 2)} as error_message from counted), valid as (select _ordinal, trim(record_id) as record_id, report_time, cast(longitude as double) as longitude, cast(latitude as double) as latitude, issue_type, source, description, region, road_name, road_class, direction, cast(speed_limit as double) as speed_limit from marked where error_code = '')"
    prio = f"case when issue_type in ({quoted(HIGH)}) then 'high' when issue_type in ({quoted(MEDIUM)}) then 'medium' else 'low' end"
    orders = f", orders as (select *, {prio} as priority, 'open' as status from valid where lower(trim(issue_type)) not in ('', 'normal', 'normal_observation', 'none'))"
    e, n = utm_sql("longitude", "latitude", ZONE)
    ea, na = utm_sql("lon", "lat", ZONE)
    eb, nb = utm_sql("(lon + 0.02)", "(lat + 0.01)", ZONE)
    segs = f", roads as ({ROADS_SQL}), segs as (select k, s_name, {ea} as x1, {na} as y1, {eb} as x2, {nb} as y2 from roads)"
    near = f"""{segs}, pts as (select _ordinal, record_id, issue_type, region, {e} as x, {n} as y from valid),
    pairs as (select p._ordinal, s.k, s.s_name, s.x1 - p.x + t * (s.x2 - s.x1) as ex, s.y1 - p.y + t * (s.y2 - s.y1) as ey from pts p, segs s, lateral (select greatest(0, least(1, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2))) as t)),
    best as (select _ordinal, arg_min(k, (sqrt(ex * ex + ey * ey), k)) as k, arg_min(s_name, (sqrt(ex * ex + ey * ey), k)) as s_name, min(sqrt(ex * ex + ey * ey)) as d from pairs group by _ordinal)"""
    status = f"case when d <= {MATCHED_MAX_M} then 'matched' when d <= {REVIEW_MAX_M} then 'needs_review' else 'unmatched' end"
    nearest = f"{base}{near} select v.record_id, cast(b.k as varchar) as matched_road_id, b.s_name as matched_road_name, round(b.d, 3) as match_distance_m, {status} as match_status from valid v join best b using (_ordinal)"
    region = lambda t: f"coalesce(nullif(trim({t}), ''), '{UNNAMED_REGION}')"
    regions = lambda r, o: f""", rs as (select {region('region')} as region, count(*) as n from {r} group by 1), os as (select {region('region')} as region, count(*) as k, count(*) filter (where priority = 'high') as h from {o} group by 1)
    select coalesce(rs.region, os.region) as "区域", coalesce(n, 0) as "有效记录数", coalesce(k, 0) as "问题数量", coalesce(h, 0) as "高优先级数量" from rs full outer join os on rs.region = os.region"""  # noqa: E731
    counts = "select unnest(string_split(error_code, ';')) as error_code from marked where error_code <> ''"
    lon, lat = "case when _ordinal % 7 = 0 then latitude else longitude end", "case when _ordinal % 7 = 0 then longitude else latitude end"
    ok = lambda a, b: f"({a} between -180 and 180 and {b} between -90 and 90)"
    sev = "case _ordinal % 6 when 0 then ' HIGH ' when 1 then 'urgent' when 2 then '' else 'low' end"
    legacy = [(blank("record_id"), "missing_record_id", "record_id 不能为空"), (f"not {blank('record_id')} and dup > 1", "duplicate_record_id", "record_id 重复")]
    for f, most, label in (("longitude", 180, "经度"), ("latitude", 90, "纬度")):
        legacy += [(f"{num(f)} is null", f"invalid_{f}", f"{label}必须是数字"), (f"{num(f)} not between -{most} and {most}", f"out_of_range_{f}", f"{label}超出范围")]
    legacy += [("severity = 'urgent'", "invalid_severity", "severity 仅支持 low/medium/high/critical"), ("try_cast(report_time as timestamp) is null", "invalid_reported_at", "reported_at 不是有效日期")]
    old = lambda sep, i: f"concat_ws('{sep}', " + ", ".join(f"case when {r[0]} then '{r[i]}' end" for r in legacy) + ")"
    legacy_base = f"with raw as ({raw}), counted as (select *, {sev} as severity, count(*) over (partition by trim(record_id)) as dup from raw), marked as (select *, {old(';', 1)} as error_codes, {old('；', 2)} as error_messages from counted)"
    scale = lambda y: f"(111320.0 * greatest(cos(radians({y})), 0.01))"
    shape = f"with v as (select s_nationkey as key, s_suppkey as k, lon, lat from (select s_nationkey, r.*, r.k as s_suppkey from ({ROADS_SQL}) r join supplier s on s.s_suppkey = r.k)), nx as (select key, row_number() over w - 1 as i, lon as x1, lat as y1, lead(lon) over w as x2, lead(lat) over w as y2 from v window w as (partition by key order by k)), sg as (select *, sqrt(((x2 - x1) * {scale('(y1 + y2) / 2')}) ** 2 + ((y2 - y1) * 111320.0) ** 2) as len from nx where x2 is not null), ac as (select *, sum(len) over (partition by key order by i) as upto, sum(len) over (partition by key) as total, max(i) over (partition by key) as most, (key % 11) / 10.0e0 as ratio from sg), ft as (select *, row_number() over (partition by key order by i) as rn from ac where ratio * total <= upto or i = most)"
    dx, dy = f"(0.02 * {scale('lat')})", "(0.01 * 111320.0)"
    m = "cast(k % 40 - 20 as double)"
    return {
        "validated_reports": f"{base} select _ordinal as event_id, record_id, error_code, error_message from marked",
        "error_code_counts": f"{base} select error_code, count(*) as n from ({counts}) group by 1",
        "validation_summary": f"{base} select count(*) as total_records, count(*) filter (where error_code = '') as valid_records, count(*) filter (where error_code <> '') as rejected_records, round_even(count(*) filter (where error_code = '') / count(*), 4) as valid_rate, (select string_agg(concat(error_code, '=', n), ',' order by error_code) from (select error_code, count(*) as n from ({counts}) group by 1)) as error_counts from marked",
        "missing_column_rejects": f"with raw as ({raw}) select record_id, description, 'missing_required_column' as error_code, '缺少必填字段：report_time, longitude, latitude, issue_type, source, region' as error_message from raw",
        "duplicate_ids": f"{base} select trim(record_id) as record_id, _ordinal as event_id from marked where dup > 1 and trim(record_id) <> ''",
        "valid_records": f"{base} select * exclude (_ordinal) from valid",
        "issue_orders": f"{base}{orders} select record_id, issue_type, priority, region, status from orders",
        "data_overview": f"""{base}{orders} select 'events.csv' as "数据源", timestamp '2026-07-22 09:00:00' as "上传时间", count(*) as "总记录数", count(*) filter (where error_code = '') as "有效记录数", count(*) filter (where error_code <> '') as "错误记录数", round(count(*) filter (where error_code = '') * 100.0e0 / nullif(count(*), 0), 2) as "有效率(%)", (select count(*) from orders) as "问题工单数", (select count(*) from orders where priority = 'high') as "高优先级问题数" from marked""",
        "issue_type_statistics": f"""{base}{orders} select issue_type as "问题类型", count(*) as "问题数量", count(*) filter (where priority = 'high') as "高优先级数量", round(count(*) * 100.0e0 / nullif(sum(count(*)) over (), 0), 2) as "占比(%)" from orders group by issue_type""",
        "region_statistics": f"{base}{orders}{regions('valid', 'orders')}",
        "region_statistics_unnamed": f"with raw as ({raw}), part as (select *, {prio} as priority from raw where lower(trim(issue_type)) not in ('', 'normal', 'normal_observation', 'none')){regions('raw', 'part')}",
        "high_priority_issues": f"""{base}{orders}{near} select o.record_id as "记录编号", o.issue_type as "问题类型", o.priority as "优先级", o.region as "区域", cast(b.k as varchar) as "匹配道路编号", b.s_name as "匹配道路名称", round(b.d, 3) as "匹配距离(米)", o.status as "工单状态" from orders o join best b using (_ordinal) where o.priority = 'high'""",
        "error_details": f"""{base} select coalesce(nullif(trim(record_id), ''), record_id) as record_id, report_time, longitude, latitude, issue_type, source, description, region, road_name, road_class, direction, speed_limit, error_code as "错误代码", error_message as "错误说明" from marked where error_code <> ''""",
        "utm_projection": f"{base} select record_id, round({e}, 3) as easting, round({n}, 3) as northing from valid",
        "nearest_road": nearest,
        "nearest_road_grid": nearest,
        "coordinate_state": f"with raw as ({raw}), sw as (select _ordinal, try_cast({lon} as double) as lon, try_cast({lat} as double) as lat from raw), f as (select *, coalesce(not {ok('lon', 'lat')} and {ok('lat', 'lon')}, false) as swap from sw) select _ordinal as event_id, case when swap then lat else lon end as longitude, case when swap then lon else lat end as latitude, case when lon is null or lat is null or not ({ok('lon', 'lat')} or swap) then 'invalid_coordinate' when _ordinal % 11 = 0 then 'empty_geometry' else 'pending' end as coordinate_state, swap as coordinate_swapped from f",
        "line_interpolation": f"{shape} select key, round(x1 + (x2 - x1) * (ratio * total - (upto - len)) / len, 7) as lon, round(y1 + (y2 - y1) * (ratio * total - (upto - len)) / len, 7) as lat, i as segment_index from ft where rn = 1",
        "perpendicular_offset": f"select cast(k as varchar) as road_id, round(lon - {dy} / sqrt({dx} ** 2 + {dy} ** 2) * {m} / {scale('lat')}, 7) as lon, round(lat + {dx} / sqrt({dx} ** 2 + {dy} ** 2) * {m} / 111320.0, 7) as lat from ({ROADS_SQL})",
        "road_segments": f"with z as (select 1){segs} select cast(k as varchar) as road_id, round(x1, 3) as x1, round(y1, 3) as y1, round(x2, 3) as x2, round(y2, 3) as y2 from segs",
        "issue_schedule": "select * from (values ('point_offset', 28::bigint), " + ", ".join(f"('{k}', {23 if i < 2 else 22}::bigint)" for i, k in enumerate(ATTRIBUTE_ISSUES)) + ", (null, 60::bigint)) t(issue_type, n)",
        "legacy_valid": f"{legacy_base} select _ordinal + 2 as source_row, trim(record_id) as record_id, cast(longitude as double) as longitude, cast(latitude as double) as latitude, case when trim(severity) = '' then severity else lower(trim(severity)) end as severity, replace(report_time, ' ', 'T') as reported_at from marked where error_codes = ''",
        "legacy_errors": f"{legacy_base} select _ordinal + 2 as source_row, case when trim(record_id) = '' or dup > 1 then record_id else trim(record_id) end as record_id, case when severity = ' HIGH ' then 'high' else severity end as severity, error_codes, error_messages from marked where error_codes <> ''",
        "record_map_center": f"{base} select round(coalesce(avg(latitude), 39.9042), 6) as latitude, round(coalesce(avg(longitude), 116.4074), 6) as longitude from valid",
    } | stored.oracle_sql(raw, base, orders, near, status)
