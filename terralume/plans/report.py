"""The five reports of a batch, as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralume.schema import UNNAMED_REGION

NAMES = ("data_overview", "issue_type_statistics", "region_statistics", "high_priority_issues", "error_details")


def data_overview(batches: DataFrame, orders: DataFrame, batch_id: str) -> DataFrame:
    of = orders.filter(F.col("batch_id") == batch_id).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") == "high").alias("h"))
    rate = F.round(F.col("valid_records") * F.lit(100.0) / F.nullif("total_records", F.lit(0)), 2)
    return batches.filter(F.col("batch_id") == batch_id).join(of, "batch_id", "left").select(F.col("source_name").alias("数据源"), F.col("uploaded_at").alias("上传时间"), F.col("total_records").alias("总记录数"), F.col("valid_records").alias("有效记录数"), F.col("rejected_records").alias("错误记录数"), rate.alias("有效率(%)"), F.coalesce("n", F.lit(0)).alias("问题工单数"), F.coalesce("h", F.lit(0)).alias("高优先级问题数"))


def issue_type_statistics(orders: DataFrame, batch_id: str) -> DataFrame:
    x = orders.filter(F.col("batch_id") == batch_id).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") == "high").alias("h"))
    share = F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 2)
    return x.select(F.col("issue_type").alias("问题类型"), F.col("n").alias("问题数量"), F.col("h").alias("高优先级数量"), share.alias("占比(%)")).orderBy(F.desc("问题数量"), F.asc_nulls_last("问题类型"))


def _region():
    return F.coalesce(F.nullif(F.regexp_replace("region", r"^\p{Zs}+|\p{Zs}+$", ""), F.lit("")), F.lit(UNNAMED_REGION)).alias("region")


def region_statistics(records: DataFrame, orders: DataFrame, batch_id: str) -> DataFrame:
    r = records.filter(F.col("batch_id") == batch_id).groupBy(_region()).agg(F.count(F.lit(1)).alias("n"))
    i = orders.filter(F.col("batch_id") == batch_id).groupBy(_region()).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("priority") == "high").alias("h"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = r.join(i, "region", "full_outer").select(F.col("region").alias("区域"), zero("n").alias("有效记录数"), zero("k").alias("问题数量"), zero("h").alias("高优先级数量"))
    return out.orderBy(F.desc("问题数量"), F.desc("有效记录数"), F.asc_nulls_last("区域"))


def high_priority_issues(orders: DataFrame, batch_id: str) -> DataFrame:
    x = orders.filter((F.col("batch_id") == batch_id) & (F.col("priority") == "high")).orderBy(F.desc_nulls_last("match_distance_m"), F.asc_nulls_last("record_id"))
    return x.select(F.col("record_id").alias("记录编号"), F.col("issue_type").alias("问题类型"), F.col("priority").alias("优先级"), F.col("region").alias("区域"), F.col("matched_road_id").alias("匹配道路编号"), F.col("matched_road_name").alias("匹配道路名称"), F.col("match_distance_m").alias("匹配距离(米)"), F.col("status").alias("工单状态"))


def error_details(results: DataFrame, batch_id: str) -> DataFrame:
    fields = ("record_id", "report_time", "longitude", "latitude", "issue_type", "source", "description", "region", "road_name", "road_class", "direction", "speed_limit")
    x = results.filter((F.col("batch_id") == batch_id) & ~F.col("is_valid"))
    x = x.withColumn("_r", F.from_json("raw_record_json", ", ".join(f"{f} string" for f in fields)))
    x = x.orderBy(F.asc_nulls_last("created_at"), F.asc_nulls_last("validation_id"))
    return x.select(F.coalesce("record_id", "_r.record_id").alias("record_id"), *(F.col(f"_r.{f}").alias(f) for f in fields[1:]), F.col("error_code").alias("错误代码"), F.col("error_message").alias("错误说明"), F.col("raw_record_json").alias("原始记录(JSON)"))


def daily_report(tables: dict[str, DataFrame], batch_id: str) -> dict[str, DataFrame]:
    b, r, v, o = (tables[t] for t in ("upload_batches", "records", "validation_results", "issue_orders"))
    return {"data_overview": data_overview(b, o, batch_id), "issue_type_statistics": issue_type_statistics(o, batch_id), "region_statistics": region_statistics(r, o, batch_id), "high_priority_issues": high_priority_issues(o, batch_id), "error_details": error_details(v, batch_id)}
