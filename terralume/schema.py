"""Fields, vocabularies and table schemas."""

from __future__ import annotations

# Fields of a report, in their order; the first eight are required.
STANDARD_FIELDS = ("record_id", "report_time", "longitude", "latitude", "issue_type", "source", "description", "region", "road_name", "road_class", "direction", "speed_limit")
REQUIRED_FIELDS = STANDARD_FIELDS[:8]
TEXT_FIELDS = ("issue_type", "source", "description", "region", "road_name", "road_class", "direction")

# Messages of error codes.
BLANK_MESSAGE = "{} 不能为空"
DUPLICATE_MESSAGE = "record_id 重复"
TIME_MESSAGE = "report_time 不是有效日期时间"
NUMBER_MESSAGE = "{} 必须是数字"
RANGE_MESSAGE = "{} 超出范围"
SPEED_MESSAGE = "speed_limit 必须是非负数字"
MISSING_COLUMN_MESSAGE = "缺少必填字段：{}"

# Issue types of work orders and their priorities.
HIGH = ("point_offset", "suspected_dead_end")
MEDIUM = ("speed_limit_anomaly", "direction_anomaly", "road_class_anomaly", "road_name_missing")
NO_ISSUE = ("", "normal", "normal_observation", "none")
UNNAMED_REGION = "未填写"

# Thresholds in metres.
MATCHED_MAX_M, REVIEW_MAX_M = 30.0, 100.0

MATCH_FIELDS = "matched_road_id string, matched_road_name string, match_distance_m double, match_status string"
TABLES = {
    "upload_batches": "batch_id string, source_name string, uploaded_at timestamp_ntz, total_records long, valid_records long, rejected_records long",
    "records": "record_key string, batch_id string, record_id string, report_time timestamp_ntz, longitude double, latitude double, issue_type string, source string, description string, region string, road_name string, road_class string, direction string, speed_limit double, " + MATCH_FIELDS + ", created_at timestamp_ntz",
    "validation_results": "validation_id string, batch_id string, record_id string, is_valid boolean, error_code string, error_message string, raw_record_json string, created_at timestamp_ntz",
    "issue_orders": "issue_order_id string, batch_id string, record_key string, record_id string, issue_type string, priority string, region string, status string, matched_road_id string, matched_road_name string, match_distance_m double, created_at timestamp_ntz",
}
KEYS = {"upload_batches": "batch_id", "records": "record_key", "validation_results": "validation_id", "issue_orders": "issue_order_id"}
