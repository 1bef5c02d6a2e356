"""Work orders from stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.functions.text import strip
from terralume.schema import HIGH, MEDIUM, NO_ISSUE


def priority(issue_type: Column) -> Column:
    """Of an issue type as it is spelt; unknown ones are low."""
    return F.when(issue_type.isin(*HIGH), "high").when(issue_type.isin(*MEDIUM), "medium").otherwise("low")


def has_issue(issue_type: Column) -> Column:
    return ~F.lower(strip(F.coalesce(issue_type, F.lit("")))).isin(*NO_ISSUE)


def key(batch_id: Column, kind: str, ordinal: Column) -> Column:
    """A key that is the same however often the plan is evaluated."""
    return F.sha2(F.concat_ws("|", batch_id, F.lit(kind), ordinal.cast("string")), 256)


def issue_orders(records: DataFrame) -> DataFrame:
    """Records (with record_key, batch_id, _ordinal and match fields) that report an issue, as open orders."""
    issue = strip(F.col("issue_type"))
    return records.filter(has_issue(F.col("issue_type"))).select(
        key(F.col("batch_id"), "order", F.col("_ordinal")).alias("issue_order_id"), "batch_id", "record_key", "record_id", issue.alias("issue_type"), priority(issue).alias("priority"), "region", F.lit("open").alias("status"), "matched_road_id", "matched_road_name", "match_distance_m", "created_at"
    )
