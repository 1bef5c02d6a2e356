"""Named SQL statements in one file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terralume.plans.report import NAMES


def named_queries(text: str, names: tuple[str, ...] = NAMES) -> dict[str, str]:
    """Statements after lines '-- name: x'; empty ones don't count and all names are needed."""
    parts = re.split(r"(?m)^\s*--\s*name:\s*(\w+)\s*$", text)
    found = {n: body.strip().rstrip(";").strip() for n, body in zip(parts[1::2], parts[2::2])}
    found = {n: body for n, body in found.items() if body}
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"missing queries: {', '.join(missing)}")
    return {n: found[n] for n in names}


def run_named(spark: SparkSession, sql: str, batch_id: str) -> DataFrame:
    """A statement with the batch bound to each of its question marks."""
    return spark.sql(sql, args=[batch_id] * sql.count("?"))
