"""The four tables of a warehouse folder, written as all-or-nothing batches.

A batch's rows go to its own partitions first; its row in upload_batches is written last and makes the
batch visible, since readers take committed batches only. A failure removes the batch's partitions.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralume.functions.text import json_row
from terralume.operators.orders import issue_orders, key
from terralume.operators.validate import ORDINAL, Validation
from terralume.schema import KEYS, STANDARD_FIELDS, TABLES


class StorageError(RuntimeError):
    pass


def initialize(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet."""
    for name, schema in TABLES.items():
        try:
            spark.createDataFrame([], schema).write.partitionBy("batch_id").mode("ignore").parquet(f"{root}/{name}")
        except Exception as e:
            raise StorageError(f"{name} can't be created: {e}") from e


def content_key(filename: str, content: bytes) -> str:
    """A batch id that is the same for the same upload."""
    return hashlib.sha256(filename.encode() + b"\0" + content).hexdigest()


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Rows of committed batches."""
    read = {n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in TABLES.items()}
    done = read["upload_batches"].select("batch_id")
    return {n: df if n == "upload_batches" else df.join(done, "batch_id", "left_semi") for n, df in read.items()}


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def persist_batch(spark: SparkSession, root: str, source_name: str, result: Validation, matched: DataFrame | None = None, batch_id: str | None = None, now: dt.datetime | None = None) -> str:
    """Store a validated upload; matched: the valid rows (with _ordinal) and their match fields, or None if matching failed."""
    if not isinstance(result, Validation):
        raise TypeError("a Validation is needed")
    batch_id = batch_id or uuid.uuid4().hex
    now = (now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None)
    counts = result.summary.first()
    valid = result.valid if matched is None else matched
    n = valid.count()
    if n != counts["valid_records"]:
        raise ValueError(f"{n} matched rows for {counts['valid_records']} valid ones")
    if counts["total_records"] != n + result.rejected.count():
        raise StorageError(f"the summary's {counts['total_records']} records aren't the valid and the rejected ones")
    at, b = F.lit(now).cast("timestamp_ntz"), F.lit(batch_id)
    fields = ("matched_road_id", "matched_road_name", "match_distance_m", "match_status")
    records = valid.withColumns({f: F.lit(None).cast("double" if f == "match_distance_m" else "string") for f in fields if f not in valid.columns})
    records = records.withColumns({"record_key": key(b, "record", F.col(ORDINAL)), "batch_id": b, "created_at": at})
    own = [c for c in result.rejected.columns if c not in ("error_code", "error_message", ORDINAL)]
    raw_id = F.col("record_id").cast("string") if "record_id" in own else F.lit(None).cast("string")
    clean = lambda df, c: F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(f"`{c}`")
    results = result.valid.select(key(b, "valid", F.col(ORDINAL)).alias("validation_id"), b.alias("batch_id"), "record_id", F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), json_row([clean(result.valid, c) for c in STANDARD_FIELDS]).alias("raw_record_json"), at.alias("created_at")).unionByName(
        result.rejected.select(key(b, "rejected", F.col(ORDINAL)).alias("validation_id"), b.alias("batch_id"), raw_id.alias("record_id"), F.lit(False).alias("is_valid"), "error_code", "error_message", json_row([clean(result.rejected, c) for c in own]).alias("raw_record_json"), at.alias("created_at"))
    )
    made = {"records": records, "validation_results": results, "issue_orders": issue_orders(records)}
    batch = spark.createDataFrame([(batch_id, PurePath(source_name).name, now, counts["total_records"], counts["valid_records"], counts["rejected_records"])], TABLES["upload_batches"])
    try:
        for name, df in (*made.items(), ("upload_batches", batch)):
            names = [c.split()[0] for c in TABLES[name].split(", ")]
            if df.filter(F.col(KEYS[name]).isNull()).limit(1).count():
                raise StorageError(f"{name} has rows without {KEYS[name]}")
            df.select(*names).write.partitionBy("batch_id").mode("append").parquet(f"{root}/{name}")
    except Exception as e:
        for name in TABLES:
            _remove(spark, f"{root}/{name}/batch_id={batch_id}")
        raise StorageError(f"batch {batch_id} wasn't stored: {e}") from e
    return batch_id
