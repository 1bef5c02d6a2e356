"""Lossless validation of reports: one annotated table, split by filters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralume.functions.text import blank, number, strip, timestamp
from terralume.schema import BLANK_MESSAGE, DUPLICATE_MESSAGE, MISSING_COLUMN_MESSAGE, NUMBER_MESSAGE, RANGE_MESSAGE, REQUIRED_FIELDS, SPEED_MESSAGE, STANDARD_FIELDS, TEXT_FIELDS, TIME_MESSAGE

ORDINAL = "_ordinal"


class Validation(NamedTuple):
    annotated: DataFrame
    valid: DataFrame
    rejected: DataFrame
    summary: DataFrame


def with_ordinal(df: DataFrame) -> DataFrame:
    """Row numbers from 0, without gaps, where the reader gave none (in the order of the partitions as read).

    One row for each partition goes over the driver; rows are numbered where they are read.
    """
    if ORDINAL in df.columns:
        return df
    x = df.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    first, begins = 0, []
    for r in sorted(x.groupBy(part.alias("part")).count().collect()):
        begins.append((r["part"], first))
        first += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(begins, "_part long, _begin long"))
    x = x.join(starts, part == F.col("_part")).withColumn(ORDINAL, F.col("_begin") + F.col("_place") - F.shiftleft("_part", 33))
    return x.drop("_place", "_part", "_begin")


def duplicated(key: Column, is_blank: Column, ordinal: Column) -> Column:
    """Whether other rows have the key; blank keys are spread by ordinal, so that they share no window."""
    spread = F.when(is_blank, F.concat(F.lit("\x00"), ordinal.cast("string"))).otherwise(key)
    return F.count(F.lit(1)).over(Window.partitionBy(spread)) > 1


def annotate(df: DataFrame) -> DataFrame:
    """Original columns, _ordinal, one normalised column _v_<field> a field, error_codes and error_messages."""
    x = with_ordinal(df)
    kinds = dict(df.dtypes)
    for f in STANDARD_FIELDS:
        if f not in df.columns:
            x = x.withColumn(f, F.lit(None).cast("string"))
            kinds[f] = "string"
    rules: list[tuple[Column, str, str]] = [(blank(F.col(f)), f"missing_{f}", BLANK_MESSAGE.format(f)) for f in REQUIRED_FIELDS]
    values = {}
    record_id = strip(F.col("record_id").cast("string"))
    no_id = blank(F.col("record_id"))
    x = x.withColumn("_duplicate", duplicated(record_id, no_id, F.col(ORDINAL)) & ~no_id)
    rules.append((F.col("_duplicate"), "duplicate_record_id", DUPLICATE_MESSAGE))
    values["record_id"] = record_id
    values["report_time"] = timestamp(F.col("report_time"), kinds["report_time"])
    rules.append((~blank(F.col("report_time")) & values["report_time"].isNull(), "invalid_report_time", TIME_MESSAGE))
    for f, most in (("longitude", 180.0), ("latitude", 90.0)):
        values[f] = number(F.col(f), kinds[f])
        given = ~blank(F.col(f))
        rules.append((given & values[f].isNull(), f"invalid_{f}", NUMBER_MESSAGE.format(f)))
        rules.append((given & ~values[f].between(-most, most), f"{f}_out_of_range", RANGE_MESSAGE.format(f)))
    values["speed_limit"] = number(F.col("speed_limit"), kinds["speed_limit"])
    rules.append((~blank(F.col("speed_limit")) & (values["speed_limit"].isNull() | (values["speed_limit"] < 0)), "invalid_speed_limit", SPEED_MESSAGE))
    for f in TEXT_FIELDS:
        c = F.col(f).cast("string")
        values[f] = F.when(blank(c), c).otherwise(strip(c))
    fired = [F.coalesce(c, F.lit(False)) for c, _, _ in rules]
    codes = F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, (_, code, _) in zip(fired, rules))))
    messages = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, (_, _, m) in zip(fired, rules))))
    return x.withColumns({f"_v_{f}": values[f] for f in STANDARD_FIELDS} | {"error_codes": codes, "error_messages": messages})


def summarize(annotated: DataFrame, missing: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts, valid_rate (4 digits, 0.0 for no rows), error_counts by code, missing_required_columns."""
    totals = annotated.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.size("error_codes") == 0).alias("valid_records"))
    counts = annotated.select(F.explode("error_codes").alias("code")).groupBy("code").count()
    counts = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "count")))).alias("error_counts"))
    rate = F.when(F.col("total_records") > 0, F.bround(F.col("valid_records") / F.col("total_records"), 4)).otherwise(0.0)
    out = totals.crossJoin(counts)  # one row each
    return out.select("total_records", "valid_records", (F.col("total_records") - F.col("valid_records")).alias("rejected_records"), rate.alias("valid_rate"), "error_counts", F.array(*map(F.lit, missing)).cast("array<string>").alias("missing_required_columns"))


def validate(df: DataFrame) -> Validation:
    """Valid rows (typed standard fields), rejected rows (as they came, with error_code and error_message), summary.

    If a required column is missing, every row is rejected for that alone.
    """
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    own = [c for c in df.columns if c != ORDINAL]
    missing = tuple(f for f in REQUIRED_FIELDS if f not in df.columns)
    if missing:
        x = with_ordinal(df).withColumns({"error_codes": F.array(F.lit("missing_required_column")), "error_messages": F.array(F.lit(MISSING_COLUMN_MESSAGE.format(", ".join(missing))))})
        x = x.withColumns({f"_v_{f}": F.lit(None).cast("double" if f in ("longitude", "latitude", "speed_limit") else "timestamp_ntz" if f == "report_time" else "string") for f in STANDARD_FIELDS})
    else:
        x = annotate(df)
    valid = x.filter(F.size("error_codes") == 0).select(*(F.col(f"_v_{f}").alias(f) for f in STANDARD_FIELDS), ORDINAL)
    rejected = x.filter(F.size("error_codes") > 0).select(*(F.col(f"`{c}`") for c in own), F.concat_ws(";", "error_codes").alias("error_code"), F.concat_ws("；", "error_messages").alias("error_message"), ORDINAL)
    return Validation(x, valid, rejected, summarize(x, missing))


def check_conserved(result: Validation) -> None:
    total, valid, rejected = result.annotated.count(), result.valid.count(), result.rejected.count()
    if valid + rejected != total:
        raise RuntimeError(f"{valid} valid and {rejected} rejected rows aren't {total}")
