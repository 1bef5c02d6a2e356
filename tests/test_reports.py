"""Validation, orders, storage and reports."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terralume import sinks, store
from terralume.functions.text import number, timestamp
from terralume.operators.legacy import validate_legacy
from terralume.operators.validate import check_conserved, validate
from terralume.plans.report import daily_report
from terralume.schema import REQUIRED_FIELDS, STANDARD_FIELDS

GOOD = dict(zip(STANDARD_FIELDS, ("R001", "2026-07-22 09:00:00", "116.481", "39.991", "missing_road", "app", "疑似缺路", "望京", "测试路", "secondary", "both", "40")))


def frame(spark, rows, extra=()):
    cols = [*STANDARD_FIELDS, *extra]
    return spark.createDataFrame([(*(r.get(c) for c in cols), i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in cols) + ", _ordinal long")


def test_rules(spark):
    rows = [GOOD | {"record_id": " R0 "}]
    want = [None]
    for f in REQUIRED_FIELDS:
        rows.append(GOOD | {"record_id": f"M{f}", f: " 　\t"})
        want.append(f"missing_{f}")
    for f, v, code in (("report_time", "not-a-date", "invalid_report_time"), ("longitude", "east", "invalid_longitude"), ("longitude", "181", "longitude_out_of_range"), ("latitude", "north", "invalid_latitude"), ("latitude", "-91", "latitude_out_of_range"), ("speed_limit", "fast", "invalid_speed_limit"), ("speed_limit", "-1", "invalid_speed_limit")):
        rows.append(GOOD | {"record_id": f"B{f}{v}", f: v})
        want.append(code)
    rows += [GOOD | {"record_id": "DUP"}, GOOD | {"record_id": " DUP "}, GOOD | {"record_id": "X", "longitude": "bad", "latitude": "100", "extra": "kept"}]
    want += ["duplicate_record_id"] * 2 + ["invalid_longitude;latitude_out_of_range"]
    v = validate(frame(spark, rows, ["extra"]))
    check_conserved(v)
    got = {r["_ordinal"]: r for r in v.rejected.collect()}
    assert {i: r["error_code"] for i, r in got.items()} == {i: w for i, w in enumerate(want) if w}
    last = got[len(rows) - 1]
    assert (last["extra"], last["longitude"], last["error_message"]) == ("kept", "bad", "longitude 必须是数字；latitude 超出范围")
    (ok,) = v.valid.collect()
    assert (ok.record_id, ok.longitude, ok.speed_limit, ok.report_time) == ("R0", 116.481, 40.0, dt.datetime(2026, 7, 22, 9))
    s = v.summary.first()
    assert (s.total_records, s.valid_records, s.rejected_records, s.error_counts["invalid_speed_limit"]) == (len(rows), 1, len(rows) - 1, 2)


def test_missing_columns_and_no_rows(spark):
    v = validate(spark.createDataFrame([("a", "b")], "record_id string, extra_field string"))
    (r,) = v.rejected.collect()
    assert (r.record_id, r.extra_field, r.error_code) == ("a", "b", "missing_required_column") and r.error_message.startswith("缺少必填字段：report_time, longitude")
    assert v.valid.count() == 0
    s = validate(frame(spark, [])).summary.first()
    assert (s.total_records, s.valid_rate, s.error_counts) == (0, 0.0, {})
    with pytest.raises(TypeError):
        validate([1])


def test_numbers_and_times(spark):
    texts = {" 1 ": 1.0, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "1d": None, "nan": None, "1,000": None, "0x10": None, "1e400": None, "inf": float("inf"), "１": None}
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert {r.c: r.n for r in df.select("c", number(df.c).alias("n")).collect()} == texts
    day = dt.datetime(2026, 7, 22)
    times = {"07/22/2026": day, "22/07/2026": day, "2026/07/22": day, "20260722": day, "Jul 22 2026": day, "2026-07-22T09:00:00+08:00": dt.datetime(2026, 7, 22, 1), "now": None, "09:00": None, "1500-01-01": None, "9999-12-31": None, "x": None}
    df = spark.createDataFrame([(t,) for t in times], "c string")
    assert {r.c: r.t for r in df.select("c", timestamp(df.c).alias("t")).collect()} == times


def test_legacy(spark):
    rows = [(" A1 ", "116.4", "39.9", "HIGH", "2026-07-22 09:00"), ("B", "x", "91", "odd", "bad"), ("D", "1", "2", None, None), ("D", "1", "2", "", None)]
    v = validate_legacy(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ID string, lng string, Y string, severity string, `reported at` string, _ordinal long"))
    (ok,) = v.valid.collect()
    assert (ok.source_row, ok.record_id, ok.longitude, ok.severity, ok.reported_at) == (2, "A1", 116.4, "high", "2026-07-22T09:00:00")
    e = {r.source_row: r for r in v.errors.collect()}
    assert e[3].error_codes == "invalid_longitude;out_of_range_latitude;invalid_severity;invalid_reported_at"
    assert {k for k, r in e.items() if r.error_codes == "duplicate_record_id"} == {4, 5}
    assert validate_legacy(spark.createDataFrame([("1",)], "record_id string")).missing_columns == ("longitude", "latitude")
    with pytest.raises(ValueError, match="longitude"):
        validate_legacy(spark.createDataFrame([("1", "2", "3")], "lon string, longitude string, id string"))


def test_store_and_report(spark, tmp_path):
    root = str(tmp_path / "w")
    store.initialize(spark, root)
    store.initialize(spark, root)
    rows = [GOOD | {"record_id": "V1", "issue_type": "point_offset", "region": "朝阳区", "report_time": "2026-07-22T09:00:00+08:00"}, GOOD | {"record_id": "V2", "issue_type": "Normal_Observation", "region": "海淀区"}, GOOD | {"record_id": "V3", "issue_type": "missing_road_name"}, GOOD | {"record_id": "E", "longitude": "bad", "extra": "原始"}]
    v = validate(frame(spark, rows, ["extra"]))
    batch = store.persist_batch(spark, root, "/up/a.csv", v, now=dt.datetime(2026, 7, 22, 10))
    t = store.tables(spark, root)
    assert {n: df.count() for n, df in t.items()} == {"upload_batches": 1, "records": 3, "validation_results": 4, "issue_orders": 2}
    assert {r.record_id: r.priority for r in t["issue_orders"].collect()} == {"V1": "high", "V3": "low"}
    assert t["issue_orders"].join(t["records"], "record_key").count() == 2
    raw = json.loads(t["validation_results"].filter("not is_valid").first().raw_record_json)
    assert raw["extra"] == "原始" and raw["longitude"] == "bad"
    report = daily_report(t, batch)
    o = report["data_overview"].first()
    assert (o["数据源"], o["总记录数"], o["有效率(%)"], o["问题工单数"], o["高优先级问题数"]) == ("a.csv", 4, 75.0, 2, 1)
    assert report["error_details"].first()["longitude"] == "bad"
    assert sum(r["占比(%)"] for r in report["issue_type_statistics"].collect()) == 100
    book = sinks.daily_workbook(report)
    from terralume.sources.files import read_xlsx

    first = read_xlsx(spark, book).first()
    assert first["总记录数"] == 4.0
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert len([n for n in z.namelist() if "worksheets" in n]) == 5
    with pytest.raises(ValueError):
        sinks.daily_workbook({})
    bad = v._replace(rejected=v.rejected.withColumn("error_code", v.rejected["error_code"].cast("int")))
    with pytest.raises(store.StorageError):
        store.persist_batch(spark, root, "b.csv", bad, batch_id="lost")
    assert store.tables(spark, root)["records"].filter("batch_id = 'lost'").count() == 0
    with pytest.raises(ValueError):
        store.persist_batch(spark, root, "c.csv", v, matched=v.valid.limit(1))


def test_sinks(spark):
    df = spark.createDataFrame([("<a>", 116.4, 39.8, "high"), ("b", 116.5, 39.9, None)], "record_id string, longitude double, latitude double, severity string")
    assert sinks.csv_bytes(df).startswith(b"\xef\xbb\xbfrecord_id")
    page = sinks.map_html(df)
    assert "&lt;a&gt;" in page and '"orange"' in page and '"cadetblue"' in page
    c = sinks.map_centre(df).first()
    assert (round(c.latitude, 6), round(c.longitude, 6)) == (39.85, 116.45)
    assert tuple(sinks.map_centre(df.limit(0)).first()) == sinks.CENTRE
    assert sinks.report_name(dt.date(2026, 7, 22)) == "road_quality_daily_20260722.xlsx"
    assert zipfile.is_zipfile(io.BytesIO(sinks.legacy_workbook(df, df.limit(0), "a.csv", dt.datetime(2026, 1, 1))))


def _book(cells, styles):
    """A workbook whose first sheet has these rows of raw cells."""
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in cells) + "</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx_dates_and_whole_numbers(spark):
    from terralume.sources.files import read_xlsx

    text = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    num = lambda v, s=0: f'<c s="{s}"><v>{v}</v></c>'
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    rows = [[text(c) for c in ("record_id", "mixed", "report_time", "other", "x")]]
    rows += [[num(1234567), num(1234567), num(46225.375, 2), num(46225, 1), num(1.5, 3)], [num(1234568), text("a"), num("46225.5", 2), text("b"), num(2, 3)]]
    got = read_xlsx(spark, _book(rows, styles))
    assert dict(got.dtypes) | {"_ordinal": ""} == {"record_id": "bigint", "mixed": "string", "report_time": "timestamp_ntz", "other": "string", "x": "double", "_ordinal": ""}
    a, b = got.orderBy("record_id").collect()
    assert (a.record_id, a.mixed, a.report_time, a.other, a.x) == (1234567, "1234567", dt.datetime(2026, 7, 22, 9), "2026-07-22 00:00:00", 1.5) and b.x == 2.0


def test_times_are_utc_whatever_the_session_zone(spark):
    from terralume.functions.text import iso, timestamp

    texts = ["2026-07-22T09:00:00+08:00", "2026-07-22 09:00:00", "2026-07-22T09:00:00Z", "2026/7/22 9:05", "2026-07-22T09:00:00.250-0530", "2026-07-22", "no"]
    want = ["2026-07-22 01:00:00", "2026-07-22 09:00:00", "2026-07-22 09:00:00", "2026-07-22 09:05:00", "2026-07-22 14:30:00.250000", "2026-07-22 00:00:00", "None"]
    shown = ["2026-07-22T09:00:00+08:00", "2026-07-22T09:00:00", "2026-07-22T09:00:00+00:00", "2026-07-22T09:05:00", "2026-07-22T09:00:00.250000-05:30", "2026-07-22T00:00:00", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    try:
        for zone in ("Asia/Shanghai", "UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select("i", timestamp(F.col("t")).alias("u"), iso(F.col("t")).alias("s")).orderBy("i").collect()
            assert [str(r.u) for r in got] == want and [r.s for r in got] == shown, zone
            typed = spark.sql("select timestamp '2026-07-22 09:00:00+08:00' as t").select(timestamp(F.col("t"), "timestamp").alias("u"))
            assert str(typed.first().u) == "2026-07-22 01:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_without_ordinals_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(f"r{i}", "116.4", "39.9") for i in range(40)], "ID string, Lon string, `Lat` string").repartition(5)
    assert sorted(r.source_row for r in validate_legacy(df).valid.collect()) == list(range(2, 42))


def test_a_summary_that_does_not_add_up_is_refused(spark, tmp_path):
    store.initialize(spark, str(tmp_path))
    r = validate(spark.createDataFrame([("a", 1)], "record_id string, x int"))
    wrong = r._replace(summary=r.summary.withColumn("total_records", F.lit(7).cast("long")))
    with pytest.raises(store.StorageError):
        store.persist_batch(spark, str(tmp_path), "a.csv", wrong)
