"""Roads, matching, simulation and file sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terralume.operators.geo import RoadMatchingError, Rules, coordinate_states, match_records, road_table, road_zone, utm_sql
from terralume.operators.simulate import ReferenceRoadError, main, simulate
from terralume.sources.files import IngestError, ingest_bytes, ingest_path, load_rules, matching_roads, read_legacy_csv, simulation_roads
from terralume.sources.queries_file import named_queries, run_named
from terralume.plans.report import NAMES


def collection(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}), encoding="utf-8-sig")
    return str(path)


@pytest.fixture
def one_road(spark, tmp_path):
    p = collection(tmp_path / "r.geojson", [({"segment_id": None}, None), ({"segment_id": "S1", "road_name": "路"}, {"type": "LineString", "coordinates": [[116.40, 39.90], [116.41, 39.90]]})])
    return road_table(matching_roads(spark, p))


def test_matching(spark, one_road):
    pts = [(116.405, 39.90), (116.405, 39.9005), (116.405, 39.902), (39.90, 116.405), (None, 39.9), (200.0, 39.9), (200.0, 100.0)]
    df = spark.createDataFrame([(i, *p, i == 1 and False) for i, p in enumerate(pts)], "_ordinal long, longitude double, latitude double, geometry_is_empty boolean")
    assert road_zone(one_road) == (50, False)
    for grid in (False, True):
        got = {r._ordinal: r for r in match_records(df, one_road, grid=grid).collect()}
        assert [got[i].match_status for i in range(7)] == ["matched", "needs_review", "unmatched", "matched", *["invalid_coordinate"] * 3]
        assert got[0].match_distance_m < 0.02 and 54 < got[1].match_distance_m < 57 and got[2].match_distance_m > 100
        assert got[2].matched_road_id == "S1" and got[3].coordinate_swapped and got[3].longitude == 116.405 and not got[6].coordinate_swapped
    empty = df.filter("_ordinal = 0").withColumn("geometry_is_empty", F.lit(True))
    assert coordinate_states(empty).first().coordinate_state == "empty_geometry"
    with pytest.raises(RoadMatchingError):
        coordinate_states(df.drop("latitude"))


def test_null_id_ties_and_grid(spark):
    r = random.Random(3)
    roads = [(i, None if i == 5 else str(i), f"n{i}", [[[116.4 + r.random() / 50, 39.9 + r.random() / 50] for _ in range(3)]]) for i in range(30)]
    roads += [(30, "30", "twin", roads[2][3])]
    roads = spark.createDataFrame(roads, "road_ord long, road_id string, road_name string, parts array<array<array<double>>>")
    pts = spark.createDataFrame([(i, 116.3 + r.random() / 4, 39.8 + r.random() / 4) for i in range(80)], "_ordinal long, longitude double, latitude double")
    a, b = (sorted(map(tuple, match_records(pts, roads, grid=g).select("_ordinal", "matched_road_id", "match_distance_m", "match_status").collect())) for g in (False, True))
    assert a == b and len(a) == 80 and "30" not in {x[1] for x in a}
    for x in a:
        assert (x[1] is None) == (x[2] is None) and (x[1] is not None or x[3] == "unmatched")


def test_utm(spark):
    e, n = utm_sql("-79.387139e0", "43.642567e0", 17)
    r = spark.range(1).select(F.expr(e).alias("e"), F.expr(n).alias("n")).first()
    assert abs(r.e - 630084.31) < 0.5 and abs(r.n - 4833438.55) < 0.5


def test_rules(tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("road_matching:\n  matched_max_distance_m: 30.0\n  review_max_distance_m: 100.0\n")
    assert load_rules(str(p)) == Rules()
    p.write_text("road_matching:\n  matched_max_distance_m: 100\n  review_max_distance_m: 30\n")
    with pytest.raises(RoadMatchingError):
        load_rules(str(p))


def test_simulation(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[116.40, 39.90], [116.41, 39.90], [116.41, 39.91]]}
    p = collection(tmp_path / "s.geojson", [({"segment_id": "A", "road_class": "Primary", "speed_limit": 60}, line), ({}, {"type": "LineString", "coordinates": [[116.42, 39.9], [116.43, 39.92]]}), ({}, {"type": "Point", "coordinates": [500000, 1]})])
    roads = simulation_roads(spark, p)
    x = simulate(roads, 60, 7, 0.8).orderBy("record_id")
    rows = x.collect()
    assert rows == simulate(roads, 60, 7, 0.8).orderBy("record_id").collect() and len(rows) == 60
    assert sum(r.expected_is_issue for r in rows) == 48 and sum(r.expected_issue_type == "point_offset" for r in rows) == 10
    for r in rows:
        assert r.original_road_id in ("A", "road_000001")
        if r.expected_issue_type == "point_offset":
            assert 15 <= abs(r.offset_m) <= 40
        else:
            assert (r.longitude, r.latitude) == (r.base_longitude, r.base_latitude)
        if r.expected_issue_type == "suspected_dead_end":
            assert (r.longitude, r.latitude) in {(116.40, 39.90), (116.41, 39.91), (116.42, 39.9), (116.43, 39.92)}
    pts = x.select("longitude", "latitude", "expected_issue_type", "offset_m", F.monotonically_increasing_id().alias("_ordinal"))
    flat = roads.select("road_ord", F.lit("x").alias("road_id"), F.lit("y").alias("road_name"), F.array("coordinates").alias("parts"))
    for r in match_records(pts, flat).collect():
        assert r.match_distance_m <= abs(r.offset_m) + 0.2
    for bad in ({"issue_rate": 2}, {"offset_min_m": -1}, {"count": 0}):
        with pytest.raises(ValueError):
            simulate(roads, **bad)
    with pytest.raises(ReferenceRoadError):
        simulation_roads(spark, collection(tmp_path / "b.geojson", [({}, {"type": "LineString", "coordinates": [[500000, 4400000], [1, 1]]})]))
    main(["--roads", p, "--csv", str(tmp_path / "o.csv"), "--geojson", str(tmp_path / "o.geojson"), "--count", "5"])
    assert len(json.loads((tmp_path / "o.geojson").read_text())["features"]) == 5 and (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_uploads(spark, tmp_path):
    text = "record_id,a,a\n001,x,\n\n\"q\"\"q\",y,z\n"
    rows = ingest_bytes(spark, text.encode("utf-8-sig"), "U.CSV").orderBy("_ordinal").collect()
    assert [tuple(r) for r in rows] == [("001", "x", "", 0), ("", "", "", 1), ('q"q', "y", "z", 2)] and rows[0].__fields__[:3] == ["record_id", "a", "a.1"]
    for content, name, why in ((b"", "a.csv", "空"), (b"x", "a.xls", "不支持"), (b"x", "a", "不支持"), ("编号\n".encode("gb18030"), "a.csv", "UTF-8"), (b"not a zip", "a.xlsx", "损坏"), (b"a\n1,2\n", "a.csv", "格式")):
        with pytest.raises(IngestError, match=why):
            ingest_bytes(spark, content, name)
    with pytest.raises(IngestError):
        ingest_path(spark, str(tmp_path))
    old = read_legacy_csv(spark, "编号,x\n甲,NA\n\n".encode("gb18030")).collect()
    assert [tuple(r)[:2] for r in old] == [("甲", None)]


def test_named_queries(spark):
    text = "".join(f"-- name: {n}\nselect ? as b, ? as c;\n" for n in NAMES)
    q = named_queries(text)
    assert tuple(run_named(spark, q[NAMES[0]], "x").first()) == ("x", "x")
    with pytest.raises(ValueError):
        named_queries(text.replace("select ? as b, ? as c;", "", 1))
