import pytest
from pyspark.sql import functions as F

from trailweave.functions import compat, geo, numbers, scoring, tags as T, tiles
from trailweave.operators import corridors, export


def one(spark, tags, column):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    return df.select(column(F.col("tags")).alias("x")).first().x


@pytest.mark.parametrize(
    ("tags", "klass", "surface"),
    [
        ({"highway": "primary_link"}, "primary", "paved"),
        ({"highway": "motorway"}, "unclassified", "unknown"),
        ({}, "unclassified", "unknown"),
        (None, "unclassified", "unknown"),
        ({"highway": "steps"}, "footway", "paved"),
        ({"highway": "track"}, "track", "unpaved"),
        ({"highway": "residential", "surface": "gravel"}, "residential", "unpaved"),
        ({"highway": "path", "surface": "marble"}, "path", "unknown"),
    ],
)
def test_class_and_surface(spark, tags, klass, surface):
    assert one(spark, tags, T.road_class) == klass
    assert one(spark, tags, lambda t: T.surface(t, T.road_class(t))[0]) == surface


@pytest.mark.parametrize(
    ("tags", "flags"),
    [
        ({"cycleway:right": "lane"}, {"has_bicycle_infra"}),
        ({"cycleway:left": "track"}, {"has_bicycle_infra", "is_separated"}),
        ({"cycleway:right": "no"}, set()),
        ({"cycleway": "shared_busway"}, {"has_bicycle_infra"}),
        ({"highway": "living_street"}, {"has_traffic_calming"}),
        ({"traffic_calming": "no"}, set()),
        ({"highway": "path"}, {"has_pedestrian_path", "is_separated"}),
        ({"highway": "path", "bicycle": "designated"}, {"has_bicycle_infra", "is_separated"}),
        ({"shoulder": "left"}, {"has_shoulder"}),
        (None, set()),
    ],
)
def test_infrastructure(spark, tags, flags):
    got = one(spark, tags, lambda t: F.struct(*[v.alias(k) for k, v in T.infrastructure(t).items()]))
    assert {k for k, v in got.asDict().items() if v} == flags and None not in got


@pytest.mark.parametrize(
    ("text", "speed"),
    [("50", 50), ("50 km/h", 50), ("30 mph", 48), ("25 MPH", 40), ("walk", 5), ("none", None), ("fast", None), (None, None)],
)
def test_speed(spark, text, speed):
    assert one(spark, {"maxspeed": text} if text else {}, T.speed_limit) == speed


@pytest.mark.parametrize(("value", "way", "back"), [("yes", True, False), ("-1", True, True), ("reverse", True, True), ("no", False, False)])
def test_one_way(spark, value, way, back):
    assert (one(spark, {"oneway": value}, T.one_way), one(spark, {"oneway": value}, T.reversed_one_way)) == (way, back)
    assert one(spark, {"junction": "roundabout"}, T.one_way)


def test_names_lanes_counterparts(spark):
    assert one(spark, {"ref": "M-1", "official_name": "x"}, T.name) == "M-1"
    assert one(spark, {"name": "", "ref": "M-1"}, T.name) == ""
    assert one(spark, {"lanes": "2;3"}, T.lanes) == 2 and one(spark, {"lanes": "x"}, T.lanes) is None
    rows = spark.createDataFrame([("1:0:f",), ("1:0:r",), ("1:0",)], "edge_id string").select(T.counterpart(F.col("edge_id")).alias("x")).collect()
    assert [r.x for r in rows] == ["1:0:r", "1:0:f", None]


def test_numbers(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (0.125,)], "x double")
    assert [r[0] for r in rows.select(numbers.round_half_up(F.col("x"))).collect()] == [3.0, -2.0, 0.0]
    s = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "s array<double>").select(numbers.at_fraction(F.col("s"), 0.5)).collect()
    assert [r[0] for r in s] == [3.0, None]


def test_geometry(spark):
    line = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    df = spark.createDataFrame([(line,)], "g array<struct<lat:double,lng:double>>")
    got = df.select(
        geo.path_length(F.col("g")), geo.entry_bearing(F.col("g")), geo.exit_bearing(F.col("g")), geo.line_distance(F.lit(0.5), F.lit(1.0), F.col("g"), F.lit(1.0))
    ).first()
    assert got[0] == pytest.approx(222390, rel=1e-3) and got[1] == pytest.approx(90) and got[2] == pytest.approx(0) and got[3] == pytest.approx(0)
    empty = spark.createDataFrame([([],), ([(1.0, 1.0)],)], df.schema).select(geo.path_length(F.col("g")), geo.exit_bearing(F.col("g"))).collect()
    assert [tuple(r) for r in empty] == [(0.0, 0.0), (0.0, 0.0)]


EDGE = {"road_class": "residential", "surface": "paved", "speed_limit": None, "name": None, "average_grade": None} | dict.fromkeys(compat.FLAGS, False)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ({}, {}, 1.0),
        ({}, {"road_class": "cycleway"}, 0.0),
        ({"road_class": "path"}, {"road_class": "footway"}, 1.0),
        ({"speed_limit": 30.0}, {"speed_limit": 50.0}, 0.0),
        ({"name": "A"}, {"name": "B"}, 0.95),
        ({"name": ""}, {"name": None}, 1.0),
        ({"average_grade": 1.0}, {}, 0.986),
        ({}, {"road_class": "service"}, 0.874),
    ],
)
def test_compatibility(spark, a, b, want):
    kinds = {"road_class": "string", "surface": "string", "speed_limit": "double", "name": "string", "average_grade": "double"} | dict.fromkeys(compat.FLAGS, "boolean")
    schema = ", ".join(f"{s}_{k} {kinds[k]}" for s in "ab" for k in EDGE)
    df = spark.createDataFrame([(*(EDGE | a).values(), *(EDGE | b).values())], schema)
    got = df.select(compat.compatibility(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).first()[0]
    assert got == pytest.approx(want)


def test_scores(spark):
    none = "struct<surface:double,speed_limit:double,traffic_control:double,infrastructure:double,scenic:double,elevation:double>"
    schema = (
        "id string, length_m double, stop_density double, crossing_density double, road_class string, surface string, surface_confidence double, average_speed_limit double,"
        "bicycle_infra_continuity double, pedestrian_path_continuity double, separation_continuity double, traffic_calming_continuity double, scenic_score double,"
        f"hilliness double, max_grade double, type string, confidence {none}"
    )
    rows = [
        ("a", 10000.0, 0.0, 0.0, "cycleway", "paved", 1.0, None, 1.0, 1.0, 1.0, 1.0, 0.6, None, None, "trail", None),
        ("b", 300.0, 5.0, 8.0, "primary", "unpaved", 1.0, 70.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 30.0, "arterial", (1.0, 0.5, 0.0, 1.0, 1.0, 1.0)),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.id, r.activity): r for r in scoring.score_corridors(df).collect()}
    assert len(got) == 8 and got["a", "walking"].safety >= 0.8 and got["b", "road-cycling"].safety < 0.2
    assert got["b", "road-cycling"].surface == 0 and got["a", "running"].scenic == 0.6 and got["a", "walking"].elevation == 0.5
    assert all(0 <= r.overall <= 1 for r in got.values())
    types = df.select(corridors.corridor_type().alias("t")).collect()
    assert [r.t for r in types] == ["trail", "arterial"]
    assert scoring.normalized({"a": 1.0, "b": 3.0}) == {"a": 0.25, "b": 0.75} and scoring.normalized({"a": 0.0}) == {"a": 0.0}


def test_colours_and_tiles(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (7.0,)], "s double").select(export.score_colour(F.col("s")).alias("c")).collect()
    assert [r.c for r in df] == ["#cc2222", "#cccc22", "#22cc22", "#22cc22"]
    box = {k: F.lit(v) for k, v in (("min_lat", 0.0), ("max_lat", 1.0), ("min_lng", 0.0), ("max_lng", 0.5))}
    parts = spark.range(1).select(tiles.sub_boxes(box, 0.5).alias("b")).first().b
    assert [(b.min_lat, b.min_lng) for b in parts] == [(0.0, 0.0), (0.5, 0.0)]
    n = spark.createDataFrame([(None,), (0,), (1,), (10,)], "n int").select(tiles.prediction_confidence(F.col("n")).alias("c")).collect()
    assert [round(r.c, 2) for r in n] == [0.6, 0.6, 0.63, 0.9]
