"""Files to graphs, caches of responses, providers, packages of surfaces, order statistics, components."""

import json
import os
import random
import sqlite3
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tests.test_operators import NODES, WAYS, _field
from trailweave.operators import iterate, ranks, street_graph as sg
from trailweave.sources import config, files, ingest, overpass, pbf, responses, surface
from trailweave.sources.providers import DetectionProvider, SurfaceProvider, enriched, shaped

PLACES = {k: (42.9 + k * 0.001, -85.7 + (k % 3) * 0.001) for k in range(1, 8)}
STREETS = [(9, [1, 2, 3, 4], {"highway": "residential", "name": "a"}), (8, [3, 5, 6], {"highway": "path", "oneway": "yes"}), (7, [6, 7], {"highway": "motorway_link"}), (6, [1, 7], {"highway": "proposed"})]


def _wanted(spark):
    nodes = spark.createDataFrame([(k, k, a, b, None) for k, (a, b) in PLACES.items()], NODES)
    ways = spark.createDataFrame([(k, i, r, t) for k, (i, r, t) in enumerate(STREETS)], WAYS)
    return sg.build_graph(nodes, sg.relevant_ways(ways))


def _edges(graph):
    return sorted((r.id, r.from_node, r.to_node, r.road_class, round(r.length_m, 3)) for r in graph.edges.collect())


def test_saved_responses_to_a_graph(spark, tmp_path):
    half = [STREETS[:2], STREETS[2:]]
    for k, ways in enumerate(half):
        elements = [{"type": "way", "id": i, "nodes": r, "geometry": [{"lat": PLACES[n][0], "lon": PLACES[n][1]} for n in r], "tags": t} for i, r, t in ways]
        (tmp_path / f"{k}.json").write_text(json.dumps({"version": 0.6, "elements": elements}))
    seq = [(r.seq, r.e.id) for r in overpass.read_responses(spark, f"{tmp_path}/*.json").orderBy("seq").collect()]
    assert seq == list(enumerate([9, 8, 7, 6]))
    assert _edges(ingest.from_overpass(spark, f"{tmp_path}/*.json")) == _edges(_wanted(spark))
    graph, stats = ingest.ingest(spark, [f"{tmp_path}/0.json", f"{tmp_path}/1.json"])
    assert stats.first().edges == graph.edges.count() and stats.first().ways == sg.relevant_ways(spark.createDataFrame([(k, i, r, t) for k, (i, r, t) in enumerate(STREETS)], WAYS)).count()


def _packed(values):
    out = b""
    for v in values:
        z = (v << 1) ^ (v >> 63)
        while z > 127:
            out += bytes([z & 127 | 128])
            z >>= 7
        out += bytes([z])
    return out


def _steps(values):
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def _blob(block, kind=b"OSMData"):
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head = _field(1, kind) + _field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


@pytest.fixture
def town_file(tmp_path):
    ids = sorted(PLACES)
    dense = _field(1, _packed(_steps(ids))) + _field(8, _packed(_steps([round(PLACES[i][0] * 1e7) for i in ids]))) + _field(9, _packed(_steps([round(PLACES[i][1] * 1e7) for i in ids])))
    out = _blob(b"", b"OSMHeader") + _blob(_field(1, _field(1, b"")) + _field(2, _field(2, dense)))
    for i, refs, tags in STREETS:
        words = [b"", *(x.encode() for pair in tags.items() for x in pair)]
        keys = bytes(range(1, len(words), 2))
        way = _field(1, i) + _field(2, keys) + _field(3, bytes(k + 1 for k in keys)) + _field(8, _packed(_steps(refs)))
        out += _blob(_field(1, b"".join(_field(1, w) for w in words)) + _field(2, _field(3, way)))
    path = tmp_path / "town.pbf"
    path.write_bytes(out)
    return str(path)


def test_pbf_to_a_graph(spark, town_file):
    assert _edges(ingest.from_pbf(spark, town_file)) == _edges(_wanted(spark))
    by_uri = pbf.read_pbf(spark, f"file://{town_file}")
    whole = pbf.whole_files(spark, town_file, 3)
    assert whole.schema.simpleString() == by_uri.schema.simpleString()
    assert sorted(map(str, whole.collect())) == sorted(map(str, by_uri.collect()))
    assert {r.type: r.n for r in pbf.element_counts(by_uri).collect()} == {"node": 7, "way": 4}
    kept = {r.id for r in pbf.nodes_of(by_uri).collect()}
    assert kept == {n for i, r, t in STREETS if t["highway"] in ("residential", "path") for n in r}


def _dense(places):
    ids = sorted(places)
    at = lambda k: _packed(_steps([round(places[i][k] * 1e7) for i in ids]))
    return _blob(_field(1, _field(1, b"")) + _field(2, _field(2, _field(1, _packed(_steps(ids))) + _field(8, at(0)) + _field(9, at(1)))))


def _way(i, refs, tags):
    words = [b"", *(x.encode() for pair in tags.items() for x in pair)]
    keys = bytes(range(1, len(words), 2))
    way = _field(1, i) + _field(2, keys) + _field(3, bytes(k + 1 for k in keys)) + _field(8, _packed(_steps(refs)))
    return _blob(_field(1, b"".join(_field(1, w) for w in words)) + _field(2, _field(3, way)))


def test_the_second_pass_opens_only_what_it_needs(spark, tmp_path):
    places = {b * 1_000_000 + k * 3: (40.0 + b * 0.01 + k * 1e-5, 5.0 + k * 2e-5) for b in range(30) for k in range(400)}
    blobs = [{i: p for i, p in places.items() if i // 1_000_000 == b} for b in range(30)]
    blobs.append({5: (1.0, 2.0), 10**15: (3.0, 4.0)})  # ids far apart: always read
    roads = [(1, [3_000_000, 3_000_003, 3_000_300], {"highway": "residential"}), (2, [3_000_300, 17_000_006, 100], {"highway": "path"}), (3, [9_000_000, 9_000_003], {"building": "yes"})]
    path = tmp_path / "a.pbf"
    path.write_bytes(_blob(b"", b"OSMHeader") + b"".join(map(_dense, blobs)) + b"".join(_way(*w) for w in roads))
    nodes, ways = pbf.two_passes(spark, f"file://{path}")
    assert {r.id for r in ways.collect()} == {1, 2}
    got = {r.id: (round(r.lat, 7), round(r.lon, 7)) for r in nodes.collect()}
    want = {3_000_000, 3_000_003, 3_000_300, 17_000_006}
    assert got == {i: tuple(round(x, 7) for x in places[i]) for i in want}
    all_elements = pbf.read_pbf(spark, str(path))
    assert got == {r.id: (round(r.lat, 7), round(r.lon, 7)) for r in pbf.nodes_of(all_elements).collect()}
    index = pbf.scanned(pbf.blob_places(spark, str(path)), frozenset(), outlines=True).where("type = 'blob'")
    assert index.count() == 31 and index.agg(F.max("most")).first()[0] == 10**15
    wanted = pbf.needed_blobs(index, ways.select(F.explode("refs").alias("id")))
    assert {r.blob for r in wanted.collect()} == {4, 18, 1, 31}  # by place in the file; 100 lies in a cell of the first
    assert pbf.scanned(wanted, frozenset({"way"})).count() == 0
    empty = tmp_path / "empty.pbf"
    empty.write_bytes(_blob(b"", b"OSMHeader"))
    assert [df.count() for df in pbf.two_passes(spark, str(empty))] == [0, 0]
    graph, stats = ingest.ingest(spark, str(path))
    assert graph.edges.count() > 0 and stats.first().ways == 2


def test_packed_numbers():
    rng = random.Random(2)
    values = [rng.choice([0, 1, -1, rng.randint(-(2**62), 2**62), rng.randint(-300, 300)]) for _ in range(500)]
    assert pbf.numbers(_packed(values), True) == values == [v for k in range(0, 500, 5) for v in pbf.numbers(_packed(values[k : k + 5]), True)]
    assert pbf.numbers(b"") == [] and pbf.numbers(bytes(range(100))) == list(range(100))


def test_response_cache(tmp_path):
    c, asked = responses.ResponseCache(f"file://{tmp_path}/r"), []

    def fetch(query, endpoint):
        asked.append((query, endpoint))
        return {"elements": [], "n": len(asked)}

    box = {"min_lat": 42.8, "max_lat": 43.0, "min_lng": -85.8, "max_lng": -85.6}
    first, bounds = c.fetched(box, fetch)
    assert bounds == {"min_lat": 42.75, "max_lat": 43.5, "min_lng": -86.25, "max_lng": -85.5} and "42.75,-86.25,43.5,-85.5" in asked[0][0]
    assert c.fetched(box, fetch)[0] == first and len(asked) == 1
    assert c.fetched(box, fetch, force=True)[0]["n"] == 2 and c.fetched(box, fetch)[0]["n"] == 2
    assert c.fetched(box, fetch, no_cache=True, endpoint="http://x")[0]["n"] == 3 and asked[-1][1] == "http://x" and c.fetched(box, fetch)[0]["n"] == 2
    files.write_bytes(c.path(responses.tile_of_box(box)), b"")
    assert c.read(responses.tile_of_box(box)) is None and c.fetched(box, fetch)[0]["n"] == 4
    assert c.read((0, 0)) is None


def test_enrichment_goes_on_without_failing_providers(spark, tmp_path):
    graph = _wanted(spark)
    spark.createDataFrame([(9, 1, 12, 42.9, -85.7)], "osm_id long, label int, n long, lat double, lng double").write.parquet(f"{tmp_path}/s")
    feature = {"geometry": {"coordinates": [-85.699, 42.901]}, "object_value": "regulatory--stop--g1", "last_seen_at": "2024-01-01T00:00:00Z"}
    stops = DetectionProvider(lambda box: [feature] if box["min_lat"] <= 42.901 < box["max_lat"] and box["min_lng"] <= -85.699 < box["max_lng"] else [], 0.1)

    class Broken(DetectionProvider):
        def observations(self, spark, box):
            raise OSError("down")

    box = {"min_lat": 42.8, "max_lat": 43.0, "min_lng": -85.8, "max_lng": -85.6}
    assert stops.boxes(spark, box).count() == 4
    out = enriched(graph, [SurfaceProvider(f"{tmp_path}/s"), Broken(lambda b: [], name="broken"), stops], box)
    assert {(r.provider, r.observations, r.failed) for r in out.providers.collect()} == {("surface predictions", 1, False), ("broken", 0, True), ("detections", 1, False)}
    surfaces = {r.id: r.surface for r in out.graph.edges.collect() if r.osm_way_id == "9"}
    assert set(surfaces.values()) == {"unpaved"} and "surface" in {r.attribute for r in out.attributes.collect()}
    assert out.graph.edges.agg(F.sum("stop_sign_count")).first()[0] > graph.edges.agg(F.sum("stop_sign_count")).first()[0]
    again = enriched(graph, [stops], box, before=out.matched)
    assert {r.id: r.surface for r in again.graph.edges.collect() if r.osm_way_id == "9"} == surfaces
    none = enriched(graph, [Broken(lambda b: [])], box)
    assert none.graph is graph and none.attributes.count() == 0
    assert set(shaped(spark.range(1)).columns) >= {"seq", "v_conf"}


def test_boxes_are_fetched_by_tasks_and_a_failing_one_is_tried_again_alone(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(box):
        """One feature a box; the box of the least corner fails at first."""
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {box['min_lat']:.3f} {box['min_lng']:.3f}\n")
        with open(log) as f:
            asked = sum(line.split()[1:] == ["42.000", "-86.000"] for line in f)
        if round(box["min_lat"], 3) == 42 and round(box["min_lng"], 3) == -86 and asked < 3:
            raise OSError("busy")
        return [{"geometry": {"coordinates": [box["min_lng"], box["min_lat"]]}, "object_value": v} for v in ("object--crosswalk", "unknown", "regulatory--stop--g1")]

    box = {"min_lat": 42.0, "max_lat": 42.3, "min_lng": -86.0, "max_lng": -85.6}
    p = DetectionProvider(fetch, 0.1, lanes=3, pauses_s=(0.0, 0.0))
    rows = sorted(p.observations(spark, box).collect())
    asked = [line.split() for line in open(log).read().splitlines()]
    assert len({tuple(a[1:]) for a in asked}) == 12 and len(asked) == 14  # the failing box alone is asked more than once
    assert str(os.getpid()) not in {a[0] for a in asked}
    assert [r.attribute for r in rows] == ["road-crossing", "stop-sign"] * 12 and len({r.seq for r in rows}) == 24
    corners = [(round(r.v_lat, 3), round(r.v_lng, 3)) for r in rows]
    assert corners == sorted(corners)  # seq follows the boxes, row by row
    with pytest.raises(Exception, match="busy"):
        DetectionProvider(fetch, 0.1, pauses_s=()).observations(spark, {**box, "max_lat": 42.1, "max_lng": -85.9}).collect() if not os.remove(log) else None


def test_requests_of_all_tasks_share_one_rate(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(box):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return []

    box = {"min_lat": 42.0, "max_lat": 42.2, "min_lng": -86.0, "max_lng": -85.6}
    assert DetectionProvider(fetch, 0.1, delay_s=0.4, lanes=2).observations(spark, box).count() == 0
    at = sorted(map(float, open(log).read().split()))
    assert len(at) == 8 and at[-1] - at[0] >= 0.4 * 6


def _package(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_contents VALUES ('other', 'tiles'), ('ways', 'features')")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('ways', 'geom')")
        db.execute("CREATE TABLE ways (fid INTEGER PRIMARY KEY, osm_id INTEGER, pred_label INTEGER, combined_surface_DL_priority TEXT, n_of_predictions_used INTEGER)")
        db.execute("CREATE TABLE rtree_ways_geom (id INTEGER, minx REAL, maxx REAL, miny REAL, maxy REAL)")
        for fid, osm, label, combined, n, x, y in rows:
            db.execute("INSERT INTO ways VALUES (?, ?, ?, ?, ?)", (fid, osm, label, combined, n))
            db.execute("INSERT INTO rtree_ways_geom VALUES (?, ?, ?, ?, ?)", (fid, x, x + 0.1, y, y + 0.1))


def test_surface_packages(spark, tmp_path):
    rows = [(1, 5, 0, None, 3, 10.0, 50.0), (2, 5, 1, None, 9, 10.0, 50.0), (3, 6, None, "paved", None, 10.0, 50.0), (4, 7, None, None, 1, 10.0, 50.0), (5, 8, 1, None, 2, 20.0, 50.0), (6, 6, 1, None, None, 10.0, 50.0)]
    path = f"{tmp_path}/a.gpkg"
    _package(path, rows)
    assert surface.feature_table(path) == ("ways", "rtree_ways_geom")
    box = {"min_lat": 50.05, "max_lat": 51.0, "min_lng": 9.0, "max_lng": 10.05}
    found = {r.osm_id: (r.seq, r.label, r.n) for r in surface.package_surfaces(spark, path, box).collect()}
    assert found == {5: (2, 1, 9), 6: (6, 1, None)}
    out = f"{tmp_path}/extract"
    assert surface.extract(spark, [path], f"file://{out}") == [path] and surface.extract(spark, [path], f"file://{out}") == []
    _package(f"{tmp_path}/b.gpkg", [(1, 8, 0, None, 2, 20.0, 50.0), (2, 9, 0, None, 1, 20.0, 50.0)])
    assert len(surface.extract(spark, [path, f"{tmp_path}/b.gpkg"], f"file://{out}")) == 1
    got = {r.osm_id: r.n for r in surface.extracted(spark, f"file://{out}").collect()}
    assert got == {5: 9, 6: None, 8: 2, 9: 1}
    near = surface.extracted(spark, f"file://{out}", {"min_lat": 50.0, "max_lat": 50.2, "min_lng": 19.9, "max_lng": 20.2})
    assert {r.osm_id for r in near.collect()} == {8, 9}
    assert surface.predicted_surfaces(spark, f"file://{out}/rows", {"min_lat": 50.0, "max_lat": 50.2, "min_lng": 9.9, "max_lng": 10.2}).count() == 3
    with sqlite3.connect(path) as db:
        db.execute("DELETE FROM gpkg_contents")
    with pytest.raises(ValueError, match="no feature table"):
        surface.feature_table(path)


def test_a_box_reads_its_own_features_only(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k * 3 + 1, rng.randrange(300), rng.choice([None, 0, 1]), rng.choice([None, "paved", ""]), rng.choice([None, 2, 9]), rng.uniform(0, 20), rng.uniform(40, 60)) for k in range(2000)]
    path = f"{tmp_path}/a.gpkg"
    _package(path, rows)
    with sqlite3.connect(path) as db:
        db.execute("ALTER TABLE rtree_ways_geom RENAME TO plain")
        db.execute("CREATE VIRTUAL TABLE rtree_ways_geom USING rtree(id, minx, maxx, miny, maxy)")
        db.execute("INSERT INTO rtree_ways_geom SELECT * FROM plain")
    box = {"min_lat": 50.0, "max_lat": 51.0, "min_lng": 5.0, "max_lng": 7.0}
    every = surface.read_packages(spark).option("rowspertask", 100).load(path).collect()
    inside = [r for r in every if r.min_lng <= 7.0 and r.max_lng >= 5.0 and r.min_lat <= 51.0 and r.max_lat >= 50.0]
    want = {}
    for r in sorted(inside, key=lambda r: (not r.has_ml, -(r.n or 0), r.seq)):
        want.setdefault(r.osm_id, r)
    assert {r.osm_id: r for r in surface.package_surfaces(spark, path, box).collect()} == want and want
    plan = surface.read_packages(spark).load(path).where(surface.overlaps(box))._jdf.queryExecution().executedPlan().toString()
    assert "surface_package" in plan or "PythonScan" in plan or "BatchScan" in plan
    reader = surface.GeoPackageReader(path, 50)
    filters = [surface.LessThanOrEqual(("min_lng",), 7.0), surface.GreaterThanOrEqual(("max_lng",), 5.0), surface.LessThan(("min_lat",), 51.0), surface.GreaterThan(("max_lat",), 50.0), surface.IsNotNull(("label",)), surface.IsNotNull(("n",))]
    assert list(reader.pushFilters(filters)) == [f for k, f in enumerate(filters) if k != 4]
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(read) == len([r for r in inside if r.label is not None]) < len(every) / 10
    nowhere = surface.GeoPackageReader(path, 50)
    list(nowhere.pushFilters([surface.GreaterThan(("min_lng",), 99.0)]))
    assert [r for p in nowhere.partitions() for r in nowhere.read(p)] == []


def test_surfaces_in_no_boxes(spark):
    rows = spark.createDataFrame([(1, 1, True, 1, 0.0, 1.0, 0.0, 1.0)], "seq long, osm_id long, has_ml boolean, n long, min_lat double, max_lat double, min_lng double, max_lng double")
    none = spark.createDataFrame([], "box_id long, min_lat double, max_lat double, min_lng double, max_lng double")
    assert surface.surfaces_in_boxes(rows, none).count() == 0
    point = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0), (2, -90.0, 90.0, -180.0, 180.0), (3, 2.0, 3.0, 2.0, 3.0)], none.schema)
    assert {r.box_id for r in surface.surfaces_in_boxes(rows, point).collect()} == {1, 2}


def test_config_root(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.config_root(str(tmp_path / "a" / "b")) == tmp_path / "configs"
    with pytest.raises(FileNotFoundError):
        config.config_root(str(tmp_path / "a" / "b"), parents=1)


def test_order_statistics(spark):
    rng = random.Random(4)
    values = [(rng.choice("ab"), float(rng.randint(0, 40))) for _ in range(501)] + [("a", None)]
    df = spark.createDataFrame(values, "k string, v double")
    known = sorted(v for _, v in values if v is not None)
    got = ranks.at_fractions(df, "v", {"low": 0.05, "mid": 0.5, "high": 1.0}).first()
    assert got.asDict() == {"low": known[25], "mid": known[250], "high": known[-1]}
    for r in ranks.at_fraction_by(df, ["k"], "v", 0.5, "m").collect():
        own = sorted(v for k, v in values if k == r.k and v is not None)
        assert r.m == own[len(own) // 2]
    assert ranks.at_fractions(df.where("false"), "v", {"p": 0.5}).first().p is None


@pytest.mark.parametrize("crowd", [2, 1000])
def test_components_with_hubs(spark, crowd):
    rng = random.Random(8)
    links = [(0, k) for k in range(1, 60)] + [(500, k) for k in range(400, 460)] + [(rng.randint(600, 700), rng.randint(600, 700)) for _ in range(60)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in iterate.components(spark.createDataFrame(links, "a long, b long"), crowd=crowd).collect()}
    assert got == {x: find(x) for x in list(root)}
