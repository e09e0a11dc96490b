import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import chains, corridors, elevation, export, fusion, lines, search, street_graph as sg
from trailweave.sources import cache, config, detections, overpass, pbf, regions, surface
from trailweave.streaming.observations import ObservationStream

NODES = "seq long, id long, lat double, lon double, tags map<string,string>"
WAYS = "seq long, id long, refs array<long>, tags map<string,string>"


def street(spark, places, ways):
    nodes = spark.createDataFrame([(k, k, a, b, t) for k, (a, b, t) in places.items()], NODES)
    return nodes, spark.createDataFrame([(k, w, r, {"highway": "residential"} | t) for k, (w, r, t) in enumerate(ways)], WAYS)


GRID = {k: (42.9 + (k // 10) * 0.001, -85.7 + (k % 10) * 0.001, {"highway": "stop"} if k == 3 else None) for k in range(60)}


def test_graph_splits_at_shared_nodes(spark):
    g = sg.build_graph(*street(spark, GRID, [(100, [1, 2, 3], {"maxspeed": "45 mph"}), (101, [2, 12], {}), (102, [99], {}), (103, [3, 98, 4], {"oneway": "-1"})]))
    e = {r.id: r for r in g.edges.collect()}
    assert set(e) == {"100:0:f", "100:0:r", "100:1:f", "100:1:r", "101:0:f", "101:0:r", "103:0"}
    assert e["100:0:f"].speed_limit == 72 and e["100:1:f"].stop_sign_count == 1
    assert (e["103:0"].from_node, e["103:0"].to_node) == ("4", "3") and e["103:0"].one_way
    assert sum(r.from_node == "2" for r in e.values()) == 3
    assert e["100:0:r"].geometry == e["100:0:f"].geometry[::-1]
    assert {r.id: r.has_stop for r in g.nodes.collect()}["3"]


def test_graph_of_a_loop_and_of_nothing(spark):
    g = sg.build_graph(*street(spark, GRID, [(1, [1, 2, 12, 11, 1], {})]))
    assert sorted(r.id for r in g.edges.collect()) == ["1:0:f", "1:0:r"]
    n, w = street(spark, GRID, [(1, [1, 2], {})])
    assert sg.build_graph(n.where("false"), w).edges.count() == 0
    assert sg.build_graph(n, w.where("false")).edges.count() == 0


@pytest.fixture(scope="module")
def town(spark):
    from trailweave.operators.iterate import settled

    rows = [(r, [r * 10 + c for c in range(10)], {"name": f"r{r}"}) for r in range(5)]
    cols = [(20 + c, [c + 10 * r for r in range(5)], {"name": f"c{c}"}) for c in (0, 4, 9)]
    g = sg.build_graph(*street(spark, GRID, [*rows, *cols, (50, [44, 54, 55], {"name": "spur"})]))
    return sg.Graph(settled(g.nodes, "n"), settled(g.edges, "e"))


def test_chains_cover_each_street_once(spark, town):
    found = chains.build_chains(town.edges)
    own = [r.edge_id for r in found.collect()]
    stems = [e.rsplit(":", 1)[0] for e in own]
    every = {r.id.rsplit(":", 1)[0] for r in town.edges.select("id").collect()}
    assert len(stems) == len(set(stems)) and set(stems) == every
    straight = found.groupBy("chain_id").count().agg(F.max("count")).first()[0]
    assert straight >= 2


def test_cores_and_trimming(spark, town):
    found = chains.build_chains(town.edges)
    degree = {r.node: r.degree for r in chains.core_degrees(found, town.edges).collect()}
    assert degree["55"] == 0 and degree["0"] == 2 and degree["4"] == 3
    left, saved = chains.trimmed_chains(found, town.edges)
    edges = {r.edge_id.rsplit(":", 1)[0] for r in left.collect()}
    assert not any(e.startswith("50:") for e in edges) and saved.count() == 0


def test_network_and_loops(spark, town):
    from trailweave.functions import scoring
    from trailweave.operators.iterate import settled

    net = corridors.build_network(town, by_tier=dict.fromkeys(chains.MIN_LENGTH_M, 350.0))
    net = corridors.Network(settled(net.corridors, "c"), settled(net.connectors, "k"), settled(net.entity_edges, "m"), net.adjacency)
    stats = corridors.network_stats(net).first()
    assert stats.corridors > 0 and stats.mean_m == pytest.approx(stats.total_m / stats.corridors)
    pairs = {(r.a, r.b) for r in net.adjacency.collect()}
    assert all((b, a) in pairs and a != b for a, b in pairs)
    scores = scoring.score_corridors(net.corridors)
    starts = spark.createDataFrame([(1, 42.902, -85.696, 600.0, 2500.0, 90.0, "moderate", 3)], "request_id long, lat double, lng double, min_m double, max_m double, direction double, turns string, seed long")
    runs = [search.loop_routes(starts, net, town, scores, "walking", noise=0.0).orderBy("pos").collect() for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]
    path = runs[0]
    assert all(a.to_node == b.from_node for a, b in zip(path, path[1:], strict=False)) and 600 <= sum(r.length_m for r in path) <= 3750
    loops = spark.createDataFrame(path)
    parts = search.segments(loops, net, town)
    total = search.route_stats(parts, net.corridors).first()
    assert total.distance_m == pytest.approx(sum(r.length_m for r in path))
    for r in export.route_features(parts, net.corridors).collect():
        assert json.loads(r.feature)["geometry"]["type"] == "LineString"
    features = [json.loads(r.feature) for r in export.corridor_features(net.corridors, scores.where("activity = 'walking'")).collect()]
    assert features and all(f["properties"]["stroke"].startswith("#") for f in features)
    assert sum(r.n for r in export.by_type(export.corridor_features(net.corridors)).collect()) == len(features)


OBS = "seq long, edge_id string, attribute string, source string, confidence double, v_str string, v_num double, v_bool boolean, v_lat double, v_lng double, v_conf double"


def test_fusion(spark):
    rows = [
        (1, "e", "surface", "osm-inferred", 0.8, "paved", None, None, None, None, None),
        (2, "e", "surface", "gravelmap", 0.8, "unpaved", None, None, None, None, None),
        (3, "e", "speed-limit", "osm-tag", 1.0, None, 50.0, None, None, None, None),
        (4, "e", "speed-limit", "osm-tag", 1.0, None, 80.0, None, None, None, None),
        (5, "e", "bicycle-infra", "osm-tag", 0.5, None, None, True, None, None, None),
        (6, "e", "bicycle-infra", "osm-tag", 0.5, None, None, False, None, None, None),
        (7, "e", "scenic", "osm-tag", 1.0, None, 1.0, None, None, None, None),
        (8, "e", "stop-sign", "mapillary", 0.7, None, None, None, 42.0, -85.0, 0.75),
        (9, "e", "stop-sign", "mapillary", 0.7, None, None, None, 42.00001, -85.0, 0.75),
        (10, "e", "stop-sign", "osm-tag", 0.7, None, None, None, 43.0, -85.0, 0.75),
        (11, "z", "surface", "gravelmap", 0.0, "paved", None, None, None, None, None),
    ]
    got = {(r.edge_id, r.attribute): r for r in fusion.fuse(spark.createDataFrame(rows, OBS)).collect()}
    assert got["e", "surface"].value_str == "unpaved" and got["e", "surface"].has_conflict
    assert got["e", "speed-limit"].value_num == 50 and got["e", "speed-limit"].has_conflict
    assert got["e", "bicycle-infra"].value_bool and got["e", "bicycle-infra"].has_conflict
    assert got["e", "stop-sign"].value_lat == pytest.approx(42.000005) and got["e", "stop-sign"].confidence == pytest.approx(0.875)
    assert got["z", "surface"].value_str == "unknown" and got["z", "surface"].confidence == pytest.approx(0.1)
    assert fusion.fuse(spark.createDataFrame([], OBS)).count() == 0
    assert len(fusion.strategies()) == 8


def test_lines_and_elevation(spark):
    z = np.zeros(5)
    assert lines.keep_points(z, np.arange(5.0), 10).tolist() == [True, False, False, False, True]
    assert lines.resampled(np.array([0.0, 100.0, 120.0]), np.array([0.0, 10.0, 10.0])).tolist() == [0, 5, 10, 10]
    assert elevation.filled(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3] and elevation.filled(np.array([np.nan, 1])) is None
    tile = np.tile(np.arange(11) * 10, (11, 1)).astype(">i2")
    tile[0, 0] = elevation.VOID
    tiles = spark.createDataFrame([("N42W086.hgt", bytearray(tile.tobytes()))], "tile string, content binary")
    points = spark.createDataFrame([(1, 42.5, -85.95), (2, 42.99, -85.99), (3, 10.0, 10.0)], "point_id long, lat double, lng double")
    got = {r.point_id: r.elevation_m for r in elevation.heights(points, tiles).collect()}
    assert got[1] == pytest.approx(5.0) and got[2] is None and got[3] is None


def test_heights_are_read_by_strip(spark, tmp_path):
    rng = np.random.default_rng(5)
    side, names = 201, {"N42W086.hgt": (42, -86), "S01E010.hgt": (-1, 10), "N43W086.hgt": (43, -86)}
    tiles = []
    for name in names:
        tile = rng.integers(-50, 3000, (side, side)).astype(">i2")
        tile[3, 5:40] = elevation.VOID
        (tmp_path / name).write_bytes(tile.tobytes())
        tiles.append((name, bytearray(tile.tobytes())))
    (tmp_path / "N10E010.hgt").write_bytes(b"broken")
    rows = [(k, y + float(rng.random()), x + float(rng.random())) for k in range(900) for y, x in [list(names.values())[k % 3]]]
    rows += [(1000, 42.0, -86.0), (1001, 43.0, -85.000001), (1002, 10.5, 10.5), (1003, 60.0, 60.0), (1004, None, 3.0), (1005, 42.999999, -85.5)] + [(2000 + k, 42.5, -85.5) for k in range(500)]
    points = spark.createDataFrame(rows, "point_id long, lat double, lng double")
    of_rows = {r.point_id: r.elevation_m for r in elevation.heights(points, spark.createDataFrame(tiles, "tile string, content binary")).collect()}
    of_files = {r.point_id: r.elevation_m for r in elevation.heights_of_files(points, f"file://{tmp_path}").collect()}
    assert len(of_files) == len(rows) and of_files == of_rows | {1004: None} and of_files[1003] is None and of_files[1002] is None
    reader = elevation._Tiles(str(tmp_path))
    reader.heights("N42W086.hgt", np.array([42.5, 42.501]), np.array([-85.5, -85.4]))
    assert 0 < reader.read_bytes <= 4 * 2 * side


def test_sources(spark, tmp_path):
    reply = {"elements": [
        {"type": "way", "id": 9, "nodes": [1, 2, 3], "geometry": [{"lat": 1.0, "lon": 2.0}, None, {"lat": 3.0, "lon": 4.0}], "tags": {"highway": "path"}},
        {"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"highway": "stop"}},
        {"type": "way", "id": 8, "nodes": [1], "geometry": [{"lat": 1.0, "lon": 2.0}], "tags": {"highway": "motorway"}},
    ]}
    (tmp_path / "r.json").write_text(json.dumps(reply))
    e = overpass.read_responses(spark, str(tmp_path / "r.json"))
    assert {r.id: r.lat for r in overpass.nodes_of(e).collect()} == {1: 1.5, 3: 3.0}
    assert [r.id for r in overpass.ways_of(e).collect()] == [9]
    assert "out body geom" in overpass.query_text(1, 2, 3, 4)
    f = spark.createDataFrame([(1, "regulatory--stop--g1", 1.0, 2.0, "2024-01-01T00:00:00Z"), (2, "object--bench", 1.0, 2.0, None)], "seq long, object_value string, lat double, lng double, last_seen_at string")
    assert [r.attribute for r in detections.observations(f).collect()] == ["stop-sign"]
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 7, 3), (2, None, 4), (2, 9, 5)], "osm_id long, n long, seq long")
    assert {r.osm_id: (r.n, r.seq) for r in surface.upserted(rows).collect()} == {1: (7, 3), 2: (None, 4)}
    assert regions.resolve("new-york")[0] == "New York" and len(regions.REGIONS) == 51
    with pytest.raises(KeyError, match="michigan"):
        regions.resolve("atlantis")


def _field(n, value):
    def var(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    return var(n << 3) + var(value) if isinstance(value, int) else var(n << 3 | 2) + var(len(value)) + value


def test_pbf(spark, tmp_path):
    strings = _field(1, b"") + _field(1, b"highway") + _field(1, b"stop")
    z = lambda *v: bytes((x << 1) ^ (x >> 31) for x in v)
    dense = _field(1, z(5, 1)) + _field(8, z(10, 2)) + _field(9, z(-10, 4)) + _field(10, bytes([1, 2, 0, 0]))
    way = _field(1, 7) + _field(2, bytes([1])) + _field(3, bytes([2])) + _field(8, z(5, 1))
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, way))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head = _field(1, b"OSMData") + _field(3, len(blob))
    path = tmp_path / "x.pbf"
    path.write_bytes(struct.pack(">I", len(head)) + head + blob)
    spark.dataSource.register(pbf.PbfDataSource)
    rows = spark.read.format("map_pbf").load(str(path)).collect()
    nodes = {r.id: r for r in rows if r.type == "node"}
    assert set(nodes) == {5, 6} and nodes[5].tags == {"highway": "stop"} and nodes[6].lat == pytest.approx(1.2e-6)
    assert [list(r.refs) for r in rows if r.type == "way"] == [[5, 6]]


def test_config_and_cache(spark, tmp_path):
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3, "c": None}}) == {"a": {"b": 3, "c": 2}}
    p = config.base(str(tmp_path), "running")
    changed = config.merged(p, {"flow": {"blend": 0.9}})
    config.save_profile(str(tmp_path), "running", "My Hills!", changed)
    assert config.profiles(str(tmp_path)) == ["my-hills"] and config.resolved(str(tmp_path), "running", "My Hills!")["flow"]["blend"] == 0.9
    c = cache.NetworkCache(spark, f"file://{tmp_path}/cache")
    assert c.find(42.5, -85.5, 5) is None
    key = c.write({"min_lat": 42.0, "min_lng": -86.0, "max_lat": 43.0, "max_lng": -85.0}, {"t": spark.range(3)}, 1.25)
    assert c.find(42.5, -85.5, 5) == key and c.find(42.01, -85.5, 5) is None and c.read(key, "t").count() == 3
    assert c.stats().first().entries == 1 and c.remove(key) == 1 and c.find(42.5, -85.5, 5) is None


def _observed(n, seed=5):
    rng = np.random.default_rng(seed)
    kinds = ["surface", "speed-limit", "bicycle-infra", "scenic", "traffic-signal", "stop-sign", "unheard-of"]
    for k in range(n):
        a, source = kinds[rng.integers(7)], ["osm-tag", "mapillary", "user-report", None][rng.integers(4)]
        edge = "hot" if rng.random() < 0.3 else f"e{rng.integers(5)}"
        gone = rng.random() < 0.05
        number = None if gone or a not in ("speed-limit", "scenic") else float(rng.integers(8) * 10) if a == "speed-limit" else float(rng.random())
        text = None if gone or a != "surface" else ["paved", "unpaved", "unknown"][rng.integers(3)]
        point = a in ("traffic-signal", "stop-sign")
        spot = [42.9 + float(rng.integers(30)) * 4e-5, -85.7 + float(rng.integers(30)) * 5e-5, float(rng.integers(1, 9)) / 8] if point else [None] * 3
        yield (k, edge, a, source, float(rng.integers(0, 11)) / 10, text, number, bool(rng.integers(2)) if a == "bicycle-infra" and not gone else None, *spot)


def test_votes_alike_but_for_rounding_are_ties(spark):
    votes = [("e", "surface", "paved", 0.1 + 0.2 + 0.3, 3, 5), ("e", "surface", "unpaved", 0.6, 1, 1), ("f", "surface", "paved", 1.0, 2, 1), ("f", "surface", "unknown", 0.15000000000000002, 2, 2)]
    got = {r.edge_id: r for r in fusion.votes_result(spark.createDataFrame(votes, "edge_id string, attribute string, v_str string, w double, m long, first long")).collect()}
    assert got["e"].value_str == "unpaved" and got["e"].has_conflict
    assert got["f"].value_str == "paved" and not got["f"].has_conflict


def test_flags_are_summed_in_order_of_arrival(spark):
    row = lambda seq, source, sure, v: (seq, "e", "bicycle-infra", source, sure, None, None, v, None, None, None)
    # 0.1 + 0.2 + 0.3 is over 0.6 in this order only
    rows = [row(4, "mapillary", 1.0, True), row(3, "other", 0.6, False), row(2, "other", 0.4, False), row(1, "other", 0.2, False)]
    for given in (rows, rows[::-1]):
        (got,) = fusion.fuse_flags(spark.createDataFrame(given, OBS).coalesce(1)).collect()
        assert (got.value_bool, got.n) == (False, 4)
    tie = [("e", "bicycle-infra", 0.7, 0.30000000000000004, 2)]
    assert not fusion.flags_result(spark.createDataFrame(tie, "edge_id string, attribute string, yes double, no double, n long")).first().has_conflict


def test_a_variance_at_the_limit_is_no_conflict(spark):
    sums = [("e", "scenic", 1.0, 0.6, 0.10000000000000002, 4), ("f", "scenic", 1.0, 0.6, 0.1000001, 4)]
    got = fusion.mean_result(spark.createDataFrame(sums, "edge_id string, attribute string, total double, s double, var double, n long")).collect()
    assert {r.edge_id: r.has_conflict for r in got} == {"e": False, "f": True}


def _fused_rows(df):
    plain = lambda v: round(v, 7) if isinstance(v, float) else v
    return {(r.edge_id, r.attribute): tuple(map(plain, r))[2:] for r in df.collect()}


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows, size = list(_observed(1500)), 250
    every = spark.createDataFrame(rows, OBS)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state = []
    for some in (range(4), range(4, 6)):  # the second half finds the sums of the first in the checkpoint
        for k in some:
            spark.createDataFrame(rows[k * size : (k + 1) * size], OBS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ObservationStream(f"{tmp_path}/state")
        q = stream.start(source, f"{tmp_path}/ck")
        q.awaitTermination()
        state.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] if q.recentProgress else None)
    want = _fused_rows(fusion.fuse(every))
    assert _fused_rows(stream.current(spark)) == want and len(want) == 36
    assert state[-1] == 36  # an edge and attribute each, however many observations came
    assert not list((tmp_path / "state" / "sums").iterdir())


def test_stream_batch_run_again_and_chosen_kinds(spark, tmp_path):
    rows = [r for r in _observed(300, 7) if r[2] == "surface"]
    every = spark.createDataFrame(rows, OBS)
    every.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ObservationStream(f"{tmp_path}/state", {"surface": "votes"})
    for checkpoint in ("a", "b"):  # without its checkpoint the first batch comes again, and replaces its folder
        stream.start(spark.readStream.schema(every.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/{checkpoint}").awaitTermination()
    assert _fused_rows(stream.current(spark)) == _fused_rows(fusion.fuse(every))


def plain_chains(twin, pairs):
    """One sequence over all edges: {seed: edges in order}."""
    used, out = set(), {}
    for seed in sorted(twin):
        if seed in used:
            continue
        line = [seed]
        used |= {seed, twin[seed]}
        for ahead in (True, False):
            while found := [(-s, y) for a, b, s in pairs for x, y in [(a, b) if ahead else (b, a)] if x == line[-1 if ahead else 0] and y not in used]:
                nxt = min(found)[1]
                line.insert(len(line) if ahead else 0, nxt)
                used |= {nxt, twin[nxt]}
        out[seed] = line
    return out


@pytest.mark.parametrize("n,blocks", [(60, 1), (30, 3), (200, 4)])
def test_chains_over_blocks_are_those_of_one_sequence(spark, n, blocks):
    rng = np.random.default_rng(n + blocks)
    twin = {k: (k ^ 1 if k < n // 2 * 2 - n // 4 * 2 else None) for k in range(n)}
    # few different scores, so that ties occur; chains cross blocks and come back
    near = rng.integers(-6, 7, 3 * n)
    pairs = {(int(a), int(a + d)) for a, d in zip(rng.integers(6, n - 6, 3 * n), near, strict=True) if d and twin[int(a)] != a + d}
    pairs = [(a, b, float(rng.integers(1, 4)) / 4) for a, b in sorted(pairs)]
    edges = spark.createDataFrame([(k, t, min(k, k if t is None else t) // 3) for k, t in twin.items()], "seq long, twin long, place long")
    found = chains.greedy_chains(edges, spark.createDataFrame(pairs, "a long, b long, score double"), blocks)
    got = {}
    for r in found.orderBy("chain_id", "pos").collect():
        got.setdefault(r.chain_id, []).append(r.edge_seq)
    assert got == plain_chains(twin, pairs)


def test_chains_of_nothing(spark):
    none = spark.createDataFrame([], "seq long, twin long, place long"), spark.createDataFrame([], "a long, b long, score double")
    assert chains.greedy_chains(*none, 1).count() == 0
    assert chains.greedy_chains(*none, 3).count() == 0
