"""Locations, reports, profiles, features, and search on small graphs against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import GRID, street, town  # noqa: F401
from trailweave.functions import scoring
from trailweave.operators import chains, corridors, elevation, export, location, reports, search, street_graph as sg
from trailweave.operators.iterate import settled


@pytest.fixture(scope="module")
def net(spark, town):  # noqa: F811
    n = corridors.build_network(town, by_tier=dict.fromkeys(chains.MIN_LENGTH_M, 350.0))
    return corridors.Network(*(settled(x, "n") for x in (n.corridors, n.connectors, n.entity_edges, n.adjacency)))


def test_location_filter(spark, net):
    own = {r.id: [(p.lat, p.lng) for p in r.geometry] for r in net.corridors.collect()}
    box = {"min_lat": 42.9005, "max_lat": 42.9025, "min_lng": -85.7005, "max_lng": -85.6955}
    inside = lambda p: box["min_lat"] <= p[0] <= box["max_lat"] and box["min_lng"] <= p[1] <= box["max_lng"]
    want = {k for k, line in own.items() if any(map(inside, line))}
    assert 0 < len(want) < len(own)
    cut = location.within_box(net, box)
    assert {r.id for r in cut.corridors.collect()} == want
    for r in net.connectors.collect():
        left = [c for c in r.corridor_ids if c in want]
        got = cut.connectors.where(F.col("id") == r.id).collect()
        assert [list(g.corridor_ids) for g in got] == ([left] if left else [])
    alive = want | {r.id for r in cut.connectors.collect()}
    assert {(r.a, r.b) for r in cut.adjacency.collect()} == {(r.a, r.b) for r in net.adjacency.collect() if r.a in alive and r.b in alive}
    stats = location.location_stats(cut).first()
    assert stats.corridors == len(want) and stats.total_m == pytest.approx(stats.mean_m * len(want))
    core, wide = location.boxes(spark, 42.9, -85.7, 1.0, 2.0)
    assert wide["max_lat"] - core["max_lat"] == pytest.approx(2 / 111.32)
    found, stats = location.build_for_location(spark, lambda box: sg.build_graph(*street(spark, GRID, [(1, list(range(10)), {"name": "x"})])), 42.9, -85.7, 1.0)
    assert stats.first().corridors == found.corridors.count()


def test_reports(spark, town, net):  # noqa: F811
    c = net.corridors.toPandas()
    spread = {r.attribute: r for r in reports.corridor_spreads(net.corridors).collect()}
    lengths = sorted(c["length_m"])
    assert spread["length_m"].p50 == lengths[min(len(lengths) // 2, len(lengths) - 1)] and spread["length_m"].most == lengths[-1]
    shares = {r.attribute: r for r in reports.corridor_shares(net.corridors).collect()}
    assert shares["stop_density"].n == (c["stop_density"] > 0).sum() and shares["average_speed_limit"].n == c["average_speed_limit"].notna().sum()
    degree = net.adjacency.groupBy("a").count().toPandas()["count"]
    stats = reports.adjacency_stats(net).first()
    assert stats.most == degree.max() and stats.mean == pytest.approx(degree.sum() / stats.entities)
    assert reports.connector_report(net.connectors).first().connectors == net.connectors.count()
    top = [r.length_m for r in reports.named_corridors(net.corridors, 300.0, 3).collect()]
    assert top == sorted(c[c["name"].notna() & (c["length_m"] > 300)]["length_m"], reverse=True)[:3]
    text = reports.report_text(town, net)
    assert all(x in text for x in ("Edge attributes", "Corridor types", "residential", "connectors"))
    assert corridors.confidences(net.entity_edges, town.edges.withColumn("enrichment", F.create_map(F.lit("surface"), F.lit(0.5)))).first().confidence.surface == pytest.approx(0.5)


def _profile(points, every=50.0):
    """Samples every 50 m between (distance, height) pairs, and the last one."""
    if len(points) < 2:
        return [z for _, z in points]
    out, k = [], 0
    while k * every <= points[-1][0]:
        d = k * every
        i = next((i for i in range(len(points) - 1) if points[i + 1][0] >= d), len(points) - 2)
        (a, y), (b, z) = points[i], points[i + 1]
        out.append(y + ((d - a) / (b - a) if b > a else 0) * (z - y))
        k += 1
    if points[-1][0] - (len(out) - 1) * every > every * 0.1:
        out.append(points[-1][1])
    return out


def test_profiles(spark):
    g = sg.build_graph(*street(spark, GRID, [(1, [0, 1, 2, 3], {"oneway": "yes"}), (2, [1, 11], {}), (3, [10, 11], {"oneway": "yes"}), (4, [20, 21], {"oneway": "yes"})]))
    members = spark.createDataFrame([("a", 0, "1:0"), ("a", 1, "1:1"), ("b", 0, "3:0"), ("c", 0, "4:0")], "id string, pos int, edge_id string")
    heights = spark.createDataFrame([("0", 100.0), ("1", 130.0), ("3", 90.0), ("10", 5.0)], "node string, z double")
    of_edge = spark.createDataFrame([("1:1", [130.0, 150.0, 90.0])], "edge_id string, heights array<double>")
    edges = {r.id: r for r in g.edges.collect()}

    def step(p, q):
        a, b, c, d = map(math.radians, (p.lat, p.lng, q.lat, q.lng))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    line = [*edges["1:0"].geometry, *edges["1:1"].geometry]
    dist, at = [0.0], 0.0
    for k, (p, q) in enumerate(zip(line, line[1:], strict=False)):
        at += step(p, q) if k != len(edges["1:0"].geometry) - 1 else 0
        dist.append(at)
    want = _profile(list(zip(dist, [100.0, 130.0, 130.0, 150.0, 90.0], strict=True)))
    got = {r.id: list(r.profile) for r in elevation.profiles(members, g.edges, of_edge, heights).collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx(want) and set(got["b"]) == {5.0}
    parts = spark.createDataFrame([(1, 0, [1.0, 2.0], False), (1, 1, [5.0, 2.0], True), (2, 0, None, False)], "request_id long, segment int, profile array<double>, reversed boolean")
    assert {r.request_id: list(r.profile) for r in export.route_profile(parts).collect()} == {1: [1.0, 2.0, 5.0]}
    twice = spark.createDataFrame([(r.lat, r.lng, 7.0) for r in line] * 2, "lat double, lng double, elevation_m double")
    assert elevation.with_climbs(g.edges, twice).count() == len(edges)


def test_features(spark, town, net):  # noqa: F811
    scores = scoring.score_corridors(net.corridors).where("activity = 'walking'")
    c = net.corridors.withColumn("elevation_profile", F.array(F.lit(1.4), F.lit(2.6)))
    c = c.withColumn("name", F.when(F.col("id") != net.corridors.first().id, F.col("name")))
    found = {r.id: json.loads(r.feature)["properties"] for r in export.corridor_features(c, scores).collect()}
    row = c.first()
    p = found[row.id]
    assert p["name"] is None and p["edgeCount"] == row.edge_count and p["elevationProfile"] == [1, 3] and "elevationGain" not in p
    assert {"scoreOverall", "scoreFlow", "scoreElevation", "oneWay", "stopDensityPerKm"} <= set(p) and "speedLimit" not in p
    plain = json.loads(export.corridor_features(net.corridors, style=False).first().feature)["properties"]
    assert "stroke" not in plain and "scoreOverall" not in plain
    every = export.network_features(net, scores, connectors=True)
    assert every.count() == net.corridors.count() + net.connectors.count()
    kinds = {json.loads(r.feature)["properties"]["featureType"] for r in every.collect()}
    assert kinds == {"corridor", "connector"} if net.connectors.count() else {"corridor"}
    edge = json.loads(export.street_features(town.edges, nodes=town.nodes).where("id = '0:0:f'").first().feature)
    assert edge["properties"]["lanes"] is None and edge["properties"]["featureType"] == "edge"
    points = [r for r in export.street_features(town.edges, nodes=town.nodes).collect() if json.loads(r.feature)["geometry"]["type"] == "Point"]
    assert len(points) == town.nodes.count()
    one = export.street_features(town.edges, one_direction=True).count()
    assert one * 2 == town.edges.count() == export.street_features(town.edges, road_classes=("residential",)).count()
    whole = json.loads(export.collection(every).first().collection)
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == every.count()


def test_directed_lines(spark):
    line = lambda *p: [(float(a), float(b)) for a, b in p]
    edges = spark.createDataFrame(
        [("x", "1", "2", line((0, 0), (0, 1))), ("y", "3", "2", line((0, 2), (0, 1))), ("z", "3", "4", line((0, 2), (0, 3))), ("w", "8", "9", line((5, 5), (5, 6)))],
        "id string, from_node string, to_node string, geometry array<struct<lat:double,lng:double>>",
    )
    parts = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (2, 0, "z"), (2, 1, "y"), (3, 0, "w")], "route long, pos int, edge_id string")
    got = {r.route: [(p.lat, p.lng) for p in r.geometry] for r in export.directed_lines(parts, edges).collect()}
    assert got == {1: [(0, 0), (0, 1), (0, 2), (0, 3)], 2: [(0, 3), (0, 2), (0, 1)], 3: [(5, 5), (5, 6)]}


def _lollipop():
    """A stem 0-1-2 and a ring 2-3-4-5-2 of steps of about 111 m."""
    place = {str(k): (42.9 + y * 0.001, -85.7 + x * 0.001) for k, (x, y) in enumerate([(0, 0), (0, 1), (0, 2), (1, 3), (0, 4), (-1, 3)])}
    ways = {}
    for a, b in [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 2)]:
        for u, v in ((a, b), (b, a)):
            ways.setdefault(str(u), []).append((str(v), f"{a}-{b}", "c", "corridor", 111.0, 0.8))
    return ways, place


def test_loops_may_close_over_edges_already_used():
    ways, place = _lollipop()
    s = search.LoopSearch(ways, place, "0", 600.0, 1500.0, 0.0, noise=0.0)
    home = s.way_home("2", 5000.0, 50)
    assert [e[0] for e in home] == ["1", "0"]
    assert s.way_home("2", 5000.0, 1) is None and s.way_home("2", 50.0, 50) is None
    found = s.run()
    assert found and found.nodes[0] == found.nodes[-1] == "0" and found.metres >= 600
    edges = [e[1] for e in found.edges]
    assert edges.count("0-1") == 2 and edges.count("1-2") == 2


def _plain_home(ways, place, start, at, radius, limit, far):
    best = {at: 0}
    layer = [at]
    for n in range(limit):
        new = []
        for u in layer:
            for e in ways.get(u, ()):
                if e[0] not in best and far(e[0]) <= radius:
                    best[e[0]] = n + 1
                    new.append(e[0])
        layer = new
    return best.get(start)


def test_way_home_is_shortest():
    place = {str(k): (42.9 + (k // 6) * 0.001, -85.7 + (k % 6) * 0.001) for k in range(36)}
    ways = {}
    for k in range(36):
        for n in (k + 1 if k % 6 < 5 else None, k + 6 if k < 30 else None):
            if n is not None and (k * 7 + n * 3) % 5:
                for u, v in ((k, n), (n, k)):
                    ways.setdefault(str(u), []).append((str(v), f"{k}-{n}", "c", "corridor", 100.0, 0.5))
    s = search.LoopSearch(ways, place, "0", 600.0, 1500.0, 0.0)
    for at in map(str, range(1, 36)):
        for radius in (300.0, 5000.0):
            way = s.way_home(at, radius, 50)
            want = _plain_home(ways, place, "0", at, radius, 50, lambda n: s.home(n)[0])
            assert (len(way) if way else None) == want


def test_ways_home_are_those_of_a_search_from_each_node():
    """The same edges as a breadth-first search from the node, whatever the radius and the limit."""
    rng = random.Random(8)
    for case in range(30):
        n = rng.choice([5, 20, 60])
        place = {str(k): (42.9 + rng.uniform(-1, 1) * 0.05, -85.7 + rng.uniform(-1, 1) * 0.07) for k in range(n)}
        ways = {}
        for k in range(rng.randint(n, 4 * n)):
            u, v = rng.randrange(n), rng.randrange(n + 1)  # one node has no place
            ways.setdefault(str(u), []).append((str(v), f"e{k}", "c", "corridor", 100.0, 0.5))
        s = search.LoopSearch(ways, place, "0", 600.0, 6000.0, 0.0)
        for at in place:
            for radius in (2000.0, 5000.0, 6400.0):
                for limit in (1, 3, 50):
                    todo, came, want = [at], {at: None}, None
                    depth = {at: 0}
                    while todo and want is None:
                        node = todo.pop(0)
                        for e in ways.get(node, ()) if depth[node] < limit else ():
                            if e[0] in came or e[0] not in place or s.home(e[0])[0] > radius:
                                continue
                            came[e[0]], depth[e[0]] = (node, e), depth[node] + 1
                            todo.append(e[0])
                            if e[0] == "0":
                                want, now = [], "0"
                                while came[now]:
                                    now, step = came[now]
                                    want.insert(0, step)
                                break
                    assert s.way_home(at, radius, limit) == want, (case, at, radius, limit)


def test_requests_of_an_area_share_the_graph_and_nothing_else(spark):
    side = 8
    place = {k: (42.9 + (k // side) * 0.002, -85.7 + (k % side) * 0.0025) for k in range(side * side)}
    rows = []
    for k in range(side * side):
        for v in (k + 1 if k % side < side - 1 else None, k + side if k < side * side - side else None):
            if v is not None:
                for a, b in ((k, v), (v, k)):
                    rows.append((str(a), str(b), f"e{k}-{v}", f"c{k % 5}", "corridor", 210.0 + (k * 7 + v) % 20, 0.3 + (k * 3 + v) % 7 / 10))
    nodes = spark.createDataFrame([(str(k), *p) for k, p in place.items()], "id string, lat double, lng double")
    edges = spark.createDataFrame(rows, "from_node string, to_node string, edge_id string, entity_id string, kind string, length_m double, score double")
    asked = [(k, str(k * 5 % (side * side)), 1500.0 + k % 2 * 500, 3000.0 + k % 3 * 1000, float(k * 40 % 360), ("minimal", "moderate", "frequent")[k % 3], k) for k in range(14)]
    requests = spark.createDataFrame(asked, "request_id long, node string, min_m double, max_m double, direction double, turns string, seed long")
    ways = {}
    for a, b, *e in sorted(rows, key=lambda r: (r[0], r[3], r[2], r[1])):
        ways.setdefault(a, []).append((b, *e))
    want = {}
    for i, node, least, most, direction, turns, seed in asked:
        p = search.LoopSearch(ways, {str(k): v for k, v in place.items()}, node, least, most, direction, turns, 40, 0.08, seed).run()
        want[i] = [e[1] for e in p.edges] if p else []
    for shared in (1, 3, 1000):
        got = {i: [] for i in want}
        for r in search.find_loops(requests, nodes, edges, width=40, shared=shared).orderBy("request_id", "pos").collect():
            got[r.request_id].append(r.edge_id)
        assert got == want
    assert any(want.values())
    sizes = search._areas(requests.join(nodes.withColumnRenamed("id", "node"), "node").unionByName(requests.join(nodes.withColumnRenamed("id", "node"), "node").where("request_id = 1")), 1).groupBy("area").count().collect()
    assert len(sizes) > 3


def test_crowded_points_cluster_as_few_ones(spark):
    from tests.test_operators import OBS
    from trailweave.operators import fusion

    rng = random.Random(11)
    rows = []
    for edge, n, spread in (("a", 400, 0.0006), ("b", 150, 0.002), ("c", 300, 0.00002), ("d", 1, 1.0), ("e", 40, 0.0)):
        lat = rng.choice([0.0, 43.0, -61.0])
        for k in range(n):
            rows.append((rng.randrange(10**9), edge, "stop-sign", rng.choice(["mapillary", "osm-tag"]), 0.5, None, None, None, lat + rng.uniform(-1, 1) * spread, 9.99995 + rng.uniform(-1, 1) * spread, rng.choice([0.25, 0.5, 1.0])))
    rows += [(k, "line", "stop-sign", "osm-tag", 0.5, None, None, None, 43.0 + k * 0.0001, 10.0, 0.5) for k in range(30)]
    obs = spark.createDataFrame(rows, OBS)
    key = lambda r: (r.edge_id, r.n, round(r.value_num, 9), round(r.value_lat, 9), round(r.value_lng, 9), round(r.confidence, 9))
    want = sorted(map(key, fusion.fuse_points(obs).collect()))
    assert sorted(map(key, fusion.fuse_points(obs, crowd=35).collect())) == want
    assert sorted(map(key, fusion.fuse_points(obs, crowd=0).collect())) == want
    clusters = {}
    for r in fusion.cluster_points(obs).collect():
        clusters.setdefault(r.edge_id, {}).setdefault(r.centre.seq, set()).add(r.seq)
    for edge in clusters:
        own = sorted((r for r in rows if r[1] == edge), key=lambda r: r[0])
        plain = fusion.point_clusters(*(np.array([r[c] for r in own]) for c in (8, 9)))
        assert {own[c[0]][0]: {own[k][0] for k in c} for c in plain} == clusters[edge]
    nowhere = spark.createDataFrame([(1, "x", "stop-sign", "s", 0.5, None, None, None, None, None, 0.5)], OBS)
    assert fusion.cluster_points(nowhere).count() == 1 and fusion.cluster_points(nowhere.where("false")).count() == 0


def test_snapping_ring_by_ring(spark):
    """The same as all distances, in crowded and in empty places."""
    rng = random.Random(6)
    nodes = [(f"n{k}", 42.9 + rng.gauss(0, 0.01), -85.7 + rng.gauss(0, 0.012)) for k in range(700)] + [(f"f{k}", 43.2 + k * 0.01, -85.7) for k in range(6)] + [("pole", 89.0, 10.0)]
    edges = [(n[0], "x") for n in nodes for _ in range(rng.choice([0, 1, 2, 3, 4]))]
    ways = {}
    for u, _ in edges:
        ways[u] = ways.get(u, 0) + 1
    starts = [(k, 42.9 + rng.uniform(-1, 1) * 0.05, -85.7 + rng.uniform(-1, 1) * 0.06) for k in range(40)] + [(90, 43.22, -85.71), (91, 10.0, 10.0), (92, 89.001, 10.5)]

    def far(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    want = {}
    for i, lat, lng in starts:
        near = sorted((far(lat, lng, a, b), n) for n, a, b in nodes if n in ways and far(lat, lng, a, b) <= 5000)[:50]
        if near:
            limit = max(3 * near[0][0], 500)
            fit = [(-ways[n], d, n) for d, n in near if ways[n] >= 3 and d <= limit]
            want[i] = min(fit)[2] if fit else near[0][1]
    got = search.snap(
        spark.createDataFrame(starts, "start_id long, lat double, lng double"), spark.createDataFrame(nodes, "id string, lat double, lng double"), spark.createDataFrame(edges, "from_node string, to_node string")
    )
    assert {r.start_id: r.node for r in got.collect()} == want and 91 not in want


def test_writers_of_the_cache_do_not_meet(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from trailweave.sources.cache import NetworkCache

    c = NetworkCache(spark, f"file://{tmp_path}/c")
    boxes = [{"min_lat": 40.0 + k, "min_lng": -86.0, "max_lat": 41.0 + k, "max_lng": -85.0} for k in range(2)]
    first = c.write(boxes[0], {"t": spark.range(1)})
    held = c.read(first, "t")
    with ThreadPoolExecutor(6) as pool:
        keys = list(pool.map(lambda k: NetworkCache(spark, c.root).write(boxes[k % 2], {"t": spark.range(k + 2)}, k), range(12)))
    rows = c.log().orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 14)) and len({r.version for r in rows}) == 13
    for key in set(keys):
        last = [r for r in rows if r.key == key][-1]
        assert c.read(key, "t").count() == int(last.megabytes) + 2
        assert c.manifest().where(f"key = '{key}'").first().megabytes == last.megabytes
    assert held.count() == 1  # a reader keeps what it has found
    (tmp_path / "c" / "log" / "000000000099.json").touch()  # claimed, not yet written
    assert c.log().count() == 13 and c.manifest().count() == 2
    assert c.vacuum() == 11 and {c.read(k, "t").count() > 0 for k in set(keys)} == {True}
    assert c.remove() == 2 and c.manifest().count() == 0
    with pytest.raises(KeyError):
        c.read(first, "t")


def test_chains_are_greedy_by_order_and_score(spark, town):  # noqa: F811
    """One sequence over all edges, without components: seeds by order, each time the best open continuation."""
    pairs = chains.continuations(town.edges).collect()
    twin = {r.id: r.seq for r in town.edges.collect()}
    name = {v: k for k, v in twin.items()}
    other = {s: twin.get(n[:-1] + {"f": "r", "r": "f"}.get(n[-1], "?")) for s, n in name.items()}
    used, want = set(), {}

    def best(edge, ahead):
        found = [(-p.score, p.b if ahead else p.a) for p in pairs if (p.a if ahead else p.b) == edge and (p.b if ahead else p.a) not in used]
        return min(found)[1] if found else None

    for seed in sorted(name):
        if seed in used:
            continue
        line = [seed]
        used |= {seed, other[seed]}
        for ahead in (True, False):
            while (nxt := best(line[-1 if ahead else 0], ahead)) is not None:
                line.insert(len(line) if ahead else 0, nxt)
                used |= {nxt, other[nxt]}
        want[seed] = [name[s] for s in line]
    got = {}
    for r in chains.build_chains(town.edges).orderBy("chain_id", "pos").collect():
        got.setdefault(r.chain_id, []).append(r.edge_id)
    assert got == want


def test_cores_match_peeling(spark, town):  # noqa: F811
    found = chains.build_chains(town.edges)
    ends = {r.id: (r.from_node, r.to_node) for r in town.edges.where("road_class <> 'service'").collect()}
    near = {}
    for r in found.collect():
        if r.edge_id in ends:
            u, v = ends[r.edge_id]
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    every = set(near)
    while gone := {n for n, x in near.items() if len(x) == 1}:
        near = {n: x - gone for n, x in near.items() if n not in gone}
        near = {n: x for n, x in near.items() if x}
    want = {n: len(near.get(n, ())) for n in every}
    assert {r.node: r.degree for r in chains.core_degrees(found, town.edges).collect()} == want


def test_point_fusion_matches_plain_clusters(spark):
    from tests.test_operators import OBS
    from trailweave.operators import fusion

    rng = random.Random(6)
    rows = []
    for k in range(120):
        c = rng.choice([(42.0, -85.0), (42.0003, -85.0), (42.0, -85.0004)])
        rows.append((k, f"e{k % 3}", "stop-sign", rng.choice(["mapillary", "osm-tag", "x"]), 0.7, None, None, None, c[0] + rng.uniform(-1e-4, 1e-4), c[1] + rng.uniform(-1e-4, 1e-4), rng.choice([0.25, 0.5, 0.75])))
    want = {}
    for e in ("e0", "e1", "e2"):
        own = [r for r in rows if r[1] == e]
        free, clusters = list(own), []
        while free:
            seed = free[0]
            near = [r for r in free if r is seed or math.hypot((seed[9] - r[9]) * 111_320 * math.cos(math.radians((seed[8] + r[8]) / 2)), (seed[8] - r[8]) * 111_320) < 15]
            clusters.append(near)
            free = [r for r in free if r not in near]
        best = max(clusters, key=lambda c: sum(r[10] for r in c))
        n = len(best)
        sure = sum(r[10] for r in best) / n
        want[e] = (sum(r[8] for r in best) / n, sum(r[9] for r in best) / n, min(0.95, sure * 0.5 + min(len({r[3] for r in own}) / 2, 1) * 0.5), len(own))
    got = {r.edge_id: (r.value_lat, r.value_lng, r.confidence, r.n) for r in fusion.fuse_points(spark.createDataFrame(rows, OBS)).collect()}
    assert set(got) == set(want) and all(got[e] == pytest.approx(want[e]) for e in want)


def test_long_dead_ends_go_path_by_path(spark):
    """A square with a dead end of forty segments that forks near its end."""
    square = [(0, 1), (1, 2), (2, 3), (3, 0)]
    tail = [(3, 100), *((100 + k, 101 + k) for k in range(40)), (130, 200), (200, 201)]
    edges = spark.createDataFrame([(f"{a}-{b}", str(a), str(b), "residential") for a, b in square + tail], "id string, from_node string, to_node string, road_class string")
    members = edges.select(F.lit(1).alias("chain_id"), F.lit(0).alias("pos"), F.col("id").alias("edge_id"))
    got = {r.node: r.degree for r in chains.core_degrees(members, edges).collect()}
    assert {n: d for n, d in got.items() if d} == dict.fromkeys("0123", 2) and len(got) == 4 + 41 + 2


def test_service(spark, town, net, tmp_path):  # noqa: F811
    from trailweave import service
    from trailweave.sources.cache import NetworkCache
    from trailweave.sources.responses import ResponseCache

    assert service.radius_km(10_000) == 5 and service.radius_km(100_000) == 39
    tried, waits = [], []

    class Busy(Exception):
        status = 429

    def fetch(query, endpoint):
        tried.append(query)
        if len(tried) < 3:
            raise Busy
        elements = [{"type": "way", "id": 1, "nodes": list(range(10)), "geometry": [{"lat": GRID[k][0], "lon": GRID[k][1]} for k in range(10)], "tags": {"highway": "residential", "name": "x"}}]
        return {"elements": elements}

    assert service.retried(fetch, pause=waits.append)("q", "e")["elements"] and waits == [2.0, 5.0]
    with pytest.raises(KeyError):
        service.retried(lambda q, e: {}["x"], pause=waits.append)("q", "e")
    regions = service.Regions(spark, NetworkCache(spark, f"file://{tmp_path}/n"), ResponseCache(f"file://{tmp_path}/r"), fetch, by_tier=dict.fromkeys(chains.MIN_LENGTH_M, 300.0))
    n = len(tried)
    first = regions.at(42.9, -85.7, 5000.0)
    assert first.graph.edges.count() == 2 and len(tried) == n + 1
    assert regions.at(42.9001, -85.7, 4000.0).graph.edges.count() == 2 and len(tried) == n + 1
    with pytest.raises(service.RequestError):
        service.network_answer(net, "flying")
    assert service.status_of(service.RequestError("x", 404)) == 404 and service.status_of(ValueError()) == 422 and service.status_of(KeyError()) == 500
    assert service.network_answer(net, "walking").count() == net.corridors.count()
    starts = spark.createDataFrame([(1, 42.902, -85.696, 600.0, 2500.0, 90.0, "moderate", 3)], "request_id long, lat double, lng double, min_m double, max_m double, direction double, turns string, seed long")
    stats, features = service.route_answers(starts, service.Region(town, net, {}), "walking", noise=0.0)
    row, lines = stats.first(), features.collect()
    summary = next(json.loads(r.feature)["properties"] for r in lines if r.segment is None)
    assert summary["isSegment"] is False and summary["distanceMeters"] == round(row.distance_m) and summary["segmentCount"] == len(lines) - 1
    assert service.health(spark)["status"] == "ok"
