"""What a route service asks of the engine: regions built on demand, networks as features, routes as answers."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import scoring
from trailweave.functions.compat import ChainOptions
from trailweave.operators import elevation, export, search
from trailweave.operators.corridors import Network, build_network
from trailweave.operators.iterate import settled
from trailweave.operators.location import boxes
from trailweave.operators.street_graph import Graph
from trailweave.sources import ingest
from trailweave.sources.cache import NetworkCache
from trailweave.sources.files import write_bytes
from trailweave.sources.overpass import query_text
from trailweave.sources.providers import Provider, enriched
from trailweave.sources.responses import ENDPOINT, Fetch, ResponseCache

LEAST_RADIUS_KM, BUFFER_KM, DELAYS_S = 5.0, 5.0, (2.0, 5.0, 10.0)
_PARTS = ("nodes", "edges", "corridors", "connectors", "entity_edges", "adjacency")


class RequestError(ValueError):
    """A request that cannot be served; ``status`` is what a service answers."""

    def __init__(self, text: str, status: int = 422):
        super().__init__(text)
        self.status = status


def status_of(error: Exception) -> int:
    """The status a service answers an error with: its own, 422 for a value that is none, else 500."""
    return getattr(error, "status", 422 if isinstance(error, ValueError) else 500)


def radius_km(most_m: float) -> float:
    """How far a loop of a length reaches: that of a circle and a fifth more, 5 km at least."""
    return max(LEAST_RADIUS_KM, math.ceil(most_m / 1000 / math.pi * 1.2))


def retried(fetch: Fetch, delays: Sequence[float] = DELAYS_S, pause: Callable[[float], None] = time.sleep) -> Fetch:
    """``fetch`` that is tried again after each delay while it fails with a status of 429 or above."""

    def run(query: str, endpoint: str) -> dict:
        for delay in [*delays, None]:
            try:
                return fetch(query, endpoint)
            except Exception as e:
                if delay is None or getattr(e, "status", 0) < 429:
                    raise
                pause(delay)
        raise AssertionError

    return run


@dataclass(frozen=True)
class Region:
    graph: Graph
    network: Network
    box: dict[str, float]


class Regions:
    """Networks by place: from the cache, else built from a fetched response, tiles and providers."""

    def __init__(
        self,
        spark: SparkSession,
        cache: NetworkCache,
        responses: ResponseCache,
        fetch: Fetch,
        tiles: DataFrame | str | None = None,
        providers: Sequence[Provider] = (),
        options: ChainOptions | None = None,
        by_tier: dict[str, float] | None = None,
    ):
        self.spark, self.cache, self.responses, self.fetch = spark, cache, responses, fetch
        self.tiles, self.providers, self.options, self.by_tier = tiles, providers, options, by_tier

    def at(self, lat: float, lng: float, most_m: float) -> Region:
        radius = radius_km(most_m)
        _, wide = boxes(self.spark, lat, lng, radius, BUFFER_KM)
        key = self.cache.find(lat, lng, radius)
        if key is None:
            key = self._built(wide)
        t = {name: self.cache.read(key, name) for name in _PARTS}
        return Region(Graph(t["nodes"], t["edges"]), Network(t["corridors"], t["connectors"], t["entity_edges"], t["adjacency"]), wide)

    def _built(self, wide: dict[str, float]) -> str:
        tile = f"{self.responses.root}/region-{self.cache.key(wide)}.json"
        query = query_text(wide["min_lat"], wide["min_lng"], wide["max_lat"], wide["max_lng"])
        write_bytes(tile, json.dumps(retried(self.fetch)(query, ENDPOINT)).encode())
        graph = ingest.from_overpass(self.spark, tile)
        if self.tiles is not None:
            graph = with_elevation(graph, self.tiles)
        if self.providers:
            graph = enriched(graph, self.providers, wide).graph
        network = build_network(graph, self.options, self.by_tier)
        tables = [graph.nodes, graph.edges, network.corridors, network.connectors, network.entity_edges, network.adjacency]
        return self.cache.write(wide, dict(zip(_PARTS, tables, strict=True)))


def with_elevation(graph: Graph, tiles: DataFrame | str) -> Graph:
    """The graph with the climbs of its edges, from a folder of tile files or ``tiles(tile, content)``."""
    places = graph.edges.select(F.explode("geometry").alias("p")).select("p.lat", "p.lng").distinct()
    points = places.withColumn("point_id", F.xxhash64("lat", "lng"))
    found = elevation.heights_of_files(points, tiles) if isinstance(tiles, str) else elevation.heights(points, tiles)
    return Graph(graph.nodes, elevation.with_climbs(graph.edges, found))


def network_answer(network: Network, activity: str, types: tuple[str, ...] | None = None, min_length_m: float | None = None, connectors: bool = False) -> DataFrame:
    """``id, feature`` of a network scored for an activity."""
    if activity not in scoring.ACTIVITIES:
        raise RequestError(f"no activity {activity}; there are {', '.join(scoring.ACTIVITIES)}")
    scores = scoring.score_corridors(network.corridors, {activity: scoring.defaults(activity)})
    return export.network_features(network, scores, types, min_length_m, connectors)


def route_answers(starts: DataFrame, region: Region, activity: str, params: dict | None = None, noise: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Statistics and features of the loops for ``starts(request_id, lat, lng, min_m, max_m, direction, turns,
    seed)``; a request without a loop has no row in either."""
    if activity not in scoring.ACTIVITIES:
        raise RequestError(f"no activity {activity}; there are {', '.join(scoring.ACTIVITIES)}")
    p = dict(params or scoring.defaults(activity))
    p["weights"] = scoring.normalized(p["weights"])
    scores = scoring.score_corridors(region.network.corridors, {activity: p})
    loops = settled(search.loop_routes(starts, region.network, region.graph, scores, activity, noise), "loops")
    runs = settled(search.segments(loops, region.network, region.graph), "runs")
    stats = search.route_stats(runs, region.network.corridors)
    return stats, export.route_features(runs, region.network.corridors, stats)


def health(spark: SparkSession) -> dict[str, str]:
    return {"status": "ok", "engine": spark.version}
