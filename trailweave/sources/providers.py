"""Providers of observations, and enrichment that goes on without those that fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.tiles import sub_boxes
from trailweave.operators import fusion, matching
from trailweave.operators.iterate import settled
from trailweave.operators.street_graph import Graph
from trailweave.sources import detections, surface

#: Numbers that a box's features have to themselves; no answer is as long.
BOX = 1 << 24

#: Columns of observations, with their types.
COLUMNS = {
    "seq": "long",
    "osm_way_id": "string",
    "geometry": "array<struct<lat:double,lng:double>>",
    "attribute": "string",
    "source": "string",
    "confidence": "double",
    "v_str": "string",
    "v_num": "double",
    "v_bool": "boolean",
    "v_lat": "double",
    "v_lng": "double",
    "v_conf": "double",
}


@runtime_checkable
class Provider(Protocol):
    """A source of observations: where they come from, what they tell, and those of a box."""

    name: str
    source: str
    provides: tuple[str, ...]

    def observations(self, spark: SparkSession, box: dict[str, float]) -> DataFrame: ...


@dataclass
class SurfaceProvider:
    """Predicted surfaces of ways in a Parquet extract."""

    path: str
    name: str = "surface predictions"
    source: str = "mapillary"
    provides: tuple[str, ...] = ("surface",)

    def observations(self, spark: SparkSession, box: dict[str, float]) -> DataFrame:
        return surface.observations(surface.predicted_surfaces(spark, self.path, box)).withColumn("seq", F.col("osm_way_id").cast("long"))


@dataclass
class DetectionProvider:
    """Map features of a web service; ``fetch`` gives a box's features as dictionaries.

    The area is cut into boxes, which tasks fetch: ``lanes`` tasks, each of which waits ``lanes`` times
    ``delay_s`` between its requests and starts in its turn, so all of them together make one
    request each ``delay_s``. A box that fails is tried again alone, after each of ``pauses_s``; one that
    still fails fails the scan, as boxes left out would look like places without features. ``seq`` orders
    features by box and then by place in its answer. Each action on the result asks anew, so settle it.
    """

    fetch: Callable[[dict[str, float]], Sequence[dict]]
    degrees: float = 0.01
    delay_s: float = 0.0
    lanes: int = 4
    pauses_s: tuple[float, ...] = (1.0, 5.0)
    name: str = "detections"
    source: str = "mapillary"
    provides: tuple[str, ...] = ("stop-sign", "traffic-signal", "road-crossing")

    def boxes(self, spark: SparkSession, box: dict[str, float]) -> DataFrame:
        """``k, min_lat, max_lat, min_lng, max_lng``: the requests to make, numbered row by row."""
        cut = sub_boxes({k: F.lit(float(v)) for k, v in box.items()}, self.degrees)
        return spark.range(1).select(F.posexplode(cut).alias("k", "b")).select(F.col("k").cast("long"), "b.*")

    def observations(self, spark: SparkSession, box: dict[str, float]) -> DataFrame:
        fetch, lanes, delay, pauses = self.fetch, self.lanes, self.delay_s, self.pauses_s

        def asked(part: dict[str, float]) -> Sequence[dict]:
            for pause in pauses:
                try:
                    return fetch(part)
                except Exception:  # what it was shows when the last attempt fails
                    time.sleep(pause)
            return fetch(part)

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wait = delay * TaskContext.get().partitionId() % (delay * lanes) if delay else 0
            for parts in batches:
                for part in parts.to_dict("records"):
                    time.sleep(wait)
                    wait = delay * lanes
                    k = int(part.pop("k"))
                    rows = [(k * BOX + i, f["object_value"], *map(float, f["geometry"]["coordinates"][:2]), f.get("last_seen_at")) for i, f in enumerate(asked(part))]
                    yield pd.DataFrame(rows, columns=["seq", "object_value", "lng", "lat", "last_seen_at"])

        found = self.boxes(spark, box).repartition(lanes).mapInPandas(features, "seq long, object_value string, lng double, lat double, last_seen_at string")
        return detections.observations(found)


def shaped(observations: DataFrame) -> DataFrame:
    """``observations`` with all of ``COLUMNS``, null where it lacks one."""
    return observations.select(*[(F.col(c) if c in observations.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


@dataclass(frozen=True)
class Enriched:
    """A graph with fused values, what each provider brought, and how often each attribute was set."""

    graph: Graph
    matched: DataFrame
    providers: DataFrame
    attributes: DataFrame


def enriched(graph: Graph, providers: Sequence[Provider], box: dict[str, float], before: DataFrame | None = None) -> Enriched:
    """Observations of all providers matched to edges, fused with those of ``before(edge_id, ...)``, and written back.

    A provider that fails counts no observations and holds up nothing.
    """
    spark, rows, stats = graph.edges.sparkSession, before, []
    mean = matching.mean_latitude(graph.nodes)
    offset = (before.agg(F.max("seq")).first()[0] or 0) + 1 if before is not None else 0
    for p in providers:
        try:
            own = settled(shaped(p.observations(spark, box)), "observations")
            n = own.count()
        except Exception:  # whatever goes wrong at a provider is its own
            stats.append((p.name, p.source, 0, 0, True))
            continue
        own = own.withColumn("seq", F.col("seq") + offset)
        offset += (own.agg(F.max("seq")).first()[0] or offset) + 1 - offset
        pairs = matching.match(own.select(F.col("seq").alias("obs_id"), "osm_way_id", "geometry"), graph.edges, mean)
        found = settled(own.join(pairs.withColumnRenamed("obs_id", "seq"), "seq"), "matched")
        stats.append((p.name, p.source, n, found.select("edge_id").distinct().count(), False))
        found = found.select("edge_id", *COLUMNS)
        rows = found if rows is None else rows.unionByName(found)
    counts = spark.createDataFrame(stats, "provider string, source string, observations long, edges long, failed boolean")
    if rows is None:
        none = spark.createDataFrame([], "attribute string, edges long, conflicts long")
        return Enriched(graph, spark.createDataFrame([], "edge_id string"), counts, none)
    fused = settled(fusion.fuse(rows), "fused")
    by = fused.groupBy("attribute").agg(F.count("*").alias("edges"), F.count_if("has_conflict").alias("conflicts"))
    return Enriched(Graph(graph.nodes, fusion.write_back(graph.edges, fused)), rows, counts, by)
