"""Observations matched to edges: by way id, by nearest edge, or along a line.

Edges are indexed by the grid cells of their points, and an observed point looks at the nine
cells around its own, so both sides meet in an equi-join on the cell and nothing is compared
with everything. A crowded cell is split by AQE's skew handling, as the join's sides are plain
shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions import geo
from trailweave.operators.joins import shuffled

RADIUS_M, CELL_M = 50.0, 100.0


def mean_latitude(nodes: DataFrame) -> float:
    """Mean latitude of a graph's nodes, at which the grid is scaled; 0 without nodes."""
    return nodes.agg(F.avg("lat")).first()[0] or 0.0


def edge_cells(edges: DataFrame, mean_lat: float) -> DataFrame:
    """``cx, cy, edge_id, seq, geometry``: a row for each edge and cell that one of its points is in."""
    cells = F.transform("geometry", lambda p: F.struct(*[c.alias(n) for c, n in zip(geo.cell(p["lat"], p["lng"], F.lit(mean_lat), CELL_M), ("cx", "cy"), strict=True)]))
    return edges.select(F.col("id").alias("edge_id"), F.col("seq").alias("edge_seq"), "geometry", F.explode(F.array_distinct(cells)).alias("c")).select(
        "c.cx", "c.cy", "edge_id", "edge_seq", "geometry"
    )


def _around(points: DataFrame, mean_lat: float) -> DataFrame:
    x, y = geo.cell(F.col("lat"), F.col("lng"), F.lit(mean_lat), CELL_M)
    near = F.array(*[F.struct((x + i).alias("cx"), (y + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return points.select("*", F.explode(near).alias("c")).select(*points.columns, "c.cx", "c.cy")


def _within(points: DataFrame, edges: DataFrame, mean_lat: float) -> DataFrame:
    """``points`` joined with the edges less than 50 m away, and ``distance``.

    Cells pair ids only; a pair's line is fetched once, however many cells the two share.
    """
    cos_lat = F.cos(F.radians(F.lit(mean_lat)))
    pairs = _around(points, mean_lat).join(shuffled(edge_cells(edges, mean_lat).drop("geometry")), ["cx", "cy"]).drop("cx", "cy").distinct()
    lines = edges.select(F.col("id").alias("edge_id"), "geometry")
    return (
        pairs.join(shuffled(lines), "edge_id")
        .withColumn("distance", geo.line_distance(F.col("lat"), F.col("lng"), F.col("geometry"), cos_lat))
        .where(F.col("distance") < RADIUS_M)
        .drop("geometry")
    )


def nearest_edges(points: DataFrame, edges: DataFrame, mean_lat: float) -> DataFrame:
    """``obs_id, edge_id, distance``: the nearest edge of each ``points(obs_id, lat, lng)``, the
    first edge among those as near to a micrometre; points with no edge within 50 m are left out."""
    near = _within(points.select("obs_id", "lat", "lng"), edges, mean_lat)
    return near.groupBy("obs_id").agg(F.min_by(F.struct("edge_id", "distance"), F.struct(F.round("distance", 6), "edge_seq")).alias("m")).select(
        "obs_id", "m.edge_id", "m.distance"
    )


def line_edges(lines: DataFrame, edges: DataFrame, mean_lat: float) -> DataFrame:
    """``obs_id, edge_id``: all edges less than 50 m from a point of ``lines(obs_id, geometry)``."""
    points = lines.select("obs_id", F.explode("geometry").alias("p")).select("obs_id", "p.lat", "p.lng")
    return _within(points, edges, mean_lat).select("obs_id", "edge_id").distinct()


def way_edges(observations: DataFrame, edges: DataFrame) -> DataFrame:
    """``obs_id, edge_id``: all edges of the way that an observation names."""
    return observations.where("osm_way_id is not null").select("obs_id", "osm_way_id").join(
        shuffled(edges.select(F.col("id").alias("edge_id"), "osm_way_id")), "osm_way_id"
    ).select("obs_id", "edge_id")


def match(observations: DataFrame, edges: DataFrame, mean_lat: float) -> DataFrame:
    """``obs_id, edge_id`` of ``observations(obs_id, osm_way_id, geometry)``: by way id where an edge
    has it, else one point to its nearest edge, else along the line; the rest matches nothing."""
    by_way = way_edges(observations, edges)
    rest = observations.join(shuffled(by_way.select("obs_id").distinct()), "obs_id", "left_anti")
    single = rest.where(F.size("geometry") == 1).select("obs_id", F.col("geometry")[0]["lat"].alias("lat"), F.col("geometry")[0]["lng"].alias("lng"))
    return by_way.unionByName(nearest_edges(single, edges, mean_lat).select("obs_id", "edge_id")).unionByName(
        line_edges(rest.where(F.size("geometry") > 1), edges, mean_lat)
    )
