"""From map files to a street graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.operators.iterate import settled
from trailweave.operators.street_graph import Graph, build_graph, build_stats
from trailweave.sources import overpass, pbf


def _of_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and relevant ways; a path that workers cannot open by URI is read through Spark."""
    scheme = path.split("://")[0] if "://" in path else "file"
    if scheme in ("file", "hdfs", "s3", "gs", "gcs", "abfs"):
        return pbf.two_passes(spark, path)
    elements = pbf.whole_files(spark, path)
    return pbf.nodes_of(elements), settled(pbf.ways_of(elements), "ways")


def from_pbf(spark: SparkSession, path: str) -> Graph:
    """The graph of a PBF file."""
    return build_graph(*_of_pbf(spark, path))


def from_overpass(spark: SparkSession, path: str | list[str]) -> Graph:
    """The graph of saved Overpass responses."""
    elements = overpass.read_responses(spark, path)
    return build_graph(overpass.nodes_of(elements), overpass.ways_of(elements))


def ingest(spark: SparkSession, path: str | list[str]) -> tuple[Graph, DataFrame]:
    """The graph of a file by its kind (``.json`` or ``.pbf``), and one row of statistics."""
    first = path if isinstance(path, str) else path[0]
    if first.endswith(".pbf"):
        nodes, ways = _of_pbf(spark, first)
    else:
        elements = overpass.read_responses(spark, path)
        nodes, ways = overpass.nodes_of(elements), settled(overpass.ways_of(elements), "ways")
    return (g := build_graph(nodes, ways)), build_stats(g, ways)
