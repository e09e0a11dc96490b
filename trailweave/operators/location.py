"""A network around a place: built from a box with a margin, cut back to what touches the box."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions import geo
from trailweave.functions.compat import ChainOptions
from trailweave.operators.corridors import Network, build_network
from trailweave.operators.iterate import settled
from trailweave.operators.joins import shuffled
from trailweave.operators.street_graph import Graph

BUFFER_KM = 2.0


def boxes(spark, lat: float, lng: float, radius_km: float, buffer_km: float = BUFFER_KM) -> tuple[dict[str, float], dict[str, float]]:
    """The box around a place, and the same with a margin."""
    core = geo.box_around(F.lit(lat), F.lit(lng), F.lit(radius_km))
    wide = geo.box_grown(core, F.lit(buffer_km))
    row = spark.range(1).select(*[v.alias(f"c_{k}") for k, v in core.items()], *[v.alias(f"w_{k}") for k, v in wide.items()]).first()
    return {k: row[f"c_{k}"] for k in core}, {k: row[f"w_{k}"] for k in wide}


def within_box(network: Network, box: dict[str, float]) -> Network:
    """Corridors with a point in the box, connectors of at least one of them, and the links among these.

    What is kept of corridors and connectors is written once; all else is looked up by their ids."""
    bounds = {k: F.lit(float(v)) for k, v in box.items()}
    own = settled(network.corridors.where(geo.touches_box(F.col("geometry"), bounds)), "own")
    ids = own.select("id")
    living = (
        network.connectors.select("id", F.posexplode("corridor_ids").alias("k", "c"))
        .join(shuffled(ids.withColumnRenamed("id", "c")), "c", "left_semi")
        .groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("corridor_ids"))
    )
    joining = settled(network.connectors.drop("corridor_ids").join(shuffled(living), "id").select(network.connectors.columns), "joining")
    alive = ids.unionByName(joining.select("id"))
    links = network.adjacency.join(shuffled(alive.withColumnRenamed("id", "a")), "a", "left_semi").join(shuffled(alive.withColumnRenamed("id", "b")), "b", "left_semi")
    return Network(own, joining, network.entity_edges.join(shuffled(alive), "id", "left_semi"), links.select("a", "b"))


def location_stats(network: Network) -> DataFrame:
    """One row: corridors, connectors, destinations, mean and total length of corridors."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = network.corridors.agg(
        F.count("*").alias("corridors"),
        F.count_if("is_destination").alias("destinations"),
        zero(F.avg("length_m")).alias("mean_m"),
        zero(F.sum("length_m")).alias("total_m"),
    )
    return c.crossJoin(network.connectors.agg(F.count("*").alias("connectors")))  # one row each


def build_for_location(
    spark, load: Callable[[dict[str, float]], Graph], lat: float, lng: float, radius_km: float, buffer_km: float = BUFFER_KM, options: ChainOptions | None = None
) -> tuple[Network, DataFrame]:
    """The network around a place, and its statistics; ``load`` gives the graph of a box."""
    core, wide = boxes(spark, lat, lng, radius_km, buffer_km)
    network = within_box(build_network(load(wide), options), core)
    return network, location_stats(network)
