"""Corridors and connectors from chains: attributes, types, who touches whom."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import geo
from trailweave.functions.compat import ChainOptions
from trailweave.functions.numbers import share
from trailweave.operators import chains as C
from trailweave.operators.iterate import settled
from trailweave.operators.joins import shuffled
from trailweave.operators.lines import simplified
from trailweave.operators.street_graph import Graph

MAJOR = ("primary", "secondary", "trunk")


@dataclass(frozen=True)
class Network:
    """``corridors`` and ``connectors``, their edges (``id, pos, edge_id``), and ``adjacency(a, b)``."""

    corridors: DataFrame
    connectors: DataFrame
    entity_edges: DataFrame
    adjacency: DataFrame


def predominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``: of each group the value of the largest summed length, the first among equals."""
    by = rows.groupBy(key, value).agg(F.sum("length_m").alias("m"), F.min("pos").alias("first"))
    return by.groupBy(key).agg(F.max_by(value, F.struct("m", -F.col("first"))).alias(value))


def roll_up(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Attributes of each group of ``members(id, pos, edge_id)``: lengths, shares, densities, turns, hills."""
    out_degree = edges.groupBy(F.col("from_node").alias("node")).agg(F.count("*").alias("out"))
    rows = members.select(F.col("id").alias("gid"), "pos", "edge_id").join(shuffled(edges), F.col("edge_id") == edges["id"]).drop("id").withColumnRenamed("gid", "id")
    order = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("leaves", geo.exit_bearing(F.col("geometry"))).withColumn("turned", geo.turn(F.lag("leaves").over(order), geo.entry_bearing(F.col("geometry"))))
    # one table for the sums, the ends and the predominant values
    rows = settled(rows.drop("geometry", "leaves", "edge_id"), "roll-up")
    m, grade = F.col("length_m"), F.abs(F.coalesce("average_grade", F.lit(0.0)))
    high = F.col("elevation_gain").isNotNull()
    part = lambda test: F.sum(F.when(test, m).otherwise(0.0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    summed = rows.groupBy("id").agg(
        F.sum(m).alias("length_m"),
        F.count("*").alias("edge_count"),
        F.sum(F.col("surface_confidence") * m).alias("_surface"),
        *[part(F.col(f"{a}")).alias(f"_{b}") for a, b in _SHARES.items()],
        F.sum(F.col("speed_limit") * m).alias("_speed"),
        part(F.col("speed_limit").isNotNull()).alias("_speed_m"),
        F.sum(n("stop_sign_count") + n("traffic_signal_count") + n("road_crossing_count")).alias("_stops"),
        F.count_if(F.col("turned") > 30).alias("turns"),
        F.sum("elevation_gain").alias("elevation_gain"),
        F.sum(F.when(high, F.coalesce("elevation_loss", F.lit(0.0)))).alias("elevation_loss"),
        F.sum(F.when(high, grade * m)).alias("_grade"),
        F.sum(F.when(high, grade * grade * m)).alias("_grade2"),
        F.sum(F.when(high, m)).alias("_grade_m"),
        F.max(F.when(high, F.greatest(F.coalesce("max_grade", F.lit(0.0)), F.lit(0.0)))).alias("max_grade"),
        F.min_by("one_way", "pos").alias("one_way"),
        F.min_by("from_node", "pos").alias("start_node"),
        F.max_by("to_node", "pos").alias("end_node"),
    )
    ends = rows.select("id", F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    busy = ends.join(shuffled(out_degree.where("out > 2")), "node").groupBy("id").agg(F.count("*").alias("_busy"))
    whole = summed.join(shuffled(busy), "id", "left").join(shuffled(predominant(rows, "id", "road_class")), "id").join(shuffled(predominant(rows, "id", "surface")), "id")
    km = F.col("length_m") / 1000
    mean = F.col("_grade") / F.col("_grade_m")
    spread = F.sqrt(F.greatest(F.col("_grade2") / F.col("_grade_m") - mean * mean, F.lit(0.0)))
    climbs = (F.col("elevation_gain") + F.col("elevation_loss")) / 2 / km
    known = F.col("_grade_m") > 0
    return whole.select(
        "id",
        "length_m",
        "edge_count",
        "road_class",
        "surface",
        share(F.col("_surface"), F.col("length_m")).alias("surface_confidence"),
        *[share(F.col(f"_{b}"), F.col("length_m")).alias(b) for b in _SHARES.values()],
        F.when(F.col("_speed_m") > 0, F.col("_speed") / F.col("_speed_m")).alias("average_speed_limit"),
        share(F.col("_stops"), km).alias("stop_density"),
        share(F.coalesce("_busy", F.lit(0)), km).alias("crossing_density"),
        F.col("turns").cast("long").alias("turns"),
        "elevation_gain",
        "elevation_loss",
        F.when(known, mean).alias("average_grade"),
        "max_grade",
        F.when(known, 0.7 * F.least(F.lit(1.0), climbs / 100) + 0.3 * F.least(F.lit(1.0), spread / 8)).alias("hilliness"),
        "one_way",
        "start_node",
        "end_node",
    )


_SHARES = {
    "has_bicycle_infra": "bicycle_infra_continuity",
    "has_pedestrian_path": "pedestrian_path_continuity",
    "is_separated": "separation_continuity",
    "has_traffic_calming": "traffic_calming_continuity",
    "scenic": "scenic_score",
}


def confidences(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, confidence``: for groups with an enriched edge a struct of length-weighted confidences,
    0 where an aspect has none; edges without enrichment are left out of it."""
    aspects = {
        "surface": ("surface",),
        "speed_limit": ("speed-limit",),
        "traffic_control": ("stop-sign", "traffic-signal", "road-crossing"),
        "infrastructure": ("bicycle-infra", "traffic-calming"),
        "scenic": ("scenic",),
        "elevation": (),
    }
    rows = members.select(F.col("id").alias("gid"), "edge_id").join(shuffled(edges.where("enrichment is not null")), F.col("edge_id") == edges["id"])

    def value(names: tuple[str, ...]) -> Column:
        if not names:
            return F.when(F.col("elevation_gain").isNotNull(), F.lit(0.9))
        return F.array_max(F.array(*[F.try_element_at("enrichment", F.lit(n)) for n in names]))

    weighted = rows.select("gid", "length_m", *[value(n).alias(k) for k, n in aspects.items()]).groupBy("gid").agg(
        *[
            F.coalesce(F.sum(F.col(k) * F.col("length_m")) / F.sum(F.when(F.col(k).isNotNull() & (F.col("length_m") > 0), F.col("length_m"))), F.lit(0.0)).alias(k)
            for k in aspects
        ]
    )
    return weighted.select(F.col("gid").alias("id"), F.struct(*aspects).alias("confidence"))


def corridor_type() -> Column:
    """Type by class, separation, speed and density, the first rule that holds."""
    klass = F.col("road_class")
    quiet = klass.isin("residential", "unclassified", "service") & (F.col("average_speed_limit").isNull() | (F.col("average_speed_limit") <= 40))
    rural = (
        (F.col("crossing_density") < 4)
        & (F.col("stop_density") < 2)
        & (F.col("pedestrian_path_continuity") < 0.3)
        & (F.col("traffic_calming_continuity") < 0.3)
    )
    return (
        F.when(klass.isin("cycleway", "path") & (F.col("separation_continuity") > 0.7), "trail")
        .when(klass.isin("footway", "path"), "path")
        .when(klass.isin("primary", "trunk", "motorway"), "arterial")
        .when(klass.isin("secondary", "tertiary"), "collector")
        .when(quiet & rural, "rural-road")
        .when(quiet, "neighborhood")
        .otherwise("mixed")
    )


def geometries(members: DataFrame, edges: DataFrame, tolerance_m: float = 10.0) -> DataFrame:
    """``id, geometry``: the edges' lines end to end, simplified."""
    rows = members.select(F.col("id").alias("gid"), "pos", "edge_id").join(shuffled(edges.select("id", "geometry")), F.col("edge_id") == F.col("id"))
    lines = rows.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pos", "geometry"))).alias("lines"))
    whole = lines.select(F.col("gid").alias("id"), geo.joined(F.transform("lines", lambda x: x["geometry"])).alias("geometry"))
    return whole.select("id", simplified(F.col("geometry"), tolerance_m).alias("geometry"))


def connector_attributes(members: DataFrame, graph: Graph) -> DataFrame:
    """``id, length_m, crosses_major, has_signal, has_stop, difficulty`` of each group."""
    rows = members.select(F.col("id").alias("gid"), "pos", "edge_id").join(shuffled(graph.edges), F.col("edge_id") == graph.edges["id"]).drop("id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    summed = rows.groupBy(F.col("gid").alias("id")).agg(
        F.sum("length_m").alias("length_m"),
        F.bool_or(F.col("road_class").isin(*MAJOR)).alias("crosses_major"),
        F.bool_or(n("traffic_signal_count")).alias("signal"),
        F.bool_or(n("stop_sign_count") | n("road_crossing_count")).alias("stop"),
        F.min_by("from_node", "pos").alias("start_node"),
        F.max_by("to_node", "pos").alias("end_node"),
    )
    flags = graph.nodes.select(F.col("id").alias("node"), F.col("has_signal").alias("s"), (F.col("has_stop") | F.col("is_crossing")).alias("t"))
    for end in ("start_node", "end_node"):
        summed = (
            summed.join(shuffled(flags.withColumnRenamed("node", end)), end, "left")
            .withColumn("signal", F.col("signal") | F.coalesce("s", F.lit(False)))
            .withColumn("stop", F.col("stop") | F.coalesce("t", F.lit(False)))
            .drop("s", "t")
        )
    return summed.select(
        "id",
        "length_m",
        "crosses_major",
        F.col("signal").alias("has_signal"),
        F.col("stop").alias("has_stop"),
        connector_difficulty().alias("difficulty"),
        "start_node",
        "end_node",
    )


def connector_difficulty() -> Column:
    """0.1; by a major road 0.7, 0.3 with a signal; else 0.2 by a stop, 0.15 by a signal."""
    return (
        F.when(F.col("crosses_major"), F.when(F.col("signal"), 0.3).otherwise(0.7)).when(F.col("stop"), 0.2).when(F.col("signal"), 0.15).otherwise(0.1)
    )


def adjacency(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b``: ordered pairs of different groups that share a node.

    A node's groups are few (they need an edge there), so the self-join on the node is linear.
    """
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array("from_node", "to_node")).alias("node"))
    at = members.select("id", "edge_id").join(shuffled(ends), "edge_id").select("id", "node").distinct()
    return at.select(F.col("id").alias("a"), "node").join(shuffled(at.select(F.col("id").alias("b"), "node")), "node").where("a <> b").select("a", "b").distinct()


def build_network(graph: Graph, options: ChainOptions | None = None, by_tier: dict[str, float] | None = None) -> Network:
    """Corridors (chains long enough, and destinations) and the connectors that join them."""
    edges = graph.edges
    chains, saved = C.trimmed_chains(C.build_chains(edges, options), edges)
    sized = C.min_lengths(chains, edges, options, by_tier)
    long_ = settled(sized.select("chain_id", (F.col("length_m") >= F.col("min_length_m")).alias("is_corridor")), "sized")
    kinds = long_.select("chain_id", "is_corridor", F.lit(False).alias("is_destination")).unionByName(
        saved.select("chain_id").distinct().select("chain_id", F.lit(True).alias("is_corridor"), F.lit(True).alias("is_destination"))
    )
    prefix = F.when(F.col("is_corridor"), "corridor-").otherwise("connector-")
    named = kinds.withColumn("id", F.concat(prefix, F.col("chain_id").cast("string")))
    members = settled(
        chains.unionByName(saved).join(shuffled(named), "chain_id").select("id", "pos", "edge_id", "is_corridor", "is_destination"), "members"
    )
    near = settled(adjacency(members, edges), "adjacency")
    is_corridor = members.select("id", "is_corridor", "is_destination").distinct()
    links = (
        near.join(shuffled(is_corridor.where("NOT is_corridor").select(F.col("id").alias("a"))), "a", "left_semi")
        .join(shuffled(is_corridor.where("is_corridor").select(F.col("id").alias("b"), "is_destination")), "b")
        .groupBy(F.col("a").alias("id"))
        .agg(F.array_sort(F.collect_set("b")).alias("corridor_ids"), F.bool_or("is_destination").alias("to_destination"))
    )
    linked = links.where((F.size("corridor_ids") >= 2) | F.col("to_destination"))
    own = members.where("is_corridor")
    rolled = roll_up(own, edges)
    names = C.name_shares(own.select(F.col("id").alias("chain_id"), "pos", "edge_id"), edges).withColumnRenamed("chain_id", "id")
    corridors = (
        rolled.withColumn("type", corridor_type())
        .join(shuffled(names.select("id", "name")), "id")
        .join(shuffled(geometries(own, edges)), "id")
        .join(shuffled(is_corridor.select("id", "is_destination")), "id")
    )
    if "enrichment" in edges.columns:
        corridors = corridors.join(shuffled(confidences(own, edges)), "id", "left")
    else:
        none = "struct<surface:double,speed_limit:double,traffic_control:double,infrastructure:double,scenic:double,elevation:double>"
        corridors = corridors.withColumn("confidence", F.lit(None).cast(none))
    joining = members.where("NOT is_corridor").join(shuffled(linked.select("id")), "id", "left_semi")
    connectors = connector_attributes(joining, graph).join(shuffled(linked.select("id", "corridor_ids")), "id").join(shuffled(geometries(joining, edges)), "id")
    alive = own.select("id").union(joining.select("id")).distinct()
    kept = near.join(shuffled(alive.withColumnRenamed("id", "a")), "a", "left_semi").join(shuffled(alive.withColumnRenamed("id", "b")), "b", "left_semi")
    entity_edges = own.select("id", "pos", "edge_id").unionByName(joining.select("id", "pos", "edge_id"))
    return Network(corridors, connectors, entity_edges, kept)


def network_stats(network: Network) -> DataFrame:
    """One row: corridors, connectors, total and mean length of corridors."""
    c = network.corridors.agg(
        F.count("*").alias("corridors"), F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("total_m"), F.coalesce(F.avg("length_m"), F.lit(0.0)).alias("mean_m")
    )
    return c.crossJoin(network.connectors.agg(F.count("*").alias("connectors")))  # one row each
