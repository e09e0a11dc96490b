"""Reports on a graph and its network: figures as rows, and the same as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.numbers import round_half_up, share
from trailweave.operators.corridors import Network
from trailweave.operators.ranks import at_fractions
from trailweave.operators.street_graph import Graph, coverage, distribution

SPREADS = {"length_m": "Length (m)", "surface_confidence": "Surface confidence", "turns": "Turns count"}
SHARES = {
    "bicycle_infra_continuity": "Bicycle infra continuity",
    "pedestrian_path_continuity": "Pedestrian path continuity",
    "separation_continuity": "Separation continuity",
    "traffic_calming_continuity": "Traffic calming continuity",
    "scenic_score": "Scenic score",
    "stop_density": "Stop density (/km)",
    "crossing_density": "Crossing density (/km)",
}


def corridor_spreads(corridors: DataFrame) -> DataFrame:
    """``attribute, mean, least, most, p50``: length, surface confidence and turns."""
    out = None
    for c in SPREADS:
        rows = corridors.select(F.col(c).cast("double").alias("v"))
        row = rows.agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")).crossJoin(at_fractions(rows, "v", {"p50": 0.5}))  # one row each
        row = row.select(F.lit(c).alias("attribute"), "mean", "least", "most", "p50")
        out = row if out is None else out.unionByName(row)
    return out


def corridor_shares(corridors: DataFrame) -> DataFrame:
    """``attribute, mean, n, share``: of continuities and densities the mean, how many are above 0, and
    their share of all corridors; of the speed limit the mean of the known ones and how many are known;
    of the surface confidence how many are below 0.3."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    cells = [F.struct(F.lit(c).alias("attribute"), finite(c).alias("v"), (finite(c) > 0).alias("has")) for c in SHARES]
    speed = F.col("average_speed_limit")
    cells.append(F.struct(F.lit("average_speed_limit").alias("attribute"), speed.alias("v"), speed.isNotNull().alias("has")))
    sure = F.col("surface_confidence")
    cells.append(F.struct(F.lit("low surface_confidence").alias("attribute"), sure.alias("v"), (sure < 0.3).alias("has")))
    rows = corridors.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.attribute").agg(
        F.coalesce(F.avg("c.v"), F.lit(0.0)).alias("mean"), F.count_if(F.coalesce("c.has", F.lit(False))).alias("n"), F.count("*").alias("all")
    )
    return rows.select("attribute", "mean", "n", share(F.col("n"), F.col("all")).alias("share"))


def corridor_distribution(corridors: DataFrame, key: str) -> DataFrame:
    """``key, n, km, share`` of corridors, the most first."""
    return distribution(corridors, key)


def connector_report(connectors: DataFrame) -> DataFrame:
    """One row: connectors, their mean, least and largest length, how many have a signal, a stop, cross a
    major road, and their mean difficulty."""
    return connectors.agg(
        F.count("*").alias("connectors"),
        F.avg("length_m").alias("mean_m"),
        F.min("length_m").alias("least_m"),
        F.max("length_m").alias("most_m"),
        F.count_if("has_signal").alias("with_signal"),
        F.count_if("has_stop").alias("with_stop"),
        F.count_if("crosses_major").alias("crossing_major"),
        F.avg("difficulty").alias("mean_difficulty"),
    )


def named_corridors(corridors: DataFrame, least_m: float = 1000.0, top: int = 15) -> DataFrame:
    """The ``top`` longest corridors with a name that are longer than ``least_m``."""
    own = corridors.where(F.nullif(F.col("name"), F.lit("")).isNotNull() & (F.col("length_m") > least_m))
    return own.select("id", "name", "type", "length_m", "surface", "bicycle_infra_continuity").orderBy(F.desc("length_m"), "id").limit(top)


def adjacency_stats(network: Network) -> DataFrame:
    """One row: corridors and connectors, mean and largest number of their neighbours; those without count, too."""
    every = network.corridors.select("id").unionByName(network.connectors.select("id"))
    degree = network.adjacency.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    rows = every.join(degree, "id", "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return rows.agg(F.count("*").alias("entities"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("most"))


def route_scores(route_corridors: DataFrame, scores: DataFrame) -> DataFrame:
    """``request_id`` and each score's mean over the corridors of ``route_corridors(request_id, id, length_m)``, by their full lengths."""
    names = [c for c in scores.columns if c not in ("id", "activity")]
    rows = route_corridors.join(scores, "id")
    m = F.col("length_m")
    return rows.groupBy("request_id").agg(*[(F.sum(F.col(c) * m) / F.sum(F.when(F.col(c).isNotNull(), m))).alias(c) for c in names])


def report_lines(graph: Graph, network: Network) -> DataFrame:
    """``section, line, text``: the coverage of the graph's attributes, figures of corridors and of connectors."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    pad = lambda c, n: F.rpad(c, n, " ")
    parts = [
        (1, coverage(graph.edges), F.concat(pad(F.col("attribute"), 30), F.format_string("%9d", "n"), F.lit(" "), pct("share"), F.lit(" "), F.format_string("%.1f km", "km"), F.lit(" "), pct("km_share"))),
        (2, distribution(graph.edges, "road_class"), F.concat(pad(F.col("road_class"), 30), F.format_string("%9d", "n"), F.lit(" "), F.format_string("%.1f km", "km"))),
        (3, corridor_spreads(network.corridors), F.concat(pad(F.col("attribute"), 30), *[x for c in ("mean", "least", "most", "p50") for x in (F.lit(" "), two(c))])),
        (4, corridor_shares(network.corridors), F.concat(pad(F.col("attribute"), 30), two("mean"), F.lit(" "), F.format_string("%9d", "n"), F.lit(" "), pct("share"))),
        *[
            (5 + k, corridor_distribution(network.corridors, key), F.concat(pad(F.coalesce(F.col(key), F.lit("-")), 30), F.format_string("%9d", "n"), F.lit(" "), F.format_string("%.1f km", "km")))
            for k, key in enumerate(("road_class", "surface", "type"))
        ],
        (8, connector_report(network.connectors), F.format_string("%d connectors, mean %.0f m, difficulty %.3f", "connectors", F.coalesce("mean_m", F.lit(0.0)), F.coalesce("mean_difficulty", F.lit(0.0)))),
    ]
    out = None
    for section, rows, text in parts:
        lines = rows.select(F.lit(section).alias("section"), text.alias("text"))
        out = lines if out is None else out.unionByName(lines)
    # a few dozen lines
    return out.withColumn("line", F.row_number().over(Window.partitionBy("section").orderBy("text"))).select("section", "line", "text")


def report_text(graph: Graph, network: Network) -> str:
    """The report as one text."""
    titles = {1: "Edge attributes", 2: "Road classes", 3: "Corridor figures", 4: "Corridor shares", 5: "Corridor classes", 6: "Corridor surfaces", 7: "Corridor types", 8: "Connectors"}
    out, last = [], None
    for r in report_lines(graph, network).orderBy("section", "line").collect():  # a few dozen lines
        if r.section != last:
            out += ["", titles[r.section]]
            last = r.section
        out.append(f"  {r.text}")
    return "\n".join(out[1:])


def rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """``df`` with columns rounded half up to so many digits."""
    return df.withColumns({c: round_half_up(F.col(c), d) for c, d in columns.items()})
