"""A street network, and observations of it, derived from the driver's tables.

It is test input, laid out by integer arithmetic on ``orders`` (a grid of nodes), ``part``
(ways along the grid) and ``events`` (observations), so that SQL can derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.tables import RELEVANT_HIGHWAYS

SURFACE_TAGS = {"STANDARD": "asphalt", "LARGE": "gravel", "SMALL": "sett", "MEDIUM": "dirt", "PROMO": "tarmac"}
SPEEDS = ("30", "50 km/h", "30 mph", "none", "80", "25 mph", "walk", "signals")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def osm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tag = F.when(
        F.col("o_orderstatus") == "F",
        F.when(F.col("o_orderpriority") == "1-URGENT", "traffic_signals").when(F.col("o_orderpriority") == "2-HIGH", "stop").when(
            F.col("o_orderpriority") == "3-MEDIUM", "crossing"
        ),
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"),
        k.alias("id"),
        (F.lit(42.9) + F.floor(k / 64) * F.lit(0.0009)).alias("lat"),
        (F.lit(-85.7) + (k % 64) * F.lit(0.0012)).alias("lon"),
        F.when(tag.isNotNull(), F.create_map(F.lit("highway"), tag)).alias("tags"),
    )


def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_orders = table(spark, sf_dir, "orders").count()
    k, size = F.col("p_partkey"), F.col("p_size")
    brand = F.substring("p_brand", 7, 9).cast("int")
    step, start = F.when(size % 3 == 0, 64).otherwise(1), (k * 7) % n_orders
    refs = F.transform(F.sequence(F.lit(0), F.lit(4) + (size % 9).cast("int")), lambda i: F.col("start") + i * F.col("step"))
    inside = lambda r: (r < n_orders) & ((F.col("step") == 64) | (F.floor(r / 64) == F.floor(F.col("start") / 64)))
    tags = {
        "highway": F.element_at(F.array(*map(F.lit, RELEVANT_HIGHWAYS)), (F.floor(k / 3) % len(RELEVANT_HIGHWAYS) + 1).cast("int")),
        "surface": F.coalesce(*[F.when(F.col("p_type") == t, F.lit(v)) for t, v in SURFACE_TAGS.items()]),
        "maxspeed": F.when(size % 4 != 0, F.element_at(F.array(*map(F.lit, SPEEDS)), (size % len(SPEEDS) + 1).cast("int"))),
        "name": F.when(size % 5 != 0, F.col("p_name")),
        "oneway": F.when(brand % 10 == 1, F.lit("yes")).when(brand % 10 == 2, F.lit("-1")),
        "lanes": F.when(size % 7 == 1, F.lit("2;3")).when(size % 7 == 2, F.lit("x")),
        "traffic_calming": F.when(size % 11 == 3, F.lit("yes")).when(size % 11 == 4, F.lit("no")),
        "cycleway:right": F.when(size % 13 == 5, F.lit("lane")).when(size % 13 == 6, F.lit("track")).when(size % 13 == 7, F.lit("no")),
        "bicycle": F.when(size % 6 == 1, F.lit("designated")),
        "scenic": F.when(size % 10 == 1, F.lit("yes")),
    }
    made = F.map_from_entries(
        F.filter(F.array(*[F.struct(F.lit(key).alias("key"), v.alias("value")) for key, v in tags.items()]), lambda e: e["value"].isNotNull())
    )
    return (
        table(spark, sf_dir, "part")
        .select(k.alias("seq"), k.alias("id"), start.alias("start"), step.cast("long").alias("step"), made.alias("tags"), size.alias("p_size"))
        .select("seq", "id", F.filter(refs, inside).alias("refs"), "tags")
    )


#: SQL of the same nodes and ways, for DuckDB.
NODES_SQL = """
nodes0 AS (SELECT o_orderkey AS id, 42.9e0 + floor(o_orderkey / 64) * 0.0009e0 AS lat, -85.7e0 + (o_orderkey % 64) * 0.0012e0 AS lng,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'traffic_signals' WHEN '2-HIGH' THEN 'stop' WHEN '3-MEDIUM' THEN 'crossing' END END AS hw
  FROM orders)"""
_HIGHWAYS = ", ".join(f"'{h}'" for h in RELEVANT_HIGHWAYS)
WAYS_SQL = f"""
ways0 AS (SELECT p_partkey AS way_id, (p_partkey * 7) % (SELECT count(*) FROM orders) AS start, CASE WHEN p_size % 3 = 0 THEN 64 ELSE 1 END AS step, 4 + p_size % 9 AS extra,
  ([{_HIGHWAYS}])[CAST((p_partkey // 3) % {len(RELEVANT_HIGHWAYS)} AS INT) + 1] AS highway,
  CASE p_type WHEN 'STANDARD' THEN 'asphalt' WHEN 'LARGE' THEN 'gravel' WHEN 'SMALL' THEN 'sett' WHEN 'MEDIUM' THEN 'dirt' WHEN 'PROMO' THEN 'tarmac' END AS surface_tag,
  CASE WHEN p_size % 4 <> 0 THEN (['30', '50 km/h', '30 mph', 'none', '80', '25 mph', 'walk', 'signals'])[CAST(p_size % 8 AS INT) + 1] END AS maxspeed,
  CASE WHEN p_size % 5 <> 0 THEN p_name END AS name,
  CAST(substr(p_brand, 7) AS INT) % 10 AS ow, p_size FROM part),
refs0 AS (SELECT way_id, i AS ref_pos, start + i * step AS node_id, highway FROM (SELECT *, unnest(range(0, extra + 1)) AS i FROM ways0)
  WHERE start + i * step < (SELECT count(*) FROM orders) AND (step = 64 OR (start + i * step) // 64 = start // 64))"""
CLASS_SQL = """CASE WHEN highway = 'living_street' THEN 'residential' WHEN highway IN ('pedestrian', 'steps') THEN 'footway' WHEN highway = 'bridleway' THEN 'path'
  ELSE replace(highway, '_link', '') END"""
TAGGED_SQL = f"""
tagged AS (SELECT *, {CLASS_SQL} AS road_class,
  CASE maxspeed WHEN '30' THEN 30 WHEN '50 km/h' THEN 50 WHEN '30 mph' THEN 48 WHEN '80' THEN 80 WHEN '25 mph' THEN 40 WHEN 'walk' THEN 5 END::DOUBLE AS speed_limit,
  coalesce(CASE surface_tag WHEN 'asphalt' THEN 'paved' WHEN 'sett' THEN 'paved' WHEN 'gravel' THEN 'unpaved' WHEN 'dirt' THEN 'unpaved' END,
    CASE WHEN {CLASS_SQL} IN ('path', 'unclassified') THEN 'unknown' WHEN {CLASS_SQL} = 'track' THEN 'unpaved' ELSE 'paved' END) AS surface,
  CASE WHEN surface_tag IN ('asphalt', 'sett', 'gravel', 'dirt') THEN 0.8e0 ELSE 0.3e0 END AS surface_confidence,
  highway = 'cycleway' OR p_size % 13 IN (5, 6) OR p_size % 6 = 1 AS has_bicycle_infra,
  highway IN ('footway', 'pedestrian') OR (highway = 'path' AND p_size % 6 <> 1) AS has_pedestrian_path,
  false AS has_shoulder,
  highway IN ('cycleway', 'path', 'footway', 'pedestrian') OR p_size % 13 = 6 AS is_separated,
  p_size % 11 = 3 OR highway = 'living_street' AS has_traffic_calming,
  ow IN (1, 2) AS one_way, ow = 2 AS reversed, CASE WHEN p_size % 7 = 1 THEN 2 END AS lanes, p_size % 10 = 1 AS scenic
  FROM ways0)"""
TRAIL_SQL, _ROAD = "('cycleway','path','bridleway','track')", "('primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','unclassified','residential','living_street','service')"
SEGMENTS_SQL = f"""
known AS (SELECT r.way_id, r.node_id, r.highway, n.lat, n.lng, n.hw, row_number() OVER (PARTITION BY way_id ORDER BY ref_pos) - 1 AS pos,
  count(*) OVER (PARTITION BY way_id) AS n FROM refs0 r JOIN nodes0 n ON n.id = r.node_id),
counted AS (SELECT node_id, count(*) AS refs, bool_or(highway IN {TRAIL_SQL}) AND bool_or(highway IN {_ROAD}) AS meets FROM refs0 GROUP BY node_id),
cuts AS (SELECT way_id, pos, lead(pos) OVER (PARTITION BY way_id ORDER BY pos) AS stop FROM known JOIN counted USING (node_id)
  WHERE n >= 2 AND (pos = 0 OR pos = n - 1 OR refs > 1)),
stepped AS (SELECT *, 2 * 6371000e0 * asin(sqrt(least(1e0, power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lng - plng) / 2), 2)))) AS d
  FROM (SELECT *, lag(lat) OVER (PARTITION BY way_id ORDER BY pos) AS plat, lag(lng) OVER (PARTITION BY way_id ORDER BY pos) AS plng FROM known)),
segments AS (SELECT c.way_id, c.pos AS start_pos, c.stop,
  sum(CASE WHEN p.pos > c.pos THEN p.d END) AS length_m,
  count(*) FILTER (p.hw = 'stop') AS stops, count(*) FILTER (p.hw = 'traffic_signals') AS signals,
  count(*) FILTER (p.hw = 'crossing' AND p.highway IN {TRAIL_SQL}) AS crossings,
  min_by(p.node_id, p.pos) AS a, max_by(p.node_id, p.pos) AS b
  FROM cuts c JOIN stepped p ON p.way_id = c.way_id AND p.pos BETWEEN c.pos AND c.stop WHERE c.stop IS NOT NULL GROUP BY ALL)"""
EDGES_SQL = """
edges0 AS (SELECT *, CASE WHEN one_way THEN way_id || ':' || start_pos ELSE way_id || ':' || start_pos || ':' || d END AS id,
  CASE WHEN (one_way AND reversed) OR d = 'r' THEN b ELSE a END AS from_node, CASE WHEN (one_way AND reversed) OR d = 'r' THEN a ELSE b END AS to_node
  FROM (SELECT *, unnest(CASE WHEN one_way THEN ['f'] ELSE ['f', 'r'] END) AS d FROM segments JOIN tagged USING (way_id)))"""
GRAPH_SQL = "WITH " + ",".join((NODES_SQL, WAYS_SQL, TAGGED_SQL, SEGMENTS_SQL, EDGES_SQL))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, way_id, attribute, source, confidence, v_str, v_num, v_bool`` from ``events``."""
    from trailweave.functions.tables import SOURCES

    n_parts = table(spark, sf_dir, "part").count()
    whole = F.floor("value").cast("long")
    attribute = F.element_at(
        F.create_map(*[F.lit(x) for pair in ATTRIBUTE_OF_EVENT.items() for x in pair]), F.col("event_type")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") % n_parts).cast("string").alias("osm_way_id"),
        attribute.alias("attribute"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("user_id") % 7 + 1).cast("int")).alias("source"),
        ((F.col("user_id") % 10 + 1) / 10).alias("confidence"),
        F.when(F.col("event_type") == "view", F.element_at(F.array(F.lit("paved"), F.lit("unpaved"), F.lit("unknown")), (whole % 3 + 1).cast("int"))).alias("v_str"),
        F.when(F.col("event_type") == "click", 20.0 + whole % 8 * 10)
        .when(F.col("event_type") == "signup", whole % 11 / 10)
        .cast("double")
        .alias("v_num"),
        F.when(F.col("event_type") == "purchase", whole % 2 == 0).alias("v_bool"),
        F.when(F.col("event_type") == "error", F.lit(42.9) + (F.col("event_id") % 997) * F.lit(0.00013)).alias("v_lat"),
        F.when(F.col("event_type") == "error", F.lit(-85.7) + (F.col("event_id") % 631) * F.lit(0.00011)).alias("v_lng"),
        F.when(F.col("event_type") == "error", F.lit(0.75)).alias("v_conf"),
    )


ATTRIBUTE_OF_EVENT = {"view": "surface", "click": "speed-limit", "purchase": "bicycle-infra", "signup": "scenic", "error": "traffic-signal"}
_SOURCE_LIST = "['osm-tag','osm-inferred','gravelmap','mapillary','google-roads','municipal-open-data','user-report']"
OBSERVATIONS_SQL = f"""
obs0 AS (SELECT event_id AS seq, event_id % (SELECT count(*) FROM part) AS way_id,
  CASE event_type WHEN 'view' THEN 'surface' WHEN 'click' THEN 'speed-limit' WHEN 'purchase' THEN 'bicycle-infra' WHEN 'signup' THEN 'scenic' ELSE 'traffic-signal' END AS attribute,
  ({_SOURCE_LIST})[CAST(user_id % 7 AS INT) + 1] AS source, (user_id % 10 + 1) / 10e0 AS confidence,
  CAST(floor(value) AS BIGINT) AS w, 42.9e0 + (event_id % 997) * 0.00013e0 AS v_lat, -85.7e0 + (event_id % 631) * 0.00011e0 AS v_lng FROM events),
matched AS (SELECT o.*, e.id AS edge_id FROM obs0 o JOIN edges0 e USING (way_id))"""
