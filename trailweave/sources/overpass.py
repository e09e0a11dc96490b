"""Map elements from Overpass: query text, and decoding of saved responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import tags as T
from trailweave.functions.tables import RELEVANT_HIGHWAYS

_POINT = "array<struct<lat:double,lon:double>>"
SCHEMA = (
    "version double, elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,"
    f"geometry:{_POINT},tags:map<string,string>>>"
)


def query_text(south: float, west: float, north: float, east: float, timeout: int = 90) -> str:
    """A request for the relevant ways of a box with their geometry, and its signals, stops and crossings."""
    box = f"({south},{west},{north},{east})"
    ways = "|".join(RELEVANT_HIGHWAYS)
    return (
        f"[out:json][timeout:{timeout}];\n(\n"
        f'  way["highway"~"^({ways})$"]{box};\n'
        f'  node["highway"~"^(traffic_signals|stop|crossing)$"]{box};\n'
        ");\nout body geom;\n"
    )


def read_responses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq, e``: the elements of saved JSON responses, numbered in the order of files and lists."""
    files = spark.read.schema(SCHEMA).json(path, multiLine=True).select("elements", F.col("_metadata.file_path").alias("file"))
    # a row for each file tells how many elements come before its own
    sizes = files.groupBy("file").agg(F.sum(F.size("elements")).alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    rows = files.select("file", F.posexplode("elements").alias("pos", "e")).join(F.broadcast(before), "file")
    return rows.select((F.col("before") + F.col("pos")).cast("long").alias("seq"), "e")


def nodes_of(elements: DataFrame) -> DataFrame:
    """``seq, id, lat, lon, tags``: explicit nodes, else the first place a way gives a node; null places are skipped."""
    own = elements.where("e.type = 'node'").select("seq", F.col("e.id").alias("id"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"), F.col("e.tags").alias("tags"), F.lit(0).alias("rank"))
    pairs = elements.where("e.type = 'way'").select("seq", F.posexplode(F.arrays_zip(F.col("e.nodes").alias("n"), F.col("e.geometry").alias("g"))).alias("k", "z"))
    drawn = pairs.where("z.g is not null and z.n is not null").select(
        "seq", F.col("z.n").alias("id"), F.col("z.g.lat").alias("lat"), F.col("z.g.lon").alias("lon"), F.lit(None).cast("map<string,string>").alias("tags"), (F.col("k") + 1).alias("rank")
    )
    order = F.struct(F.when(F.col("rank") == 0, 0).otherwise(1), "seq", "rank")
    best = own.unionByName(drawn).groupBy("id").agg(F.min_by(F.struct("lat", "lon", "tags", "seq"), order).alias("b"))
    return best.select("b.seq", "id", "b.lat", "b.lon", "b.tags")


def ways_of(elements: DataFrame) -> DataFrame:
    """``seq, id, refs, tags`` of the relevant ways."""
    ways = elements.where("e.type = 'way'").select("seq", F.col("e.id").alias("id"), F.col("e.nodes").alias("refs"), F.col("e.tags").alias("tags"))
    return ways.where(T.is_relevant(F.col("tags")))


def element_counts(elements: DataFrame) -> DataFrame:
    """``type, n``."""
    return elements.groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))
