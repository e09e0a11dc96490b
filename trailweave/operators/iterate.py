"""Tables between the rounds of iterative operators, and connected components.

Rounds end in Parquet tables of the folder that ``spark.checkpoint.dir`` names, which all
executors share, so a lost executor costs its running tasks only. A round's table goes once
the next one stands.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators.joins import shuffled

#: A node of more links than this hands its value out by broadcast, while at most ``HUBS`` nodes do.
CROWD, HUBS = 1_000, 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates; a temporary one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``settled`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hpath, True)


def settled_and(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``settled``, and metrics over all rows that the same job takes."""
    seen = Observation()
    out = settled(df.observe(seen, *[v.alias(k) for k, v in metrics.items()]), label)
    return out, seen.get


def _handed(links: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``links(u, v)`` with ``m``, the least of ``u`` and its ``v``; ``hubs(u, m)`` know theirs already."""
    least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
    if hubs is None:
        return links.withColumn("m", least)
    rest = links.join(F.broadcast(hubs.select("u")), "u", "left_anti").withColumn("m", least)
    return rest.unionByName(links.join(F.broadcast(hubs), "u"))


def components(links: DataFrame, label: str = "links", crowd: int = CROWD) -> DataFrame:
    """``node, component`` (the least node) of the graph ``links(a long, b long)``; nulls and loops link nothing.

    Every round hands each node's least neighbour to its larger neighbours and then to the
    node itself; the number of rounds grows with the logarithm of the graph's diameter. The links
    of crowded nodes, a hub's say, never gather in one task: their least node is found by partial
    sums and handed on by broadcast. Where very many nodes are crowded, all are joined instead.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    stamp = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))}
    smallest = F.least(F.min("v"), F.col("u")).alias("m")
    now, before = settled_and(links.where("a is not null and b is not null and a <> b").select(hi, lo).distinct(), label, **stamp)
    while before["n"]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(smallest, F.count("*").alias("n"))
        hubs, seen = settled_and(least.where(F.col("n") > crowd).select("u", "m"), label, n=F.count(F.lit(1)))
        done, few = [hubs], seen["n"] <= HUBS
        handed = _handed(both, hubs if seen["n"] else None) if few else both.join(shuffled(least.select("u", "m")), "u")
        large = handed.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if seen["n"]:
            large = settled(large, label)
            done.append(large)
            # only what was crowded before can be crowded now
            crowded = large.join(F.broadcast(hubs.select("u")), "u", "left_semi") if few else large
            least = settled(crowded.groupBy("u").agg(smallest), label)
            done.append(least)
            handed = _handed(large, least) if few else large.join(shuffled(least), "u")
        else:
            handed = _handed(large, None)
        small = handed.select(F.explode(F.array(F.struct(F.col("u").alias("hi"), "m"), F.struct(F.col("v").alias("hi"), "m"))).alias("e"))
        new, after = settled_and(small.where("e.hi <> e.m").select("e.hi", F.col("e.m").alias("lo")).distinct(), label, **stamp)
        discard(now, *done)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
