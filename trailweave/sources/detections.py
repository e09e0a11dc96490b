"""Detections of map features, from saved API responses, as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beginnings of detection names and the attribute they stand for.
PREFIXES = {
    "regulatory--stop": "stop-sign",
    "regulatory--traffic-signal": "traffic-signal",
    "object--traffic-signal": "traffic-signal",
    "marking--crosswalk": "road-crossing",
    "object--crosswalk": "road-crossing",
}
DETECTION, SOURCE = 0.75, 0.7


def attribute_of(value: Column) -> Column:
    """The attribute a detection is evidence of; null for others."""
    out = F
    for prefix, attribute in PREFIXES.items():
        out = out.when(value.startswith(prefix), F.lit(attribute))
    return out.otherwise(F.lit(None).cast("string"))


def observations(features: DataFrame) -> DataFrame:
    """Observations of ``features(seq, object_value, lat, lng, last_seen_at)``; unknown detections are dropped."""
    rows = features.withColumn("attribute", attribute_of(F.col("object_value"))).where("attribute is not null")
    return rows.select(
        "seq",
        "attribute",
        F.lit("mapillary").alias("source"),
        F.lit(SOURCE).alias("confidence"),
        F.col("lat").alias("v_lat"),
        F.col("lng").alias("v_lng"),
        F.lit(DETECTION).alias("v_conf"),
        F.to_timestamp("last_seen_at").alias("observed_at"),
        F.array(F.struct("lat", "lng")).alias("geometry"),
    )
