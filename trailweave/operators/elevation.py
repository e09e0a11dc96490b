"""Elevation of points from raster tiles, and the climbs of edges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import geo
from trailweave.sources.files import open_fs

SIDE, VOID = 3601, -32768


def tile_name(lat: Column, lng: Column) -> Column:
    """File name of the tile that holds a point, such as N42W086.hgt."""
    a, b = F.floor(lat), F.floor(lng)
    return F.concat(
        F.when(a >= 0, "N").otherwise("S"),
        F.lpad(F.abs(a).cast("string"), 2, "0"),
        F.when(b >= 0, "E").otherwise("W"),
        F.lpad(F.abs(b).cast("string"), 3, "0"),
        F.lit(".hgt"),
    )


def interpolated(raster: np.ndarray, lat: np.ndarray, lng: np.ndarray, width: int | None = None, first: int = 0) -> np.ndarray:
    """Bilinear heights in a square tile whose first row is its north edge; NaN where a corner is void.
    ``raster`` may be some rows of a tile of ``width``, from the row ``first`` on."""
    n = (width or len(raster)) - 1
    y, x = (np.floor(lat) + 1 - lat) * n, (lng - np.floor(lng)) * n
    r, c = np.minimum(y.astype(int), n - 1), np.minimum(x.astype(int), n - 1)
    fy, fx = y - r, x - c
    corners = [raster[r - first + i, c + j].astype("f8") for i in (0, 1) for j in (0, 1)]
    out = corners[0] * (1 - fy) * (1 - fx) + corners[1] * (1 - fy) * fx + corners[2] * fy * (1 - fx) + corners[3] * fy * fx
    return np.where(np.any([k == VOID for k in corners], axis=0), np.nan, out)


#: Strips of a tile, from north to south, that are read at a time.
STRIPS = 64


class _Tiles:
    """Strips of the tile files of a folder; the file and the strip read last stay open."""

    def __init__(self, folder: str):
        self.fs, base = open_fs(folder)
        self.base, self.name, self.file, self.width, self.rows, self.read_bytes = base.rstrip("/"), None, None, 0, (0, 0, None), 0

    def _open(self, name: str) -> None:
        self.name, self.width, self.rows = name, 0, (0, 0, None)
        path = f"{self.base}/{name}"
        size = self.fs.get_file_info(path).size or 0  # none where there is no file
        width = int(round((size // 2) ** 0.5))
        if width > 1 and width * width * 2 == size:
            self.file, self.width = self.fs.open_input_file(path), width

    def heights(self, name: str, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        if name != self.name:
            self._open(name)
        if not self.width:
            return np.full(len(lat), np.nan)
        n = self.width - 1
        row = np.minimum(((np.floor(lat) + 1 - lat) * n).astype(int), n - 1)
        first, past = int(row.min()), int(row.max()) + 2
        if not self.rows[0] <= first < past <= self.rows[1]:
            self.file.seek(2 * self.width * first)
            data = self.file.read(2 * self.width * (past - first))
            self.read_bytes += len(data)
            self.rows = first, past, np.frombuffer(data, ">i2").reshape(past - first, self.width)
        return interpolated(self.rows[2], lat, lng, self.width, self.rows[0])


def heights_of_files(points: DataFrame, folder: str) -> DataFrame:
    """``heights`` from the tile files of a shared folder or store, such as N42W086.hgt.

    Points are brought together by strip of a tile, and a task reads of each file, by offset, the rows
    that its points need. Only points move; a crowded strip is split among tasks.
    """
    strip = F.least(F.lit(STRIPS - 1), F.floor((F.floor("lat") + 1 - F.col("lat")) * STRIPS).cast("int"))
    id_kind = points.schema["point_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _Tiles(folder)
        for batch in batches:
            names, strips = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            lat, lng = (batch.column(k).to_numpy(zero_copy_only=False).astype("f8") for k in (1, 2))
            z, start = np.full(len(names), np.nan), 0
            for (name, _), run in groupby(zip(names, strips, strict=True)):
                stop = start + sum(1 for _ in run)
                if name is not None:
                    z[start:stop] = tiles.heights(name, lat[start:stop], lng[start:stop])
                start = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.float64(), mask=np.isnan(z))], ["point_id", "lat", "lng", "elevation_m"])

    placed = points.select("point_id", F.col("lat").cast("double"), F.col("lng").cast("double"), tile_name(F.col("lat"), F.col("lng")).alias("tile"), strip.alias("strip"))
    return placed.hint("rebalance", "tile", "strip").sortWithinPartitions("tile", "strip").mapInArrow(read, f"point_id {id_kind}, lat double, lng double, elevation_m double")


def heights(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """``points(point_id, lat, lng)`` with ``elevation_m``, null without a tile or by a void.

    ``tiles(tile, content)`` are read once each: a tile's points come to it, in groups of about
    50 000 so that a crowded tile is several tasks' work.
    """
    side = points.withColumn("tile", tile_name(F.col("lat"), F.col("lng")))
    crowd = side.groupBy("tile").agg(F.count("*").alias("n")).select("tile", F.ceil(F.col("n") / 50_000).cast("int").alias("parts"))
    dealt = side.join(crowd, "tile").withColumn("part", F.pmod(F.xxhash64("point_id"), "parts").cast("int"))
    spread = tiles.join(crowd, "tile").select("tile", "content", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def read(own: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        z = np.full(len(own), np.nan)
        if len(tile) and len(own):
            data = np.frombuffer(tile["content"].iloc[0], ">i2")
            width = int(round(len(data) ** 0.5))
            if width > 1 and width * width == len(data):
                z = interpolated(data.reshape(width, width), own["lat"].to_numpy(), own["lng"].to_numpy())
        return pd.DataFrame({"point_id": own["point_id"], "lat": own["lat"], "lng": own["lng"], "elevation_m": z})

    kind = f"point_id {points.schema['point_id'].dataType.simpleString()}, lat double, lng double, elevation_m double"
    out = dealt.groupBy("tile", "part").cogroup(spread.groupBy("tile", "part")).applyInPandas(read, kind)
    return out.withColumn("elevation_m", F.nanvl("elevation_m", F.lit(None).cast("double")))


def filled(z: np.ndarray) -> np.ndarray | None:
    """Gaps filled by index: flat outside the known values, linear between them; None with fewer than two."""
    known = np.flatnonzero(~np.isnan(z))
    return None if len(known) < 2 else np.interp(np.arange(len(z)), known, z[known])


def edge_climbs(points: DataFrame) -> DataFrame:
    """``edge_id, gain, loss, max_grade, average_grade, known`` from ``points(edge_id, pos, lat, lng, z)``.

    Rises and falls are between a known point and the known one before it, grades over the
    distance from the point just before, in per cent; edges with fewer than two known points have
    nulls.
    """
    by = Window.partitionBy("edge_id").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    step = geo.haversine(F.lag("lat").over(by), F.lag("lng").over(by), F.col("lat"), F.col("lng"))
    rows = points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("rise", F.col("z") - F.last("z", ignorenulls=True).over(before))
    grade = F.when(F.col("step") > 0, F.abs(F.col("rise")) / F.col("step") * 100)
    out = rows.groupBy("edge_id").agg(
        F.sum(F.greatest("rise", F.lit(0.0))).alias("gain"),
        F.sum(F.greatest(-F.col("rise"), F.lit(0.0))).alias("loss"),
        F.max(grade).alias("max_grade"),
        F.min_by("z", F.when(F.col("z").isNotNull(), F.col("pos"))).alias("first"),
        F.max_by("z", F.when(F.col("z").isNotNull(), F.col("pos"))).alias("last"),
        F.sum("step").alias("length_m"),
        F.count("z").alias("known"),
    )
    enough = F.col("known") >= 2
    return out.select(
        "edge_id",
        *[F.when(enough, F.col(c)).alias(c) for c in ("gain", "loss")],
        F.when(enough, F.coalesce("max_grade", F.lit(0.0))).alias("max_grade"),
        F.when(enough & (F.col("length_m") > 0), (F.col("last") - F.col("first")) / F.col("length_m") * 100).alias("average_grade"),
        "known",
    )


def with_climbs(edges: DataFrame, node_heights: DataFrame) -> DataFrame:
    """``edges`` with the climbs that ``node_heights(lat, lng, elevation_m)`` give at their points."""
    points = edges.select(F.col("id").alias("edge_id"), F.posexplode("geometry").alias("pos", "p")).select("edge_id", "pos", "p.lat", "p.lng")
    places = node_heights.groupBy("lat", "lng").agg(F.max("elevation_m").alias("z"))  # one height a place
    known = points.join(places, ["lat", "lng"], "left")
    climbs = edge_climbs(known).select(
        F.col("edge_id").alias("id"), F.col("gain").alias("_g"), F.col("loss").alias("_l"), F.col("average_grade").alias("_a"), F.col("max_grade").alias("_m")
    )
    out = edges.join(climbs, "id", "left")
    new = {"elevation_gain": "_g", "elevation_loss": "_l", "average_grade": "_a", "max_grade": "_m"}
    return out.withColumns({k: F.coalesce(v, k) for k, v in new.items()}).select(edges.columns)


def profiles(
    members: DataFrame, edges: DataFrame, edge_heights: DataFrame | None = None, node_heights: DataFrame | None = None, every: float = 50.0
) -> DataFrame:
    """``id, profile``: heights every ``every`` metres along the edges of each group of ``members(id, pos, edge_id)``.

    An edge has the heights of its points (``edge_heights(edge_id, heights)``, where there are as many
    as points), else those between its end nodes (``node_heights(node, z)``; one known end stands for
    both); an edge without either only adds its length. Heights between samples are linear; the last
    sample ends a profile if more than a tenth of a step is left. Groups without heights have no row.
    """
    spark = edges.sparkSession
    edge_heights = edge_heights if edge_heights is not None else spark.createDataFrame([], "edge_id string, heights array<double>")
    node_heights = node_heights if node_heights is not None else spark.createDataFrame([], "node string, z double")
    end = lambda c, z: node_heights.select(F.col("node").alias(c), F.col("z").alias(z))
    rows = (
        members.select(F.col("id").alias("gid"), F.col("pos").alias("edge_pos"), "edge_id")
        .join(edges.select(F.col("id").alias("edge_id"), "from_node", "to_node", "geometry"), "edge_id")
        .join(edge_heights.select("edge_id", "heights"), "edge_id", "left")
        .join(end("from_node", "z1"), "from_node", "left")
        .join(end("to_node", "z2"), "to_node", "left")
    )
    own = F.coalesce(F.size("heights") == F.size("geometry"), F.lit(False))
    points = rows.withColumn("own", own).select("gid", "edge_pos", "own", "heights", "z1", "z2", F.posexplode("geometry").alias("k", "p"))
    of_edge = Window.partitionBy("gid", "edge_pos").orderBy("k")
    step = F.coalesce(geo.haversine_atan(F.lag("p.lat").over(of_edge), F.lag("p.lng").over(of_edge), F.col("p.lat"), F.col("p.lng")), F.lit(0.0))
    points = points.withColumn("step", step)
    upto = of_edge.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = points.withColumns({"at": F.sum("step").over(upto), "edge_m": F.sum("step").over(Window.partitionBy("gid", "edge_pos"))})
    along = Window.partitionBy("gid").orderBy("edge_pos", "k")
    points = points.withColumn("dist", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first, last = F.coalesce("z1", "z2"), F.coalesce("z2", "z1")
    between = first + F.when(F.col("edge_m") > 0, F.col("at") / F.col("edge_m")).otherwise(0.0) * (last - first)
    samples = points.withColumn("z", F.when(F.col("own"), F.get("heights", F.col("k"))).otherwise(between)).where("z is not null")
    samples = samples.withColumns(
        {"n": F.row_number().over(along), "next_dist": F.lead("dist").over(along), "next_z": F.lead("z").over(along), "end": F.max("dist").over(Window.partitionBy("gid"))}
    )
    s0, s1 = F.col("dist"), F.col("next_dist")
    lowest = F.when(F.col("n") == 1, F.lit(0).cast("long")).otherwise(F.floor(s0 / every) + 1)
    highest = F.floor(s1 / every)
    steps = F.when(highest >= lowest, F.sequence(lowest, highest)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    slope = F.when(s1 > s0, (F.col("d") * every - s0) / (s1 - s0)).otherwise(0.0)
    inner = samples.where("next_dist is not null").select("gid", "dist", "z", "next_dist", "next_z", F.explode(steps).alias("d"))
    inner = inner.select("gid", F.col("d").cast("double").alias("d"), (F.col("z") + slope * (F.col("next_z") - F.col("z"))).alias("z"))
    ends = samples.where("next_dist is null").where((F.col("n") == 1) | (F.col("end") - F.floor(F.col("end") / every) * every > 0.1 * every))
    whole = inner.unionByName(ends.select("gid", F.lit(float("inf")).alias("d"), "z"))
    lists = whole.groupBy(F.col("gid").alias("id")).agg(F.array_sort(F.collect_list(F.struct("d", "z"))).alias("s"))
    return lists.select("id", F.transform("s", lambda x: x["z"]).alias("profile"))


def gap_filled(lines: DataFrame) -> DataFrame:
    """``line_id, pos, z`` of ``lines`` with gaps filled as ``filled`` does; nulls where it cannot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [filled(np.array([np.nan if v is None else v for v in z], "f8")) for z in b["z"]]
            yield pd.DataFrame({"line_id": b["line_id"], "z": [None if d is None else d.tolist() for d in done]})

    kind = f"line_id {lines.schema['line_id'].dataType.simpleString()}, z array<double>"
    arrays = lines.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("a"))
    back = arrays.select("line_id", F.transform("a", lambda x: x["z"]).alias("z")).mapInPandas(run, kind)
    return back.select("line_id", F.posexplode_outer("z").alias("pos", "z"))
