"""Built networks kept as tables, found again by place."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import geo
from trailweave.functions.tiles import box_key

BOUNDS = ("min_lat", "min_lng", "max_lat", "max_lng")
MANIFEST = "key string, min_lat double, min_lng double, max_lat double, max_lng double, megabytes double"
_ENTRY = f"seq long, {MANIFEST}, alive boolean, version string"


class NetworkCache:
    """Tables under ``root/tables/key/version/name``, and a log under ``root/log`` that says which version counts.

    An entry of the log is a small file named by its number. A number is claimed by creating the
    file, which fails if it exists; then the next one is tried. So writers never share a number, the
    last entry of a key is the same for all readers, and tables are never written in place: a
    reader keeps the version that it has found until ``vacuum`` removes it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), hpath

    def log(self) -> DataFrame:
        """Every entry of the log; one that is being written has no row yet."""
        fs, path = self._fs(f"{self.root}/log")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json(f"{self.root}/log").where("seq is not null")

    def _last(self) -> DataFrame:
        rows = self.log()
        last = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "seq").alias("v"))
        return last.select("key", "v.*").where("alive")

    def manifest(self) -> DataFrame:
        """The last entry of each key that has not been removed since."""
        return self._last().select("key", *BOUNDS, "megabytes")

    def _claimed(self, path: str) -> bool:
        """Create a file unless it exists; whether it is ours. The first of several writers gets it."""
        fs, hpath = self._fs(path)
        if hpath.toUri().getScheme() in (None, "file"):  # where creating through Hadoop looks first and then creates
            return self.spark._jvm.java.io.File(hpath.toUri().getPath()).createNewFile()
        try:
            fs.create(hpath, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _note(self, entry: dict) -> int:
        """Append an entry under the first number that is free; the number."""
        fs, folder = self._fs(f"{self.root}/log")
        fs.mkdirs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        seq = max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0) + 1
        while not self._claimed(path := f"{self.root}/log/{seq:012d}.json"):
            seq += 1
        out = fs.create(self._fs(path)[1], True)
        out.write(bytearray(json.dumps(entry | {"seq": seq}).encode() + b"\n"))
        out.close()
        return seq

    def key(self, box: dict[str, float]) -> str:
        return self.spark.range(1).select(box_key({b: F.lit(float(box[b])) for b in BOUNDS}).alias("k")).first().k

    def write(self, box: dict[str, float], tables: dict[str, DataFrame], megabytes: float = 0.0) -> str:
        """A new version of the box's tables; it counts once all of them are written."""
        key, version = self.key(box), uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/tables/{key}/{version}/{name}")
        self._note({"key": key, **{b: float(box[b]) for b in BOUNDS}, "megabytes": float(megabytes), "alive": True, "version": version})
        return key

    def find(self, lat: float, lng: float, reach_km: float) -> str | None:
        """The first key whose box, less the reach on all sides, holds the place."""
        box = geo.box_grown({b: F.col(b) for b in BOUNDS}, F.lit(-reach_km))
        inside = F.lit(lat).between(box["min_lat"], box["max_lat"]) & F.lit(lng).between(box["min_lng"], box["max_lng"])
        row = self.manifest().where(inside).orderBy("key").first()
        return row.key if row else None

    def read(self, key: str, name: str) -> DataFrame:
        row = self._last().where(F.col("key") == key).first()
        if row is None:
            raise KeyError(key)
        return self.spark.read.parquet(f"{self.root}/tables/{key}/{row.version}/{name}")

    def remove(self, key: str | None = None) -> int:
        """Forget a key, or all; how many there were."""
        rows = self._last().collect()  # a row for each cached region
        gone = [r.asDict() for r in rows if key in (None, r.key)]
        for r in gone:
            self._note(r | {"alive": False})
        return len(gone)

    def vacuum(self) -> int:
        """Delete the versions that were replaced or removed, for times without readers of them; how many.
        Versions that the log does not name yet stay, as they may be being written."""
        live = {r.version for r in self._last().collect()}
        old = {(r.key, r.version) for r in self.log().where("alive").collect() if r.version not in live}
        deleted = 0
        for key, version in sorted(old):
            fs, path = self._fs(f"{self.root}/tables/{key}/{version}")
            deleted += bool(fs.delete(path, True))
        return deleted

    def hit_zones(self, reach_km: float) -> DataFrame:
        """``key`` and the box in which a start of that reach is served."""
        box = geo.box_grown({b: F.col(b) for b in BOUNDS}, F.lit(-reach_km))
        return self.manifest().select("key", *[v.alias(k) for k, v in box.items()])

    def stats(self) -> DataFrame:
        return self.manifest().agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum("megabytes"), F.lit(0.0)), 1).alias("megabytes"))
