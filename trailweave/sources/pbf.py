"""Map elements from PBF files, by the public description of the format.

A file is a sequence of blobs, each a length, a header and compressed data; blobs are
independent, so the data source gives Spark one partition for each run of blobs. Files are
opened by URI, in a shared folder or a store. ``two_passes`` reads what a street graph needs, each
blob for ways once and for nodes only if it can hold one that a way refers to. ``whole_files``
reads paths that only Spark itself can open, one file's bytes a row.

``seq`` numbers the elements in the order of the file: ``BLOB_ROOM`` numbers for each blob.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trailweave.functions import tags as T
from trailweave.operators.iterate import settled, settled_and
from trailweave.sources.files import open_fs

SCHEMA = "seq long, type string, id long, lat double, lon double, refs array<long>, tags map<string,string>"
NANO = 1e-9
#: More elements than a blob of the format's largest size can hold.
BLOB_ROOM = 1 << 24


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: integers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7


def numbers(data: bytes, signed: bool = False) -> list[int]:
    """The integers of a packed field."""
    if len(data) < 64:  # tags and short ways: not worth an array
        out, at = [], 0
        while at < len(data):
            v, at = _varint(data, at)
            out.append((v >> 1) ^ -(v & 1) if signed else v)
        return out
    return _packed_numbers(data, signed).tolist()


def _packed_numbers(data: bytes, signed: bool) -> np.ndarray:
    """All of them at once: a number ends at a byte below 128, each byte before has seven bits of it."""
    b = np.frombuffer(data, "u1")
    ends = np.flatnonzero(b < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(len(ends), "u8")
    for k in range(int((ends - begins).max(initial=-1)) + 1):
        use = begins + k <= ends
        out[use] |= (b[begins[use] + k] & 127).astype("u8") << np.uint64(7 * k)
    return (out >> np.uint64(1)).astype("i8") ^ -(out & np.uint64(1)).astype("i8") if signed else out.astype("i8")


def _running(values: list[int]) -> list[int]:
    return list(accumulate(values))


def _get(message: dict, key: int, default):
    return message.get(key, [default])[-1]


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for k, v in fields(data):
        out.setdefault(k, []).append(v)
    return out


def blobs(f, size: int) -> Iterator[tuple[int, int, str]]:
    """Place, length and type of each blob of an open file."""
    at = 0
    while at < size:
        f.seek(at)
        n = struct.unpack(">I", f.read(4))[0]
        header = _message(f.read(n))
        length = _get(header, 3, 0)
        at += 4 + n
        yield at, length, _get(header, 1, b"").decode()
        at += length


def inflate(data: bytes) -> bytes:
    blob = _message(data)
    if 1 in blob:
        return blob[1][-1]
    if 3 in blob:
        return zlib.decompress(blob[3][-1])
    raise ValueError("a compression that is not supported")


KINDS = frozenset({"node", "way", "relation"})


def outline(block: bytes) -> tuple[int | None, int | None]:
    """The least and the largest id of a block's nodes; only ids are decoded."""
    least = most = None
    for group in _message(block).get(2, []):
        for kind, data in fields(group):
            if kind == 2:
                ids = _running(numbers(_get(_message(data), 1, b""), True))
            elif kind == 1:
                z = _get(_message(data), 1, 0)
                ids = [(z >> 1) ^ -(z & 1)]
            else:
                continue
            if ids:
                low, high = min(ids), max(ids)
                least, most = (low, high) if least is None else (min(least, low), max(most, high))
    return least, most


def elements(block: bytes, kinds: frozenset[str] = KINDS) -> Iterator[tuple]:
    """Rows of a primitive block; elements of other kinds are passed over."""
    b = _message(block)
    strings = [s.decode() for s in _message(_get(b, 1, b"")).get(1, [])]
    grain, lat0, lon0 = _get(b, 17, 100), _get(b, 19, 0), _get(b, 20, 0)
    place = lambda v, base: NANO * (base + grain * v)
    for group in b.get(2, []):
        g = _message(group)
        for data in g.get(1, []) if "node" in kinds else ():
            n = _message(data)
            tags = {strings[k]: strings[v] for k, v in zip(numbers(_get(n, 2, b"")), numbers(_get(n, 3, b"")), strict=True)}
            z = lambda x: (x >> 1) ^ -(x & 1)
            yield "node", z(_get(n, 1, 0)), place(z(_get(n, 8, 0)), lat0), place(z(_get(n, 9, 0)), lon0), None, tags
        for data in g.get(2, []) if "node" in kinds else ():
            d = _message(data)
            keys, at = numbers(_get(d, 10, b"")), 0
            ids, lats, lons = (_running(numbers(_get(d, k, b""), True)) for k in (1, 8, 9))
            for i, y, x in zip(ids, lats, lons, strict=True):
                tags = {}
                while at < len(keys) and keys[at]:
                    tags[strings[keys[at]]] = strings[keys[at + 1]]
                    at += 2
                at += 1
                yield "node", i, place(y, lat0), place(x, lon0), None, tags
        for data in g.get(3, []) if "way" in kinds else ():
            w = _message(data)
            tags = {strings[k]: strings[v] for k, v in zip(numbers(_get(w, 2, b"")), numbers(_get(w, 3, b"")), strict=True)}
            yield "way", _get(w, 1, 0), None, None, _running(numbers(_get(w, 8, b""), True)), tags
        for data in g.get(4, []) if "relation" in kinds else ():
            yield "relation", _get(_message(data), 1, 0), None, None, None, {}


class _Run(InputPartition):
    def __init__(self, path: str, runs: list[tuple[int, int, int]]):
        self.path, self.runs = path, runs


class PbfReader(DataSourceReader):
    def __init__(self, path: str, per_task: int = 8):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[_Run]:
        fs, path = open_fs(self.path)
        with fs.open_input_file(path) as f:
            data = [(k, a, n) for k, (a, n, kind) in enumerate(blobs(f, f.size())) if kind == "OSMData"]
        return [_Run(self.path, data[k : k + self.per_task]) for k in range(0, len(data), self.per_task)] or [_Run(self.path, [])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        fs, path = open_fs(partition.path)
        with fs.open_input_file(path) as f:
            for k, at, n in partition.runs:
                f.seek(at)
                for j, row in enumerate(elements(inflate(f.read(n)))):
                    yield k * BLOB_ROOM + j, *row


class PbfDataSource(DataSource):
    """``spark.dataSource.register(PbfDataSource); spark.read.format("map_pbf").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "map_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], int(self.options.get("blobspertask", 8)))


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a file."""
    spark.dataSource.register(PbfDataSource)
    return spark.read.format("map_pbf").load(path)


def whole_files(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """The same through Spark's own reader, for paths that only Spark opens: blobs are cut out of
    each file's bytes (2 GB at most, one task) and then decoded in parallel."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                f = pa.BufferReader(data)
                for k, (at, n, kind) in enumerate(blobs(f, data.size)):
                    if kind == "OSMData":
                        yield pa.RecordBatch.from_pydict({"blob": pa.array([k], pa.int64()), "data": pa.array([data.slice(at, n).to_pybytes()], pa.binary())})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
        names = ["seq", "type", "id", "lat", "lon", "refs", "tags"]
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(k * BLOB_ROOM + j, *r[:5], list(r[5].items())) for j, r in enumerate(elements(inflate(data)))]
                for a in range(0, len(rows), 10_000):
                    columns = zip(*rows[a : a + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "blob long, data binary")
    return found.repartition(parts or max(8, spark.sparkContext.defaultParallelism), "blob").mapInArrow(decode, SCHEMA)


_BLOB = "path string, blob long, at long, length long"
_SCANNED = f"{SCHEMA}, {_BLOB}, least long, most long"
#: Blobs that a task decodes, about; ids of a cell of the index are equal but for so many bits; cells of a blob that is looked up.
BLOBS_PER_TASK, CELL_BITS, MOST_CELLS = 8, 10, 4096


def blob_places(spark: SparkSession, path: str) -> DataFrame:
    """``path, blob, at, length`` of each data blob of a file, from the headers alone, which one task walks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, own = open_fs(name)
                with fs.open_input_file(own) as f:
                    found = ((k, at, n) for k, (at, n, kind) in enumerate(blobs(f, f.size())) if kind == "OSMData")
                    while part := list(islice(found, 10_000)):
                        k, at, n = (pa.array(c, pa.int64()) for c in zip(*part, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), k, at, n], ["path", "blob", "at", "length"])

    return spark.createDataFrame([(path,)], "path string").mapInArrow(walk, _BLOB)


def scanned(places: DataFrame, kinds: frozenset[str], outlines: bool = False) -> DataFrame:
    """The elements of some kinds in the blobs of ``places``; with ``outlines`` a row of type ``blob`` for
    each blob with nodes, which has its place and the least and largest id of its nodes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCANNED.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), pa.string(), *[pa.int64()] * 5]
        with ExitStack() as stack:
            files: dict[str, pa.NativeFile] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["path"] not in files:
                        fs, own = open_fs(row["path"])
                        files[row["path"]] = stack.enter_context(fs.open_input_file(own))
                    f = files[row["path"]]
                    f.seek(row["at"])
                    block, k, none = inflate(f.read(row["length"])), row["blob"], (None,) * 6
                    rows = [(k * BLOB_ROOM + j, *r[:5], list(r[5].items()), *none) for j, r in enumerate(elements(block, kinds))]
                    if outlines and (ends := outline(block))[0] is not None:
                        rows.append((None, "blob", None, None, None, None, None, row["path"], k, row["at"], row["length"], *ends))
                    for a in range(0, len(rows), 10_000):
                        columns = zip(*rows[a : a + 10_000], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return places.select("path", "blob", "at", "length").mapInArrow(read, _SCANNED)


def _dealt(places: DataFrame, n: int) -> DataFrame:
    return places.repartition(max(1, -(-n // BLOBS_PER_TASK)), "blob")


def needed_blobs(index: DataFrame, refs: DataFrame) -> DataFrame:
    """The blobs of ``index(path, blob, at, length, least, most)`` that can hold one of ``refs(id)``.

    Ids meet blobs on cells of ids; a blob whose ids lie so far apart that it touches very many
    cells (a file that is not sorted) is always read.
    """
    cell = lambda c: F.shiftright(c, CELL_BITS)
    near = cell("most") - cell("least") < MOST_CELLS
    asked = refs.select(cell("id").alias("cell")).distinct()
    met = index.where(near).withColumn("cell", F.explode(F.sequence(cell("least"), cell("most")))).join(asked, "cell", "left_semi")
    columns = ["path", "blob", "at", "length"]
    return met.select(*columns).distinct().unionByName(index.where(~near).select(*columns))


def two_passes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``seq, id, lat, lon, tags`` of the nodes that relevant ways refer to, and ``seq, id, refs, tags`` of those ways.

    The first pass decodes ways, and of nodes the ids, so that it leaves an index of the blobs;
    the second opens only blobs that can hold a node that is asked for, and decodes nodes only.
    Ways and index are written once.
    """
    places, seen = settled_and(blob_places(spark, path), "blobs", n=F.count(F.lit(1)))
    first = scanned(_dealt(places, seen["n"]), frozenset({"way"}), outlines=True)
    first = settled(first.where((F.col("type") == "blob") | T.is_relevant(F.col("tags"))), "ways")
    ways = first.where("type = 'way'").select("seq", "id", "refs", "tags")
    refs = ways.select(F.explode("refs").alias("id")).distinct()
    index = first.where("type = 'blob'").select("path", "blob", "at", "length", "least", "most")
    wanted, seen = settled_and(needed_blobs(index, refs), "needed-blobs", n=F.count(F.lit(1)))
    nodes = scanned(_dealt(wanted, seen["n"]), frozenset({"node"})).select("seq", "id", "lat", "lon", "tags")
    return nodes.join(refs, "id", "left_semi").select("seq", "id", "lat", "lon", "tags"), ways


def element_counts(elements: DataFrame) -> DataFrame:
    """``type, n``."""
    return elements.groupBy("type").agg(F.count("*").alias("n"))


def ways_of(elements: DataFrame) -> DataFrame:
    """``seq, id, refs, tags`` of the relevant ways."""
    return elements.where("type = 'way'").where(T.is_relevant(F.col("tags"))).select("seq", "id", "refs", "tags")


def nodes_of(elements: DataFrame) -> DataFrame:
    """``seq, id, lat, lon, tags`` of the nodes that a relevant way refers to."""
    refs = ways_of(elements).select(F.explode("refs").alias("id")).distinct()
    return elements.where("type = 'node'").select("seq", "id", "lat", "lon", "tags").join(refs, "id", "left_semi").select("seq", "id", "lat", "lon", "tags")
