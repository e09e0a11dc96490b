"""Token ids in binary shards: one zstandard frame for each document, one shared dictionary.

Layout of a shard (all numbers little-endian)::

    magic "TWTK" | version u32 | dictionary hash u64
    frames, one after the other
    index: for each document  doc_id i64 | null flag u8 | ids u32 | end of its frame u64
    footer: place of the index u64 | magic "TWTK"

The dictionary lies beside the shards as ``dictionary.zstd``; its hash in each header keeps a
shard from being read with another one. A document's frame inflates to its ids as unsigned
32-bit numbers, so a short document is read with one seek and without its neighbours.

The dictionary is trained on at most ``SAMPLE`` documents, those with the smallest hash of
their id over the whole table; it changes sizes of frames only, never ids. Shards hold
ascending ranges of ``doc_id`` (nulls first, repeated ids side by side, ordered by length and
checksum). Null and empty texts hold the end id alone; very long texts are encoded whole, into
one frame; an empty table writes no shard and reads back as no rows; further columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import binary_list, open_fs, slices
from trailweave.llm.wordbpe import piece_table

MAGIC, VERSION = b"TWTK", 1
HEAD, ENTRY, FOOT = struct.Struct("<4sIQ"), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("end", "<u8")]), struct.Struct("<Q4s")
HEAD_BYTES = HEAD.size
#: Documents that the dictionary is trained on, their ids at most, and its bytes at most.
SAMPLE, SAMPLE_IDS, DICTIONARY = 2_000, 4_096, 65_536
#: Runs that the ids of a longer document are drawn in, from its first to its last.
RUNS = 16
#: Documents in a shard, about.
SHARD_DOCS = 20_000


def ids_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _head(digest: int) -> bytes:
    return HEAD.pack(MAGIC, VERSION, digest)


def _foot(place: int) -> bytes:
    return FOOT.pack(place, MAGIC)


def drawn_ids(ids: bytes) -> bytes:
    """All of a serialized id array, or ``SAMPLE_IDS`` of its ids in ``RUNS`` runs spread over the whole."""
    n, size = len(ids) // 4, SAMPLE_IDS // RUNS
    if n <= SAMPLE_IDS:
        return ids
    starts = [k * (n - size) // (RUNS - 1) for k in range(RUNS)]
    return b"".join(ids[4 * a : 4 * (a + size)] for a in starts)


def train_dictionary(df: DataFrame, path: str, key: str | None = None) -> bytes:
    """A dictionary for serialized id arrays; empty if there is too little to train on.

    ``key`` names the workers' piece tables that the encoding goes on with.
    """
    key = key or uuid.uuid4().hex
    hashed = df.where("text is not null").withColumn("h", F.xxhash64(F.col("doc_id"), F.length("text")))
    lowest = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first().h
    # repeated rows share a hash; the second limit bounds what comes to the driver
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(key, path)
        for batch in batches:
            for part in slices(batch):
                rows = table.lookup([(t or b"").split() for t in binary_list(part.column(0))])
                drawn = [drawn_ids(b"".join(r)) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.binary())], ["ids"])

    sampled = hashed.where(F.col("h") <= F.lit(lowest)).select("text").limit(SAMPLE)
    sampled = sampled.repartition(df.sparkSession.sparkContext.defaultParallelism)
    samples = [bytes(r.ids) for r in sampled.mapInArrow(run, "ids binary").collect()] if lowest is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY, [s for s in samples if s], level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(df: DataFrame, path: str, out: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Encode every text with the vocabulary file ``path``, append ``end_id``, write shards to ``out``.

    Texts are encoded and compressed where they are read; only frames move, to the shard that
    owns their range of ids. Returns the manifest, which is also written beside the shards.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_docs = docs.count()
    n_shards = max(1, min(65_536, -(-n_docs // SHARD_DOCS)), min(n_docs // 1000, spark.sparkContext.defaultParallelism))
    cuts = [k / n_shards for k in range(1, n_shards)]
    bounds = (docs.agg(F.percentile_approx("doc_id", cuts, 100 * n_shards).alias("b")).first().b if cuts else None) or []
    bounds = np.unique(np.asarray(bounds, "i8"))
    n_shards = len(bounds) + 1
    key = uuid.uuid4().hex
    dictionary = train_dictionary(docs, path, key)
    shared, digest = spark.sparkContext.broadcast(dictionary), xxhash.xxh64_intdigest(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(key, path)
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared.value), write_content_size=True)
        last = ids_bytes([end_id])
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                rows = [b"".join(x) + last for x in table.lookup([(x or b"").split() for x in binary_list(part.column(1))])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(np.searchsorted(bounds, [-(1 << 63) if i is None else i for i in ids], "right"), pa.int32()),
                        "doc_id": part.column(0),
                        "n": pa.array([len(r) // 4 for r in rows], pa.int64()),
                        "crc": pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                        "frame": pa.array([pack.compress(r) for r in rows], pa.binary()),
                    }
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out)
        fs.create_dir(base, recursive=True)
        shard, name, sink, place, index, total = None, "", None, 0, [], 0

        def close() -> pa.RecordBatch:
            entries = np.array(index, ENTRY)
            sink.write(entries.tobytes())
            sink.write(_foot(place))
            sink.close()
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(entries)], "n_ids": [total], "bytes": [place]}
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if sink:
                        yield close()
                    shard, place, index, total = row["shard"], HEAD_BYTES, [], 0
                    name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.bin"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    sink.write(_head(digest))
                sink.write(row["frame"])
                place += len(row["frame"])
                total += row["n"]
                null = row["doc_id"] is None
                index.append((0 if null else row["doc_id"], null, row["n"], place))
        if sink:
            yield close()

    fs, base = open_fs(out)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zstd") as f:
        f.write(dictionary)
    shards = (
        docs.mapInArrow(encode, "shard int, doc_id long, n long, crc long, frame binary")
        .repartitionById(n_shards, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "crc")
        .mapInArrow(write, "shard int, file string, n_docs long, n_ids long, bytes long")
        .collect()
    )
    # a sort in Spark would sample its input first, and so write all shards twice
    shards.sort(key=lambda s: s.shard)
    start, manifest = 0, {"dictionary": f"{digest:016x}", "end_id": end_id, "shards": []}
    for s in shards:
        manifest["shards"].append({"file": s.file, "start": start, "n_docs": s.n_docs, "n_ids": s.n_ids})
        start += s.n_ids
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """Random access to one shard: ``len``, and by position ``(doc_id, n, start, ids)``."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(0)
        magic, version, digest = HEAD.unpack(self.file.read(HEAD.size))
        self.file.seek(size - FOOT.size)
        place, last = FOOT.unpack(self.file.read(FOOT.size))
        if magic != MAGIC or last != MAGIC or version != VERSION or digest != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{path}: not a shard of this dictionary")
        self.file.seek(place)
        self.index = np.frombuffer(self.file.read(size - FOOT.size - place), ENTRY)
        self.starts = np.cumsum(self.index["n"], dtype="i8") - self.index["n"]
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def raw(self, k: int) -> bytes:
        begin = int(self.index["end"][k - 1]) if k else HEAD.size
        self.file.seek(begin)
        return self.unpack.decompress(self.file.read(int(self.index["end"][k]) - begin))

    def __getitem__(self, k: int) -> tuple[int | None, int, int, np.ndarray]:
        i = self.index[k]
        return None if i["null"] else int(i["id"]), int(i["n"]), int(self.starts[k]), np.frombuffer(self.raw(k), "<u4")


def read_token_files(spark, out: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the shards in ``out``: ``doc_id, start, n_tokens, ids_crc32``
    (and ``ids`` if asked for), inflated and checked against the index."""
    fs, base = open_fs(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out)
        with fs.open_input_stream(f"{base}/dictionary.zstd") as f:
            dictionary = f.read()
        for batch in batches:
            for s in batch.to_pylist():
                shard = Shard(fs, f"{base}/{s['file']}", dictionary)
                for a in range(0, len(shard), 512):
                    part = range(a, min(a + 512, len(shard)))
                    index, raw = shard.index[a : part.stop], [shard.raw(k) for k in part]
                    if [len(r) // 4 for r in raw] != index["n"].tolist():
                        raise ValueError(f"{s['file']}: its index does not fit its frames")
                    columns = {
                        "doc_id": pa.array(index["id"], pa.int64(), mask=index["null"].astype(bool)),
                        "start": pa.array(shard.starts[a : part.stop] + s["start"], pa.int64()),
                        "n_tokens": pa.array(index["n"].astype("i8")),
                        "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([np.frombuffer(r, "<u4").astype("i8") for r in raw], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    rows = [(k, s["file"], s["start"]) for k, s in enumerate(manifest["shards"])]
    files = spark.createDataFrame(rows, "k int, file string, start long")
    return files.repartitionById(max(1, len(rows)), F.col("k")).mapInArrow(read, kind)
