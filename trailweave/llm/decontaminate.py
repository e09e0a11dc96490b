"""Benchmark passages in documents by greedy string tiling.

Words are runs of letters and digits, lower-cased. Rolling hashes of ``SEED`` words of all
benchmark items are the seeds that documents and items meet by. Tiles are then marked from the
longest common run to the shortest: for a length, rolling hashes of all its runs that no tile has
touched are compared, and matches are confirmed seed by seed; runs below ``SEED`` words are dropped. An item is held by a document if its tiles cover at
least ``COVER`` of the item's words, in whatever order they stand in the document.

The benchmark's seeds are a table (hash, item, places). A bit array of a bounded size, ``BITS`` at
most, that every seed sets two bits of goes to the workers; a document's seeds that pass it are
rows, each with the list of its places, that meet the table of seeds in an equi-join (by broadcast
while the table is small). So words repeated on both sides meet as two lists, not as the product
of their places. The lists of a document and an item are then tiled together. So documents are read once whatever
the benchmark's size, the driver holds the bit array only, and a passage that a third of all
documents share makes matches of many documents, each tiled on its own.

Items of fewer than ``SEED`` words count if all their words stand together. Equal runs are taken
in the order of their places in the document, then in the item. Null and empty texts and items
hold nothing; rows of the same id and text give one result; items that repeat do as well; very
long texts are hashed whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trailweave.llm.common import materialize, slices, small_or_shuffled, word_hashes

SEED, COVER = 5, 0.5
#: Bits for each seed of the benchmark, and at most.
SEED_BITS, BITS = 32, 1 << 28
_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_numbers(text: str | None) -> np.ndarray:
    """The words of a text as 64-bit hashes."""
    if not text:
        return np.empty(0, "u8")
    return word_hashes(text.lower().encode().translate(_SPACE).split())


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2 ** 64) of all runs of ``n`` words."""
    if len(words) < n:
        return np.empty(0, "u8")
    out = np.zeros(len(words) - n + 1, "u8")
    for j in range(n):
        out = out * _BASE + words[j : j + len(out)]
    return out


class _Seeds:
    """Seeds of a text in the order of their places, and which of them tiles have taken a word of."""

    def __init__(self, at: np.ndarray, codes: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        self.at, self.codes = at[order], codes[order]
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(at), b, "u8")], dtype="u8") for b in (_BASE, _INVERSE))
            self.sums = np.r_[np.uint64(0), np.cumsum(self.codes * up[:-1], dtype="u8")]
        self.down, self.taken = down, np.zeros(len(at), bool)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``k`` free seeds follow each other place by place, and the Karp-Rabin hashes of these runs."""
        n = len(self.at) - k + 1
        if n < 1:
            return np.empty(0, "i8"), np.empty(0, "u8")
        used = np.r_[0, np.cumsum(self.taken)]
        i = np.flatnonzero((self.at[k - 1 :] - self.at[:n] == k - 1) & (used[k:] == used[:n]))
        return i, (self.sums[i + k] - self.sums[i]) * self.down[i]

    def take(self, start: int, length: int, least: int) -> None:
        a, b = np.searchsorted(self.at, [start - least + 1, start + length])
        self.taken[a:b] = True


def tiles(starts: np.ndarray, hashes: np.ndarray, places: np.ndarray, item_hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds, runs of ``least`` words at ``starts`` of a document and ``places`` of an item
    with their hashes: (start, place, length), longest first.

    The longest length at which a free run of both sides is alike is found by halving, then all its
    matches are marked in one pass over the document. A length costs time in proportion to the
    document's seeds and the item's, however often these repeat.
    """
    doc, item, out = _Seeds(starts, hashes), _Seeds(places, item_hashes), []
    longest = len(places)
    while longest:
        low = 0
        while low < longest:
            k = (low + longest + 1) // 2
            if np.isin(item.runs(k)[1], doc.runs(k)[1]).any():
                low = k
            else:
                longest = k - 1
        if not low:
            break
        (i, h), (j, g) = doc.runs(low), item.runs(low)
        there: dict[int, deque] = {}
        for q, x in zip(j.tolist(), g.tolist(), strict=True):
            there.setdefault(x, deque()).append(q)
        both, size, free = np.isin(h, g), low + least - 1, -1
        for p, x in zip(i[both].tolist(), h[both].tolist(), strict=True):
            start = int(doc.at[p])
            if start < free or x not in there:
                continue
            left = there[x]
            while left and item.taken[left[0] : left[0] + low].any():
                left.popleft()
            alike = (q for q in left if not item.taken[q : q + low].any() and np.array_equal(item.codes[q : q + low], doc.codes[p : p + low]))
            if (q := next(alike, None)) is not None:
                place, free = int(item.at[q]), start + size
                out.append((start, place, size))
                doc.take(start, size, least)
                item.take(place, size, least)
            elif not left:
                del there[x]
                if not there:
                    break
        longest = low - 1
    return out


def seed_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words that differ for different ``n``."""
    h = rolling(words, n) ^ np.uint64(n)
    h = (h ^ (h >> np.uint64(32))) * _BASE
    return h ^ (h >> np.uint64(29))


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in an array of ``size`` bits, a power of two."""
    mask = np.uint64(size - 1)
    return (h & mask).astype("i8"), ((h >> np.uint64(33)) & mask).astype("i8")


def item_seeds(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``hash, n, item_id, item, places, item_words``: a row for each seed of each different item, with all its places; ``item`` tells texts of an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = word_numbers(t)
                if len(w):
                    n = min(SEED, len(w))
                    h, places = _listed(seed_hashes(w, n), np.arange(len(w) - n + 1))
                    fixed = [n, i, _key(w), len(w)]
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                    n, i, item, size = (pa.array([x] * len(h), k) for x, k in zip(fixed, kinds, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), n, i, item, places, size], ["hash", "n", "item_id", "item", "places", "item_words"])

    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, "hash long, n int, item_id long, item long, places array<int>, item_words int").distinct()


def _listed(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Different hashes and, for each, the list of its places in ascending order."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, "i8")
    return h[first], pa.ListArray.from_arrays(np.r_[first, len(h)].astype("i4"), pa.array(at[order].astype("i4")))


def _key(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The bit array of all seeds (as bytes), its size, and the seeds' lengths in words."""
    total = seeds.agg(F.count("*").alias("n"), F.collect_set("n").alias("lengths")).first()
    size = min(BITS, 1 << max(10, math.ceil(math.log2(SEED_BITS * total.n + 1))))
    part = size // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column(0).to_numpy()
            for k in np.unique(bits // part).tolist():
                own = found.setdefault(k, np.zeros(part, bool))
                own[bits[bits // part == k] - k * part] = True
        for k, own in found.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    mask = F.lit(size - 1)
    both = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 33).bitwiseAND(mask))
    spread = seeds.select(F.explode(both).alias("bit")).repartition(16, F.floor(F.col("bit") / part))
    out = np.zeros(size // 8, "u1")
    for r in spread.mapInArrow(run, "part int, bits binary").collect():  # a sixteenth of the array in each row
        out[r.part * part // 8 : (r.part + 1) * part // 8] |= np.frombuffer(bytes(r.bits), "u1")
    return out, size, sorted(total.lengths)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1 == 1


def _places(bits, lengths: list[int], size: int):
    """Rows ``doc_id, text, hash, starts`` of documents' seeds that pass the filter, with all their places; ``text`` is a hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, keys, hashes, starts = [], [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    w, key = word_numbers(t), None
                    for n in lengths:
                        h = seed_hashes(w, n)
                        a, b = _bits(h, size)
                        at = np.flatnonzero(_set(bits.value, a) & _set(bits.value, b))
                        if len(at):
                            key = _key(w) if key is None else key
                            own, lists = _listed(h[at], at)
                            owner += [k] * len(own)
                            keys += [key] * len(own)
                            hashes.append(own)
                            starts.append(lists)
                if owner:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(owner)),
                            pa.array(keys, pa.int64()),
                            pa.array(np.concatenate(hashes).view("i8")),
                            pa.concat_arrays(starts),
                        ],
                        ["doc_id", "text", "hash", "starts"],
                    )

    return run


def _flat(lists: pa.ListArray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all lists, and the hash that each belongs to."""
    return lists.flatten().to_numpy().astype("i8"), np.repeat(hashes, lists.value_lengths().to_numpy())


_GROUP = ["doc_id", "text", "item_id", "item", "item_words", "n"]


def _tiled(cover: float):
    """Matches, ordered by document and item, to rows of the items that documents hold."""

    def held(rows: pa.Table) -> Iterator[dict]:
        codes = [rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in _GROUP]
        change = np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0)
        cuts = np.append(np.flatnonzero(change), len(rows))
        hashes = rows["hash"].to_numpy().view("u8")
        starts, places = (rows[c].combine_chunks() for c in ("starts", "places"))
        words, n = rows["item_words"].to_numpy(), rows["n"].to_numpy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            size, least = int(words[a]), int(n[a])
            place, of_item = _flat(places.slice(a, b - a), hashes[a:b])
            there = len(place)
            if min(there + least - 1, least * there) < cover * size and least * there < cover * size:
                continue
            found = tiles(*_flat(starts.slice(a, b - a), hashes[a:b]), place, of_item, least)
            covered = sum(t[2] for t in found)
            if covered >= cover * size:
                yield {"at": a, "n_tiles": len(found), "covered": covered}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            found = list(held(rows))
            if found:
                own = rows.select(["doc_id", "text", "item_id", "item_words"]).take(pa.array([x["at"] for x in found])).combine_chunks()
                columns = [own[c].combine_chunks() for c in own.column_names]
                for c in ("n_tiles", "covered"):
                    columns.append(pa.array([x[c] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*own.column_names, "n_tiles", "covered"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            last = rows.slice(len(rows) - 1, 1).to_pylist()[0]
            # the last pair may go on in the next batch
            same = np.ones(len(rows), bool)
            for c in _GROUP:
                column = rows[c].combine_chunks()
                mine = column.is_null() if last[c] is None else pc.equal(column, pa.scalar(last[c], column.type)).fill_null(False)
                same &= mine.to_numpy(zero_copy_only=False)
            first = int(np.argmax(same))
            if first:
                yield from out(rows.slice(0, first))
            waiting = rows.slice(first)
        if waiting is not None:
            yield from out(waiting)

    return run


def _held(docs: DataFrame, items: DataFrame, cover: float, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """``doc_id, text, item_id, item_words, n_tiles, covered`` of held items; ``text`` is a hash of the document's words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    seeds = materialize(item_seeds(items, item_id, item_text), "seeds")
    bits, size, lengths = seed_filter(seeds)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    places = rows.mapInArrow(_places(shared, lengths, size), f"doc_id {kind}, text long, hash long, starts array<int>")
    parts = max(8, docs.rdd.getNumPartitions())
    return (
        places.distinct()
        .join(small_or_shuffled(seeds), "hash")
        .repartition(parts, "doc_id", "text", "item_id", "item")
        .sortWithinPartitions(*_GROUP)
        .select(*_GROUP, "hash", "starts", "places")
        .mapInArrow(_tiled(cover), f"doc_id {kind}, text long, item_id long, item_words int, n_tiles long, covered long")
    )


def contamination(
    docs: DataFrame, items: DataFrame, cover: float = COVER, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, n_tiles, covered, item_words, coverage``: a row for each held item of each different document."""
    out = _held(docs, items, cover, doc_id, text, item_id, item_text)
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("doc_id", "item_id", "n_tiles", "covered", long("item_words"), (F.col("covered") / F.col("item_words")).alias("coverage"))


def decontaminated(docs: DataFrame, items: DataFrame, cover: float = COVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose ``text`` holds an item; other columns as they are."""
    held = materialize(_held(docs, items, cover, doc_id, text, "item_id", "text").select("doc_id", F.col("text").alias("words")).distinct(), "held")
    names = {*docs.columns}
    key = next(f"_words{k}" for k in range(len(names) + 1) if f"_words{k}" not in names)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_key(word_numbers(t)) for t in texts], pa.int64())], [*part.schema.names, key])

    held = small_or_shuffled(held.select(F.col("doc_id").alias(f"{key}_id"), "words"))
    ids = held.select(f"{key}_id").distinct()
    same = lambda d: docs[doc_id].eqNullSafe(d[f"{key}_id"])
    suspects = docs.join(ids, same(ids), "left_semi").mapInArrow(keyed, StructType([*docs.schema.fields, StructField(key, LongType())]))
    clean = suspects.join(held, suspects[doc_id].eqNullSafe(held[f"{key}_id"]) & (suspects[key] == held["words"]), "left_anti").select(docs.columns)
    return docs.join(ids, same(ids), "left_anti").select(docs.columns).unionByName(clean)
