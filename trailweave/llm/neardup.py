"""Near-duplicate documents by compressed MinHash registers, with exact links.

A document is the set of its distinct word shingles (64-bit hashes; a text of fewer words
than a shingle is one element). Its registers are a one-permutation MinHash of ``2 ** P``
buckets, of which each keeps only the leading-zero count and ``MANTISSA`` bits of its
minimum; a bucket without an element takes the minimum of a hash of its own over the set.
``BANDS`` bands of ``ROWS`` registers make candidates: at a Jaccard similarity of 0.8 a pair
shares no band with a probability of about 1e-7.

Documents of equal sets are one class before anything else happens, so exact copies are
never paired. Classes that share a band are tied to the band's smallest member (a star, not
all pairs); the connected groups of this graph are dealt to blocks of about ``BLOCK`` members.
First all blocks of a group are compared with one of them, which ties most of a large group of
copies together at a cost in proportion to its size. Only members outside the group's largest
part are then compared with all of it: through the group or, where they are very many, band by
band. A comparison takes two blocks: of the pairs that share a band, those whose
collision-corrected register estimate lies far below the threshold are left out, the others are
decided on their full sets. So which pairs can be linked is the same at every size, and pairs
are left uncompared only where both are tied together already. A task reports a spanning
forest of the links it found, which keeps every component whole.

Nulls and texts without words have no set: no links, their own component, kept. A null id
takes no part: component null, kept. Rows that share an id are one document. Repeated rows
give repeated results. Very long texts give all their shingles. An empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import binary_list, connected_components, discard, materialize, released, slices, small_or_shuffled, word_hashes

P, MANTISSA, BANDS, ROWS = 8, 10, 40, 5
#: Members of a block, of those that a whole group is compared with first and of others.
FIRST, BLOCK = 64, 256
#: Standard errors below the threshold at which the estimate rules a pair out.
SLACK = 6.0
_RNG = np.random.Generator(np.random.PCG64(20240501))
_ODD = _RNG.integers(0, 1 << 63, 1 << P, "u8") * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 1 << P, "u8")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles: words between ASCII white
    space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = word_hashes(words)
    n = max(1, len(h) - k + 1)
    if len(h) < k:
        return _mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], "u8"))
    out = np.full(n, k, "u8")
    for j in range(k):
        out = (out ^ h[j : j + n]) * _M1
        out ^= out >> _S33
    return np.unique(_mix(out))


def registers(s: np.ndarray) -> np.ndarray:
    """The ``2 ** P`` compressed registers of a non-empty set, 16 bits each."""
    low = s & np.uint64((1 << 56) - 1)
    bucket = (s >> np.uint64(64 - P)).astype("i8")
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = np.zeros(1 << P, "u8")
    least[bucket[first]] = low[first]
    empty = np.ones(1 << P, bool)
    empty[bucket[first]] = False
    gaps = np.flatnonzero(empty)
    if len(gaps):
        for a in range(0, len(gaps), 64):
            g = gaps[a : a + 64]
            v = s[:, None] * _ODD[g] + _ADD[g]
            v = (v ^ (v >> _S33)) * _M2
            least[g] = v.min(axis=0) >> np.uint64(8)
    mantissa, exponent = np.frexp(least.astype("f8"))
    zeros = np.clip(57 - exponent, 0, 63)
    return (zeros << MANTISSA | ((mantissa * 2 - 1).clip(0) * (1 << MANTISSA)).astype("i8")).astype("u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs[: BANDS * ROWS].reshape(BANDS, ROWS).astype("u8")
    key = np.arange(1, BANDS + 1, dtype="u8")
    for j in range(ROWS):
        key = _mix(key * _M1 + r[:, j])
    return key.view("i8")


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from two register arrays, less the collisions of different minima.

    Two different minima agree in their leading zeros with probability 1/3 at equal sizes
    (less at others) and then in all mantissa bits with 2 ** -MANTISSA.
    """
    ratio = 4 * n * m / (n + m) ** 2
    c = ratio / 3 / (1 << MANTISSA)
    return max(0.0, (float(np.mean(a == b)) - c) / (1 - c))


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, hi, lo, bands = [], [], [], []
                for text in binary_list(part.column(1)):
                    s = shingle_set(text, k)
                    n.append(len(s))
                    if len(s):
                        d = xxhash.xxh3_128_intdigest(s.tobytes())
                        hi.append((d >> 64) - (1 << 63))
                        lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                        bands.append(band_keys(registers(s)))
                    else:
                        hi.append(None)
                        lo.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in (n, hi, lo)), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n", "hi", "lo", "bands"],
                )
        released()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in slices(batch):
                ids, sets = [], []
                for i, text in zip(part.column(0).to_pylist(), binary_list(part.column(1)), strict=True):
                    s = shingle_set(text, k)
                    key = (i, xxhash.xxh3_64_intdigest(s.tobytes()))
                    if len(s) and key not in seen:
                        seen.add(key)
                        ids.append(i)
                        sets.append(s.tobytes())
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "elements"])

    return run


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Index pairs that share a band and whose sets have a Jaccard similarity of ``percent`` or more, exactly.

    ``right`` None: pairs within ``left``. Pairs that the registers rule out are not counted.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], "i8")
    rows = np.arange(len(left))
    cols = np.arange(len(left), len(sets)) if right is not None else rows
    regs = np.stack([registers(s) for s in sets])
    bands = np.stack([band_keys(r) for r in regs])
    sa, sb = sizes[rows][:, None], sizes[cols][None, :]
    wanted = 100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)
    if right is None:
        wanted &= rows[:, None] < cols[None, :]
    floor = percent / 100 - SLACK * np.sqrt(0.16 / np.minimum(np.maximum(sa, sb), 1 << P))
    for i in rows:
        near = np.flatnonzero(wanted[i])
        shared = (bands[cols[near]] == bands[i]).any(axis=1)
        wanted[i, near[~shared]] = False
        near = near[shared]
        if len(near):
            same = (regs[cols[near]] == regs[i]).mean(axis=1)
            ratio = 4 * sizes[i] * sb[0, near] / (sizes[i] + sb[0, near]) ** 2
            c = ratio / 3 / (1 << MANTISSA)
            wanted[i, near] = (same - c) / (1 - c) >= floor[i, near]
    use = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(use[0]):
        return np.empty((0, 2), "i8")
    if len(use[0]) == len(use[1]) == 1:
        pair = int(rows[use[0][0]]), int(cols[use[1][0]])
        both = len(np.intersect1d(sets[pair[0]], sets[pair[1]], assume_unique=True))
        return np.array([pair]) if 100 * both >= percent * (sizes[list(pair)].sum() - both) else np.empty((0, 2), "i8")
    members = np.union1d(rows[use[0]], cols[use[1]])
    owner = np.repeat(np.arange(len(members)), sizes[members])
    _, inverse, count = np.unique(np.concatenate([sets[k] for k in members]), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    keep = order[count[inverse[order]] > 1]
    column = np.unique(inverse[keep], return_inverse=True)[1]
    both = np.zeros((len(members), len(members)), "f4")
    width = max(1, int(column.max()) + 1) if len(column) else 1
    for a in range(0, width, 4096):
        here = (column >= a) & (column < a + 4096)
        dense = np.zeros((len(members), min(4096, width - a)), "f4")
        dense[owner[keep[here]], column[here] - a] = 1
        both += dense @ dense.T
    at = np.zeros(len(sets), "i8")
    at[members] = np.arange(len(members))
    i, j = np.nonzero(wanted)
    shared = both[at[rows[i]], at[cols[j]]].astype("i8")
    good = 100 * shared >= percent * (sizes[rows[i]] + sizes[cols[j]] - shared)
    return np.stack([rows[i[good]], cols[j[good]]], axis=1)


def _forest(nodes: list[int], links: np.ndarray) -> Iterator[tuple[int, int]]:
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            yield nodes[i], nodes[j]


def _compare(percent: int):
    """Links of comparisons ``(group, lo, hi)``: members of side 0 with those of side 1, or among themselves where lo = hi."""

    def links(key: tuple, part: list[tuple]) -> list[tuple[int, int]]:
        sides = [[x for x in part if x[0] == k] for k in (0, 1)]
        within = key[1] == key[2]
        if not sides[0] or (len(sides[0]) < 2 if within else not sides[1]):
            return []
        arrays = [[np.frombuffer(x[2], "u8") for x in side] for side in sides]
        found = links_between(arrays[0], None if within else arrays[1], percent)
        return list(_forest([x[1] for x in sides[0] + sides[1]], found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, out = None, [], []
        for batch in batches:
            for group, lo, hi, side, node, elements in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, lo, hi) != key:
                    if part:
                        out += links(key, part)
                    key, part = (group, lo, hi), []
                part.append((side, node, elements))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if part:
            out = links(key, part)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _links(docs: DataFrame, dealt: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: forests of the comparisons of ``dealt(node, group, lo, hi, side)``."""
    parts = max(1, docs.rdd.getNumPartitions())
    nodes = small_or_shuffled(dealt.select("node").distinct())
    sets = docs.join(nodes, docs.doc_id == F.col("node"), "left_semi").mapInArrow(_sets(k), "node long, elements binary")
    return (
        sets.join(dealt, "node")
        .repartition(4 * parts, "group", "lo", "hi")
        .sortWithinPartitions("group", "lo", "hi")
        .select("group", "lo", "hi", "side", "node", "elements")
        .mapInArrow(_compare(percent), "a long, b long")
    )


def _blocks(size: Column, rows: int) -> Column:
    return (F.floor((size - 1) / rows) + 1).cast("int")


def _against(loose: DataFrame, every: DataFrame) -> DataFrame:
    """Comparisons of ``loose(node, group)`` with ``every(node, group)``, both in blocks: one that has ``loose`` on side 0."""
    count = lambda df, c: df.groupBy("group").agg(_blocks(F.count("*"), BLOCK).alias(c))
    sizes = count(loose, "lows").join(count(every, "highs"), "group")

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node", "group"), own).cast("int").alias("block")
        return df.join(small_or_shuffled(sizes), "group").select("node", "group", block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))

    low = side(loose, "lows", "highs").select("node", "group", F.col("block").alias("lo"), (-F.col("other") - 1).alias("hi"), F.lit(0).alias("side"))
    high = side(every, "highs", "lows").select("node", "group", F.col("other").alias("lo"), (-F.col("block") - 1).alias("hi"), F.lit(1).alias("side"))
    return low.unionByName(high)


def near_duplicates(
    df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", many: int = BANDS * BLOCK
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; see the module.

    ``many``: of a group's members outside its largest part, how many are compared with the group
    as a whole; more are compared band by band, which ships fewer sets and finds the same links.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = materialize(docs.mapInArrow(_sketches(k), "doc_id long, n long, hi long, lo long, bands array<long>"), "sketches")
    classes = (
        sketches.where("n > 0 and doc_id is not null")
        .groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes, "classes")
    members = classes.select("node", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    star = members.join(hubs.select("band", "hub"), "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = materialize(connected_components(star, "groups").withColumnRenamed("component", "group"), "grouped")
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    sized = groups.join(sizes, "group").withColumn("blocks", _blocks(F.col("size"), FIRST))
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = sized.withColumn("block", block).select(
        "node",
        "group",
        F.lit(0).alias("lo"),
        F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("hi"),
        F.least("block", F.lit(1)).alias("side"),
    )
    dealt = materialize(dealt, "dealt")
    found = materialize(_links(docs, dealt, k, percent), "found")
    written = [groups, dealt, found]
    large = sized.where("blocks > 1").select("node", "group")
    if large.limit(1).count():
        # members outside the largest part of their group are compared with all of it
        part = materialize(connected_components(found, "parts"), "parts")
        large = large.join(part, "node", "left").select("node", "group", F.coalesce("component", "node").alias("part"))
        largest = large.groupBy("group", "part").count().groupBy("group").agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
        large = materialize(large.join(small_or_shuffled(largest), "group"), "large")
        loose = materialize(large.where("part <> largest").select("node", "group"), "loose")
        crowded = loose.groupBy("group").count().where(F.col("count") > many).select("group")
        written += [part, large, loose]
        if loose.limit(1).count():
            whole = _against(loose.join(small_or_shuffled(crowded), "group", "left_anti"), large.select("node", "group"))
            banded = lambda df: df.join(small_or_shuffled(crowded), "group", "left_semi").join(members, "node").select("node", F.col("band").alias("group"))
            of_bands = _against(banded(loose), banded(large.select("node", "group")))
            again = materialize(whole.unionByName(of_bands), "dealt")
            more = materialize(_links(docs, again, k, percent), "found")
            written += [again, more]
            found = found.unionByName(more)
    components = materialize(connected_components(found, "links"), "components")
    of_class = (
        classes.select("hi", "lo", "node", "copies")
        .join(components, "node", "left")
        .where("copies > 1 or component is not null")
        .select("hi", "lo", F.coalesce("component", "node").alias("component_id"))
    )
    of_class = materialize(of_class, "of-class")
    out = (
        sketches.select("doc_id", "n", "hi", "lo")
        .join(small_or_shuffled(of_class), ["hi", "lo"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    discard(*written, classes, components)
    return out
