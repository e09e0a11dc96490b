"""Ranked lexical search over an inverted index whose posting blocks vary in length.

The index is a table: for each shard, a run of documents of one task of the scan, a row for each
term, with the documents that hold it, the impact of each (what the term adds to the document's
score, but for the term's weight) and blocks with the largest impact of each. Where a block ends
is chosen by dynamic programming: the sum of all overestimates, block bound less impact, and of a
fixed cost for each block is least. Texts never move; a shard holds at most ``SHARD_DOCS``
documents.

A search goes shard by shard. The block ends of all terms of an item cut the shard into
intervals, each with one bound, the sum of its blocks' bounds by their terms' weights. Intervals
are taken by falling bound, in batches of growing size. In a batch the pivot rule of WAND holds
for many documents at once: only documents are candidates that hold one of the terms without
which the bounds do not reach the threshold, the score of the item's ``top``-th document so far.
Candidates are scored in full. The search ends at the first interval whose bound is below the
threshold; blocks that lie in none of the intervals taken are never unpacked. This skips nothing
that could count, so results are exact. The best of the shards meet in two rounds of ranking.

Items are dealt to blocks of about ``BLOCK`` terms, which are broadcast one after the other; the
index keeps the terms of the items only, while they are few enough (``TERMS``), else all.

Defined results: null texts have no terms, are never found, and do not count in ``N``; an item
without terms has no rows; rows of an item id are one item, that of all their terms; rows of one
document id are documents of their own; ties go to the smaller id, a null id last; empty tables
give no rows; further columns are not read; very long texts are read whole.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.llm.common import binary_list, discard, materialize, released, slices, small_or_shuffled

SHARD_DOCS, BLOCK, TERMS = 16_384, 200_000, 1_000_000
#: Postings of a block at most, postings whose blocks are chosen together, and the cost of a block in mean overestimates of one posting.
LONGEST, SEGMENT, COST = 64, 512, 6.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INDEX = "shard long, term string, df long, places binary, impacts binary, ends binary, bounds binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def packed(a: np.ndarray) -> bytes:
    """Numbers as the width of the largest and their bytes."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or a.max() < 1 << 8 * w)
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("i8")


def _cut(x: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    """Of rows of impacts, padded with -1 at the end, the ends of the blocks of least total overestimate.

    ``error[i]`` is the least cost of the first ``i`` impacts; all rows take a step at a time. The
    columns of ``base``, ``most`` and ``begin`` are the last ``LONGEST`` places where a block may begin.
    """
    rows, n = x.shape
    size = (x >= 0).sum(1)
    at, width = np.arange(rows), min(LONGEST, n)
    upto = np.concatenate([np.zeros((rows, 1)), np.cumsum(np.maximum(x, 0), axis=1)], axis=1)
    error, back = np.zeros((rows, n + 1)), np.zeros((rows, n + 1), "i4")
    base, most, begin = np.full((rows, width), np.inf), np.zeros((rows, width)), np.zeros(width, "i8")
    for i in range(n):
        k = i % width
        base[:, k], most[:, k], begin[k] = error[:, i] + cost + upto[:, i], 0, i
        np.maximum(most, x[:, i : i + 1], out=most)
        total = most * (i + 1 - begin)
        total += base
        best = total.argmin(1)
        error[:, i + 1] = total[at, best] - upto[:, i + 1]
        back[:, i + 1] = begin[best]
    ends, now = [[] for _ in range(rows)], size.copy()
    while (now > 0).any():
        for r in np.flatnonzero(now > 0).tolist():
            ends[r].append(int(now[r]))
        now = np.where(now > 0, back[at, now], 0)
    return [np.array(e[::-1], "i8") for e in ends]


def blocks(impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ends of the blocks of each posting list, in lists one after the other."""
    pieces = [(k, a, min(SEGMENT, n - a)) for k, n in enumerate(sizes.tolist()) for a in range(0, n, SEGMENT)]
    pieces.sort(key=lambda p: p[2])
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in sizes]
    for a in range(0, len(pieces), 1024):
        part = pieces[a : a + 1024]
        x = np.full((len(part), part[-1][2]), -1.0)
        for r, (k, first, n) in enumerate(part):
            x[r, :n] = impacts[starts[k] + first : starts[k] + first + n]
        mean = np.maximum(x, 0).sum(1) / (x >= 0).sum(1)
        cost = np.maximum(1.0, COST * (x.max(1) - mean))
        for (k, first, _), ends in zip(part, _cut(x, cost), strict=True):
            found[k].append((first, first + ends))
    return [np.concatenate([e for _, e in sorted(f, key=lambda y: y[0])]) for f in found]


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = np.array([len(terms_of(t)) if t else 0 for t in binary_list(part.column(0))])
                yield pa.RecordBatch.from_pydict({"n": pa.array([int((n > 0).sum())], pa.int64()), "terms": pa.array([int(n.sum())], pa.int64())})

    got = docs.select("text").mapInArrow(run, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return got.n or 0, got.terms or 0


def index(docs: DataFrame, n_docs: int, n_terms: int, words: list[str] | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of ``docs(doc_id, text)``, see above; of ``words`` only, if given. The row of a shard without a term holds its ids (``places``) and which are null (``impacts``)."""
    asked = docs.sparkSession.sparkContext.broadcast(None if words is None else {w.encode(): k for k, w in enumerate(words)})

    def shard(number: int, numbers: dict, ids: list, seen: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s[0]) for s in seen])
        term, tf = (np.concatenate([s[j] for s in seen]) for j in (0, 1))
        place, n = np.repeat(np.arange(len(seen)), sizes), np.repeat([s[2] for s in seen], sizes)
        impact = 10**9 * tf // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms))
        order = np.argsort(term, kind="stable")
        term, place, impact = term[order], place[order], impact[order]
        names = list(numbers)
        found, starts, counts = np.unique(term, return_index=True, return_counts=True)
        null = np.array([i is None for i in ids])
        own = np.array([i or 0 for i in ids], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([number], [None], [len(ids)], [own.tobytes()], [np.packbits(null).tobytes()], [b""], [b""]), _types, strict=True)], _names)
        for a in range(0, len(found), 20_000):
            few = slice(a, a + 20_000)
            cut = blocks(impact, starts[few], counts[few])
            rows: list[list] = [[] for _ in range(7)]
            for t, b, c, ends in zip(found[few].tolist(), starts[few].tolist(), counts[few].tolist(), cut, strict=True):
                at, x = place[b : b + c], impact[b : b + c]
                bounds = np.maximum.reduceat(x, np.concatenate([[0], ends[:-1]]))
                for column, v in zip(rows, (number, names[t].decode(), c, packed(np.diff(at, prepend=0)), packed(x), packed(ends), packed(bounds)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, _types, strict=True)], _names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId() << 32, itertools.count()
        words, ids, seen, size = asked.value, [], [], 0
        numbers = defaultdict(itertools.count().__next__) if words is None else words
        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column(0).to_pylist(), binary_list(part.column(1)), strict=True):
                    found = terms_of(t) if t else []
                    if not found:
                        continue
                    tf = Counter(map(numbers.__getitem__ if words is None else numbers.get, found))
                    tf.pop(None, None)
                    ids.append(i)
                    seen.append((np.fromiter(tf.keys(), "i8", len(tf)), np.fromiter(tf.values(), "i8", len(tf)), len(found)))
                    size += len(tf)
                    if len(ids) >= shard_docs or size >= 512 * shard_docs:
                        yield from shard(task + next(count), numbers, ids, seen)
                        ids, seen, size = [], [], 0
                        if words is None:
                            numbers = defaultdict(itertools.count().__next__)
        if ids:
            yield from shard(task + next(count), numbers, ids, seen)
        released()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX)


_names = ["shard", "term", "df", "places", "impacts", "ends", "bounds"]
_types = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4]


class Postings:
    """A term's list in one shard; a block's postings are unpacked when it is read."""

    def __init__(self, places: bytes, impacts: bytes, ends: bytes, bounds: bytes, weight: int, top: int):
        self.place = np.cumsum(unpacked(places))
        self.impacts, self.width = np.frombuffer(impacts, f"<u{impacts[0]}", offset=1), weight
        self.ends, self.bounds = unpacked(ends), unpacked(bounds) * weight
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.first, self.past = self.place[self.begins], self.place[self.ends - 1] + 1
        self.most = int(self.bounds.max())
        # so many documents score as much by this term alone
        self.sure = int(np.partition(self.impacts, -top)[-top]) * weight if len(self.impacts) >= top else 0

    def read(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the blocks that meet places of ``live`` (how many are, before each place)."""
        use = np.flatnonzero(live[self.past] > live[self.first])
        if len(use) == len(self.ends):
            return self.place, self.impacts.astype("i8") * self.width
        size = self.ends[use] - self.begins[use]
        at = np.repeat(self.begins[use] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(use) else use
        return self.place[at], self.impacts[at].astype("i8") * self.width


def best(lists: list[Postings], n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a shard that can be among the ``top`` of an item, ties at the end included."""
    if not lists:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    points, inverse = np.unique(np.concatenate([x.first for x in lists] + [x.past for x in lists]), return_inverse=True)
    steps = np.concatenate([x.bounds for x in lists] + [-x.bounds for x in lists])
    bound = np.cumsum(np.bincount(inverse, steps, len(points)))[:-1].round().astype("i8")
    begin, end = points[:-1], points[1:]
    order = np.argsort(-bound, kind="stable")
    upto = np.cumsum((end - begin)[order])
    lists = sorted(lists, key=lambda x: x.most)
    below = np.cumsum([x.most for x in lists])
    threshold, done, want = max(1, *(x.sure for x in lists)), 0, 4 * top
    places, scores = np.zeros(0, "i8"), np.zeros(0, "i8")
    while done < len(order) and bound[order[done]] >= threshold:
        stop = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + want)) + 1
        use = order[done:stop]
        use = use[bound[use] >= threshold]
        change = np.zeros(n_docs + 1, "i8")
        np.add.at(change, begin[use], 1)
        np.add.at(change, end[use], -1)
        inside = np.cumsum(change)[:-1] > 0
        live = np.concatenate([[0], np.cumsum(inside)])
        score, pivot = np.zeros(n_docs, "i8"), np.zeros(n_docs, bool)
        for x, upto_here in zip(lists, below, strict=True):
            at, add = x.read(live)
            score[at] += add
            if upto_here >= threshold:
                pivot[at] = True
        found = np.flatnonzero(pivot & inside & (score >= threshold))
        places, scores = np.concatenate([places, found]), np.concatenate([scores, score[found]])
        if len(scores) >= top:
            threshold = max(threshold, int(np.partition(scores, -top)[-top]))
        done, want = stop, want * 4
    keep = scores >= threshold
    return places[keep], scores[keep]


def _first(df: DataFrame, top: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return df.withColumn("rank", rank).where(F.col("rank") <= top)


def _search(rows: DataFrame, items: dict[int, list[str]], top: int) -> DataFrame:
    """``item, shard, doc_id, score``: the best documents of each shard; ``rows``: the index with weights."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns, lists = table.to_pydict(), {}
        for term, df, places, impacts, ends, bounds, weight in zip(*[columns[c] for c in (*_names[1:], "weight")], strict=True):
            if term is None:
                ids, null = np.frombuffer(places, "<i8"), np.unpackbits(np.frombuffer(impacts, "u1"), count=df).astype(bool)
            elif weight:
                lists[term] = Postings(places, impacts, ends, bounds, weight, top)
        out: dict[str, list] = {"item": [], "doc_id": [], "score": [], "null": []}
        for item, terms in shared.value.items():
            at, score = best([lists[t] for t in terms if t in lists], len(ids), top)
            order = np.lexsort((ids[at], null[at], -score))[:top]
            out["item"].append(np.full(len(order), item))
            for name, v in (("doc_id", ids[at]), ("score", score), ("null", null[at])):
                out[name].append(v[order])
        item, doc_id, score, null = (np.concatenate(v) if v else np.zeros(0, "i8") for v in out.values())
        return pa.table({"item": pa.array(item, pa.int64()), "shard": pa.array(np.full(len(item), key[0].as_py()), pa.int64()), "doc_id": pa.array(doc_id, pa.int64(), mask=null.astype(bool)), "score": pa.array(score, pa.int64())})

    return rows.groupBy("shard").applyInArrow(run, "item long, shard long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, block: int = BLOCK, limit: int = TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item of ``items(item_id, text)``."""
    spark: SparkSession = docs.sparkSession
    asked = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERM), F.lit(0)))).alias("term")).distinct()
    asked = materialize(asked, "asked")
    words = [r.term for r in asked.select("term").distinct().limit(limit + 1).collect()]
    n_docs, n_terms = statistics(docs)
    postings = materialize(index(docs, n_docs, max(1, n_terms), words if len(words) <= limit else None, shard_docs), "postings")
    df = postings.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = materialize(df.join(asked.select("term").distinct(), "term", "left_semi").select("term", weight.alias("weight")), "weights")
    n_blocks = max(1, -(-asked.count() // block))
    of_block = F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(n_blocks))
    found = []
    for k in range(n_blocks):
        part = asked.where(of_block == k).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        own = weights.join(asked.where(of_block == k).select("term").distinct(), "term", "left_semi")
        rows = postings.join(small_or_shuffled(own), "term", "left").where("term is null or weight is not null")
        local = _search(rows, {i: r.terms for i, r in enumerate(part)}, top)
        few = _first(local.withColumn("deal", F.pmod("shard", F.lit(61))), top, "item", "deal").drop("rank")
        few = _first(few, top, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found.append(few if n_blocks == 1 else materialize(few, "ranked"))
    out = found[0]
    for few in found[1:]:
        out = out.unionByName(few)
    out = materialize(out, "ranked") if n_blocks == 1 else out
    discard(postings, asked, weights)
    return out


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT r, doc_id, 50 + ((50 * n * nn) // ll) AS m FROM d, s),
x AS (SELECT item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
WHERE rank <= 50
"""
