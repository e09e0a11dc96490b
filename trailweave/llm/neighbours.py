"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` vectors (those of the smallest hash of their id; a
documented bound), ``BRANCH`` children a node. A leaf that holds more than ``LEAF_ROWS`` rows of
the table is split further by a tree of its own, fitted in a task on at most ``SAMPLE`` of the
leaf's rows, and so on, so that leaves stay as small as the table grows (up to ``LEAVES``
leaves, whose centres are all that driver and workers hold). Every vector is indexed in the
leaf that the descent to the nearest child reaches. A query walks the tree best bin first: a
priority queue holds nodes by the inner product that their vectors could have at most (centre
and radius), and leaves are visited in the order in which they leave the queue. How many are
visited is calibrated: on queries from the sample the number is widened until their exact
neighbours in the sample are found with recall ``RECALL``.

Vectors of a leaf are dealt to blocks of about ``BLOCK`` rows, so that a crowded leaf (one
vector held by a third of all rows, say) is many tasks' work; a block compares its distinct
vectors with its queries, some hundred at a time, and keeps the best for each query. Products
are in double precision, row by row, so equal vectors have equal scores; ties go to the
smaller id. Vectors that are null, empty, zero, or that hold null or non-finite components take
no part, nor do null ids. A query is compared with vectors of its own length: those of the
sample's most frequent length are in the tree, those of each other length are a leaf of their
own. A row whose id repeats is a candidate as often as it occurs, but never of its own id's
query. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import discard, materialize

SAMPLE, BRANCH, LEAF, RECALL, BLOCK = 20_000, 8, 1_200, 0.95, 8192
#: Rows of a leaf beyond which it is split, and leaves beyond which none is.
LEAF_ROWS, LEAVES = 16_384, 65_536


class Tree:
    """Centres, radii and children by node; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, most: int = LEAF):
        self.centre, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves, self.most = 0, most
        self._rng = np.random.Generator(np.random.PCG64(7))
        self._grow(x)

    def _grow(self, x: np.ndarray) -> int:
        node = len(self.centre)
        c = x.mean(axis=0)
        self.centre.append(c)
        self.radius.append(float(np.sqrt(np.max(((x - c) ** 2).sum(axis=1)))))
        self.children.append([])
        self.leaf.append(-1)
        if len(x) > max(self.most, BRANCH):
            centres = x[self._rng.choice(len(x), BRANCH, replace=False)]
            for _ in range(10):
                near = np.argmin(self._far(x, centres), axis=1)
                centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(BRANCH)])
            near = np.argmin(self._far(x, centres), axis=1)
            groups = [x[near == j] for j in range(BRANCH) if (near == j).any()]
            if len(groups) > 1:
                self.children[node] = [self._grow(g) for g in groups]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def grafted(self, subtrees: dict[int, "Tree"]) -> None:
        """Puts trees in the place of leaves, and numbers the leaves anew."""
        for node in range(len(self.centre)):
            sub = subtrees.get(self.leaf[node]) if self.leaf[node] >= 0 else None
            if sub is not None and sub.children[0]:
                at = len(self.centre)
                self.centre += sub.centre
                self.radius += sub.radius
                self.children += [[k + at for k in kids] for kids in sub.children]
                self.leaf += [0 if leaf >= 0 else -1 for leaf in sub.leaf]
                self.children[node], self.leaf[node] = self.children[at], -1
        ends = [k for k, leaf in enumerate(self.leaf) if leaf >= 0 and not self.children[k]]
        for n, k in enumerate(ends):
            self.leaf[k] = n
        self.leaves = len(ends)

    @staticmethod
    def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c**2).sum(axis=1)[None, :] - 2 * x @ c.T

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), "i8")

        def go(node: int, at: np.ndarray) -> None:
            kids = self.children[node]
            if not kids:
                out[at] = self.leaf[node]
            elif len(at):
                near = np.argmin(self._far(x[at], np.stack([self.centre[k] for k in kids])), axis=1)
                for j, k in enumerate(kids):
                    go(k, at[near == j])

        go(0, np.arange(len(x)))
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a query, best bin first."""
        norm, out = float(np.sqrt(q @ q)), []
        heap = [(0.0, 0)]
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for k in self.children[node]:
                heapq.heappush(heap, (-(float(q @ self.centre[k]) + 0.25 * norm * self.radius[k]), k))
        return out


def usable(v: Column) -> Column:
    """Whether a vector takes part: components there and finite, not all of them zero."""
    x = v.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.coalesce(F.when(F.size(x) > 0, fine), F.lit(False))


def _calibrated(tree: Tree, x: np.ndarray, top: int, recall: float) -> int:
    rng = np.random.Generator(np.random.PCG64(11))
    queries = rng.choice(len(x), min(300, len(x)), replace=False)
    leaf = tree.place(x)
    ranks = []
    for k in queries:
        s = x @ x[k]
        s[k] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(top, len(x) - 1)]
        at = {v: j for j, v in enumerate(tree.visit(x[k], tree.leaves))}
        ranks += [at[leaf[b]] for b in best]
    if not ranks:
        return tree.leaves
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _product(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same way."""
    return (rows * q).sum(axis=1)


def _best(q: np.ndarray, name: int, rows: np.ndarray, ids: list[np.ndarray], rough: np.ndarray, top: int) -> list[tuple[int, float]]:
    take = min(len(rows), top + 12)
    near = np.argpartition(-rough, take - 1)[:take]
    edge = rough[near].min()
    near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    found = [(-s, int(i)) for k, s in zip(near, _product(q, rows[near]).tolist(), strict=True) for i in ids[k][: top + 1] if i != name]
    return [(i, -s) for s, i in heapq.nsmallest(top, found)]


def _best_of_single(qs: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: np.ndarray, rough: np.ndarray, top: int) -> list[tuple[int, int, float]]:
    """The same for all queries at once where every vector has one id: (query, id, score)."""
    take = min(len(rows), top + 12)
    near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
    edge = np.take_along_axis(rough, near, axis=1).min(axis=1)
    # where products at the edge tie, all of them are looked at
    crowded = (rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]).sum(axis=1) > take
    out = []
    for k in np.flatnonzero(crowded).tolist():
        out += [(int(names[k]), i, s) for i, s in _best(qs[k], names[k], rows, [ids[j : j + 1] for j in range(len(ids))], rough[k], top)]
    qs, names, near = qs[~crowded], names[~crowded], near[~crowded]
    score = (rows[near] * qs[:, None, :]).sum(axis=2)
    own = ids[near]
    score[own == names[:, None]] = -np.inf
    order = np.lexsort((own, -score), axis=1)[:, :top]
    score, own = np.take_along_axis(score, order, axis=1), np.take_along_axis(own, order, axis=1)
    k, j = np.nonzero(np.isfinite(score))
    return out + list(zip(names[k].tolist(), own[k, j].tolist(), score[k, j].tolist(), strict=True))


def _lowest(rows: DataFrame, most: int) -> DataFrame:
    """``v`` of at most ``most`` rows, those of the smallest hash of their id (of repeated ids any)."""
    hashed = rows.select("v", F.xxhash64("id").alias("h"))
    lowest = hashed.select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    return hashed.where(F.lit(False) if lowest is None else F.col("h") <= F.lit(lowest)).select("v").limit(most)


def _index(rows: DataFrame, tree, length: int) -> DataFrame:
    """``leaf, id, v, asks``: every row with its leaf; vectors of another length have leaf ``-length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().to_numpy()
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype("f8"), np.cumsum(sizes)
            leaf = -sizes.astype("i4")
            at = np.flatnonzero(sizes == length)
            if len(at):
                leaf[at] = tree.value.place(flat[(ends[at] - length)[:, None] + np.arange(length)])
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            yield pa.RecordBatch.from_pydict(
                {
                    "leaf": pa.array(leaf, pa.int32()),
                    "id": batch.column(0),
                    "v": pa.array([bytes(raw[8 * (e - n) : 8 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                    "asks": batch.column(2),
                }
            )

    return rows.mapInArrow(run, "leaf int, id long, v binary, asks boolean")


def _subtrees(indexed: DataFrame, crowded: dict[int, int]) -> dict[int, Tree]:
    """A tree for each crowded leaf, fitted on at most about ``SAMPLE`` of its rows."""
    sizes = indexed.sparkSession.createDataFrame(sorted(crowded.items()), "leaf int, n long")
    own = indexed.join(F.broadcast(sizes), "leaf").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < F.lit(1e6 * SAMPLE) / F.col("n"))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        x = np.unique(np.stack([np.frombuffer(v, "f8") for v in table["v"].to_pylist()[: 2 * SAMPLE]]), axis=0)
        rows = table["n"][0].as_py()
        most = max(BRANCH, int(LEAF_ROWS / 4 * len(table) / rows))
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(Tree(x, most))], pa.binary())})

    found = own.select("leaf", "v", "n").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary")
    return {r.leaf: pickle.loads(bytes(r.tree)) for r in found.collect()}  # centres of at most LEAVES leaves


def search(df: DataFrame, queries: Column, top: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest rows found of each row in ``queries``."""
    spark = df.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    sample = [np.asarray(r.v, "f8") for r in _lowest(rows, SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], kind)
    length = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.unique(np.stack([v for v in sample if len(v) == length]), axis=0)
    tree = Tree(x)
    shared = spark.sparkContext.broadcast(tree)
    indexed = materialize(_index(rows, shared, length), "indexed")
    while True:
        sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row for each leaf of the tree
        crowded = {k: n for k, n in sizes.items() if k >= 0 and n > LEAF_ROWS}
        before = tree.leaves
        if not crowded or before + sum(4 * n // LEAF_ROWS for n in crowded.values()) > LEAVES:
            break
        tree.grafted(_subtrees(indexed, crowded))
        if tree.leaves == before:  # copies of one vector cannot be split; their leaf is many blocks
            break
        shared = spark.sparkContext.broadcast(tree)
        again = materialize(_index(rows, shared, length), "indexed")
        discard(indexed)
        indexed = again
    most = _calibrated(tree, x, top, recall)
    blocks = {k: max(1, -(-n // BLOCK)) for k, n in sizes.items()}
    of_leaf = spark.createDataFrame([(k, n) for k, n in sorted(blocks.items())] or [(0, 1)], "leaf int, blocks int")
    members = indexed.join(F.broadcast(of_leaf), "leaf").select(
        "leaf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"), "id", "v"
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leaves = shared.value.visit(np.frombuffer(v, "f8"), most) if len(v) == 8 * length else [-len(v) // 8]
                yield pa.RecordBatch.from_pydict(
                    {"leaf": pa.array(leaves, pa.int32()), "id": pa.array([i] * len(leaves), pa.int64()), "v": pa.array([v] * len(leaves), pa.binary())}
                )

    asked = (
        indexed.where("asks")
        .select("id", "v")
        .mapInArrow(walk, "leaf int, id long, v binary")
        .join(F.broadcast(of_leaf), "leaf")
        .select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, waiting = None, [], []
        unique = ids = None

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal unique, ids
            if members and waiting:
                if unique is None:
                    by: dict[bytes, list[int]] = {}
                    for i, v in members:
                        by.setdefault(v, []).append(i)
                    unique = np.stack([np.frombuffer(v, "f8") for v in by])
                    ids = [np.array(heapq.nsmallest(top + 1, i), "i8") for i in by.values()]
                qs = np.stack([np.frombuffer(v, "f8") for _, v in waiting])
                rough = qs @ unique.T
                if all(len(i) == 1 for i in ids):
                    out = _best_of_single(qs, np.array([n for n, _ in waiting], "i8"), unique, np.concatenate(ids), rough, top)
                else:
                    out = [(n, i, s) for k, (n, _) in enumerate(waiting) for i, s in _best(qs[k], n, unique, ids, rough[k], top)]
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c)})
            waiting.clear()

        for batch in batches:
            for leaf, block, side, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leaf, block) != key:
                    yield from answered()
                    key, members, unique = (leaf, block), [], None
                (waiting if side else members).append((i, v))
                if len(waiting) >= 256:
                    yield from answered()
        yield from answered()

    parts = max(8, min(len(blocks) * max(blocks.values(), default=1), 4 * spark.sparkContext.defaultParallelism))
    found = (
        members.unionByName(asked)
        .repartition(parts, "leaf", "block")
        .sortWithinPartitions("leaf", "block", "side")
        .mapInArrow(compare, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
